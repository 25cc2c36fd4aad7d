"""From raw documents to token shards: a pipeline of stages over the documents table.

Every stage takes (spark, docs, sf_dir); run() writes each stage's rows as Parquet to the shared folder and gives them
to the next one. Thresholds of the filters are the operators' production parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import tokens, toxicity
from corvane.llm.common import WORD, cut, n_words, table
from corvane.llm.decontam import decontaminate
from corvane.llm.mixing import cut_points, random_key
from corvane.llm.neardup import near_duplicates
from corvane.llm.queries import mix_targets, tokenizer_path


#: Columns of documents that stages read.
READ = ("doc_id", "text", "source", "n_chars")


def keeps_columns(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """All other columns pass the stage under names of their own, so that none meets what its operator adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"__kept{i}" for i, c in enumerate(docs.columns) if c not in READ}
        return stage(spark, docs.withColumnsRenamed(names), sf_dir).withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)

    return run


@keeps_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay; the model learns from the labels of documents that are in docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, least=0.5).select(*docs.columns)


@keeps_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays (five-word shingles, similarity 0.8), the one of the
    smallest doc_id. Rows that share a doc_id are documents of their own where their texts differ: the one of the least
    hash goes by the doc_id, the others by a large number made of both. Of rows of equal ids and texts the first by
    their other columns stays. Rows with a null doc_id stay."""
    named = docs.where("doc_id is not null")
    mark = F.xxhash64("text")
    repeated = cut(named.groupBy("doc_id").agg(F.count("*").alias("__n"), F.min(mark).alias("__first")).where("__n > 1"), "repeated")
    first = F.col("__first").isNull() | (mark == F.col("__first"))
    other = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(1)), 2) + F.lit(1 << 62)
    keyed = named.join(repeated, "doc_id", "left").withColumn("__key", F.when(first, F.col("doc_id").cast("long")).otherwise(other))
    kept = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__key")).distinct()
    once = keyed.where("__n is null").join(kept, "__key", "left_semi")
    twins = Window.partitionBy("__key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], F.col("text"))
    rest = keyed.where("__n is not null").join(kept, "__key", "left_semi").withColumn("__n", F.row_number().over(twins)).where("__n = 1")
    return once.unionByName(rest, allowMissingColumns=True).select(*docs.columns).unionByName(docs.where("doc_id is null"))


@keeps_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@keeps_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document comes once for each epoch of its source and once more if it stands before the cut of
    the last one; one at the cut comes with as many of its first words as the budget still takes. Documents without
    words or source budget don't come. Columns are those of docs. Ids and sizes alone are sorted; the rows meet one row
    of their source."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    points = cut_points(sized, mix_targets(sized, F.col("size")))
    points = cut(points.select(F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("epochs", "key", "doc_id", "share")]), "points")
    rows = docs.join(points, F.col("source").eqNullSafe(F.col("__source")))
    here = F.struct(F.coalesce(random_key(F.col("doc_id"), 7), F.lit("")).alias("k"), F.col("doc_id").alias("d"))
    there = F.struct(F.col("__key").alias("k"), F.col("__doc_id").alias("d"))
    # shares of the text: whole for each epoch, and what the last one takes
    last = F.when(F.col("__key").isNull() | (here > there), 0.0).when(here < there, 1.0).otherwise(F.col("__share"))
    shares = F.concat(F.array_repeat(F.lit(1.0), F.col("__epochs").cast("int")), F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<double>")))
    rows = rows.where(F.col("text").rlike(WORD)).withColumn("__share", F.explode(shares))
    n = F.floor(F.col("__share") * n_words(F.col("text")) + 1e-6).cast("int")
    cut_text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), 1, n), "")
    rows = rows.withColumn("text", F.when(F.col("__share") < 1, cut_text).otherwise(F.col("text"))).where("text <> ''")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all rows in the shared folder; returns what reading them back gives for each row. Rows with a
    null doc_id have no key in a shard: they end here."""
    return tokens.read_shards(tokens.write_shards(docs.select("doc_id", "text"), tokenizer_path())).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The trained and hashed stages can't be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
