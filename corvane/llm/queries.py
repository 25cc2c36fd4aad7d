"""The registered queries over the corpus tables: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import html
from . import license as licences
from . import pii, secrets, tokens, toxicity
from .common import cut, n_words, table
from .decontam import contaminated
from .mixing import allocate, take
from .lexical import search
from .neardup import near_duplicates
from .spelling import spelling_groups, words_of
from .substrings import repeated_spans
from .topk import quantized, top_k


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = secrets.joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"), F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mix_targets(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """Sources by code point, null last, weigh 5, 2, 1, repeating. size: of a document, its text's words if not given."""
    size = n_words(F.col("text")) if size is None else size
    sources = cut(docs.groupBy("source").agg(F.sum(size).alias("source_size")), "sources")  # read for every step of the shares
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3
    return allocate(sources.withColumn("weight", F.when(place == 0, 5.0).when(place == 1, 2.0).otherwise(1.0)))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words")), "words")
    mixed = take(docs, mix_targets(docs, F.col("words")), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.find(docs, licences.fit(docs))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corvane")
    count = lambda *kinds: F.size(F.filter("pii", lambda s: s["kind"].isin(*kinds))).cast("long")
    return docs.select("doc_id", F.size("pii").cast("long").alias("n_pii"), count("email").alias("n_email"), count("phone").alias("n_phone"), count("card").alias("n_card"), count("ipv4").alias("n_ipv4"), count(*pii.DATES).alias("n_date"), "pii", "text")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(words_of(table(spark, sf_dir, "documents"), least=7, occurrences=2, drop_every=31), ratio=10)


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from d group by source),
r as (select *, 2.0::double * source_size / weight as bound, sum(source_size) over () as total from s),
c as (select *, sum(2.0::double * source_size) over (order by bound, source nulls last) as capped, sum(weight) over () - sum(weight) over (order by bound, source nulls last) as open from r),
l as (select max(level) as level from (
  select (1.5::double * total - capped) / open as level, lead(bound) over (order by bound, source nulls last) as next, bound from c where open > 0
  union all select 1.5::double * max(total) / sum(weight), min(bound), 0 from c) where level <= next + 1e-9 and level >= bound - 1e-9),
t as (select source, source_size, least(2.0::double * source_size, weight * level) as target from r, l),
p as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target) as goal,
  coalesce(sum(d.size) over (partition by d.source order by md5('7:' || d.doc_id), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (case when source_size > 0 then floor(goal / source_size) * size + greatest(0, least(size, goal - floor(goal / source_size) * source_size - before)) else 0 end)::bigint as taken from p
"""


OP11_SQL = """
with t as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, p, md5(substr(h, 2 * p + 1, 800)) as k from (select r, h, unnest(range(greatest(0, length(h) // 2 - 399))) as p from t)),
d as (select r, p from (select r, p, count(*) over (partition by k) as n from w) where n > 1),
g as (select r, p, case when p - lag(p) over (partition by r order by p) <= 400 then 0 else 1 end as first from d),
i as (select r, p, sum(first) over (partition by r order by p) as run from g),
s as (select r, min(p) as a, max(p) + 400 as z from i group by r, run),
e as (select r, a, z, lag(z, 1, 0) over (partition by r order by a) as before from s),
k as (select t.r, count(e.a) as n_spans, coalesce(sum(e.z - e.a), 0) as n_removed, coalesce(string_agg(substr(t.h, 2 * e.before + 1, 2 * (e.a - e.before)), '' order by e.a), '') as parts, coalesce(max(e.z), 0) as rest from t left join e using (r) group by t.r)
select doc_id, (length(h) // 2)::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(parts || substr(h, 2 * rest + 1))) as kept_sha256 from t join k using (r)
"""

OP13_SQL = r"""
with w as (select doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select doc_id, text, row_number() over () as r from documents)),
d as (select r, any_value(doc_id) as doc_id, count(*) as n from w group by r),
c as (select count(*) as all_docs, sum(n)::bigint as all_terms from d),
p as (select r, term, count(*) as tf from w group by r, term),
f as (select term, floor(1000 * ln((2 * any_value(all_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select q.item_id, p.r, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * d.n * c.all_docs) // c.all_terms))))::bigint as score from q join f using (term) join p using (term) join d using (r), c group by q.item_id, p.r),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s join d using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_secret_scans, op3_html_extraction, op4_benchmark_decontamination, op5_license_scans, op6_mixing_sources, op7_token_id_output, op8_exact_top_k, op9_toxicity, op10_pii, op11_suffix_array_dedup, op12_spelling_variants, op13_ranked_lexical_search)}
ORACLE_SQL: dict[str, str] = {"op6_mixing_sources": OP6_SQL, "op8_exact_top_k": OP8_SQL, "op11_suffix_array_dedup": OP11_SQL, "op13_ranked_lexical_search": OP13_SQL}
