import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from corvane.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    base = [say(60) for _ in range(80)]
    texts = [(i, base[i % 80] if i % 4 == 0 else say(60)) for i in range(300)]
    texts = [(i, t + " vile nasty awful vile" if i % 10 == 1 else t) for i, t in texts]
    leak = say(25)
    texts += [(400, say(20) + " " + leak + " " + say(20)), (401, None), (402, "")]
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"s{i % 3}" if i != 401 else None, len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 1)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        was, docs = docs, pipeline.cut(stage(spark, docs, folder), name)
        if name != "token_output":
            assert docs.columns == was.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        before = {r.doc_id for r in was.select("doc_id").collect()}
        if name == "toxicity":
            assert sum(i in ids for i in range(1, 300, 10)) <= 2 and len(before - ids) <= 32
        elif name == "near_dedup":
            assert ids == {r.doc_id for r in near_duplicates(was).where("kept").collect()} and {0, 80, 160, 240} & ids == {0}
        elif name == "decontamination":
            assert before - ids == {400}
        elif name == "mixing":
            assert docs.count() > was.count()
        else:
            assert docs.count() == was.count() and docs.agg(F.min("start")).first()[0] == 0


def test_run_equals_stages_and_survives_an_empty_table(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0


def test_columns_of_clashing_names_pass_every_stage(spark, folder):
    """Columns that operators add under the same names keep the documents' own values."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["toxicity", "n_tokens", "passages", "component_id", "kept", "size", "taken", "segments", "features", "__key", "__n"]
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut(stage(spark, docs, folder), name)
        assert docs.columns == [*SCHEMA.replace(",", "").split()[::2], *names]
        wrong = docs.where(" or ".join(f"`{c}` <> concat('{c}:', doc_id)" for c in names))
        assert docs.count() > 0 and wrong.count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
