"""Queries against plain versions on the smallest tables, and edge cases of the operators: repeated rows, very long
texts, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from corvane.llm import decontam, pii, queries, secrets, tokens
from corvane.llm import license as licences
from corvane.llm.mixing import take
from corvane.llm.neardup import near_duplicates
from corvane.llm.topk import top_k

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_secret_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.op2_secret_scans(spark, SF).collect():
        t = texts[r.doc_id]
        found = {"assign": [m.span() for m in assign.finditer(t) if len(m.group(2)) >= 6], "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20], "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found.values()))
        order = sorted((s, k, e) for k, name in enumerate(found) for s, e in found[name])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{list(found)[k]}:{s}:{e}" for s, k, e in order).encode()).hexdigest()
        assert set(f"{list(found)[k]}:{s}:{e}" for s, k, e in order) <= set(r.spans.split(",") if r.spans else [])


def test_secrets_of_repeated_and_long_rows(spark):
    long = "plain " * 100_000 + "token=abcdefgh"
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, "token=abcdefgh"), (2, long)], DOCS).withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    got = sorted(((r.doc_id or 0, [tuple(s) for s in r.spans]) for r in secrets.scan(df).collect()), key=lambda x: x[0])
    assert [g[1] for g in got] == [[(0, 0, 14)]] * 3 + [[(600_000, 0, 600_014)]]


def test_token_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got, at = {r.doc_id: r for r in queries.op7_token_id_output(spark, SF).collect()}, 0
    for i, t in texts:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_shards_of_repeated_ids_and_long_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = [(5, words(rng, 30)) for _ in range(200)] + [(6, words(rng, 150_000)), (7, None)]
    df = spark.createDataFrame(texts, DOCS).withColumn("shard", F.lit("clash")).withColumn("start", F.lit(-1))
    manifest = tokens.write_shards(df, queries.tokenizer_path(), docs_per_shard=20)
    assert manifest.count() >= 5  # one doc_id of many rows isn't one shard
    rows = sorted(tokens.read_shards(manifest).collect(), key=lambda r: r.start)
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert [r.doc_id for r in rows] == [5] * 200 + [6, 7] and sorted(r.ids_crc32 for r in rows) == sorted(crc(t) for _, t in texts)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a b": 1, "\n": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Split("|", "isolated")
    tok.save(str(tmp_path / "t.json"))
    enc = tokens.Encoder(str(tmp_path / "t.json"), b"\0\0\0\0")
    assert not enc.splits
    assert np.frombuffer(enc.encode(["a b|a b"])[0], "<u4").tolist() == [*tok.encode("a b|a b").ids, 0]


def test_pieces_met_lately_stay_known_when_others_are_forgotten():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, enc, learned = Tokenizer.from_file(path), tokens.Encoder(path, b"\0\0\0\0", limit=20, stem_limit=0), []
    learn = enc._learn
    enc._learn = lambda words: (learned.extend(words), learn(words))[1]
    one = " ".join(f"word{a}{b}," for a in "abcdef" for b in "ghijk")
    odd = ["x\ty z", "don't  stop", "\u00a0a b\u00a0 c", "a\u2003b\n\n c.\r", "'tis o'x ... !a \u0301b", one + "\n" + one, None, "\n", " "]
    for texts in ([one], odd, [one], odd, ["new words", one], odd):
        assert enc.encode(texts) == [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    learned.clear()
    enc.encode([one])
    assert not learned


def test_top_k_of_lengths_repeats_and_few_rows(spark):
    rng = random.Random(3)
    rows = [(i % 90, [rng.randrange(-50, 50) for _ in range(4 if i % 3 else 6)]) for i in range(150)] + [(7, []), (None, [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("floor", F.lit("clash")).withColumn("rank", F.lit(0))
    got = {}
    for r in top_k(df, df.where("vec_id % 20 = 0"), k=5, block=30, query_block=4, step=8, sample=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    asks = {}
    for q, x in rows:
        if q is not None and q % 20 == 0:
            asks.setdefault(q, []).append(x)
    for q, xs in asks.items():
        if len(xs) == 1:
            best = sorted((-sum(a * b for a, b in zip(xs[0], v, strict=True)), i) for i, v in rows if i is not None and i != q and len(v) == len(xs[0]))[:5]
            assert [(-s, i) for _, s, i in sorted(got[q])] == best


def test_pseudonyms_of_edge_cases(spark):
    numbers = [f"{a:03d}-{b:02d}-{c:04d}" for a in range(100, 900, 40) for b in (1, 50, 99) for c in (1, 777, 9999) if a != 666]
    df = spark.createDataFrame([(i, f"no {n}") for i, n in enumerate(numbers)] + [(1000, "no 123-45-6789"), (1000, "no 123-45-6789"), (None, None), (1001, ""), (1002, "x " * 200_000 + "123-45-6789")], DOCS).withColumn("__hits", F.lit("clash"))
    rows = pii.pseudonymize(df.drop("__hits"), "key").collect()
    new = [s.value for r in rows if r.doc_id is not None and r.doc_id < 900 for s in r.pii]
    assert len(new) == len(set(new)) == len(numbers) and not any(re.search("^(000|666|9)|-00-|-0000$", n) for n in new)
    twice = {r.text for r in rows if r.doc_id == 1000}
    assert len(twice) == 1 and twice.pop().split()[1] == next(r.text for r in rows if r.doc_id == 1002).split()[-1]
    assert pii.pseudonymize(spark.createDataFrame([], DOCS), "key").count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_places_of_many_finds_in_one_text(spark, n):
    rng = random.Random(n)
    parts = [(rng.choice(["é ", "𝄞 at ", "", "no "]) + " ", rng.choice(["ann@example.org", "123-45-6789", "10.1.2.3"])) for _ in range(n)]
    text, want = "", []
    for before, value in parts:
        text += before
        want.append((len(text), value))
        text += value + " ;"
    row = pii.pseudonymize(spark.createDataFrame([(1, text)], DOCS), "key").first()
    assert [s.start for s in row.pii] == [at for at, _ in want]
    assert [s.kind for s in row.pii] == [{"a": "email", "1": "ssn"}.get(v[0]) if v != "10.1.2.3" else "ipv4" for _, v in want]


def test_pii_query_finds_what_plain_patterns_find(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    mail = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    for r in queries.op10_pii(spark, SF).collect():
        t = texts[r.doc_id]
        assert r.n_email == len(mail.findall(t))
        out, at = [], 0
        for s in r.pii:  # each find stands where it says, and all else of the text stays
            out += [t[at : s.start], s.value]
            at = s.start + len(s.value)
        if all(len(s.value) for s in r.pii) and not any(s.kind == "ipv4" for s in r.pii):
            assert "".join([*out, t[at:]]) == (r.text or "")


def test_licences_of_edge_cases(spark):
    model = licences.fit(spark.createDataFrame([], DOCS))
    assert licences.find(spark.createDataFrame([], DOCS), model).count() == 0
    rng = random.Random(2)
    plain = [(i, "\n".join(words(rng, 25) for _ in range(3))) for i in range(300)] + [(None, words(rng, 20))] * 3
    model = licences.fit(spark.createDataFrame(plain, DOCS), max_paragraphs=400)
    mit = "Released under the MIT License."
    rows = [(1, mit), (1, mit), (None, mit), (2, words(rng, 100_000) + "\n" + mit), (3, "The licensed premises renew their liquor licence each year."), (4, "This work is licensed under the Sybase Open Watcom Public License version 1.0")]
    got = licences.find(spark.createDataFrame(rows, DOCS).withColumn("family", F.lit("clash")), model).collect()
    found = [(r.doc_id, r.paragraph) for r in got if r.family == "mit" and r.confirmed]
    assert found.count((1, 0)) == 2 and found.count((None, 0)) == 1 and set(found) == {(1, 0), (None, 0), (2, 0)}  # a line without an end runs on
    assert {r.doc_id for r in got} == {1, None, 2, 3, 4}
    assert all(r.family == "unknown" and not r.confirmed for r in got if r.doc_id in (3, 4))
    assert all(r.confirmed == (r.family != "unknown") for r in got)


def test_decontamination_of_edge_cases(spark):
    rng = random.Random(4)
    item, docs = words(rng, 20), [(1, "x"), (1, None)]
    docs += [(2, item), (2, item), (2, "clean"), (3, words(rng, 100_000) + " " + item), (None, item)]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(9, item), (9, item)], "item_id long, text string")
    got = decontam.contaminated(df, bench)
    assert sorted((r.doc_id, r.distance) for r in got.collect()) == [(2, 0), (2, 0), (3, 0)]
    kept = decontam.decontaminate(df, bench, block_chars=100)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, item), (1, "x"), (2, "clean")]


def test_near_duplicates_lose_no_link_of_the_small_table(spark):
    from tests.llm.test_text_ops import brute_components

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    low, sizes = brute_components(texts, 2, 80)
    got = {r.doc_id: r for r in queries.op1_minhash_near_dedup(spark, d).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    linked = [i for i, m in low.items() if m != i]
    assert sum(got[i].component_id == low[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i].component_id == i for i, m in low.items() if m == i)


def test_large_like_groups_are_one_component(spark):
    rng = random.Random(6)
    base = words(rng, 80).split()
    texts = [(i, " ".join(w if rng.random() > 0.02 else f"x{i}" for w in base)) for i in range(400)] + [(1000 + i, words(rng, 60)) for i in range(200)]
    texts += [(2000 + i, "one two three four five six seven " + words(rng, 30)) for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(texts, DOCS), width=2, small=8).collect()}
    from tests.llm.test_text_ops import brute_components

    low, _ = brute_components(dict(texts), 2, 80)
    assert got == low


def test_pipeline_keeps_documents_that_share_an_id(spark):
    rng = random.Random(7)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(1, a, "en"), (1, a, "de"), (1, a, "de"), (1, b, "en"), (2, b, "en"), (3, c, "en"), (3, None, "en"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.text or "", r.lang) for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert {t for _, t, _ in got} == {a, b, c, ""} and len([g for g in got if g[1] == a]) == 2 and (1, a, "de") in got
    assert len([g for g in got if g[1] == b]) == 1


def test_pipeline_mix_equals_the_operator(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 50)), f"s{i % 4}" if i % 4 else None) for i in range(300)] + [(500, None, "s1"), (None, "a b c", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    want = {}
    for r in take(docs.withColumn("n", size), queries.mix_targets(docs), F.col("n")).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got = dict.fromkeys(want, 0)
    for r in pipeline.mix_sources(spark, docs, "").collect():
        got[r.doc_id] += len(r.text.split())
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_mix_of_one_repeated_id(spark, seed):
    rng = random.Random(seed)
    docs = spark.createDataFrame([(4, words(rng, 10), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    targets = {r.source: r.target for r in queries.mix_targets(docs).collect()}
    got = dict.fromkeys(targets, 0)
    for r in pipeline.mix_sources(spark, docs, "").collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - t) <= 0.1 * t for s, t in targets.items())


def test_top_k_of_very_many_equal_rows(spark):
    """Copies of one vector under one id part into blocks like any others; ties go to the smaller ids."""
    rows = [(7, [1, 2])] * 6000 + [(i, [1, 2]) for i in range(100, 140)] + [(40, [3, 1]), (60, [0, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = top_k(df, df.where("vec_id in (40, 60)"), k=5, block=500).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([(40, i + 1, 7, 5) for i in range(5)] + [(60, i + 1, 7, 2) for i in range(5)])
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(9)), F.lit(13))
    assert df.groupBy(deal.alias("b")).count().agg(F.max("count")).first()[0] < 700
