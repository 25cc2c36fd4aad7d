"""Substring removal, spelling variants and ranked search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corvane.llm import lexical, spelling, substrings

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def plain_repeats(texts, length):
    """Spans of each text, and the kept bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                hit[p : p + length] = [True] * length
        spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if h else "." for h in hit))]
        out.append((spans, bytes(b for b, h in zip(d, hit) if not h)))
    return out


def found_repeats(spark, rows, length, **more):
    got = substrings.repeated_spans(spark.createDataFrame(rows, DOCS), length, **more).collect()
    return sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in got)


def expected_repeats(rows, length):
    plain = plain_repeats([r[1] for r in rows], length)
    return sorted((str(d), len((t or "").encode()), spans, hashlib.sha256(kept).hexdigest()) for (d, t), (spans, kept) in zip(rows, plain, strict=True))


def mixed_texts(seed: int = 5):
    """Copies with edits, shared passages inside other texts, periodic texts, texts within texts, wide characters."""
    import random

    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢 ") for _ in range(r.randint(1, 9)))
    base = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = list(enumerate(base))
    for i in range(60):
        t = r.choice(base)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "x", "yz"]) + t[at + r.randint(0, 2) :]
        a, b = sorted((r.randrange(len(t)), r.randrange(len(t))))
        rows.append((100 + i, r.choice([t, t[a:b], word() + t[a:b] + word(), t[a:b] + t[a:b]])))
    return [*rows, (300, "ab" * 90), (301, "a" * 70), (302, "a" * 39), (303, "a" * 41), (304, None), (None, ""), (None, base[0]), (305, base[1]), (305, base[1]), (306, "ab" * 30 + "c")]


@pytest.mark.parametrize(("length", "gram"), [(40, None), (40, 3), (7, None), (1, None)])
def test_repeats_against_all_substrings(spark, length, gram):
    rows = mixed_texts()
    assert found_repeats(spark, rows, length, gram=gram) == expected_repeats(rows, length)


def test_repeats_across_segments(spark):
    import random

    r = random.Random(3)
    long = "".join(r.choice("abcdefgh") for _ in range(70_000))
    rows = [(1, long), (2, "x" + long[32_000:34_000] + "y"), (3, long[65_000:66_000] + long[100:600]), (4, "z" * 500)]
    assert found_repeats(spark, rows, 400) == expected_repeats(rows, 400)


def test_repeats_of_empty_and_one(spark):
    assert found_repeats(spark, [], 40) == []
    assert found_repeats(spark, [(1, None)], 40) == [("1", 0, [], substrings.EMPTY_SHA)]


def test_many_copies_with_common_passages(spark):
    """A third of the rows share a passage, many with other words around it; exact copies beside them."""
    passage = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"{i * 7919} begins {passage} ends {i * 104729}") for i in range(600)] + [(1000 + i, f"copy of {passage} and more") for i in range(300)] + [(2000 + i, f"{i} {i * i} alone {i ** 3}" * 2) for i in range(300)]
    assert found_repeats(spark, rows, 60) == expected_repeats(rows, 60)


def test_rows_of_a_large_group_stay_apart(spark):
    """Rows of one key, most of all, and of null keys: as a plain join, but in no one task."""
    rows = spark.range(0, 20_000, numPartitions=8).select("id", F.when(F.col("id") % 10 > 0, 7).when(F.col("id") % 100 > 0, F.col("id") % 3000).alias("c"))
    groups = rows.where("c % 3 = 1").groupBy("c").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    in_tasks = lambda df: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n"), F.max("first")).collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the groups were many
    try:
        for how in ("left", "inner"):
            got, plain = substrings._joined(rows, groups, ["c"], 20_000, how), rows.join(groups.drop("size"), "c", how)
            assert sorted(got.select("id", "c", "first").collect(), key=str) == sorted(plain.select("id", "c", "first").collect(), key=str)
            assert max(in_tasks(plain)) >= 18_000
            assert max(in_tasks(got)) < 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_without_repeats_keeps_rows_and_columns(spark):
    rows = [(1, "0123456789abcdefghij", "k"), (2, "x0123456789abcdefghijy", "k2"), (3, None, None), (4, "same same same same!", "a"), (4, "same same same same!", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(((r.doc_id, bytes(r.kept)) for r in substrings.without_repeats(docs, 20).collect()), key=str)
    assert got == [(1, b""), (2, b"xy"), (3, b""), (4, b""), (4, b"")]


def test_op11_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = sorted(map(tuple, db.execute(__spark_entry__.oracle_sql()["op11_suffix_array_dedup"]).fetchall()))
    assert sorted(map(tuple, __spark_entry__.queries()["op11_suffix_array_dedup"](spark, SF).collect())) == expected
    assert sum(r[2] for r in expected) > 0


def plain_words(rows, every, least=7, occurrences=2):
    words = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= occurrences}


def plain_groups(words, ratio=10):
    spots = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            spots[w[:i] + "\0" + w[i:]].add(w)
            if i < len(w):
                spots[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for own in spots.values():
        for w in own:
            near[w] |= own - {w}
    near = {w: {v for v in vs if abs(len(v) - len(w)) <= 1} for w, vs in near.items()}
    form = {}
    for w in words:
        best = min(near.get(w, ()), key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), words[w], len(near.get(w, ())), words[form[w]] if form[w] else -1) for w in words)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_op12_against_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_groups(plain_words(docs, 31))
    got = __spark_entry__.queries()["op12_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == expected
    assert sum(bool(r[1]) for r in expected) > 50


def test_words_of_edge_texts(spark):
    rows = [(None, "Straße straÉe straße"), (1, None), (2, ""), (3, "abcdefg ABCDEFG漢abcdefg×abcdefg"), (3, "abcdefg"), (4, "a" * 5000 + " " + "a" * 5000)]
    got = {r.word: r.n for r in spelling.words_of(spark.createDataFrame(rows, DOCS), 6, 1, 3).collect()}
    assert got == plain_words(rows, 3, 6, 1)
    assert spelling.words_of(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghij"])
def test_near_words_of_dense_words(spark, alphabet):
    """Short words of few letters: every gram is frequent, all words have many near ones."""
    import random

    r = random.Random(1)
    words = {"".join(r.choice(alphabet) for _ in range(r.randint(2, 9))): r.choice([2, 3, 25, 300, 4000]) for _ in range(1500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.spelling_groups(df)) == plain_groups(words)


def test_chains_of_forms_and_equal_counts(spark):
    words = {"abcdefgh": 100_000, "abcdefghi": 10_000, "abcdefghij": 1000, "abcdefghijk": 100, "abcdefghijkl": 10, "zzzzzzz": 20, "zzzzzzy": 200, "zzzzzzx": 200, "a": 5, "ab": 50}
    df = spark.createDataFrame([*words.items(), (None, 4)], "word string, n long")
    got = {r[0]: r for r in rows_of(spelling.spelling_groups(df))}
    assert got["abcdefghijkl"][1:3] == ("abcdefghijk", "abcdefgh")
    assert got["zzzzzzz"][1] == "zzzzzzx"
    assert got["a"][1] == ""
    assert set(got) == set(words)


def plain_search(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for d, c, n in counts:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if nul else d, -s) for r, (s, nul, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [{}, {"per_bundle": 40}, {"most_items": 2}, {"owners": 1}, {"owners": 9}])
def test_search_against_plain_version(spark, many):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "a of the B"), (None, None), (7, "the the the, of-a"), (7, "the the the, of-a"), (9, "été 漢字 THE")] + [(5000 + i, "equal texts the of") for i in range(40)]
    items = [(1, "The of, a thing"), (1, "of THE été"), (None, "漢字 the"), (2, None), (3, "no-such-term-at-all"), (4, docs[0][1]), (5, docs[3][1])]
    df = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string").withColumn("score", F.lit("clash"))
    got = lexical.search(df(docs, "doc_id"), df(items, "item_id"), **many).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    none = lambda c: spark.createDataFrame([], f"{c} long, text string")
    some = lambda c: spark.createDataFrame([(1, "words here")], f"{c} long, text string")
    assert lexical.search(none("doc_id"), some("item_id")).count() == 0
    assert lexical.search(some("doc_id"), none("item_id")).count() == 0


def test_op13_against_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = sorted(map(tuple, db.execute(__spark_entry__.oracle_sql()["op13_ranked_lexical_search"]).fetchall()))
    assert sorted(map(tuple, __spark_entry__.queries()["op13_ranked_lexical_search"](spark, SF).collect())) == expected
