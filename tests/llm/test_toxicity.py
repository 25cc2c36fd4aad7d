"""Toxicity: segments against brute force, linear time, held-out accuracy, edge cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, toxicity

DOCS = "doc_id long, text string"


def brute_segments(x, a, b):
    """Ruzzo and Tompa's definition: the best segment (the shortest of equal ones), then the same on either side of it."""
    best = max(((sum(x[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
    if best[0] <= 0:
        return []
    s, _, i, j = best
    return [*brute_segments(x, a, i), (s, i, j - 1), *brute_segments(x, j, b)]


def test_all_maximal_segments_equal_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        x = [rng.choice((rng.uniform(-2, 0), rng.uniform(0, 2), -0.5)) for _ in range(rng.randrange(1, 30))]
        got, want = toxicity.maximal_segments(x), brute_segments(x, 0, len(x))
        assert [g[1:] for g in got] == [w[1:] for w in want]
        assert [g[0] for g in got] == pytest.approx([w[0] for w in want])


@pytest.mark.parametrize("part", [[1.0, -2.0], [1.0, -0.5], [1.0, -1.0], [2.0, -3.0, 1.0, -0.2]])
def test_segments_take_linear_time(part):
    def took(n):
        began = time.process_time()
        toxicity.maximal_segments(part * n)
        return time.process_time() - began

    took(10_000)
    assert took(200_000) < 0.3 + 4 * took(100_000)


def test_nested_segments_take_linear_time():
    x = [w for i in range(100_000) for w in (1.0, -1.0 - (i % 7) / 8)]
    began = time.process_time()
    assert toxicity.maximal_segments(x) and time.process_time() - began < 5


def test_words_take_odds_from_their_stems():
    words = [(f"vile{c}", 8, 8) for c in "abcdefghijkl"] + [("losing", 0, 9), ("losers", 30, 30), ("lost", 0, 50)]
    by = {}
    for w in words:
        by.setdefault(w[0][:4], []).append(w)
    known = {k: v for own in by.values() for k, v in toxicity.known_odds(own, 0.1, 10.0, 0.4).items()}
    scan = toxicity.Scanner(known, 0.0)
    assert scan.weight("vilexyz") > 1.5 and scan.weight("vilea") > 2 and scan.weight("losers") > 2
    assert scan.weight("losexy") < 1 and scan.weight("other") == 0 and scan.weight("lost") < -1


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = queries.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    high, low = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in high for b in low) / len(high) / len(low)
    right = sum(r.predicted == r.toxic for r in rows)
    assert area > 0.9 and right / len(rows) > 0.95 > max(len(high), len(low)) / len(rows)


def test_edge_cases(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{'abcdefgh'[rng.randrange(8)]}{'xyzuv'[rng.randrange(5)]}" for _ in range(n))
    docs = [(i, say(40) + (" vile nasty awful" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(1, 0), (1, 0), (2, 1), (2, 0), (3, None), (None, 1), (4, 7)]
    df = spark.createDataFrame(docs, DOCS).withColumn("passages", F.lit("clash"))
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = "İİ fine words İ then vile nasty awful ones"
    more = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 --"), (4, text), (4, text), (None, "vile nasty awful"), (5, say(200_000) + " vile nasty awful")], DOCS)
    rows = toxicity.score(more, model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and got[1].toxicity == got[2].toxicity == got[3].toxicity < 0.5 and got[1].n_tokens == got[3].n_tokens == 0
    hit = [text[p.start : p.end] for p in got[4].passages]
    assert hit == ["vile nasty awful"] and got[None].toxicity > 0.5 and got[5].passages
    assert toxicity.score(more, model, least=0.5).count() == sum(r.toxicity < 0.5 for r in rows)
    one = toxicity.fit(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert all(r.toxicity == pytest.approx(0.75) for r in toxicity.score(more, one).collect())
