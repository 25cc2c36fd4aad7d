"""Toxic passages as maximum-scoring segments.

Every token is weighed by its log-odds between toxic and clean documents under an informative Dirichlet prior, less a
rent that makes the weights of ordinary text negative on average. A word's prior comes from the words that begin with
the same letters, each counting once, so inflected words that were never seen have log-odds too. One linear scan finds all maximal segments of a text
(Ruzzo and Tompa). lambda * score - log(length) is a segment's extreme-value figure: the larger, the fewer segments like
it chance brings. A logistic curve of the figures' sum is the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)  # lengths of the stems whose words give a word's prior
GRID = 20  # figures are fitted in steps of 1 / GRID


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]  # log-odds by word, and by stem with * for other words
    rent: float  # what a passage pays for each of its tokens
    lam: float
    curve: tuple[float, float]


def _counts(batches):
    """Documents that hold a word, by class and fold (toxic + 2 * fold), summed over each batch."""
    for b in batches:
        seen: list[Counter] = [Counter() for _ in range(4)]
        for text, cell in zip(b.column("text").to_pylist(), b.column("cell").to_pylist(), strict=True):
            seen[cell].update(set(_words(text or "")))
        rows = [(w[: STEMS[0]], w, k, n) for k, own in enumerate(seen) for w, n in own.items()]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["stem", "token", "cell", "n"])


def _words(text: str) -> list[str]:
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in TOKEN.findall(text)]


def known_odds(words: list[tuple[str, float, float]], share: float, prior: float, least: float) -> dict[str, float]:
    """Log-odds against `share` of the words of one stem of least length, (word, toxic documents, documents), and of
    its stems (with *). A stem's share of toxic words, each word counting as its own share, has the shorter stem's as
    prior; a word's has that of its longest stem without itself. What differs by less than `least` from what the rest
    tells isn't given."""
    stems: dict[str, list[float]] = {}
    for w, t, n in words:
        for k in STEMS:
            if len(w) >= k:
                own = stems.setdefault(w[:k], [0.0, 0])
                own[0] += t / n
                own[1] += 1

    def expected(word: str, without: float | None = None) -> float:
        p, last = share, 0
        for k in STEMS:
            if len(word) < k or word[:k] not in stems:
                break
            toxic, n = stems[word[:k]]
            if without is not None:
                toxic, n = toxic - without, n - 1
            if n != last and n > 0:  # else this stem has no other words than the last one
                p, last = (toxic + prior * p) / (n + prior), n
        return p

    base, out = math.log(share / (1 - share)), {}

    def told(word: str) -> float:
        return next((out[x] for k in reversed(STEMS) if len(word) > k and (x := word[:k] + "*") in out), 0.0)

    def tell(name: str, word: str, p: float) -> None:
        if abs((odds := math.log(p / (1 - p)) - base) - told(word)) >= least:
            out[name] = odds

    for x in sorted(stems, key=len):
        tell(x + "*", x, expected(x))
    for w, t, n in words:
        tell(w, w[: STEMS[-1]] + "*", (t + prior * expected(w, t / n)) / (n + prior))
    return out


def _odds(share: float, prior: float, least: float):
    """Words of a stem, side by side in sorted batches, to log-odds: of all documents, without fold 0, without fold 1."""

    def of(rows: list[tuple]) -> list[tuple]:
        each = [known_odds([(w, x[k], x[k + 1]) for w, *x in rows if x[k + 1]], share, prior, least) for k in (0, 2, 4)]
        return [(w, *[e.get(w) for e in each]) for w in sorted(set().union(*each))]

    def run(batches):
        stem, rows = None, []
        for b in batches:
            out = []
            for s, w, t, n, t0, n0 in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if s != stem:
                    out += of(rows)
                    stem, rows = s, []
                rows.append((w, t, n, t - t0, n - n0, t0, n0))
            yield _table(out)
        yield _table(of(rows))

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.float64()) for c in cols[1:]]], ["token", "odds0", "odds1", "odds2"])

    return run


def maximal_segments(weights: list[float]) -> list[tuple[float, int, int]]:
    """All maximal segments of positive score, as (score, first, last), in linear time: a candidate knows the nearest
    one before it whose left sum is smaller, and a search goes along these."""
    sums = list(accumulate(weights, initial=0.0))
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, the candidate known
    for i, w in enumerate(weights):
        if w <= 0:
            continue
        left, right, first, j = sums[i], sums[i + 1], i, len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, i, j))
                break
            left, _, first, _, before = found[j]
            del found[j:]
            j = before
    return [(right - left, first, last) for left, right, first, last, _ in found]


class Scanner:
    """Scores texts by a model's weights; remembers the weights of words, up to a number of them."""

    def __init__(self, weights: dict[str, float], rent: float):
        self.weights, self.rent, self.known = weights, rent, {}

    def weight(self, word: str) -> float:
        """Log-odds of the word or else of its longest stem that has some, 0 where nothing is known; less the rent."""
        if (w := self.known.get(word)) is None:
            if len(self.known) > 60_000:
                self.known.clear()
            own = self.weights
            odds = own[word] if word in own else next((own[x] for k in reversed(STEMS) if len(word) >= k and (x := word[:k] + "*") in own), 0.0)
            w = self.known[word] = odds - self.rent
        return w

    def tokens(self, text: str) -> list[float]:
        known, own = self.known, self.weight
        return [known[x] if x in known else own(x) for x in _words(text)]

    def segments(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens, and the maximal segments as (score, first, last token)."""
        weights = self.tokens(text)
        return len(weights), maximal_segments(weights) if weights and max(weights) > 0 else []


def figure(n: int, segments: list, lam: float) -> float:
    """Sum over a text's segments of log(1 + 1 / E), where E = n * exp(-lambda * score) is how many such segments chance
    brings in n tokens; 0 without segments."""
    return float(np.logaddexp(0.0, lam * np.array([s for s, _, _ in segments]) - math.log(n)).sum()) if segments else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(2), np.diag([1e-6, ridge])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * w @ keep @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w).clip(-35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n * (y - p)) - keep @ w)
        while loss(w + step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, prior: float = 10.0, rent: float = 1.0, least: float = 0.4) -> ToxicityModel:
    """Learns from docs (doc_id, text) joined to labels (doc_id, toxic 0 or 1; other values and nulls are left out).

    At most about max_rows labelled rows are used, chosen by a hash of doc_id: the documented bound of the sample, and
    with it of the model. The prior counts as `prior` documents. Words and stems whose log-odds are within `least` of
    what a shorter stem tells are left to it; all others are kept, of either sign. Scale and curve are fitted on scores
    by weights of the other half of the sample, so that words of the text itself don't count. Where one class is missing
    every text scores the rate of label 1. lambda is at most 10. A document with several labels counts once for each.
    """
    spark = docs.sparkSession
    small_batches(spark, 400)
    own = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("long").alias("toxic")).distinct()
    total = own.count()
    keep = int(1_000_000 * min(1.0, max_rows / max(total, 1)))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(1_000_000)) < keep  # on both sides: the rest isn't shuffled
    own = own.withColumn("doc_id", F.col("doc_id").cast("long")).where(drawn)
    if own.count() <= 2 * max_rows:  # checked: then texts aren't shuffled; beyond it the join picks its own way
        own = F.broadcast(own)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(drawn).join(own, "doc_id")
    rows = cut(rows.select("text", (F.col("toxic") + 2 * fold).cast("long").alias("cell")), "labelled")
    sizes = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    toxic, clean = (sum(sizes.get(k + 2 * f, 0) for f in (0, 1)) for k in (1, 0))
    share = (toxic + 0.5) / (toxic + clean + 1)
    if not toxic or not clean:
        return ToxicityModel({}, rent, 1.0, (math.log(share / (1 - share)), 0.0))

    n = lambda *cells: F.sum(F.when(F.col("cell").isin(*cells), F.col("n")).otherwise(0))
    # one shuffle, by stem; the words of a stem are at most those of the sample
    counts = rows.mapInArrow(_counts, "stem string, token string, cell long, n long").repartition("stem").groupBy("stem", "token").agg(n(1, 3).alias("t"), n(0, 1, 2, 3).alias("n"), n(1).alias("t0"), n(0, 1).alias("n0"))
    got = counts.sortWithinPartitions("stem", "token").mapInArrow(_odds(share, prior, least), "token string, odds0 double, odds1 double, odds2 double").toArrow()
    tokens = got.column("token").to_pylist()
    weights, *halves = ({w: o for w, o in zip(tokens, got.column(f"odds{k}").to_pylist(), strict=True) if o is not None} for k in range(3))

    # rates of weights in clean text give the scale of chance scores: sum of p * exp(lambda * s) = 1
    def rates(batches):
        scans = [Scanner(w, rent) for w in halves]
        for b in batches:
            seen = Counter()
            for text, cell in zip(b.column("text").to_pylist(), b.column("cell").to_pylist(), strict=True):
                if cell % 2 == 0:
                    seen.update([round(w * GRID) for w in scans[cell // 2].tokens(text or "")])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["s", "n"])

    seen = rows.mapInArrow(rates, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    score, part = np.array([r.s / GRID for r in seen]), np.array([r.n for r in seen], dtype=float)
    part /= max(part.sum(), 1)
    low, high = 1e-3, 10.0
    for _ in range(60):
        lam = (low + high) / 2
        low, high = (lam, high) if (part * np.exp(lam * score)).sum() < 1 else (low, lam)

    def fitted(batches):
        scans = [Scanner(w, rent) for w in halves]
        for b in batches:
            cells = b.column("cell").to_pylist()
            each = [round(GRID * figure(*scans[c // 2].segments(t or ""), lam)) for t, c in zip(b.column("text").to_pylist(), cells, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array([c % 2 for c in cells], pa.int64())], ["x", "toxic"])

    cells = rows.mapInArrow(fitted, "x long, toxic long").groupBy("x", "toxic").count().collect()
    curve = _logistic(np.array([c.x / GRID for c in cells]), np.array([c.toxic for c in cells], float), np.array([c["count"] for c in cells], float))
    return ToxicityModel(weights, rent, lam, curve)


def score(docs: DataFrame, model: ToxicityModel, least: float = 0.0) -> DataFrame:
    """Adds toxicity (0 to 1), n_tokens and passages (array of start, end, score, evalue; places in code points of the
    text, for segments expected less than once by chance) to docs (text, ...); columns of these names are replaced.
    Null and empty texts score as texts without passages; repeated rows repeat; an empty table gives no rows. With
    least > 0 only rows that score less are kept."""
    small_batches(docs.sparkSession, 400)
    docs = docs.drop("toxicity", "n_tokens", "passages")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches):
        scan = Scanner(model.weights, model.rent)
        for b in batches:
            scores, sizes, spans = [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                n, segments = scan.segments(text)
                z = model.curve[0] + model.curve[1] * figure(n, segments, model.lam)
                scores.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                sizes.append(n)
                own = [(s, i, j, math.exp(math.log(n) - model.lam * s)) for s, i, j in segments if model.lam * s > math.log(n)]
                place = [m.span() for m in TOKEN.finditer(text if len(text.lower()) != len(text) else text.lower())] if own else []
                spans.append([{"start": place[i][0], "end": place[j][1], "score": s, "evalue": e} for s, i, j, e in own])
            keep = [least <= 0 or s < least for s in scores]
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(spans, kind)], [*b.schema.names, "toxicity", "n_tokens", "passages"])
            yield out.filter(pa.array(keep, pa.bool_()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, toxicity double, n_tokens long, passages array<struct<start: long, end: long, score: double, evalue: double>>")
