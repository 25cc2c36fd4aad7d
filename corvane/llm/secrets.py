"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

A token's encoding is the smallest alphabet that holds all its characters. Three statistics measure how far it is from
uniform random characters of that alphabet: chi-squared of the character counts, runs above and below the alphabet's
middle, and serial correlation of neighbours; the score is minus the largest deviation, so random tokens score highest.
Decoys, made of a text's neighbouring plain words run together, give the scores of ordinary text of the same length
class; Benjamini and Hochberg's rule on the resulting p-values, in each length class, bounds the share of false finds.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 and more
KINDS = ("assign", "access", "hex", "random")
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PLAIN_START = re.compile(r"(?<!\S)[A-Za-z]{2,}")  # the letters that a word begins with
CLASSES = (20, 24, 32, 40, 64, 128)  # least lengths of the length classes
STEP = 20  # scores are kept in steps of 1 / STEP

# fixed values: alphabets from the smallest to the largest
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}


def encoding_of(token: str) -> str | None:
    own = set(token.rstrip("="))
    return next((k for k, v in _SETS.items() if own <= v), None)


@functools.cache
def _places(kind: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(ALPHABETS[kind])}


def battery(token: str, kind: str) -> tuple[float, float, float]:
    """Standard deviations from uniform random characters of the alphabet: chi-squared, runs, serial correlation."""
    at = _places(kind)
    x = np.array([at[c] for c in token.rstrip("=")])
    n, a = len(x), len(at)
    chi = float((np.bincount(x, minlength=a) ** 2).sum()) * a / n - n
    z_chi = ((chi / (a - 1)) ** (1 / 3) - (1 - 2 / (9 * (a - 1)))) / math.sqrt(2 / (9 * (a - 1)))
    up = x >= a / 2
    n1 = int(up.sum())
    n0 = n - n1
    runs = 1 + int((up[1:] != up[:-1]).sum())
    mean = 2 * n0 * n1 / n + 1
    var = (mean - 1) * (mean - 2) / max(n - 1, 1)
    z_runs = (runs - mean) / math.sqrt(var) if var > 0 else math.sqrt(n)
    y = x - (a - 1) / 2
    z_serial = float((y[1:] * y[:-1]).sum()) / ((a * a - 1) / 12) / math.sqrt(n - 1)
    return z_chi, z_runs, z_serial


def randomness(token: str, kind: str) -> float:
    """Minus the largest deviation, between -12 and 0."""
    z_chi, z_runs, z_serial = battery(token, kind)
    return -min(12.0, max(abs(z_chi), abs(z_runs), abs(z_serial)))


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _decoy_scores(letters: str | np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and rounded score of decoys that lie end to end in letters (A-Z, a-z; text or its bytes), as length_class
    and randomness give them one by one."""
    code = np.frombuffer(letters.encode() if isinstance(letters, str) else letters, np.uint8).astype(np.int64)
    at = np.where(code >= 97, code - 71, code - 65)  # places in the alphabet `letters`
    starts = np.concatenate(([0], ends[:-1]))
    n = ends - starts
    least, most = np.minimum.reduceat(at, starts), np.maximum.reduceat(at, starts)
    lower, upper = least >= 26, most < 26
    few = np.where(lower, most <= 31, most <= 5)  # a to f alone: hex
    one = lower | upper
    a = np.where(one, np.where(few, 16, 26), 52)
    shift = np.where(lower, 26, 0) - np.where(one & few, 10, 0)
    own = np.repeat(np.arange(len(n)), n)
    cells = np.bincount(own * 52 + at, minlength=len(n) * 52).reshape(len(n), 52)
    chi = (cells * cells).sum(axis=1) * a / n - n
    z_chi = (np.cbrt(chi / (a - 1)) - (1 - 2 / (9 * (a - 1)))) / np.sqrt(2 / (9 * (a - 1)))
    y = at - np.repeat(shift + (a - 1) / 2, n)
    up = y > 0
    n1 = np.add.reduceat(up, starts, dtype=np.int64)
    turn = np.concatenate(([False], up[1:] != up[:-1]))
    near = np.concatenate(([0.0], y[1:] * y[:-1]))
    turn[starts], near[starts] = False, 0.0
    mean = 2 * (n - n1) * n1 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = np.where(var > 0, (1 + np.add.reduceat(turn, starts, dtype=np.int64) - mean) / np.sqrt(np.where(var > 0, var, 1)), np.sqrt(n))
    z_serial = np.add.reduceat(near, starts) / ((a * a - 1) / 12) / np.sqrt(n - 1)
    worst = np.minimum(12.0, np.maximum(np.abs(z_chi), np.maximum(np.abs(z_runs), np.abs(z_serial))))
    return np.searchsorted(CLASSES, n, side="right") - 1, np.rint(-worst * STEP).astype(np.int64)


def decoys(texts: list[list[str]], classes: Sequence[int] = range(len(CLASSES))) -> tuple[dict[tuple[int, int], int], list[list[int]]]:
    """Decoys of texts (their plain words) by class and score, and how many words each text has left for each class.

    Neighbouring words of a text are run together to the least length of a class: for each class from all words, a decoy
    at the end of the last one. What doesn't fill one at a text's end is left; it has fewer letters than the class."""
    found: dict[tuple[int, int], int] = {}
    left = [[0] * len(CLASSES) for _ in texts]
    words = [w for ws in texts for w in ws]
    if not words:
        return found, left
    code = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    bounds = np.cumsum([0, *map(len, texts)]).tolist()
    for k in classes:
        goal = CLASSES[k]
        after = (np.searchsorted(starts[1:], starts[:-1] + goal) + 1).tolist()  # the word after a decoy that begins here
        first, last = [], []
        for t, (i, end) in enumerate(itertools.pairwise(bounds)):
            while i < end and (j := after[i]) <= end:
                first.append(i)
                last.append(j)
                i = j
            left[t][k] = end - i
        for i in range(0, len(first), 20_000):  # bounds the table of letter counts
            own, n = starts[first[i : i + 20_000]], starts[last[i : i + 20_000]]
            ends = np.cumsum(n - own)
            at = np.arange(ends[-1]) + np.repeat(own - np.concatenate(([0], ends[:-1])), n - own)
            cls, score = _decoy_scores(code[at], ends)
            keys, each = np.unique(cls * 1000 - score, return_counts=True)
            for key, m in zip(keys.tolist(), each.tolist(), strict=True):
                place = key // 1000, -(key % 1000)
                found[place] = found.get(place, 0) + m
    return found, left


def run_on(tails: list[tuple[str, list[int], int]]) -> dict[tuple[int, int], int]:
    """Decoys of what texts had left (words, words left for each class, number of texts), run together in order: the
    first copies of all, the second copies of those that have one, and so on. Copies never run on into each other."""
    found: dict[tuple[int, int], int] = {}
    tails, done = sorted(tails), 0
    for level in sorted({n for *_, n in tails}):
        own = [(tail.split(" "), left) for tail, left, n in tails if n >= level]
        for k in range(len(CLASSES)):
            loose = [w for words, left in own if left[k] for w in words[-left[k] :]]
            for (cls, score), m in decoys([loose], [k])[0].items():
                found[cls, score] = found.get((cls, score), 0) + m * (level - done)
        done = level
    return found


def _scan(batches):
    """For each text its base spans, candidates and what its decoys left; decoys of a batch as counts in its first row."""
    for b in batches:
        rows, texts = [], [t or "" for t in b.column("text").to_pylist()]
        for text in texts:
            base = base_spans(text)
            cand = []
            for m in LONG.finditer(text):
                if any(s < m.end() and m.start() < e for s, _, e in base):
                    continue
                if kind := encoding_of(m.group()):
                    cand.append({"start": m.start(), "end": m.end(), "cls": length_class(m.end() - m.start()), "score": round(randomness(m.group(), kind) * STEP)})
            rows.append(([{"start": s, "kind": k, "end": e} for s, k, e in base], cand))
        words = [PLAIN_START.findall(t) for t in texts]
        counted, left = decoys(words)
        seen = [[] for _ in rows]
        if rows:
            seen[0] = [{"cls": c, "score": s, "n": n} for (c, s), n in counted.items()]
        tails = [" ".join(ws[-max(n) :]) if max(n) else "" for ws, n in zip(words, left, strict=True)]
        spans = pa.array([r[0] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())])))
        cands = pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cls", pa.int64()), ("score", pa.int64())])))
        counts = pa.array(seen, pa.list_(pa.struct([("cls", pa.int64()), ("score", pa.int64()), ("n", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), spans, cands, counts, pa.array(tails, pa.string()), pa.array(left, pa.list_(pa.int32()))], ["doc_id", "base", "cands", "decoys", "tail", "loose"])


def _run_on(group: pa.Table) -> pa.Table:
    found = run_on(list(zip(*[group.column(c).to_pylist() for c in ("tail", "loose", "n")], strict=True)))
    rows = [(c, s, n) for (c, s), n in found.items()]
    return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["cls", "score", "n"])


SCANNED = "doc_id long, base array<struct<start: long, kind: long, end: long>>, cands array<struct<start: long, end: long, cls: long, score: long>>, decoys array<struct<cls: long, score: long, n: long>>, tail string, loose array<int>"


def thresholds(cands: DataFrame, rate: float) -> DataFrame:
    """Least score of a find in each length class by Benjamini and Hochberg's rule; cands: cls, score, t (candidates),
    d (decoys). Works on counts by class and score, a table of bounded size."""
    counts = cands.groupBy("cls", "score").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    above = Window.partitionBy("cls").orderBy(F.desc("score"))
    sums = counts.select("cls", "score", F.sum("t").over(above).alias("t_up"), F.sum("d").over(above).alias("d_up"), F.sum("t").over(Window.partitionBy("cls")).alias("t_all"), F.sum("d").over(Window.partitionBy("cls")).alias("d_all"))
    p = (F.col("d_up") + 1) / (F.col("d_all") + 1)
    return sums.where((F.col("t_up") > 0) & (p <= rate * F.col("t_up") / F.col("t_all"))).groupBy("cls").agg(F.min("score").alias("least"))


def scan(docs: DataFrame, rate: float = 0.01, per_block: int = 2_000) -> DataFrame:
    """doc_id and spans (start, kind, end in code points; kind counts KINDS) of docs (doc_id, text), ordered by start,
    then kind. The fixed patterns always stay; `random` spans are added where they overlap none of them and pass the
    battery at false-discovery rate `rate`, judged over all of docs. Words that fill no decoy at a text's end are run
    together with those of other texts, in blocks of about per_block texts that the words themselves choose, so results
    don't depend on how rows lie in tasks. Null texts are empty, repeated rows and null ids are scanned like others, an
    empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCANNED), "secrets")
    none, each = F.lit(0).cast("long"), F.lit(1).cast("long")
    seen = F.concat(F.transform("cands", lambda c: F.struct(c["cls"].alias("cls"), c["score"].alias("score"), each.alias("t"), none.alias("d"))), F.transform("decoys", lambda c: F.struct(c["cls"].alias("cls"), c["score"].alias("score"), none.alias("t"), c["n"].alias("d"))))
    blocks = max(1, -(-found.count() // per_block))
    tails = found.where("tail != ''").groupBy("tail", "loose").agg(F.count("*").alias("n")).withColumn("block", F.pmod(F.xxhash64("tail", "loose"), F.lit(blocks)))
    more = tails.groupBy("block").applyInArrow(_run_on, "cls long, score long, n long").select("cls", "score", none.alias("t"), F.col("n").alias("d"))
    limits = {r.cls: r.least for r in thresholds(found.select(F.explode(seen).alias("c")).select("c.*").unionByName(more), rate).collect()}
    passes = F.lit(False)
    pick = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(int(v)) for kv in limits.items() for v in kv]), c["cls"].cast("int")) <= c["score"], passes) if limits else passes
    added = F.transform(F.filter("cands", pick), lambda c: F.struct(c["start"].alias("start"), F.lit(3).cast("long").alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans, kinds=KINDS):
    """spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in kinds]), (s["kind"] + 1).cast("int")), s["start"].cast("string"), s["end"].cast("string"))))


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
