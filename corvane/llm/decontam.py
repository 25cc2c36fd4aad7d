"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ by k = floor(error_rate * n) edits. Cut into k + 1 pieces, at least one piece is
intact in any such copy, so exact piece hits (one Aho-Corasick automaton for all items of a block) find every place to
look at; Myers' bit-parallel distance then decides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_WORD = re.compile(r"\S+")
HITS = "doc_id long, item_id long, start long, end long, distance long"


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal_form(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(_lower(text or "").split())


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers_ends(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """Smallest edit distance, at most k, of pattern to a substring of text, and the first place where one ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def best_match(pattern: str, text: str, k: int) -> tuple[int, int, int] | None:
    """Distance, start and end of the closest substring of text within k edits of pattern."""
    if (hit := myers_ends(pattern, text, k)) is None:
        return None
    d, end = hit
    back = myers_ends(pattern[::-1], text[:end][::-1], d)
    return d, end - (back[1] if back else len(pattern)), end


_built: dict[str, Callable[[str], list[tuple[int, int, int, int]]]] = {}


def _finder(items: list[tuple[int, str]], rate: float, name: str) -> Callable[[str], list[tuple[int, int, int, int]]]:
    """What finds the items of a block in a text. A worker keeps the last one for its later tasks."""
    import ahocorasick

    if name not in _built:
        found = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        budget = [int(rate * len(t)) for _, t in items]
        for n, (_, t) in enumerate(items):
            for at, p in pieces(t, budget[n]):
                places.setdefault(p, []).append((n, at))
        for p, where in places.items():
            found.add_word(p, (len(p), where))
        found.make_automaton()
        _built.clear()
        _built[name] = lambda text: _in_text(text, items, budget, found)
    return _built[name]


def _matcher(items: list[tuple[int, str]], rate: float, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, rate, name)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text and doc is not None:
                    rows += [(doc, *r) for r in find(text)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "end", "distance"])

    return run


def _without(items: list[tuple[int, str]], rate: float, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(items, rate, name)
        for b in batches:
            pairs = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
            yield b.filter(pa.array([doc is None or not text or not find(text) for doc, text in pairs], pa.bool_()))

    return run


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, as many at once as have about block_chars characters."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if own := sorted({(r.item_id, t) for r in own if (t := normal_form(r.text))}):
            yield own


def _in_text(text: str, items, budget, found) -> list[tuple[int, int, int, int]]:
    plain = normal_form(text)
    tried: set[tuple[int, int]] = set()
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for last, (size, where) in found.iter(plain):
        for n, at in where:
            k, pattern, begin = budget[n], items[n][1], last + 1 - size - at
            if (n, begin) in tried or any(a <= last < b for _, a, b in spans.get(n, ())):
                continue
            tried.add((n, begin))
            low = max(0, begin - k)
            if hit := best_match(pattern, plain[low : begin + len(pattern) + k], k):
                spans.setdefault(n, []).append((hit[0], low + hit[1], low + hit[2]))
    if not spans:
        return []
    back = []  # place in text of each character of the normal form
    for m in _WORD.finditer(text):
        if back:
            back.append(m.start() - 1)
        back.extend(range(m.start(), m.end()))
    return [(items[n][0], back[a], back[b - 1] + 1, d) for n, each in spans.items() for d, a, b in each]


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, start, end, distance: passages of docs (doc_id, text) within floor(error_rate * n) edits of a
    benchmark item (item_id, text) of n characters, in lower case with white space as single spaces; places count code
    points of the original text. Of places that overlap for one item the first found stays.

    Null texts, texts without words and null ids match nothing, on either side. Repeated rows give repeated matches.
    Tasks get the items in blocks of about block_chars characters, one scan of docs for each block, so a benchmark of
    any size works in bounded memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], HITS)
    for own in _blocks(benchmark, block_chars):
        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_matcher(own, error_rate, uuid.uuid4().hex), HITS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs without a benchmark passage, see contaminated(); rows with a null doc_id stay. Every row is
    judged by its own text in the pass that reads it, so texts aren't shuffled; all columns pass through."""
    small_batches(docs.sparkSession)
    for own in _blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_without(own, error_rate, uuid.uuid4().hex), docs.schema)
    return docs
