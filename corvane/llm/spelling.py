"""Spelling variants: words at edit distance one, found by an index of variable-length grams.

The dictionary holds the grams that are frequent among the words, grown letter by letter: a gram is extended only while
it is frequent. From every place of a word its variable gram is the shortest one that isn't in the dictionary, so common
beginnings give long grams and rare ones short. Which gram stands at a place depends on its own letters alone, so an edit
affects just the grams that hold its place: a word's grams that no edit affects all at once, two apart from each other,
bound what a near word must share. Of these the rarest are chosen and their lists merged; every hit is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Maps Latin-1 bytes to what words are made of: letters with A-Z lower-cased, all from 0xC0; else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0xC0 or 97 <= b <= 122 else 32 for b in range(256))
SHORTEST, LONGEST = 2, 8
PROBES = "key long, word string, n long, step int, earlier array<struct<at: int, gram: string>>"


def _word_counts(every: int, least: int, most: int = 200_000):
    """Words of `least` letters or more with their counts, in parts: what a task remembers is bounded."""

    def flush(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    def run(batches):
        words: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter((text or "").encode("latin-1", "replace").translate(WORD_BYTES).split()).items():
                    if len(w) >= least:
                        if every:
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                            if h % every == 0:
                                i = h % len(w)
                                w = w[:i] + w[i + 1 :]
                                if len(w) < least:
                                    continue
                        words[w] += n
                if len(words) > most:
                    yield flush(words)
                    words = Counter()
        yield flush(words)

    return run


def words_of(docs: DataFrame, least: int = 7, occurrences: int = 2, drop_every: int = 0) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z and U+00C0 to U+00FF) of docs (doc_id, text) with A-Z lower-cased, of at
    least `least` letters and with at least `occurrences` in all. A null text has none; a null doc_id counts as an empty
    one; repeated rows count each; other columns are ignored.

    drop_every plants misspellings for tests and measurements: where it divides the crc32 h of "doc_id:run", the letter
    at h modulo the run's length is dropped."""
    small_batches(docs.sparkSession)
    parts = docs.select("doc_id", "text").mapInArrow(_word_counts(drop_every, least), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _grams(size: int, frequent: set[str]):
    """Counts of the grams of `size` whose shorter beginnings are all in the dictionary, summed within tasks."""

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for word in b.column("word").to_pylist():
                w = f"^{word}$"
                counts.update(g for g in (w[i : i + size] for i in range(len(w) - size + 1)) if size == SHORTEST or g[:-1] in frequent)
            if len(counts) > 200_000:
                yield flush(counts)
                counts = Counter()
        yield flush(counts)

    return run


def gram_dictionary(words: DataFrame, least: int = 64, most: int = 50_000) -> dict[str, int]:
    """Frequent grams of words with their counts. Of each length at most about `most` are held: a gram is frequent if it
    comes more than `least` times and more than once in `most` places."""
    n = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bound, out, frequent = max(least, n // most), {}, set()
    for size in range(SHORTEST, LONGEST):
        counts = words.select("word").mapInArrow(_grams(size, frequent), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        level = {r.gram: r.n for r in counts.where(F.col("n") > bound).collect()}
        if not level:
            break
        out |= level
        frequent = set(level)
    return out


def variable_grams(word: str, frequent: dict[str, int], longest: int) -> list[tuple[int, str]]:
    """From every place of the marked word the shortest gram that isn't in the dictionary, or up to `longest` letters."""
    w, out = f"^{word}$", []
    for i in range(len(w) - 1):
        size = SHORTEST
        while size < longest and i + size < len(w) and w[i : i + size] in frequent:
            size += 1
        out.append((i, w[i : i + size]))
    return out


def _longest(letters: int) -> int:
    """No gram is longer than half of the shorter word with its marks, so that two grams always stand apart."""
    return min(LONGEST, (letters + 2) // 2)


def _key(gram: str, at: int, letters: int) -> int:
    x = f"{at}:{letters}:{gram}".encode()
    return (zlib.crc32(x) << 32 | zlib.crc32(x, 0x5EED)) - (1 << 63)


def _postings(frequent: dict[str, int]):
    """Keys of all grams of each word: of words as long as it, and of words one letter shorter."""

    def run(batches):
        for b in batches:
            keys, words, ns = [], [], []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                size = len(word)
                for at, gram in {g for longest in {_longest(size), _longest(size - 1)} for g in variable_grams(word, frequent, longest)}:
                    keys.append(_key(gram, at, size))
                    words.append(word)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["key", "word", "n"])

    return run


def chosen_grams(word: str, frequent: dict[str, int], rare: int) -> tuple[tuple[int, str], tuple[int, str]]:
    """The two cheapest grams of a word that share no letter: one edit affects at most one of them."""
    grams = [(frequent.get(g, rare), at, g) for at, g in variable_grams(word, frequent, _longest(len(word)))]
    best, after, cheapest = None, len(grams) - 1, {}
    for i in range(len(grams) - 1, -1, -1):  # cheapest gram from each place on
        cheapest[i] = min(grams[i], cheapest.get(i + 1, grams[i]))
    for cost, at, gram in grams:
        if at + len(gram) <= after:
            other = cheapest[at + len(gram)]
            best = min(best or (cost + other[0], at, gram, other), (cost + other[0], at, gram, other))
    return (best[1], best[2]), (best[3][1], best[3][2])


def _probes(frequent: dict[str, int], rare: int):
    """Keys of the lists that a word's near words of its length or one letter more must be in. `earlier` are the grams
    of the probes before: a word that holds one of them was met there."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("gram", pa.string())]))

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                for step in (0, 1):
                    earlier: list[dict] = []
                    for at, gram in chosen_grams(word, frequent, rare):
                        for shift in range(step + 1):
                            for c, x in zip(out, (_key(gram, at + shift, len(word) + step), word, n, step, list(earlier)), strict=True):
                                c.append(x)
                            earlier.append({"at": at + shift + 1, "gram": gram})
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], kind)], ["key", "word", "n", "step", "earlier"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words (word, n) that differ by one inserted, deleted or replaced code point,
    in both orders, once each. Words must be distinct and not null; those of one code point take no part."""
    small_batches(words.sparkSession, 20_000)
    words = words.where(F.length("word") > 1)
    frequent = gram_dictionary(words)
    rare = max(1, min(frequent.values(), default=1) // 4)
    lists = words.mapInArrow(_postings(frequent), "key long, word string, n long").select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    asks = words.mapInArrow(_probes(frequent, rare), PROBES)
    met = asks.join(lists, "key").where((F.length("near") == F.length("word") + F.col("step")) & ((F.col("step") == 1) | (F.col("word") < F.col("near"))))
    marked = F.concat(F.lit("^"), F.col("near"), F.lit("$"))
    met = met.where((F.levenshtein("word", "near", 1) == 1) & ~F.exists("earlier", lambda g: F.substr(marked, g["at"], F.length(g["gram"])) == g["gram"]))
    met = cut(met.select("word", "n", "near", "near_n"), "near")
    return met.unionByName(met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def spelling_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """words (word, n) with form (the near word of the largest n, ties to the smallest in code-point order, if that n is
    at least ratio times the word's own; else null), root (where following forms ends; the word itself without a form),
    n_near (near words, 0 if none) and form_n (the form's n or null). Pairs meet by lists of rare grams, not by words;
    words that many have as their form are joined as any skewed key."""
    words = cut(words.where("word is not null").select("word", "n"), "words")
    near = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    every = words.join(best, "word", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    every = cut(every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    # a form's n is ratio times larger, so chains are short and end; each round doubles what is followed
    roots = every.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = cut(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = roots.join(ahead, "root", "left")
        if longer.where("further is not null").isEmpty():
            break
        roots = longer.select("word", F.coalesce("further", "root").alias("root"))
    return every.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
