"""Ranked lexical search by pipelined term partitioning.

Terms of the items are dealt to owners by the number of documents that hold them, rarest first, with equal numbers of
postings. A bundle of items passes the owners one after the other: at each, its accumulators (one for a document that
scores so far) meet the owner's postings in a cogroup by ranges of documents, and integer contributions are added. An
accumulator that can't reach its range's k-th score with all that later owners may add is left behind; the last owner's
stage selects. Rare terms come first, so most documents never get an accumulator before the last stage.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Maps bytes of UTF-8 to what terms are made of: digits, letters with A-Z lower-cased, all bytes from 0x80; else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPAN = 12  # bits of a document's place in its range
SCORES = "r long, q int, at array<int>, score array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def _asked(batches):
    for b in batches:
        rows = [(i, t) for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for t in set(terms_of(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field("item_id").type), pa.array([r[1].decode() for r in rows], pa.string())], ["item_id", "term"])


def _counts(numbers: dict[bytes, int]):
    """Documents with a term: number of terms, and those that are asked for with their occurrences."""
    kind = pa.list_(pa.struct([("t", pa.int32()), ("tf", pa.int32())]))

    def run(batches):
        for b in batches:
            keep, n, hits = [], [], []
            for i, text in enumerate(b.column("b").to_pylist()):
                own = terms_of(text)
                if own:
                    keep.append(i)
                    n.append(len(own))
                    hits.append([{"t": t, "tf": tf} for t, tf in Counter(numbers[w] for w in own if w in numbers).items()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(hits, kind)], ["doc_id", "n", "hits"])

    return run


def _stage(bundle: list[list[tuple[int, int, int]]], owner: int, last: bool, k: int):
    """One owner's stage for one range of documents. bundle: of each item its terms as (term, owner, most it can add).
    In the last stage postings of term -1 name the documents, and rows are the range's k best of each item."""
    asks: dict[int, list[int]] = {}
    for q, own in enumerate(bundle):
        for t, o, _ in own:
            if o == owner:
                asks.setdefault(t, []).append(q)
    rest = [sum(most for _, o, most in own if o > owner) for own in bundle]

    def run(key, left, right):
        scores = np.zeros((len(bundle), 1 << SPAN), np.int64)
        for q, at, score in zip(left.column("q").to_pylist(), left.column("at").combine_chunks(), left.column("score").combine_chunks(), strict=True):
            scores[q, at.values.to_numpy()] = score.values.to_numpy()
        t, at, c = (right.column(x).to_numpy() for x in ("t", "at", "c"))
        order = np.argsort(t, kind="stable")
        t, at, c = t[order], at[order], c[order]
        cuts = np.flatnonzero(np.diff(t, prepend=-2, append=np.iinfo(np.int32).max))
        for a, z in zip(cuts, cuts[1:], strict=False):
            for q in asks.get(int(t[a]), ()):
                scores[q, at[a:z]] += c[a:z]
        ids = np.full(1 << SPAN, np.iinfo(np.int64).max)
        known = np.zeros(1 << SPAN, bool)
        if last:
            own = t == -1
            named = right.column("named").to_numpy(zero_copy_only=False)[order]
            ids[at[own]], known[at[own]] = c[own], named[own].astype(bool)
        out: dict[str, list] = {"q": [], "at": [], "score": []}
        for q, row in enumerate(scores):
            some = np.flatnonzero(row)
            if len(some) >= k:
                least = np.partition(row[some], -k)[-k]
                some = some[row[some] + rest[q] >= least]
            if last:
                some = some[np.lexsort((ids[some], ~known[some], -row[some]))[:k]]
            if len(some):
                out["q"].append(np.full(len(some), q) if last else [q])
                out["at"].append(some)
                out["score"].append(row[some])
        if last:
            at = np.concatenate([*out["at"], np.zeros(0, np.int64)]).astype(np.int64)
            q, score = (np.concatenate([*out[c], np.zeros(0, np.int64)]) for c in ("q", "score"))
            return pa.table([pa.array(q.astype(np.int32)), pa.array(ids[at], mask=~known[at]), pa.array(score.astype(np.int64))], names=["q", "doc_id", "score"])
        n = len(out["q"])
        return pa.table([pa.array(np.full(n, key[0].as_py(), np.int64)), pa.array([q[0] for q in out["q"]], pa.int32()), pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["score"], pa.list_(pa.int64()))], names=["r", "q", "at", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, owners: int = 4, per_bundle: int = 50_000, most_items: int = 1024) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents (doc_id, text) of the highest score above 0 for each item
    (item_id, text), equal scores by ascending doc_id, null last; fewer where fewer score.

    With N documents that hold a term, L terms in all and n in the document, df documents that hold the term and tf of
    its occurrences in the document, an item's distinct terms add floor(1000 ln((2N + 2) / (2df + 1))) times
    (10**9 tf) div (1000 tf + 8 m), where m = 10 + (90 n N) div L. Rows of documents are documents of their own, also
    with equal or null doc_id; rows of one item_id, null included, are one item. A null or empty text has no terms;
    other columns are ignored. Items go in bundles of about `per_bundle` terms and `most_items` items at most on
    average, whose terms are broadcast; each bundle is one more pass over the documents."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {c: dict(df.dtypes)[c] for c, df in (("item_id", items), ("doc_id", docs))}
    asked = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(_asked, f"item_id {kinds['item_id']}, term string")
    asked = cut(asked.distinct(), "asked")
    n_terms, n_items = asked.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    bundles = max(1, -(-n_terms // per_bundle), -(-n_items // most_items))
    asked = asked.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    found, sums = None, None
    for bundle in range(bundles):
        own: dict[object, list[str]] = {}
        for r in asked.where(F.col("bundle") == bundle).collect():
            own.setdefault(r.item_id, []).append(r.term)
        numbers = {t: i for i, t in enumerate(sorted({t for terms in own.values() for t in terms}))}
        counted = texts.mapInArrow(_counts({t.encode(): i for t, i in numbers.items()}), "doc_id long, n long, hits array<struct<t: int, tf: int>>")
        rid = F.monotonically_increasing_id()
        counted = cut(counted.withColumns({"r": F.shiftright(rid, SPAN), "at": rid.bitwiseAND((1 << SPAN) - 1).cast("int")}), "counted")
        sums = sums or counted.agg(F.count("*"), F.sum("n")).first()
        part = _search_bundle(counted, list(own.items()), numbers, sums[0], sums[1] or 0, k, owners)
        part = spark.createDataFrame([(i, q) for q, i in enumerate(own)], f"item_id {kinds['item_id']}, q int").join(part, "q").drop("q")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_bundle(counted: DataFrame, own: list[tuple[object, list[str]]], numbers: dict[str, int], n_docs: int, n_terms: int, k: int, owners: int) -> DataFrame:
    spark = counted.sparkSession
    m = F.expr(f"10 + (90 * n * {n_docs}) div {max(1, n_terms)}")
    hits = counted.select("r", "at", m.alias("m"), F.inline("hits")).withColumn("part", F.expr("(1000000000L * tf) div (1000L * tf + 8 * m)"))
    terms = cut(hits.groupBy("t").agg(F.count("*").alias("df"), F.max("part").alias("most")), "terms")
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2 * F.col("df").cast("double") + 1)))
    # one row a term of the bundle: a bounded table
    before = F.sum("df").over(Window.orderBy("df", "t").rowsBetween(Window.unboundedPreceding, -1))
    shares = terms.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("df").over(Window.partitionBy()))
    terms = cut(shares.select("t", weight.alias("w"), "most", F.least(F.lit(owners - 1), F.floor(F.col("before") * owners / F.col("all"))).cast("int").alias("owner")), "owners")
    known = {r.t: (r.owner, r.w * r.most) for r in terms.collect()}
    bundle = [[(t, *known[t]) for t in (numbers[x] for x in words) if t in known] for _, words in own]
    posted = hits.join(terms.where("w > 0").select("t", "w", "owner"), "t").select("owner", "r", "at", "t", (F.col("w") * F.col("part")).alias("c"), F.lit(True).alias("named"))
    posted = cut(posted, "posted")
    scores = spark.createDataFrame([], SCORES)
    for owner in range(owners):
        right, last = posted.where(F.col("owner") == owner).drop("owner"), owner == owners - 1
        if last:
            names = counted.select("r", "at", F.lit(-1).alias("t"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("c"), F.col("doc_id").isNotNull().alias("named"))
            right = right.unionByName(names)
        schema = "q int, doc_id long, score long" if last else SCORES
        scores = scores.groupBy("r").cogroup(right.groupBy("r")).applyInArrow(_stage(bundle, owner, last, k), schema)
    return scores
