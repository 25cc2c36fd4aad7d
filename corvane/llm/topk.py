"""Exact top-k by inner product with a pivot table.

Vectors get one more component so that all have one length; then the largest inner product is the smallest distance,
and |d(query, pivot) - d(row, pivot)| bounds that distance from below for every pivot. Candidates of a block are
evaluated in the order of their largest bound and a query stops where no bound left can beat its k-th score. That score
starts from the query's k-th best of a bounded sample of the rows, so a block may be left without an evaluation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

PIVOTS = 32
HITS = "query_id long, vec_id long, score long"


def quantized(embedding, scale: int = 64):
    """floor(scale * x) of each component as longs; null where the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(ids, x, q_ids, q, floors, pivots, length2: float, k: int, step: int):
    """For each query its k best rows of a block, without those under its floor."""
    extra = np.sqrt(np.maximum(0.0, length2 - (x * x).sum(axis=1)))
    norm2 = lambda m: (m * m).sum(axis=1)
    p, p_extra = pivots
    to_rows = np.sqrt(np.maximum(0.0, length2 + (norm2(p) + p_extra**2)[:, None] - 2 * (p @ x.T + np.outer(p_extra, extra))))
    q2 = norm2(q)
    to_queries = np.sqrt(np.maximum(0.0, q2[:, None] + (norm2(p) + p_extra**2)[None, :] - 2 * q @ p.T))
    out = []
    for i in range(len(q)):
        bound = np.abs(to_queries[i][:, None] - to_rows).max(axis=0, initial=0.0)
        most = (q2[i] + length2 - bound * bound) / 2 + 1e-6 * (1 + length2)  # no row scores more
        order = np.argsort(-most, kind="stable")
        best, least = np.zeros((0, 2), dtype=np.int64), floors[i]
        for a in range(0, len(order), step):
            if most[order[a]] < least:
                break
            now = order[a : a + step]
            score = np.rint(x[now] @ q[i]).astype(np.int64)
            keep = (ids[now] != q_ids[i]) & (score >= least)  # ties may still have the smaller id
            if not keep.any():
                continue
            both = np.concatenate([best, np.column_stack([score[keep], ids[now][keep]])])
            best = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
            least = max(least, best[-1, 0]) if len(best) == k else least
        out.append((np.full(len(best), q_ids[i]), best[:, 1], best[:, 0]))
    return out


def _search(pivots: dict[int, np.ndarray], length2: float, k: int, step: int):
    def run(key, table):
        mine = table.column("is_query").to_numpy(zero_copy_only=False)
        ids, x = table.column("vec_id").to_numpy(), _rows(table.column("v").combine_chunks())
        own = pivots.get(x.shape[1], np.zeros((0, x.shape[1])))
        own = own, np.sqrt(np.maximum(0.0, length2 - (own * own).sum(axis=1)))
        found = _best(ids[~mine], x[~mine], ids[mine], x[mine], table.column("floor").to_numpy()[mine], own, length2, k, step) if mine.any() and not mine.all() else []
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3)]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    return run


def _floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds to queries the k-th highest score among the sampled rows of other ids, or the least long."""

    def run(batches):
        for b in batches:
            ids, out = b.column("vec_id").to_numpy(), []
            for i, v in zip(ids, b.column("v").to_pylist(), strict=True):
                own_ids, x = sample.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)))))
                score = (x @ np.array(v, dtype=np.float64))[own_ids != i]
                out.append(int(np.rint(np.partition(score, -k)[-k])) if len(score) >= k else np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "floor"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, query_block: int = 1024, pivots: int = PIVOTS, step: int = 512, sample: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query (vec_id, v) with vectors
    (vec_id, v) of other ids, ties to the smaller vec_id; fewer where there are fewer vectors.

    v holds whole numbers whose products stay under 2**53; rows with null v or vec_id take no part; vectors of different
    lengths don't meet. Repeated vec_ids count as one row each, none of them against its own id; other columns are
    ignored. Rows and queries are dealt into blocks of bounded size by a number of each written row, so equal rows part
    as well, and every block of queries meets every block of rows: no task grows with the tables. Pivots are the first of `sample` rows drawn by a hash.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    written = lambda df, name: cut(df.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.monotonically_increasing_id().alias("salt")), name)
    rows, asks = written(vectors, "vectors"), written(queries, "asks")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, length2 = rows.agg(F.count("*"), F.max(square)).first()
    m = asks.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_size: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(sample).collect():
        by_size.setdefault(len(r.v), []).append(r)
    drawn = {d: (np.array([r.vec_id for r in own]), np.array([r.v for r in own], dtype=np.float64)) for d, own in by_size.items()}
    asks = asks.mapInArrow(_floors(drawn, k), "vec_id long, v array<long>, salt long, floor long")
    p = {d: x[:pivots] for d, (_, x) in drawn.items()}
    row_blocks, ask_blocks = -(-n // block), -(-m // query_block)
    deal = lambda c, parts: F.pmod(F.xxhash64("salt", F.lit(9)), F.lit(parts)).cast("int").alias(c)
    every = lambda c, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(c)
    pairs = rows.select("vec_id", "v", F.lit(0).cast("long").alias("floor"), F.lit(False).alias("is_query"), deal("rb", row_blocks), every("qb", ask_blocks)).unionByName(asks.select("vec_id", "v", "floor", F.lit(True).alias("is_query"), every("rb", row_blocks), deal("qb", ask_blocks)))
    found = pairs.withColumn("size", F.size("v")).groupBy("size", "rb", "qb").applyInArrow(_search(p, float(length2), k, step), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
