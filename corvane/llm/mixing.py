"""Mixing sources to target weights: hash-random keys, range-sorted blocks within each source, distributed prefix sums
of sizes, and a cut at each source's exact budget, with further epochs where a budget exceeds its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets


def allocate(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds `target` to sources (source, source_size, weight): share * all sizes by weight, at most cap * its own size
    each; what exceeds a cap goes to the others by weight until none is above. Sources of weight 0 get nothing."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level, full = min(share, cap) * total, None, F.lit(False)
    while True:
        row = sources.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.count(F.when(full, 1))).first()
        if not row[1] or (level is not None and row[2] == level[1]):
            break
        level = ((budget - row[0]) / row[1], row[2])
        full = F.col("source_size") * cap <= F.col("weight") * level[0]
    per_weight = level[0] if level else 0.0
    return sources.withColumn("target", F.least(F.col("source_size") * cap, F.col("weight") * per_weight).cast("double"))


def random_key(doc_id: Column, seed: int) -> Column:
    """A hash-random key that SQL engines agree on: md5 of seed and id, in hexadecimal."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))


def take(docs: DataFrame, targets: DataFrame, size: Column, seed: int = 7, per_block: int = 4_000) -> DataFrame:
    """Adds size, source_size, target and taken to docs (doc_id, source, ...): how much of each document the mix takes.

    targets: source, source_size, target; a null source is a source. Within a source, documents in order of
    random_key(doc_id), then doc_id and size, are taken whole, epoch after epoch; the one at the cut is taken in part, so a
    source's sum is its floored target. A document of size 0 or of a source without target is taken 0 times. Rows with
    equal ids and sizes are interchangeable; those of one id are in one block. Columns of docs named like those added
    are replaced.
    """
    n = docs.count()
    blocks = max(1, -(-n // per_block))
    docs = docs.drop("size", "source_size", "target", "taken").withColumn("size", size).withColumn("__key", F.coalesce(random_key(F.col("doc_id"), seed), F.lit("")))
    docs = docs.withColumn("__block", F.coalesce(F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / 2.0**32 * blocks), F.lit(0)).cast("long"))
    before = running_offsets(docs.groupBy("source", "__block").agg(F.sum("size").alias("s")), ["source"], "__block", "s")
    before = before.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(F.col("p.source").alias("__s"), F.col("p.__block").alias("__b"), "before", "source_size", "target")
    w = Window.partitionBy("source", "__block").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = docs.withColumn("__in", F.coalesce(F.sum("size").over(w), F.lit(0)))
    out = out.join(before, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
    goal, whole = F.floor(F.coalesce("target", F.lit(0.0))), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(goal / whole)).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), goal - epochs * whole - F.col("before") - F.col("__in")))
    taken = F.coalesce(epochs * F.col("size") + part, F.lit(0)).cast("long")
    return out.withColumn("taken", taken).drop("__key", "__block", "__in", "before", "__s", "__b")


def cut_points(sized: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """One row a source: epochs taken whole, and where the next one is cut, as key and doc_id of the document at the cut
    with the share of its words that the budget takes. sized: doc_id, source, size; see take(). Rows of one doc_id at a
    cut share what is left for them. Texts needn't be moved to be mixed: each row compares its key with its source's."""
    taken = take(sized.withColumnRenamed("size", "__words"), targets, F.col("__words"), seed).where("source_size > 0")
    whole = F.floor(F.floor("target") / F.col("source_size"))
    part = F.col("taken") - whole * F.col("size")
    rows = taken.select("source", whole.alias("epochs"), F.coalesce(random_key(F.col("doc_id"), seed), F.lit("")).alias("key"), "doc_id", "size", part.alias("part"))
    each = rows.groupBy("source", "epochs", "key", "doc_id").agg(F.sum("part").alias("part"), F.sum("size").alias("size"))
    last = F.max(F.when(F.col("part") > 0, F.struct("key", "doc_id", F.try_divide("part", "size").alias("share")))).alias("last")
    return each.groupBy("source", "epochs").agg(last).select("source", "epochs", "last.*")
