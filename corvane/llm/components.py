"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


PER_FILE = 50_000  # edges: steps over few edges end in few files


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Minima are aggregated before the shuffle and joined back, so a hub's
    neighbours are never gathered in one task. edges: hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi")
    return small.select("hi", F.col("m").alias("lo")).unionByName(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is its smallest reachable node. Self-edges and
    repeated edges and those with a null end do nothing; no edges give no rows. Raises if it has not converged after `rounds` steps."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    was = None
    for _ in range(rounds):
        # converged when every node has one edge, to a node without an edge of its own: the sums then stand still
        state = now.agg(F.count("*"), F.sum("hi"), F.sum("lo"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        was = state
        now = cut(_stars(now).coalesce(max(1, state[0] // PER_FILE)), "stars")
    raise RuntimeError(f"components: not converged after {rounds} rounds")
