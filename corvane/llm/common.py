"""What several corpus operators share: tables, shared work folders, cut lineage, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.work import cut, new_path, work_dir

__all__ = ["WORD", "cut", "n_words", "new_path", "running_offsets", "small_batches", "table", "work_dir"]

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: rows and bytes of an Arrow batch. Jobs are planned later, so the
    session keeps these settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_offsets(blocks: DataFrame, keys: list[str], block: str, value: str, width: int = 1000) -> DataFrame:
    """Exclusive prefix sums of value over block within keys, in two steps, so that no task holds more than about
    `width` blocks, or a sum for each `width` of them. Blocks are integers; returns keys, block and `before`."""
    grouped = blocks.withColumn("__g", F.floor(F.col(block) / width))
    inner = Window.partitionBy(*keys, "__g").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy(*keys, "__g").agg(F.sum(value).alias("__s"))
    sums = sums.select(*keys, "__g", F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__base"))
    on = F.col("a.__g") == F.col("b.__g")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    within = grouped.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.alias("a").join(sums.alias("b"), on).select(*[f"a.{k}" for k in keys], f"a.{block}", (F.col("__base") + F.col("__in")).alias("before"))
