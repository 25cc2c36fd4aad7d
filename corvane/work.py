"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset. That is for
    local runs: on a cluster a missing setting is an error, as a local folder is each machine's own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/corvane-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """As cut, as a table of n buckets by key: windows, groups and joins by the key move none of its rows. df lies in n
    partitions by the key, so that each task writes one bucket."""
    spark, name = df.sparkSession, f"corvane_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).option("path", new_path(spark, label)).saveAsTable(name)
    return spark.table(name)
