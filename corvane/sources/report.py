"""Several dated tables published together.

Tables are written first, under the run's own name; one small record for each date, written last, says which run a date
shows. Readers go by these records alone, so a run that breaks off is never seen, and a rerun of some dates replaces them
and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources import registry

SHOWN = "as_of date, run string, tables map<string,string>, at timestamp"


def write_run(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes tables (each with as_of) as CSV by date under a new run's name, which it returns; nothing shows them yet."""
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "as_of").csv(f"{folder}/{name}", header=True, nullValue="")
    return run


def show_run(tables: dict[str, DataFrame], folder: str, run: str) -> None:
    """The records of the run's dates, of which there are few: from now on readers see these dates of it."""
    every = None
    for df in tables.values():
        own = df.select("as_of").distinct()
        every = own if every is None else every.unionByName(own)
    spark, at = every.sparkSession, registry.now()
    schemas = {n: ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "as_of") for n, df in tables.items()}
    for r in every.distinct().orderBy("as_of").collect():
        registry.create(spark, f"{folder}/_shown/{r.as_of}-{run}.json", {"as_of": str(r.as_of), "run": run, "tables": schemas, "at": at})


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    run = write_run(tables, folder)
    show_run(tables, folder, run)
    return run


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table as its readers see them: of each date those of the run that was published last."""
    last = Window.partitionBy("as_of").orderBy(F.desc("at"), "run")
    shown = registry.records(spark, f"{folder}/_shown", SHOWN).where(F.map_contains_key("tables", name))
    shown = shown.withColumn("__k", F.row_number().over(last)).where("__k = 1").select("as_of", "run", F.col("tables")[name].alias("kinds"))
    kinds = shown.agg(F.max("kinds")).first()[0]
    rows = spark.read.schema(f"{kinds}, run string, as_of date").csv(f"{folder}/{name}", header=True, nullValue="")
    return rows.join(shown.select("as_of", "run"), ["as_of", "run"], "left_semi").drop("run")
