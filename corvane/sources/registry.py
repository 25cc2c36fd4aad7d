"""Small records that outlive a run: experiments, holdout checks and what a report has published.

A record is one JSON file, created exclusively: where two callers make the same one, one of them gets it. Files that are
named by chance never meet. That is as strong as the file system's exclusive creation; within one driver a lock adds to it.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_lock = threading.Lock()
EXPERIMENTS = "id string, family string, spec string, metrics map<string,double>, at timestamp"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, record: dict) -> bool:
    """Writes record as the JSON file path if there is none; tells whether it did."""
    p, fs = _path(spark, path)
    with _lock:
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
    return True


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All records of a folder; none where it isn't there yet."""
    p, fs = _path(spark, folder)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(folder)


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def spec_id(spec: dict, family: str) -> str:
    """First 12 characters of the SHA-1 of the specification with its family, keys in order."""
    return hashlib.sha1(json.dumps({**spec, "family": family}, sort_keys=True, default=str).encode()).hexdigest()[:12]


def log_experiment(spark: SparkSession, folder: str, family: str, spec: dict, metrics: dict[str, float]) -> str:
    """Appends one trial, whatever came of it, and returns its id. Equal trials are logged each."""
    key = spec_id(spec, family)
    create(spark, f"{folder}/{key}-{uuid.uuid4().hex}.json", {"id": key, "family": family, "spec": json.dumps(spec, sort_keys=True), "metrics": metrics, "at": now()})
    return key


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, EXPERIMENTS)


def count_trials(spark: SparkSession, folder: str, family: str) -> int:
    """Trials of a family so far; what the best of them is judged by."""
    return experiments(spark, folder).where(f"family = '{family}'").count()
