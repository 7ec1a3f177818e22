"""Writers: feature stores, CSV and JSON tables, partial rewrites and resumable jobs."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _local_root() -> str:
    """One folder for all local sessions of this process."""
    return "file://" + tempfile.mkdtemp(prefix="busloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names.

    Where that is unset, a local master gets a temporary folder, and a cluster an error. No setting is changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_store(df: DataFrame, path: str, by: str = "vehicle") -> DataFrame:
    """A Parquet store partitioned by vehicle, read again; readers of one vehicle open its folder alone."""
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> DataFrame:
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def read_csv_files(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """All files that match, with each row's file name."""
    return spark.read.schema(schema).option("header", True).csv(pattern).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def replace_rows(store: DataFrame, fresh: DataFrame, is_old, path: str) -> DataFrame:
    """Drops the rows is_old marks, appends fresh ones, and writes the whole to another path."""
    store.where(~is_old).unionByName(fresh, allowMissingColumns=True).write.parquet(path)
    return store.sparkSession.read.parquet(path)


def pending(specs: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """Job specs without a finished result."""
    return specs.join(finished.select(*key).distinct(), key, "left_anti")


def summary_json(small: DataFrame) -> str:
    """A small report as JSON text (one row for each model and vehicle at most)."""
    return json.dumps([r.asDict(recursive=True) for r in small.collect()], sort_keys=True)
