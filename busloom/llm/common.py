"""What the corpus operators share: the shared work folder, staging tables, hashing, distributed ranks."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bits of the hashes that order rows; they stay positive in a signed long.
HASH_BITS = 60


@functools.cache
def _local_root() -> str:
    """One folder for all local sessions of this process."""
    return "file://" + tempfile.mkdtemp(prefix="busloom-")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI inside the folder that driver and executors share.

    The session's spark.checkpoint.dir names it. Where that is unset, a local master (tests, a laptop) gets a temporary
    folder; on a cluster that is an error, as executors would not see the driver's folder. No setting is changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there and no task is run twice."""
    path = f"{folder or workspace(df.sparkSession, 'stage')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_hash(*cols: Column | str, seed: str) -> Column:
    """A 60-bit hash that other SQL engines can compute too: the first 15 hex digits of an md5. Nulls count as empty."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def bins_for(rows: int, per_bin: int = 50_000, least: int = 64, most: int = 65_536) -> int:
    """A power of two so that a bin of uniformly hashed rows holds about per_bin of them."""
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(1, rows) / per_bin)))))


def ranked(df: DataFrame, by: list[str], bin_col: str, order: list, out: str) -> DataFrame:
    """Adds out: the row's number from 0 within its group `by`, in the order of (bin_col, *order).

    No group meets in one task: rows are dealt by (by, bin) and only the bins' counts are summed along a group.
    bin_col must be monotone in the wanted order. Its bins are few (bins_for), so the one window without
    a key, when by is empty, reads that many rows at most.
    """
    counts = df.groupBy(*by, bin_col).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*by).orderBy(bin_col) if by else Window.orderBy(bin_col)
    offsets = counts.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).drop("_n")
    joined = df.join(offsets, [*by, bin_col])
    within = Window.partitionBy(*by, bin_col).orderBy(*order)
    return joined.withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_before")


def with_column(df: DataFrame, make, kind: DataType, out: str, reads: str) -> DataFrame:
    """Adds out, or replaces it: make(batches, position of reads) gives Arrow batches of df's columns but out, and out after them.

    Columns are numbered on the way, as mapInArrow can't see names with dots.
    """
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower() or f.name == reads]
    at = [f.name for f in kept].index(reads)
    shape = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate([*kept, StructField(out, kind)])])
    numbered = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    return numbered.mapInArrow(lambda batches: make(batches, at), shape).toDF(*[f.name for f in kept], out)


def extended(columns: list, more) -> pa.RecordBatch:
    """A batch of numbered columns, with one after them."""
    return pa.RecordBatch.from_arrays([*columns, more], names=[f"c{i}" for i in range(len(columns) + 1)])
