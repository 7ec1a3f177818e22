"""Quantities of single messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators import exact
from busloom.settings import EPS

#: Numbers seq of a capture's frames that are put in order at once.
PART = 65_536


def payload_entropy(b: Column) -> Column:
    """Bits of entropy of the bytes present (absent ones are -1); 0 without any."""
    present = F.filter(b, lambda v: v >= 0)
    of = lambda n, count: F.element_at(F.array(*[F.array(*[F.lit(exact.bits_of(c, m) if m else 0.0) for c in range(m + 1)]) for m in range(9)]), n + 1)[count]
    count = lambda all_, x: F.size(F.filter(all_, lambda v: v == x))
    return exact.let(present, lambda p: F.aggregate(F.array_distinct(p), F.lit(0.0), lambda a, x: a + of(F.size(p), count(p, x))))


def hamming(b: Column, before: Column) -> Column:
    """Positions that differ; an absent byte differs from a present one. Null without a frame before."""
    return F.size(F.filter(F.zip_with(b, before, lambda x, y: x != y), lambda d: d)).cast("double")


def placed(frames: DataFrame) -> DataFrame:
    """Adds ord and n_capture, a frame's number from 0 and the frames of its capture, and dt, seconds since the frame before (0 at first).

    A capture is cut into parts of PART numbers seq; only the parts' counts and last times are put in order along it.
    seq must not repeat within a capture.
    """
    dealt = frames.withColumn("_part", F.floor(F.col("seq") / PART))
    along = Window.partitionBy("capture").orderBy("_part")
    parts = dealt.groupBy("capture", "_part").agg(F.count(F.lit(1)).alias("_c"), F.max_by("us", "seq").alias("_last"))
    parts = parts.select("capture", "_part", (F.sum("_c").over(along) - F.col("_c")).alias("_before"), F.lag("_last").over(along).alias("_us"), F.sum("_c").over(Window.partitionBy("capture")).alias("n_capture"))
    within = Window.partitionBy("capture", "_part").orderBy("seq")
    rows = dealt.join(parts, ["capture", "_part"])
    gap = F.col("us") - F.coalesce(F.lag("us").over(within), F.col("_us"))
    return rows.select(*frames.columns, (F.col("_before") + F.row_number().over(within) - 1).alias("ord"), "n_capture", F.coalesce(gap / 1e6, F.lit(0.0)).alias("dt"))


def per_message(frames: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ordinal and number in the capture, dt, dt_id, ham, period_ratio, unseen, dlc_mismatch, ent, allzero, allff.

    Missing is NULL throughout. Two orders: the capture's (seq), and each identifier's by time (us, seq).
    """
    same = Window.partitionBy("capture", "aid").orderBy("us", "seq")
    rows = (
        placed(frames)
        .withColumn("dt_id", (F.col("us") - F.lag("us").over(same)) / 1e6)
        .withColumn("_b", F.lag("b").over(same))
    )
    known = ids.select("vehicle", "aid", "period", "ref_dlc", F.lit(1).alias("_seen"))
    present = F.filter("b", lambda v: v >= 0)
    return (
        rows.join(known, ["vehicle", "aid"], "left")
        .withColumn("ham", F.when(F.col("_b").isNotNull(), hamming(F.col("b"), F.col("_b"))))
        .withColumn("period_ratio", F.col("dt_id") / (F.col("period") + EPS))
        .withColumn("unseen", F.when(F.col("_seen").isNull(), 1.0).otherwise(0.0))
        .withColumn("dlc_mismatch", F.when(F.col("ref_dlc") != F.col("dlc"), 1.0).otherwise(0.0))
        .withColumn("ent", payload_entropy(F.col("b")))
        .withColumn("allzero", F.when((F.size(present) > 0) & F.forall(present, lambda v: v == 0), 1.0).otherwise(0.0))
        .withColumn("allff", F.when((F.size(present) > 0) & F.forall(present, lambda v: v == 255), 1.0).otherwise(0.0))
        .drop("_b", "_seen")
    )
