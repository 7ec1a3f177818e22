"""Attack-free reference profiles of vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators import ordered
from busloom.settings import EPS, Settings


def benign(frames: DataFrame) -> DataFrame:
    return frames.where("family = 'benign'")


def id_profile(frames: DataFrame, s: Settings) -> DataFrame:
    """Per vehicle and identifier: count, modal DLC (the lowest of equally frequent ones), median and spread of the
    positive gaps within captures (seconds), and whether it is periodic."""
    b = benign(frames)
    last = F.lag("us").over(Window.partitionBy("vehicle", "capture", "aid").orderBy("us", "seq"))
    gaps = b.withColumn("gap", (F.col("us") - last) / 1e6)
    spread = ordered.quantiles(gaps.where("gap > 0"), ["vehicle", "aid"], "gap", [0.25, 0.5, 0.75], "p")
    timing = b.groupBy("vehicle", "aid").agg(F.count(F.lit(1)).alias("cnt")).join(spread, ["vehicle", "aid"], "left")
    by_dlc = b.groupBy("vehicle", "aid", "dlc").agg(F.count(F.lit(1)).alias("n"))
    modal = by_dlc.groupBy("vehicle", "aid").agg(F.min(F.struct((-F.col("n")).alias("n"), "dlc"))["dlc"].alias("ref_dlc"))
    out = timing.select("vehicle", "aid", "cnt", F.col("p")[1].alias("period"), (F.col("p")[2] - F.col("p")[0]).alias("iqr")).join(modal, ["vehicle", "aid"])
    periodic = (F.col("cnt") >= s.min_count) & (F.col("period") > 0) & (F.col("period") <= s.max_period) & (F.col("iqr") / F.greatest("period", F.lit(EPS)) <= s.max_rel_iqr)
    return out.withColumn("is_periodic", F.coalesce(periodic, F.lit(False)))


def vehicle_profile(frames: DataFrame) -> DataFrame:
    """Per vehicle: attack-free frames, seconds (captures of one frame add none), frames a second and identifiers."""
    captures = benign(frames).groupBy("vehicle", "capture").agg(F.count(F.lit(1)).alias("n"), ((F.max("us") - F.min("us")) / 1e6).alias("dur"))
    rates = captures.groupBy("vehicle").agg(F.sum("n").alias("n_frames"), F.sum("dur").alias("seconds"))
    ids = benign(frames).groupBy("vehicle").agg(F.countDistinct("aid").alias("n_ids"))
    return rates.withColumn("bus_rate", F.col("n_frames") / F.greatest("seconds", F.lit(1e-6))).join(ids, "vehicle")


def vocabulary(frames: DataFrame, top: int) -> DataFrame:
    """Per vehicle the `top` most frequent attack-free identifiers and their place (0 first); ties go to the smaller."""
    counts = benign(frames).groupBy("vehicle", "aid").agg(F.count(F.lit(1)).alias("cnt"))
    place = F.row_number().over(Window.partitionBy("vehicle").orderBy(F.desc("cnt"), "aid")) - 1
    return counts.withColumn("pos", place).where(F.col("pos") < top)


def pooled_vocabulary(frames: DataFrame, top: int) -> DataFrame:
    """For each target vehicle the `top` identifiers by the sum of the other vehicles' shares."""
    counts = benign(frames).groupBy("vehicle", "aid").agg(F.count(F.lit(1)).alias("cnt"))
    shares = counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("vehicle")))
    targets = counts.select(F.col("vehicle").alias("target")).distinct()
    pooled = shares.join(targets, F.col("vehicle") != F.col("target")).groupBy("target", "aid").agg(F.sum("share").alias("share"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("share", 9)), "aid")) - 1
    return pooled.withColumn("pos", place).where(F.col("pos") < top)


def vocabulary_of(frames: DataFrame, vehicles: tuple[str, ...], top: int) -> DataFrame:
    """The `top` identifiers by the sum of these vehicles' shares: aid and pos."""
    counts = benign(frames).where(F.col("vehicle").isin(*vehicles)).groupBy("vehicle", "aid").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("vehicle").agg(F.sum("cnt").alias("total"))
    pooled = counts.join(totals, "vehicle").groupBy("aid").agg(F.sum(F.col("cnt") / F.col("total")).alias("share"))
    first = pooled.orderBy(F.desc(F.round("share", 9)), "aid").limit(top)  # as large as the vocabulary
    return first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.round("share", 9)), "aid")) - 1).select("aid", "pos")
