"""Training, calibration and evaluation windows; bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import ordered


def cross(labelled: DataFrame) -> DataFrame:
    """Leave-one-vehicle-out flags: calibration is attack-free and early, evaluation late or attacked."""
    return labelled.withColumn("is_calib", (F.col("y") == 0) & (F.col("q") <= 1)).withColumn("is_eval", (F.col("q") >= 2) | (F.col("y") == 1))


def in_domain(labelled: DataFrame, fold: int) -> DataFrame:
    """Two folds within a vehicle: trained on one half, calibrated on the next quarter, evaluated on the rest."""
    q, y = F.col("q"), F.col("y")
    train, calib, last = (q <= 1, 2, 3) if fold == 0 else (q >= 2, 1, 0)
    return labelled.withColumn("is_train", train).withColumn("is_calib", (y == 0) & (q == calib)).withColumn("is_eval", (q == last) | ((y == 1) & (q == calib)))


def hash_order(*keys: str, seed: str):
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


def capped(rows: DataFrame, group: list[str], key: list[str], cap: int, seed: str) -> DataFrame:
    """At most cap rows of each group: up to half of them with y = 1, the rest with y = 0, by a seeded hash of the key.

    Groups of up to cap rows stay whole. Only counts meet by group; the ranks are taken within (group, y).
    """
    counts = rows.groupBy(*group).agg(F.sum("y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    pos = F.least(F.col("_p"), F.floor(F.lit(cap / 2)))
    quota = F.when(F.col("_n") <= cap, F.col("_n")).when(F.col("y") == 1, pos).otherwise(F.least(F.col("_n") - F.col("_p"), cap - pos))
    return _taken(rows.join(counts, group).withColumn("_q", quota), group, key, seed)


def matched(rows: DataFrame, group: list[str], key: list[str], total: int, positives: int, seed: str) -> DataFrame:
    """total rows of each group, `positives` of them with y = 1, as far as there are so many."""
    counts = rows.groupBy(*group).agg(F.sum("y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    pos = F.least(F.col("_p"), F.lit(positives))
    quota = F.when(F.col("y") == 1, pos).otherwise(F.least(F.col("_n") - F.col("_p"), F.lit(total) - pos))
    return _taken(rows.join(counts, group).withColumn("_q", quota), group, key, seed)


def _taken(rows: DataFrame, group: list[str], key: list[str], seed: str) -> DataFrame:
    placed = ordered.numbered(rows, [*group, "y"], hash_order(*key, seed=seed), key, "_i")
    return placed.where(F.col("_i") <= F.col("_q")).drop("_i", "_q", "_p", "_n")


def stratified_folds(rows: DataFrame, folds: int, key: list[str], seed: str) -> DataFrame:
    """Adds fold: each class dealt evenly, in the order of a seeded hash."""
    placed = ordered.numbered(rows, ["y"], hash_order(*key, seed=seed), key, "_i")
    return placed.withColumn("fold", ((F.col("_i") - 1) % folds).cast("int")).drop("_i")


def pools(windows: DataFrame) -> DataFrame:
    """Every other vehicle's windows, for each target."""
    targets = windows.select(F.col("vehicle").alias("target")).distinct()
    return windows.join(targets, F.col("vehicle") != F.col("target"))
