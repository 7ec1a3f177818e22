"""Thresholds from false-alarm budgets, confusion counts, event recall, ROC-AUC and average precision, for all jobs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.operators import ordered
from busloom.settings import ALARM_BUDGETS, RATE_TARGETS

JOB = ["target", "model"]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def operating_points(sizes: DataFrame) -> DataFrame:
    """(job, n_calib, win_seconds) -> a row for each tag with k, the alarms that the calibration windows may raise, and resolvable.

    An alarm budget allows min(1, budget * win_seconds / 3600) of the windows; one that allows less than one isn't resolvable.
    """
    tags = F.array(*[F.struct(F.lit(f"fa{int(b)}").alias("tag"), F.lit(b).alias("budget"), F.lit(True).alias("hourly")) for b in ALARM_BUDGETS], *[F.struct(F.lit(f"fpr{r:g}").alias("tag"), F.lit(r).alias("budget"), F.lit(False).alias("hourly")) for r in RATE_TARGETS])
    share = F.when(F.col("p.hourly"), F.least(F.greatest(F.col("p.budget") * F.col("win_seconds") / 3600, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("p.budget"))
    return (
        sizes.withColumn("p", F.explode(tags))
        .withColumn("allowed", share)
        .select(*sizes.columns, F.col("p.tag").alias("tag"), "allowed", F.floor(F.col("allowed") * F.col("n_calib")).alias("k"), (F.col("allowed") * F.col("n_calib") >= 1).alias("resolvable"))
    )


def thresholds(calib: DataFrame, points: DataFrame, job: list[str] = JOB) -> DataFrame:
    """Per job and tag thr: the least calibration score that at most k of them reach, NULL if there is none; and top, the largest.

    A window alarms where score >= thr, or, without thr, where score > top.
    """
    kept = calib.where(finite(F.col("score")))
    steps = kept.groupBy(*job, "score").agg(F.count(F.lit(1)).alias("c"))
    steps = ordered.running(steps, job, "score", {"ge": "c"}, descending=True)
    return (
        points.join(steps, job, "left")
        .groupBy(*points.columns)
        .agg(F.min(F.when(F.col("ge") <= F.col("k"), F.col("score"))).alias("thr"), F.max("score").alias("top"))
    )


def alarms(scored: DataFrame, limits: DataFrame, job: list[str] = JOB) -> DataFrame:
    """Evaluation rows with pred for each tag; scores that aren't finite count as lowest."""
    s = F.when(finite(F.col("score")), F.col("score")).otherwise(F.lit(-1e30))
    fired = F.when(F.col("thr").isNotNull(), s >= F.col("thr")).otherwise(F.col("top").isNotNull() & (s > F.col("top")))
    return scored.join(limits, job).withColumn("pred", fired.cast("int"))


def confusion(predicted: DataFrame, job: list[str] = JOB) -> DataFrame:
    """Counts, recall, precision, false-positive rate and false alarms an hour of each job and tag."""
    count = lambda y: F.sum(F.when((F.col("pred") == 1) & (F.col("y") == y), 1).otherwise(0))
    out = predicted.groupBy(*job, "tag").agg(count(1).alias("tp"), count(0).alias("fp"), F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"), F.first("win_seconds").alias("win_seconds"))
    fpr = F.col("fp") / F.greatest(F.col("n") - F.col("pos"), F.lit(1))
    return (
        out.withColumn("recall", F.col("tp") / F.greatest("pos", F.lit(1)))
        .withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).otherwise(0.0))
        .withColumn("fpr", fpr)
        .withColumn("fa_per_hour", fpr * 3600 / F.greatest("win_seconds", F.lit(1e-9)))
    )


def family_recall(predicted: DataFrame, job: list[str] = JOB) -> DataFrame:
    return predicted.where("y = 1").groupBy(*job, "tag", "family").agg(F.avg("pred").alias("recall"), F.count(F.lit(1)).alias("n"))


def event_recall(predicted: DataFrame, job: list[str] = JOB) -> DataFrame:
    """A capture with an attacked window is an event, found if one of those windows alarms. By family, and 'all'."""
    events = predicted.where("y = 1").groupBy(*job, "tag", "family", "capture").agg(F.max("pred").alias("hit"))
    each = F.explode(F.array(F.col("family"), F.lit("all"))).alias("family")
    return events.select(*job, "tag", each, "hit").groupBy(*job, "tag", "family").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("events"), F.avg("hit").alias("event_recall"))


def ranking(scored: DataFrame, job: list[str] = JOB, weight: str | None = None) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (the step sum of average precision over distinct scores) of each job.

    Both come from one pass over the distinct scores, positives and negatives summed for each; NULL with one class only.
    """
    w = F.col(weight) if weight else F.lit(1)
    s = F.when(finite(F.col("score")), F.col("score")).otherwise(F.lit(-1e30))
    steps = scored.withColumn("s", s).groupBy(*job, "s").agg(F.sum(w * F.col("y")).alias("p"), F.sum(w * (1 - F.col("y"))).alias("m"))
    steps = ordered.running(steps, job, "s", {"tp": "p", "fp": "m"}, descending=True)
    sums = steps.groupBy(*job).agg(
        F.sum("p").alias("pos"),
        F.sum("m").alias("neg"),
        F.sum(F.col("m") * (F.col("tp") - F.col("p") / 2.0)).alias("won"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))).otherwise(0.0)).alias("area"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(*job, "pos", "neg", F.when(both, F.col("won") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(both, F.col("area") / F.col("pos")).alias("pr_auc"))
