"""Report tables over long results (protocol, fold, feature_set, model, vehicle, metric, value), tests and bootstraps."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_means(results: DataFrame) -> DataFrame:
    return results.groupBy("protocol", "feature_set", "model", "vehicle", "metric").agg(F.avg("value").alias("value"))


def headline(results: DataFrame, metric: str) -> DataFrame:
    """Per feature set and model the mean, least and deviation over vehicles across, beside the base model's mean within."""
    m = fold_means(results).where(F.col("metric") == metric)
    cross = m.where("protocol = 'cross'").groupBy("feature_set", "model").agg(
        F.avg("value").alias("cross_mean"), F.min("value").alias("cross_min"), F.stddev_samp("value").alias("cross_sd"), F.count(F.lit(1)).alias("n_vehicles")
    )
    within = m.where("protocol = 'within'").groupBy("feature_set", F.col("model").alias("base")).agg(F.avg("value").alias("within_mean"))
    joined = cross.withColumn("base", F.regexp_replace("model", "@target$", "")).join(within, ["feature_set", "base"], "left")
    return joined.withColumn("gap", F.col("within_mean") - F.col("cross_mean")).withColumn("retention", 100 * F.col("cross_mean") / F.greatest("within_mean", F.lit(1e-9))).drop("base")


def by_vehicle(results: DataFrame, metric: str, vehicles: list[str]) -> DataFrame:
    m = fold_means(results).where((F.col("metric") == metric) & (F.col("protocol") == "cross"))
    return m.groupBy("feature_set", "model").pivot("vehicle", vehicles).agg(F.avg("value"))


def average_rank(group: list[str], value: str) -> Column:
    """Rank from the largest, ties sharing the mean of their places."""
    w = Window.partitionBy(*group).orderBy(F.desc(value))
    ties = Window.partitionBy(*group, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def rank_instability(values: DataFrame) -> DataFrame:
    """(model, vehicle, value) -> mean, best and worst rank of each model over the vehicles, and their range."""
    ranked = values.withColumn("r", average_rank(["vehicle"], "value"))
    return ranked.groupBy("model").agg(F.avg("r").alias("mean_rank"), F.min("r").alias("best_rank"), F.max("r").alias("worst_rank"), (F.max("r") - F.min("r")).alias("rank_range"), F.avg("value").alias("mean_value"))


def resolvability(sizes: DataFrame) -> DataFrame:
    """Windows an hour and the least calibration sizes that one and ten alarms an hour need."""
    rate = 3600 / F.col("win_seconds")
    return sizes.withColumn("windows_per_hour", rate).withColumn("min_calib_fa1", F.ceil(rate)).withColumn("min_calib_fa10", F.ceil(rate / 10))


def signed_ranks(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Wilcoxon's statistic of a - b by group: zeros dropped, absolute differences ranked with shared ties."""
    d = pairs.withColumn("d", F.col(a) - F.col(b)).where(F.col("d").isNotNull())
    size = Window.partitionBy(*by).orderBy(F.abs("d"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, F.abs("d")))
    moved = d.where("d <> 0").withColumn("r", F.rank().over(size) + (ties - 1) / 2.0).withColumn("t", ties)
    stats = moved.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).alias("tie_sum")
    )
    plain = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.5)).alias("median_diff"), F.avg((F.col("d") > 0).cast("int")).alias("frac_better"))
    return plain.join(stats, by, "left")


#: Pairs up to which the signed-rank test is exact where there are no ties and no zeros.
EXACT_PAIRS = 50


def signed_rank_counts(n: int) -> list[int]:
    """How many of the 2**n choices of signs give each sum of positive ranks, 0 to n (n + 1) / 2: rank by rank, each is in or out."""
    counts = [1]
    for rank in range(1, n + 1):
        shifted = [0] * rank + counts
        counts = [a + b for a, b in zip([*counts, *[0] * rank], shifted, strict=True)]
    return counts


def wilcoxon_p(n: int, w_plus: float, tie_sum: float, one_sided: bool, zeros: int = 0) -> float:
    """The signed-rank test of n differences that aren't 0; one-sided, that they tend to be positive. NaN without any.

    Exact for up to EXACT_PAIRS without ties and dropped zeros; beyond, the normal approximation with the variance corrected
    for ties and no continuity correction. tie_sum is the sum of t * t - 1 over rows that share their rank with t.
    """
    if 0 < n <= EXACT_PAIRS and not tie_sum and not zeros:
        counts, at = signed_rank_counts(n), round(w_plus)
        upper, lower = sum(counts[at:]) / 2**n, sum(counts[: at + 1]) / 2**n
        return upper if one_sided else min(1.0, 2 * min(upper, lower))
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    if variance <= 0:
        return float("nan")
    z = (w_plus - n * (n + 1) / 4) / math.sqrt(variance)
    return 0.5 * math.erfc(z / math.sqrt(2)) if one_sided else math.erfc(abs(z) / math.sqrt(2))


#: The four metrics of the paired tests: areas, and recall at the primary budget and at the false-positive rate of one in a thousand.
TESTED = ("pr_auc", "roc_auc", "recall@fa10", "recall@fpr0.001")


def comparisons(results: DataFrame, metrics: tuple[str, ...] = TESTED) -> DataFrame:
    """(comparison, metric, model, vehicle, first, second): what the paired tests compare, a row for each cell that both sides have.

    The second feature set against the first across vehicles, and for each set within against across, detectors fitted on the
    target left out there.
    """
    m = fold_means(results).where(F.col("metric").isin(*metrics))
    cell = ["metric", "model", "vehicle"]
    side = lambda protocol, fs, name: m.where((F.col("protocol") == protocol) & (F.col("feature_set") == fs)).select(*cell, F.col("value").alias(name))
    out = side("cross", "FS-B", "first").join(side("cross", "FS-A", "second"), cell).withColumn("comparison", F.lit("FS-B > FS-A across"))
    for fs in ("FS-A", "FS-B"):
        across = side("cross", fs, "second").where(~F.col("model").contains("@target"))
        out = out.unionByName(side("within", fs, "first").join(across, cell).withColumn("comparison", F.lit(f"within or across, {fs}")))
    return out


def paired_tests(results: DataFrame, metrics: tuple[str, ...] = TESTED) -> DataFrame:
    """(comparison, metric, n_pairs, mean_diff, median_diff, frac_better, p): the feature sets one-sided, the protocols two-sided.

    p is null with five pairs or fewer. Differences are taken to nine places, so that ties don't hang on an engine's last bits.
    """
    pairs = comparisons(results, metrics).withColumn("d", F.round(F.col("first") - F.col("second"), 9)).withColumn("zero", F.lit(0.0))
    stats = signed_ranks(pairs, ["comparison", "metric"], "d", "zero")

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, ties: pd.Series, n_pairs: pd.Series, one_sided: pd.Series) -> pd.Series:
        cells = zip(n.fillna(0), w.fillna(0), ties.fillna(0), n_pairs, one_sided, strict=True)
        return pd.Series([wilcoxon_p(int(a), b, c, bool(o), int(k - a)) if k > 5 else None for a, b, c, k, o in cells], dtype="float64")

    one_sided = F.col("comparison").startswith("FS-B >")
    return stats.select("comparison", "metric", "n_pairs", "mean_diff", "median_diff", "frac_better", p("n", "w_plus", F.col("tie_sum").cast("double"), "n_pairs", one_sided).alias("p"))


def draws(clusters: DataFrame, by: list[str], cluster: str, replicates: int, seed: str) -> DataFrame:
    """(by, rep, cluster, times): each replicate draws as many clusters as there are, with replacement, by the first 15 digits of
    seeded md5 hashes, which other engines can follow."""
    order = Window.partitionBy(*by).orderBy(cluster)
    numbered = clusters.select(*by, cluster).distinct().withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    drawn = numbered.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_d", (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "_i", *by)), 1, 15), 16, 10).cast("long") % F.col("_n")).cast("int"))
    picked = drawn.groupBy(*by, "rep", F.col("_d").alias("_i")).agg(F.count(F.lit(1)).alias("times"))
    return picked.join(numbered.drop("_n"), [*by, "_i"]).drop("_i")


def bootstrap_mean(values: DataFrame, by: list[str], cluster: str, replicates: int, seed: str) -> DataFrame:
    """Mean of value over clusters and its 95 % interval over resampled clusters."""
    means = draws(values, by, cluster, replicates, seed).join(values, [*by, cluster]).groupBy(*by, "rep").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    bounds = means.groupBy(*by).agg(p.alias("p")).select(*by, F.col("p")[0].alias("ci_lo"), F.col("p")[1].alias("ci_hi"))
    return values.groupBy(*by).agg(F.avg("value").alias("mean")).join(bounds, by)


def bootstrap_ranking(scored: DataFrame, by: list[str], replicates: int, seed: str) -> DataFrame:
    """95 % intervals of average precision and ROC-AUC over resampled captures; replicates of one class are left out.

    Equal scores of a capture are counted first, so that replicates multiply counts and not windows.
    """
    from busloom.operators.evaluation import ranking

    counted = scored.groupBy(*by, "capture", "score", "y").agg(F.count(F.lit(1)).alias("_c"))
    weighted = counted.join(draws(scored, by, "capture", replicates, seed), [*by, "capture"]).withColumn("_w", F.col("_c") * F.col("times"))
    each = ranking(weighted, [*by, "rep"], "_w").where("pr_auc IS NOT NULL")
    p = {c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in ("pr_auc", "roc_auc")}
    bounds = [F.col(c)[i].alias(f"{end}_{c[:-4]}") for c in p for i, end in enumerate(("lo", "hi"))]
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_boot"), *p.values()).select(*by, "n_boot", *bounds)
