"""Rule detectors: robust z-scores of single features and of panels, and benign-quantile surprisal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import ordered

#: Feature and sign of each single-feature rule; the panels of the combined rules: fixed values of the detectors.
SINGLE = {
    "Rule:Periodicity": ("pr_absdev_max", 1),
    "Rule:BusLoad": ("bus_rate_norm", 1),
    "Rule:IDEntropy": ("id_entropy", -1),
    "Rule:Hamming": ("ham_mean", 1),
    "Rule:Staleness": ("stale_max", 1),
}
HIGH = "pr_absdev_max pr_gt_two pr_lt_half unseen_rate bus_rate_norm dlc_mismatch_rate ham_mean dt_cv id_max_share allff_frac stale_max".split()
TWO_SIDED = "id_entropy id_unique_frac dt_mean_norm ent_mean".split()
#: The panels where a window is all there is: no staleness, and the plain mean gap.
HIGH34, TWO_SIDED34 = [c for c in HIGH if c != "stale_max"], ["dt_mean" if c == "dt_mean_norm" else c for c in TWO_SIDED]
#: Scale of the unseen-identifier rate.
UNSEEN_SCALE = 1000.0


def melted(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, x), a row for each feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.x")


def reference(long: DataFrame, group: list[str]) -> DataFrame:
    """Median and scale (interquartile range, 1e-6 at least) of each feature of a group."""
    p = ordered.quantiles(long, [*group, "feature"], "x", [0.25, 0.5, 0.75], "p")
    return p.select(*group, "feature", F.col("p")[1].alias("med"), F.greatest(F.col("p")[2] - F.col("p")[0], F.lit(1e-6)).alias("scale"))


def z_scores(long: DataFrame, fitted: DataFrame, group: list[str]) -> DataFrame:
    return long.join(fitted, [*group, "feature"]).withColumn("z", (F.col("x") - F.col("med")) / F.col("scale")).drop("med", "scale")


def rule_scores(z: DataFrame, keys: list[str], high: list[str] = HIGH, two_sided: list[str] = TWO_SIDED) -> DataFrame:
    """(keys, model, score) of the single-feature rules and the union, from one row for each key and feature."""
    panel = F.when(F.col("feature").isin(high), F.col("z")).when(F.col("feature").isin(two_sided), F.abs("z"))
    one = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    wide = z.groupBy(*keys).agg(*[(one(f, "z") * sign).alias(m) for m, (f, sign) in SINGLE.items()], (one("unseen_rate", "x") * UNSEEN_SCALE).alias("Rule:UnseenID"), F.max(panel).alias("Rule:Combined"))
    return wide.unpivot(keys, [*SINGLE, "Rule:UnseenID", "Rule:Combined"], "model", "score")


def ecdf(rows: DataFrame, group: list[str], value: str, is_reference: str, out: str) -> DataFrame:
    """Adds out: how many of the group's reference values are <= value. A running sum over distinct values, no range join.

    Null values stay, with no count.
    """
    steps = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(F.col(is_reference).cast("long")).alias("_c"))
    return rows.join(ordered.running(steps, group, value, {out: "_c"}).drop("_c"), [*group, value], "left")


def quantile_scores(z: DataFrame, keys: list[str], group: list[str], high: list[str] = HIGH, two_sided: list[str] = TWO_SIDED) -> DataFrame:
    """(keys, score) of the quantile union: z has rows with is_ref (to fit on) and without (to score).

    Of each panel feature: surprisal -ln(1 - F) at F = (reference values <= z) / (n + 1), and beyond the largest one
    ln1p of the excess in units of (largest - 99th percentile). The score is the largest over the panel.
    """
    v = F.when(F.col("feature").isin(two_sided), F.abs("z")).otherwise(F.col("z"))
    rows = z.where(F.col("feature").isin(*high, *two_sided)).withColumn("v", v)
    fitted = rows.where("is_ref").groupBy(*group, "feature").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    p99 = ordered.quantiles(rows.where("is_ref"), [*group, "feature"], "v", [0.99], "p99").withColumn("p99", F.col("p99")[0])
    counted = ecdf(rows, [*group, "feature"], "v", "is_ref", "below").where("NOT is_ref").join(fitted.join(p99, [*group, "feature"]), [*group, "feature"])
    excess = F.greatest(F.lit(0.0), (F.col("v") - F.col("top")) / F.greatest(F.col("top") - F.col("p99"), F.lit(1e-9)))
    surprisal = -F.log(1 - F.col("below") / (F.col("n") + 1.0)) + F.log1p(excess)
    return counted.withColumn("s", surprisal).groupBy(*keys).agg(F.max("s").alias("score"))
