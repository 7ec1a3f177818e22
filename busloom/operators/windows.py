"""Windows of a fixed number of messages and the two feature tables over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators import exact
from busloom.settings import EPS, Settings

WINDOW = ["vehicle", "capture", "family", "widx"]
#: The identifier-free features, in the order of the feature table; a fixed list.
FS_B = (
    "dt_mean dt_std dt_cv dt_p95 dt_max bus_rate_norm idle_frac burstiness id_entropy id_entropy_norm id_unique_frac id_max_share "
    "unseen_rate dlc_mismatch_rate pr_mean pr_std pr_p05 pr_p95 pr_lt_half pr_gt_two pr_absdev_mean pr_absdev_max dtid_nan_frac "
    "ham_mean ham_std ham_max ham_zero_frac ent_mean ent_std ent_min allzero_frac allff_frac dlc_mean dlc_std stale_max stale_frac "
    "dt_mean_norm dt_p95_norm dt_max_norm id_unique_norm"
).split()
#: Columns of messages whose means and deviations are added up in the window's order, and their short names.
ADDED = {"dt": "dt", "period_ratio": "pr", "ham": "ham", "ent": "ent", "dlc": "dlc"}
#: Its first 34, of windows alone.
FS_B34 = FS_B[:34]
FS_A_RAW = "aid_mean aid_std aid_min aid_max aid_p25 aid_p75 dt_mean dt_std dt_max dlc_mean dlc_std".split() + [f"b{i}_mean" for i in range(8)] + [f"b{i}_std" for i in range(8)]


def windowed(messages: DataFrame, s: Settings) -> DataFrame:
    """Adds widx and keeps whole windows of captures that have two and more."""
    whole = F.floor(F.col("n_capture") / s.window)
    return messages.withColumn("widx", F.floor(F.col("ord") / s.window)).where((F.col("widx") < whole) & (whole >= 2))


def _finite(c: Column) -> Column:
    return F.coalesce(F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c), F.lit(0.0))


def identifier_stats(w: DataFrame, s: Settings) -> DataFrame:
    """Entropy, distinct identifiers and largest share of a window, by counts of identifiers."""
    share = F.col("c") / F.lit(float(s.window))
    return (
        w.groupBy("capture", "widx", "aid")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("capture", "widx")
        .agg(F.sum(exact.bits(F.col("c"), s.window)).alias("id_entropy"), F.count(F.lit(1)).cast("double").alias("id_unique"), F.max(share).alias("id_max_share"))
    )


def staleness(messages: DataFrame, w: DataFrame, ids: DataFrame) -> DataFrame:
    """Per window: the largest time since a periodic identifier's last arrival over its period, and the share over 3.

    An as-of lookup without a range join: arrivals and probes (window ends, one for each periodic identifier of the
    vehicle) are merged in time, arrivals first among equals, and the latest arrival carried along. An identifier that hasn't
    arrived yet is left out.
    """
    periodic = ids.where("is_periodic").select("vehicle", "aid", "period")
    ends = w.groupBy("vehicle", "capture", "widx").agg(F.max_by("us", "seq").alias("us"))
    probes = ends.join(periodic, "vehicle").select("capture", "aid", "us", F.lit(1).alias("kind"), "widx", "period", F.lit(None).cast("long").alias("at"))
    arrivals = messages.join(periodic.drop("period"), ["vehicle", "aid"], "left_semi").select(
        "capture", "aid", "us", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("widx"), F.lit(None).cast("double").alias("period"), F.col("us").alias("at")
    )
    along = Window.partitionBy("capture", "aid").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = arrivals.unionByName(probes).withColumn("at", F.last("at", ignorenulls=True).over(along)).where("kind = 1")
    stale = (F.col("us") - F.col("at")) / 1e6 / F.col("period")
    return (
        seen.withColumn("stale", stale)
        .groupBy("capture", "widx")
        .agg(F.max("stale").alias("stale_max"), (F.count(F.when(F.col("stale") > 3, 1)) / F.greatest(F.count("stale"), F.lit(1))).alias("stale_frac"))
    )


def features_b(messages: DataFrame, ids: DataFrame, vehicles: DataFrame, s: Settings) -> DataFrame:
    """The identifier-free feature table: WINDOW and the columns FS_B."""
    w = windowed(messages, s)
    n = float(s.window)
    share = lambda c: F.count(F.when(c, 1)) / F.lit(n)  # noqa: E731  of all messages, those without the value included
    dev = F.abs(F.col("period_ratio") - 1)
    basic = w.groupBy(*WINDOW).agg(
        F.array_sort(F.collect_list(F.struct("ord", *ADDED))).alias("_rows"),  # one window's messages
        F.max("dt").alias("dt_max"),
        F.avg("unseen").alias("unseen_rate"),
        F.avg("dlc_mismatch").alias("dlc_mismatch_rate"),
        share(F.col("period_ratio") < 0.5).alias("pr_lt_half"),
        share(F.col("period_ratio") > 2.0).alias("pr_gt_two"),
        F.max(dev).alias("pr_absdev_max"),
        share(F.col("dt_id").isNull()).alias("dtid_nan_frac"),
        F.max("ham").alias("ham_max"),
        share(F.col("ham") == 0).alias("ham_zero_frac"),
        F.min("ent").alias("ent_min"),
        F.avg("allzero").alias("allzero_frac"),
        F.avg("allff").alias("allff_frac"),
    )
    values = lambda c: F.transform("_rows", lambda r: r[c].cast("double"))
    basic = basic.withColumns({f"_{c}": exact.moments(values(c)) for c in ADDED} | {"_dev": exact.moments(F.transform(values("period_ratio"), lambda x: F.abs(x - 1)))})
    basic = basic.withColumns({"_up": F.array_sort(values("dt")), "_pr": F.array_sort(F.array_compact(values("period_ratio"))), "dt_sum": F.col("_dt.total"), "pr_absdev_mean": F.col("_dev.mean")})
    basic = basic.withColumns({f"{short}_{end}": F.col(f"_{c}")[part] for c, short in ADDED.items() for end, part in (("mean", "mean"), ("std", "sd"))})
    side = vehicles.select("vehicle", "bus_rate", "n_ids")
    joined = basic.join(identifier_stats(w, s), ["capture", "widx"]).join(staleness(messages, w, ids), ["capture", "widx"], "left").join(side, "vehicle")
    ref = 1 / F.greatest("bus_rate", F.lit(EPS))
    out = (
        joined.withColumn("dt_cv", F.col("dt_std") / (F.col("dt_mean") + EPS))
        .withColumn("bus_rate_norm", F.lit(n) / (F.col("dt_sum") + EPS) / (F.col("bus_rate") + EPS))
        .withColumn("dt_p95", exact.quantile(F.col("_up"), 0.95))
        .withColumn("idle_frac", F.size(F.filter("_up", lambda x: x > F.col("dt_mean") * 3)) / F.lit(n))
        .withColumn("burstiness", (F.col("dt_std") - F.col("dt_mean")) / (F.col("dt_std") + F.col("dt_mean") + EPS))
        .withColumn("id_entropy_norm", F.col("id_entropy") / (exact.log2(F.col("id_unique"), s.window) + EPS))
        .withColumn("id_unique_frac", F.col("id_unique") / n)
        .withColumn("pr_p05", exact.quantile(F.col("_pr"), 0.05))
        .withColumn("pr_p95", exact.quantile(F.col("_pr"), 0.95))
        .withColumn("dt_mean_norm", F.col("dt_mean") / ref)
        .withColumn("dt_p95_norm", F.col("dt_p95") / ref)
        .withColumn("dt_max_norm", F.col("dt_max") / ref)
        .withColumn("id_unique_norm", F.col("id_unique") / F.greatest("n_ids", F.lit(1)))
    )
    return out.select(*WINDOW, *[_finite(F.col(c)).alias(c) for c in FS_B])


def features_a_raw(messages: DataFrame, s: Settings) -> DataFrame:
    """The identifier-coupled table's statistics: WINDOW and FS_A_RAW; an absent byte counts as 0."""
    w = windowed(messages, s)
    stats = [F.avg("aid"), F.stddev_pop("aid"), F.min("aid"), F.max("aid"), F.percentile("aid", F.lit(0.25)), F.percentile("aid", F.lit(0.75)), F.avg("dt"), F.stddev_pop("dt"), F.max("dt"), F.avg("dlc"), F.stddev_pop("dlc")]
    byte = [F.greatest(F.col("b")[i], F.lit(0)) for i in range(8)]
    stats += [F.avg(x) for x in byte] + [F.stddev_pop(x) for x in byte]
    return w.groupBy(*WINDOW).agg(*[x.cast("double").alias(c) for x, c in zip(stats, FS_A_RAW, strict=True)])


def histogram(messages: DataFrame, vocabulary: DataFrame, s: Settings, key: str = "vehicle") -> DataFrame:
    """Shares of a window's identifiers at the vocabulary's places 0 .. K-1, and K for all others: h_00 .. h_K.

    The vocabulary is keyed by vehicle (its own), or by target: then each window counts once for each target.
    """
    w, k = windowed(messages, s), s.vocabulary
    places = vocabulary.select(key, "aid", "pos")
    if key == "vehicle":
        coded, by = w.join(places, ["vehicle", "aid"], "left"), WINDOW
    else:
        coded = w.join(places.select(key).distinct(), F.col(key) == F.col("vehicle")).join(places, [key, "aid"], "left")
        by = WINDOW
    at = F.coalesce("pos", F.lit(k))
    return coded.groupBy(*by).agg(*[(F.count(F.when(at == i, 1)) / F.lit(float(s.window))).alias(f"h_{i:02d}") for i in range(k + 1)])


def features_a(raw: DataFrame, messages: DataFrame, places: DataFrame, s: Settings) -> DataFrame:
    """The identifier-coupled table: target, WINDOW, FS_A_RAW and h_00 .. h_K, each window once for each target of places
    (target, aid, pos).

    Identifiers are counted once a window; a target's vocabulary is looked up from these counts.
    """
    k = s.vocabulary
    counts = windowed(messages, s).groupBy(*WINDOW, "aid").agg(F.count(F.lit(1)).alias("c"))
    hits = counts.join(places.select("target", "aid", "pos"), "aid").groupBy("target", *WINDOW)
    hits = hits.agg(*[F.sum(F.when(F.col("pos") == i, F.col("c")).otherwise(0)).alias(f"h_{i:02d}") for i in range(k)])
    every = raw.crossJoin(F.broadcast(places.select("target").distinct()))  # a row a vehicle
    shares = [F.coalesce(F.col(f"h_{i:02d}"), F.lit(0)) for i in range(k)]
    rest = F.lit(s.window) - sum(shares[1:], shares[0])
    joined = every.join(hits, ["target", *WINDOW], "left")
    return joined.select("target", *WINDOW, *FS_A_RAW, *[(c / F.lit(float(s.window))).alias(f"h_{i:02d}") for i, c in enumerate([*shares, rest])])


def features_a_rank(raw: DataFrame, own: DataFrame) -> DataFrame:
    """The same columns with places by each vehicle's own ranks: the statistics joined with the histogram of its own vocabulary."""
    return raw.join(own, WINDOW)


def labels(w: DataFrame) -> DataFrame:
    """WINDOW and y: 1 with an attacked message, or where the closed suspension interval meets the window."""
    hit = (F.max_by("us", "seq") >= F.first("s0")) & (F.min_by("us", "seq") <= F.first("s1"))
    return w.groupBy(*WINDOW).agg(F.greatest(F.max("y"), F.coalesce(hit.cast("int"), F.lit(0))).alias("y"))


def quarters(labelled: DataFrame) -> DataFrame:
    """Adds q, 0 to 3: the quarter of a window by time among its capture's windows of the same label."""
    w = Window.partitionBy("capture", "y")
    i = F.row_number().over(w.orderBy("widx")) - 1
    return labelled.withColumn("q", F.floor(4 * i / F.count(F.lit(1)).over(w)).cast("int"))


def window_seconds(frames: DataFrame, s: Settings) -> DataFrame:
    """Per vehicle the mean seconds of a window, over attack-free captures and over all, of captures with windows."""
    per = frames.groupBy("vehicle", "capture", "family").agg(F.floor(F.count(F.lit(1)) / s.window).alias("k"), ((F.max_by("us", "seq") - F.min_by("us", "seq")) / 1e6).alias("dur")).where("k >= 2")
    own = F.col("family") == "benign"
    total = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0))
    return per.groupBy("vehicle").agg(
        (total(own, "dur") / F.greatest(total(own, "k"), F.lit(1))).alias("win_seconds"), (F.sum("dur") / F.greatest(F.sum("k"), F.lit(1))).alias("win_seconds_all")
    )


def trailing(windows: DataFrame, value: str, length: int, out: str) -> DataFrame:
    """Adds out: the values of the `length` windows that end with each, the capture's first one repeated before its start."""
    order = Window.partitionBy("capture").orderBy("widx")
    got = F.collect_list(value).over(order.rowsBetween(1 - length, 0))
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return windows.withColumn(out, F.concat(F.array_repeat(first, F.lit(length) - F.size(got)), got))
