"""Registry of the library's own queries and their SQL twins: one for each operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busloom.operators import evaluation, exact, learners, messages, reports, rules, splits, windows
from busloom.operators.profile import benign
from busloom.operators.windows import FS_A_RAW, FS_B, FS_B34
from busloom.plans import jobs
from busloom.plans.bus import bus, union_all
from busloom.plans.oracle import K, N, with_pieces
from busloom.sources import frames as src
from busloom.sources import logs, sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
W = "vehicle, capture, family, widx"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[exact.rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    """Registers a query; sql gives the same columns, integers as BIGINT and doubles rounded to six places."""

    def register(f):
        _QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[name] = with_pieces(sql)
        return f

    return register


def shared(name: str, sql: str, duck: str | None = None) -> None:
    """A query whose SQL text both engines read; tables are written as {events}."""
    import re

    tables = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark, sf_dir):
        return rounded(spark.sql(sql, **{t: src.table(spark, sf_dir, t) for t in tables}))

    _QUERIES[name] = run
    _SQL[name] = re.sub(r"\{(\w+)\}", r"\1", duck or sql)


def r6(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in names)


def big(*names: str) -> str:
    return ", ".join(f"{c}::BIGINT AS {c}" for c in names)


# ---- scans, sources, sinks
shared("s1_parquet_scan", "SELECT event_id, user_id, event_type FROM {events} WHERE value > 50e0")


@query("s2_narrow_scan", "SELECT event_id, length(props)::BIGINT AS n FROM events")
def _(spark, d):
    return src.table(spark, d, "events").select("event_id", F.length("props").alias("n"))


@query("s3_manifest_json", "SELECT DISTINCT capture, family, vehicle FROM fr")
def _(spark, d):
    path = sinks.scratch(spark, "manifest")
    entry = F.struct("vehicle", "family", F.col("capture").alias("name"), F.concat("capture", F.lit(".parquet")).alias("file"), F.lit("events").alias("dataset"))
    captures = src.event_frames(spark, d).select("vehicle", "family", "capture").distinct()
    captures.agg(F.to_json(F.collect_list(entry)).alias("value")).write.text(path)  # one entry a capture
    return src.read_manifest(spark, path).select(F.col("name").alias("capture"), "family", "vehicle")


@query("s1_s3_captures", "SELECT vehicle, capture, family, count(*) AS n, sum(us)::BIGINT AS us, sum(aid)::BIGINT AS aids, sum(list_sum(b))::BIGINT AS bytes, sum(y)::BIGINT AS y, coalesce(max(s0), 0)::BIGINT AS s0 FROM fr GROUP BY vehicle, capture, family")
def _(spark, d):
    frames, path = src.event_frames(spark, d), sinks.scratch(spark, "captures")
    columns = [(F.col("us") / 1e6).alias("t"), "aid", "dlc", *[F.col("b")[i].alias(f"b{i}") for i in range(8)], "y"]
    frames.select("capture", *columns).repartition("capture").write.partitionBy("capture").parquet(path)  # a folder each
    entries = frames.groupBy("vehicle", "family", "capture").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    entries = entries.select("vehicle", "family", F.col("capture").alias("name"), F.concat(F.lit("capture="), "capture").alias("file"), F.lit("events").alias("dataset"), F.when(F.col("s0").isNotNull(), F.array(F.col("s0") / 1e6, F.col("s1") / 1e6)).alias("susp_interval"))
    entries.coalesce(1).write.json(f"{path}-manifest")  # an entry a capture
    manifest = spark.read.schema(src.MANIFEST).json(f"{path}-manifest")
    got = src.read_captures(spark, path, manifest)
    counted = got.groupBy("vehicle", "capture", "family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("us").cast("decimal(20,0)")).alias("us"), F.sum("aid").alias("aids"), F.sum(F.aggregate("b", F.lit(0), lambda a, x: a + x)).alias("bytes"), F.sum("y").alias("y"), F.coalesce(F.max("s0"), F.lit(0)).alias("s0"))
    counted.write.parquet(f"{path}-counted")  # a row a capture
    counted = spark.read.schema(counted.schema).parquet(f"{path}-counted")
    largest = counted.agg(F.max(F.abs("us"))).first()[0] or 0
    return counted.withColumn("us", F.col("us").cast("long")) if largest < 2**63 else counted  # sums beyond a long stay exact decimals


@query("s4_csv_source", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(spark, d):
    return sinks.write_csv(src.table(spark, d, "nation").select("n_nationkey", "n_name"), sinks.scratch(spark, "csv"))


@query("s5_multi_file_scan", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, 'even' AS part FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, r_name, 'odd' FROM region WHERE r_regionkey % 2 = 1")
def _(spark, d):
    path = sinks.scratch(spark, "rows")
    region = src.table(spark, d, "region").select("r_regionkey", "r_name")
    for part, rest in (("even", 0), ("odd", 1)):
        region.where(F.col("r_regionkey") % 2 == rest).write.option("header", True).csv(f"{path}/{part}")
    found = spark.read.schema(region.schema).option("header", True).csv(f"{path}/*")
    return found.select("r_regionkey", "r_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("part"))


@query("s8_feature_store", f"SELECT vehicle, count(*) AS n, {r6('dt')} FROM (SELECT vehicle, avg(dt_mean_norm) AS dt, widx FROM fsb WHERE vehicle = 'v1' GROUP BY vehicle, widx) GROUP BY vehicle, dt")
def _(spark, d):
    store = sinks.write_store(bus(spark, d).features.select("vehicle", "capture", "widx", "dt_mean_norm"), sinks.scratch(spark, "store"))
    return store.where("vehicle = 'v1'").groupBy("vehicle", "widx").agg(F.avg("dt_mean_norm").alias("dt")).groupBy("vehicle", "dt").agg(F.count(F.lit(1)).alias("n"))


@query("s7_s10_score_archive", "SELECT target, model, 'ev' AS side, count(*) AS n FROM scores WHERE is_eval AND model LIKE 'Rule:%' GROUP BY target, model")
def _(spark, d):
    scores = bus(spark, d).scores
    sides = scores.where("is_eval").withColumn("side", F.lit("ev")).unionByName(scores.where("is_calib").withColumn("side", F.lit("cal")))
    archive = sinks.write_store(sides.select("target", "model", "side", "capture", "widx", "y", F.col("score").cast("float")), sinks.scratch(spark, "scores"), "side")
    return archive.where((F.col("side") == "ev") & F.col("model").startswith("Rule:")).groupBy("target", "model", "side").agg(F.count(F.lit(1)).alias("n"))


@query("s9_csv_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return sinks.write_csv(src.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), sinks.scratch(spark, "report"))


@query("s11_partial_rewrite", "SELECT model, count(*) AS n FROM (SELECT 'fresh' AS model FROM scores WHERE model = 'Rule:Hamming' UNION ALL SELECT model FROM scores WHERE model NOT LIKE 'Rule:H%') GROUP BY model")
def _(spark, d):
    rows = bus(spark, d).scores.select("target", "model", "score")
    fresh = rows.where("model = 'Rule:Hamming'").withColumn("model", F.lit("fresh"))
    return sinks.replace_rows(rows, fresh, F.col("model").startswith("Rule:H"), sinks.scratch(spark, "patched")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("s12_summary_json", "SELECT vehicle, n_frames, n_ids::BIGINT AS n_ids FROM vp")
def _(spark, d):
    text = sinks.summary_json(bus(spark, d).vehicles.select("vehicle", "n_frames", "n_ids"))  # three vehicles
    return spark.createDataFrame([(text,)], "j string").select(F.inline(F.from_json("j", "array<struct<vehicle:string,n_frames:long,n_ids:long>>")))


@query("s14_plot_table", f"SELECT target, model, {r6('pr_auc')} FROM auc")
def _(spark, d):
    return bus(spark, d).ranking.select("target", "model", "pr_auc")


@query("s15_pending_jobs", "SELECT c_mktsegment AS segment, n_name FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN nation WHERE (c_mktsegment, n_name) NOT IN (SELECT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0)")
def _(spark, d):
    customers, nation = src.table(spark, d, "customer"), src.table(spark, d, "nation")
    specs = customers.select(F.col("c_mktsegment").alias("segment")).distinct().crossJoin(F.broadcast(nation.select("n_name")))
    done = customers.where("c_acctbal > 0").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), "n_name")
    return sinks.pending(specs, done, ["segment", "n_name"])


@query("s16_attack_slice", "SELECT capture, count(*) AS n, min(seq) AS a, max(seq) AS z FROM (SELECT *, min(CASE WHEN y = 1 THEN seq END) OVER (PARTITION BY capture) AS lo, max(CASE WHEN y = 1 THEN seq END) OVER (PARTITION BY capture) AS hi FROM fr) WHERE lo IS NULL OR seq BETWEEN lo - 100 AND hi + 100 GROUP BY capture")
def _(spark, d):
    return src.attack_slice(src.event_frames(spark, d), 100).groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z"))


# ---- projections, filters
shared("f1_family_exclusion", "SELECT event_type, count(*) AS n FROM {events} WHERE event_type NOT IN ('error') GROUP BY event_type")


@query("f2_benign", "SELECT capture, count(*) AS n FROM fr WHERE family = 'benign' GROUP BY capture")
def _(spark, d):
    return benign(src.event_frames(spark, d)).groupBy("capture").agg(F.count(F.lit(1)).alias("n"))


@query("f3_f4_whole_windows", "SELECT capture, max(widx)::BIGINT + 1 AS windows, count(*) AS n FROM wl GROUP BY capture")
def _(spark, d):
    return bus(spark, d).windows.groupBy("capture").agg((F.max("widx") + 1).alias("windows"), F.count(F.lit(1)).alias("n"))


@query(
    "f5_label_repair",
    "SELECT y::BIGINT AS y, fixed::BIGINT AS fixed, count(*) AS n FROM (SELECT CASE WHEN y = 1 AND (NOT regexp_full_match(h, '[0-9A-Fa-f]*') OR length(h) % 2 <> 0) THEN 0 ELSE y END AS y, y AS fixed FROM (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, coalesce(regexp_replace(props, '[{}\" :]', '', 'g'), '') AS h FROM events)) GROUP BY 1, 2",
)
def _(spark, d):
    rows = src.table(spark, d, "events").select(F.when(F.col("event_type") == "error", 1).otherwise(0).alias("fixed"), F.regexp_replace("props", '[{}" :]', "").alias("h"))
    return rows.select(src.repaired(F.col("fixed"), F.col("h")).alias("y"), "fixed").groupBy("y", "fixed").agg(F.count(F.lit(1)).alias("n"))


@query("f6_feature_prefix", f"SELECT {W.replace('widx', 'widx::BIGINT AS widx')}, {r6(*[c for c in FS_B34 if c.startswith('id')])} FROM fsb")
def _(spark, d):
    return bus(spark, d).features.select(*windows.WINDOW, *[c for c in FS_B34 if c.startswith("id")])


@query("f7_positive_gaps", "SELECT capture, count(*) AS n FROM gaps WHERE gap > 0 GROUP BY capture")
def _(spark, d):
    last = F.lag("us").over(Window.partitionBy("vehicle", "capture", "aid").orderBy("us", "seq"))
    return benign(src.event_frames(spark, d)).withColumn("gap", F.col("us") - last).where("gap > 0").groupBy("capture").agg(F.count(F.lit(1)).alias("n"))


@query("f8_f9_finite", "SELECT count(*) AS n, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END)::BIGINT AS positive FROM events")
def _(spark, d):
    odd = src.table(spark, d, "events").select(F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("s"))
    return odd.select(F.when(evaluation.finite(F.col("s")), F.col("s")).otherwise(-1e30).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("s") > -1e30).cast("long")).alias("positive"))


@query(
    "s16_raw_logs",
    """SELECT capture, count(*) AS n, count(CASE WHEN seq % 97 = 0 THEN 1 END) AS bad, count(CASE WHEN y = 1 THEN 1 END) AS injected, sum(us % 1000000)::BIGINT AS parts, min(us) AS first, max(us) AS last, sum(aid)::BIGINT AS aids,
    sum(list_sum([x FOR x IN b IF x >= 0]))::BIGINT AS bytes FROM fr GROUP BY capture""",
)
def _(spark, d):
    """Frames written as text logs with broken lines among them, and the attack-free ones as originals; read again, bad lines
    counted, labels recovered by the count-aware comparison of both."""
    frames = bus(spark, d).frames
    lines = frames.select("capture", (F.col("seq") * 2).alias("seq"), logs.log_line().alias("value"))
    broken = frames.where("seq % 97 = 0").select("capture", (F.col("seq") * 2 + 1).alias("seq"), F.regexp_replace(logs.log_line(), "#", "").alias("value"))
    path, columns = sinks.scratch(spark, "logs"), ["capture", "aid", "dlc", "b"]
    logs.write_lines(lines.unionByName(broken), f"{path}/attack")
    logs.write_lines(frames.where("y = 0").select("capture", "seq", logs.log_line().alias("value")), f"{path}/original")
    read, bad = logs.read_logs(spark, f"{path}/attack")
    labelled = src.relabelled(read, logs.read_logs(spark, f"{path}/original")[0], columns)
    counts = labelled.groupBy("capture").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("injected"),
        F.sum(F.col("us") % 1_000_000).alias("parts"),
        F.min("us").alias("first"),
        F.max("us").alias("last"),
        F.sum("aid").alias("aids"),
        F.sum(F.aggregate(F.filter("b", lambda x: x >= 0), F.lit(0), lambda a, x: a + x)).alias("bytes"),
    )
    return counts.join(bad.groupBy("capture").agg(F.count(F.lit(1)).alias("bad")), "capture", "left").withColumn("bad", F.coalesce("bad", F.lit(0)))


@query("f10_f11_model_names", "SELECT model, replace(model, '@target', '') AS base, model LIKE '%@target' AS is_target, count(*) AS n FROM scores WHERE starts_with(model, 'Rule:') AND contains(model, 'I') GROUP BY model")
def _(spark, d):
    m = F.col("model")
    rows = bus(spark, d).scores.where(m.startswith("Rule:") & m.contains("I")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("model", F.regexp_replace("model", "@target$", "").alias("base"), m.endswith("@target").alias("is_target"), "n")


@query("f12_without_family", f"SELECT target, model, {r6('pr_auc')} FROM (SELECT target, model, sum(p * (tp / (tp + fp)::DOUBLE)) / nullif(sum(p), 0) AS pr_auc FROM (SELECT *, sum(p) OVER d AS tp, sum(m) OVER d AS fp FROM (SELECT target, model, score, sum(y) AS p, sum(1 - y) AS m FROM scores WHERE is_eval AND family <> 'dos' GROUP BY target, model, score) WINDOW d AS (PARTITION BY target, model ORDER BY score DESC)) GROUP BY target, model)")
def _(spark, d):
    return evaluation.ranking(bus(spark, d).scores.where("is_eval AND family <> 'dos'")).select("target", "model", "pr_auc")


shared("f13_clip", "SELECT event_id, greatest(10e0, least(value, 60e0)) AS clipped FROM {events}")


@query("f14_dropna", "SELECT doc_id, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def _(spark, d):
    return src.table(spark, d, "documents").select("doc_id").join(src.table(spark, d, "labels"), "doc_id", "left").dropna(subset=["quality"]).select("doc_id", "quality")


# ---- joins
@query("j1_profile_lookup", f"SELECT seq, {r6('period_ratio')}, unseen, dlc_mismatch FROM msg")
def _(spark, d):
    return bus(spark, d).messages.select("seq", "period_ratio", "unseen", "dlc_mismatch")


_hist = ", ".join(f"round(count(CASE WHEN coalesce(pos, {K}) = {i} THEN 1 END) / {N}e0, 6) AS h_{i:02d}" for i in range(K + 1))


@query("j2_a15_histogram_own", f"SELECT wl.vehicle, wl.capture, wl.family, widx::BIGINT AS widx, {_hist} FROM wl LEFT JOIN voc ON wl.vehicle = voc.vehicle AND wl.aid = voc.aid GROUP BY wl.vehicle, wl.capture, wl.family, widx")
def _(spark, d):
    b = bus(spark, d)
    return windows.histogram(b.messages, b.vocabulary, b.s)


@query("a15_histogram_cross", f"SELECT wl.vehicle, wl.capture, wl.family, widx::BIGINT AS widx, {_hist} FROM wl LEFT JOIN pvoc ON wl.vehicle = pvoc.target AND wl.aid = pvoc.aid GROUP BY wl.vehicle, wl.capture, wl.family, widx")
def _(spark, d):
    b = bus(spark, d)
    return windows.histogram(b.messages, b.pooled, b.s, "target")


@query("j3_staleness", f"SELECT capture, widx::BIGINT AS widx, {r6('stale_max', 'stale_frac')} FROM stale")
def _(spark, d):
    b = bus(spark, d)
    return windows.staleness(b.messages, b.windows, b.ids).select("capture", "widx", "stale_max", "stale_frac")


@query("j4_ecdf", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (SELECT count(*) FROM lineitem r WHERE r.l_returnflag = 'A' AND r.l_suppkey % 10 = p.l_suppkey % 10 AND r.l_quantity <= p.l_quantity)::BIGINT AS below FROM lineitem p WHERE l_returnflag <> 'A'")
def _(spark, d):
    rows = src.table(spark, d, "lineitem").withColumn("g", F.col("l_suppkey") % 10).withColumn("is_ref", F.col("l_returnflag") == "A")
    return rules.ecdf(rows, ["g"], "l_quantity", "is_ref", "below").where("NOT is_ref").select("l_orderkey", "l_linenumber", F.coalesce("below", F.lit(0)).alias("below"))


@query("j5_suspension_overlap", f"SELECT {W.replace('widx', 'widx::BIGINT AS widx')}, y::BIGINT AS y FROM lab")
def _(spark, d):
    return windows.labels(bus(spark, d).windows)


_RES = "(SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'cross' ELSE 'within' END AS protocol, o_orderkey // 4 % 2 AS fold, CASE WHEN o_custkey % 2 = 0 THEN 'FS-A' ELSE 'FS-B' END AS feature_set, 'm' || (o_orderkey // 8 % 7) || CASE WHEN o_orderkey % 10 = 0 THEN '@target' ELSE '' END AS model, 'v' || (o_custkey % 5) AS vehicle, CASE WHEN o_orderkey // 2 % 2 = 0 THEN 'pr_auc' ELSE 'roc_auc' END AS metric, floor(o_totalprice) % 1000 / 1000e0 AS value FROM orders)"
_FM = f"(SELECT protocol, feature_set, model, vehicle, metric, avg(value) AS value FROM {_RES} GROUP BY ALL)"


def results(spark, d) -> DataFrame:
    """A long result table made of orders."""
    k = F.col("o_orderkey")
    return src.table(spark, d, "orders").select(
        F.when(k % 2 == 0, "cross").otherwise("within").alias("protocol"),
        (F.floor(k / 4) % 2).alias("fold"),
        F.when(F.col("o_custkey") % 2 == 0, "FS-A").otherwise("FS-B").alias("feature_set"),
        F.concat(F.lit("m"), F.floor(k / 8) % 7, F.when(k % 10 == 0, "@target").otherwise("")).alias("model"),
        F.concat(F.lit("v"), F.col("o_custkey") % 5).alias("vehicle"),
        F.when(F.floor(k / 2) % 2 == 0, "pr_auc").otherwise("roc_auc").alias("metric"),
        (F.floor("o_totalprice") % 1000 / 1000.0).alias("value"),
    )


def _pairs(spark, d) -> DataFrame:
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross'")
    side = lambda fs, c: m.where(F.col("feature_set") == fs).select("model", "vehicle", "metric", F.col("value").alias(c))
    return side("FS-A", "a").join(side("FS-B", "b"), ["model", "vehicle", "metric"])


_PAIRS = f"(SELECT x.model, x.vehicle, x.metric, x.value AS a, y.value AS b FROM {_FM} x JOIN {_FM} y USING (model, vehicle, metric) WHERE x.protocol = 'cross' AND y.protocol = 'cross' AND x.feature_set = 'FS-A' AND y.feature_set = 'FS-B')"


@query("j6_feature_set_pairs", f"SELECT model, vehicle, metric, {r6('a', 'b')} FROM {_PAIRS}")
def _(spark, d):
    return _pairs(spark, d)


@query("j7_protocol_pairs", f"SELECT x.feature_set, x.model, x.vehicle, x.metric, round(x.value, 6) AS across, round(y.value, 6) AS within FROM {_FM} x JOIN {_FM} y USING (feature_set, model, vehicle, metric) WHERE x.protocol = 'cross' AND y.protocol = 'within' AND x.model NOT LIKE '%@target%'")
def _(spark, d):
    m = reports.fold_means(results(spark, d))
    keys = ["feature_set", "model", "vehicle", "metric"]
    across = m.where((F.col("protocol") == "cross") & ~F.col("model").contains("@target")).select(*keys, F.col("value").alias("across"))
    return across.join(m.where("protocol = 'within'").select(*keys, F.col("value").alias("within")), keys)


@query(
    "j8_b1_headline",
    f"""SELECT feature_set, model, {r6('cross_mean', 'cross_min', 'cross_sd')}, n_vehicles, {r6('within_mean')}, round(within_mean - cross_mean, 6) AS gap, round(100 * cross_mean / greatest(within_mean, 1e-9), 6) AS retention FROM
    (SELECT feature_set, model, replace(model, '@target', '') AS base, avg(value) AS cross_mean, min(value) AS cross_min, stddev_samp(value) AS cross_sd, count(*) AS n_vehicles FROM {_FM} WHERE protocol = 'cross' AND metric = 'pr_auc' GROUP BY feature_set, model)
    LEFT JOIN (SELECT feature_set, model AS base, avg(value) AS within_mean FROM {_FM} WHERE protocol = 'within' AND metric = 'pr_auc' GROUP BY feature_set, model) USING (feature_set, base)""",
)
def _(spark, d):
    return reports.headline(results(spark, d), "pr_auc")


@query(
    "j9_b9_three_way",
    f"SELECT model, vehicle, round(x.value, 6) AS a, round(y.value, 6) AS b, round(z.value, 6) AS c FROM (SELECT * FROM {_FM} WHERE protocol = 'within' AND feature_set = 'FS-A' AND metric = 'pr_auc') x FULL JOIN (SELECT * FROM {_FM} WHERE protocol = 'cross' AND feature_set = 'FS-A' AND metric = 'pr_auc') y USING (model, vehicle) LEFT JOIN (SELECT * FROM {_FM} WHERE protocol = 'cross' AND feature_set = 'FS-B' AND metric = 'pr_auc') z USING (model, vehicle)",
)
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("metric = 'pr_auc'")
    side = lambda p, fs, c: m.where((F.col("protocol") == p) & (F.col("feature_set") == fs)).select("model", "vehicle", F.col("value").alias(c))
    return side("within", "FS-A", "a").join(side("cross", "FS-A", "b"), ["model", "vehicle"], "full_outer").join(side("cross", "FS-B", "c"), ["model", "vehicle"], "left")


@query("j10_eval_intersection", "SELECT c.vehicle, count(*) FILTER (WHERE e.widx IS NOT NULL) AS shared, count(*) AS n, round(count(*) FILTER (WHERE e.widx IS NOT NULL) / count(*)::DOUBLE, 6) AS covered FROM (SELECT * FROM infold WHERE fold = 0 AND f_eval) c LEFT JOIN (SELECT * FROM lq WHERE q >= 2 OR y = 1) e USING (vehicle, capture, widx) GROUP BY c.vehicle")
def _(spark, d):
    labelled = bus(spark, d).labelled
    inner = splits.in_domain(labelled, 0).where("is_eval").select("vehicle", "capture", "widx")
    outer = splits.cross(labelled).where("is_eval").select("vehicle", "capture", "widx", F.lit(1).alias("hit"))
    g = inner.join(outer, ["vehicle", "capture", "widx"], "left").groupBy("vehicle").agg(F.count("hit").alias("shared"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("covered", F.col("shared") / F.col("n"))


shared("j11_u3_intersection", "SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'")
shared("j12_job_product", "SELECT v.r_name AS vehicle, f.fold FROM {region} v CROSS JOIN (SELECT 0 AS fold UNION ALL SELECT 1) f", "SELECT v.r_name AS vehicle, f.fold::BIGINT AS fold FROM region v CROSS JOIN (SELECT 0 AS fold UNION ALL SELECT 1) f")


@query("j13_p6_pools", "SELECT target, vehicle, count(*) AS n, sum(y)::BIGINT AS n_pos FROM lab JOIN targets ON vehicle <> target GROUP BY target, vehicle")
def _(spark, d):
    return splits.pools(windows.labels(bus(spark, d).windows)).groupBy("target", "vehicle").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@query("j14_count_aware_labels", "SELECT user_id, count(*) FILTER (WHERE o.i IS NULL) AS injected, count(*) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) a LEFT JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events WHERE event_id % 3 <> 0) o USING (user_id, event_type, i) GROUP BY user_id")
def _(spark, d):
    log = src.table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    return src.relabelled(log, log.where("seq % 3 <> 0"), ["user_id", "event_type"]).groupBy("user_id").agg(F.sum("y").alias("injected"), F.count(F.lit(1)).alias("n"))


@query("j15_w7_trailing", "SELECT capture, widx::BIGINT AS widx, array_to_string([greatest(widx - 7 + i, 0) FOR i IN range(8)], ',') AS trail FROM lab")
def _(spark, d):
    rows = windows.trailing(windows.labels(bus(spark, d).windows), "widx", 8, "t")
    return rows.select("capture", "widx", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("trail"))


# ---- aggregations
@query("a1_bus_rate", f"SELECT vehicle, n_frames, round(seconds / 3600, 6) AS hours, round(bus_rate * 3600, 6) AS per_hour, n_ids::BIGINT AS n_ids FROM vp")
def _(spark, d):
    return bus(spark, d).vehicles.select("vehicle", "n_frames", (F.col("seconds") / 3600).alias("hours"), (F.col("bus_rate") * 3600).alias("per_hour"), "n_ids")


@query("a2_a6_id_profile", "SELECT vehicle, aid::BIGINT AS aid, cnt, ref_dlc::BIGINT AS ref_dlc, round(period / 3600, 6) AS period_h, round(iqr / 3600, 6) AS iqr_h, is_periodic FROM idp")
def _(spark, d):
    return bus(spark, d).ids.select("vehicle", "aid", "cnt", "ref_dlc", (F.col("period") / 3600).alias("period_h"), (F.col("iqr") / 3600).alias("iqr_h"), "is_periodic")


@query("a7_k4_vocabulary", "SELECT vehicle, aid::BIGINT AS aid, cnt, pos::BIGINT AS pos FROM voc")
def _(spark, d):
    return bus(spark, d).vocabulary


@query("a8_pooled_vocabulary", f"SELECT target, aid::BIGINT AS aid, {r6('share')}, pos::BIGINT AS pos FROM pvoc")
def _(spark, d):
    return bus(spark, d).pooled


shared("a9_window_stats", "SELECT l_suppkey, round(avg(l_quantity), 6) AS m, round(stddev_pop(l_quantity), 6) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem} GROUP BY l_suppkey")
shared("a10_a27_percentiles", "SELECT l_suppkey, percentile(l_quantity, 0.05) AS p05, percentile(l_quantity, 0.5) AS med, greatest(percentile(l_quantity, 0.75) - percentile(l_quantity, 0.25), 1e-6) AS scale FROM {lineitem} GROUP BY l_suppkey", "SELECT l_suppkey, round(quantile_cont(l_quantity, 0.05), 6) AS p05, round(quantile_cont(l_quantity, 0.5), 6) AS med, round(greatest(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 1e-6), 6) AS scale FROM lineitem GROUP BY l_suppkey")
shared("a11_conditional_fraction", "SELECT user_id, avg(CASE WHEN value > 50e0 THEN 1e0 ELSE 0e0 END) AS frac FROM {events} GROUP BY user_id", "SELECT user_id, round(avg(CASE WHEN value > 50e0 THEN 1e0 ELSE 0e0 END), 6) AS frac FROM events GROUP BY user_id")


@query("a12_a14_id_entropy", f"SELECT capture, widx::BIGINT AS widx, {r6('id_entropy', 'id_unique', 'id_max_share')} FROM ids")
def _(spark, d):
    b = bus(spark, d)
    return windows.identifier_stats(b.windows, b.s)


@query("a12_entropy_by_supplier", "SELECT l_suppkey, round(sum(-p * log2(p + 1e-9)), 6) AS bits FROM (SELECT l_suppkey, count(*) / sum(count(*)) OVER (PARTITION BY l_suppkey)::DOUBLE AS p FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus) GROUP BY l_suppkey")
def _(spark, d):
    c = src.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("l_suppkey")))
    return p.groupBy("l_suppkey").agg(F.sum(-F.col("p") * F.log2(F.col("p") + 1e-9)).alias("bits"))


shared("a13_distinct_count", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM {lineitem} GROUP BY l_orderkey")


@query("a17_window_seconds", "SELECT vehicle, round(win_seconds / 3600, 6) AS h, round(win_seconds_all / 3600, 6) AS h_all FROM winsec")
def _(spark, d):
    return bus(spark, d).seconds.select("vehicle", (F.col("win_seconds") / 3600).alias("h"), (F.col("win_seconds_all") / 3600).alias("h_all"))


@query("a18_confusion", f"SELECT target, model, tag, {big('tp', 'fp', 'pos', 'n')}, round(tp / greatest(pos, 1)::DOUBLE, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(fp / greatest(n - pos, 1)::DOUBLE, 6) AS fpr, round(fp / greatest(n - pos, 1)::DOUBLE * 3600 / greatest(win_seconds, 1e-9), 6) AS fa_per_hour FROM conf")
def _(spark, d):
    return bus(spark, d).confusion.drop("win_seconds")


@query("a19_family_recall", "SELECT target, model, tag, family, round(avg(pred), 6) AS recall, count(*) AS n FROM preds WHERE y = 1 GROUP BY target, model, tag, family")
def _(spark, d):
    return evaluation.family_recall(bus(spark, d).predicted)


_EV = "(SELECT target, model, tag, family, capture, max(pred) AS hit FROM preds WHERE y = 1 GROUP BY ALL)"


@query("a20_event_recall", f"SELECT target, model, tag, family, sum(hit)::BIGINT AS hits, count(*) AS events, round(avg(hit), 6) AS event_recall FROM (SELECT * FROM {_EV} UNION ALL SELECT target, model, tag, 'all', capture, hit FROM {_EV}) GROUP BY target, model, tag, family")
def _(spark, d):
    return evaluation.event_recall(bus(spark, d).predicted)


@query("a21_roc_auc", f"SELECT target, model, {r6('roc_auc')} FROM auc")
def _(spark, d):
    return bus(spark, d).ranking.select("target", "model", "roc_auc")


@query("a22_average_precision", f"SELECT target, model, {big('pos', 'neg')}, {r6('pr_auc')} FROM auc")
def _(spark, d):
    return bus(spark, d).ranking.select("target", "model", "pos", "neg", "pr_auc")


@query("a21_a22_text_length", "SELECT lang, round(sum(m * (tp - p / 2e0)) / (sum(p) * sum(m)), 6) AS roc_auc, round(sum(p * (tp / (tp + fp)::DOUBLE)) / sum(p), 6) AS pr_auc FROM (SELECT *, sum(p) OVER d AS tp, sum(m) OVER d AS fp FROM (SELECT lang, n_chars, sum(quality) AS p, sum(1 - quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY lang, n_chars) WINDOW d AS (PARTITION BY lang ORDER BY n_chars DESC)) GROUP BY lang HAVING sum(p) > 0 AND sum(m) > 0")
def _(spark, d):
    rows = src.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(src.table(spark, d, "labels"), "doc_id").withColumnRenamed("quality", "y")
    return evaluation.ranking(rows, ["lang"]).where("pos > 0 AND neg > 0").select("lang", "roc_auc", "pr_auc")


@query("a23_fold_means", f"SELECT protocol, feature_set, model, metric, round(avg(value), 6) AS value FROM {_FM} GROUP BY protocol, feature_set, model, metric")
def _(spark, d):
    return reports.fold_means(results(spark, d)).groupBy("protocol", "feature_set", "model", "metric").agg(F.avg("value").alias("value"))


@query("a24_a25_vehicle_stats", f"SELECT feature_set, model, round(avg(value), 6) AS m, round(min(value), 6) AS lo, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM {_FM} WHERE protocol = 'cross' AND metric = 'roc_auc' GROUP BY feature_set, model")
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross' AND metric = 'roc_auc'")
    return m.groupBy("feature_set", "model").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n"))


@query("a28_standardised", "SELECT p_partkey, round((p_retailprice - m) / s, 6) AS z FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)")
def _(spark, d):
    part = src.table(spark, d, "part")
    return learners.scaled(part, learners.scaling(part, ["p_retailprice"])).select("p_partkey", F.col("p_retailprice").alias("z"))


@query("a_rollup_report", "SELECT vehicle, family, count(*) AS n, sum(y)::BIGINT AS n_pos FROM lab GROUP BY ROLLUP (vehicle, family)")
def _(spark, d):
    return windows.labels(bus(spark, d).windows).rollup("vehicle", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


# ---- ordered analytics
@query("w1_w2_gaps", f"SELECT seq, {r6('dt', 'dt_id')} FROM m0")
def _(spark, d):
    return bus(spark, d).messages.select("seq", "dt", "dt_id")


@query("w3_hamming", "SELECT seq, coalesce(ham, -1e0) AS ham FROM msg")
def _(spark, d):
    return bus(spark, d).messages.select("seq", F.coalesce("ham", F.lit(-1.0)).alias("ham"))


@query("w4_ordinals", "SELECT seq, capture, widx::BIGINT AS widx FROM wl")
def _(spark, d):
    return bus(spark, d).windows.select("seq", "capture", "widx")


@query("w5_quarters", "SELECT capture, widx::BIGINT AS widx, y::BIGINT AS y, q::BIGINT AS q FROM lq")
def _(spark, d):
    return bus(spark, d).labelled.select("capture", "widx", "y", "q")


shared("w5_quarters_orders", "SELECT o_orderkey, CAST(floor(4 * (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1) / count(*) OVER (PARTITION BY o_custkey, o_orderstatus)) AS BIGINT) AS q FROM {orders}")


@query("w6_last_seen", "SELECT e.event_id, coalesce(max(p.event_id), -1) AS last_buy FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id GROUP BY e.event_id")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return src.table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_buy")).fillna(-1)


@query("w8_average_rank", f"SELECT model, vehicle, rank() OVER (PARTITION BY vehicle ORDER BY round(value, 2) DESC) + (count(*) OVER (PARTITION BY vehicle, round(value, 2)) - 1) / 2e0 AS r FROM {_FM} WHERE protocol = 'cross' AND metric = 'pr_auc' AND feature_set = 'FS-B'")
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross' AND metric = 'pr_auc' AND feature_set = 'FS-B'").withColumn("value", F.round("value", 2))
    return m.select("model", "vehicle", reports.average_rank(["vehicle"], "value").alias("r"))


shared("w9_cumulative", "SELECT l_suppkey, l_quantity, sum(count(*)) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS reach FROM {lineitem} GROUP BY l_suppkey, l_quantity", "SELECT l_suppkey, l_quantity, (sum(count(*)) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC))::BIGINT AS reach FROM lineitem GROUP BY l_suppkey, l_quantity")


@query("w10_window_ends", "SELECT capture, widx::BIGINT AS widx, arg_min(us, seq) AS first_us, arg_max(us, seq) AS last_us FROM wl GROUP BY capture, widx")
def _(spark, d):
    return bus(spark, d).windows.groupBy("capture", "widx").agg(F.min_by("us", "seq").alias("first_us"), F.max_by("us", "seq").alias("last_us"))


@query("w11_runs", "SELECT user_id, count(*) AS runs FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type GROUP BY user_id")
def _(spark, d):
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return src.table(spark, d, "events").withColumn("p", p).where("p IS NULL OR p <> event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"))


# ---- sorts, top-k
shared("k1_k2_sorts", "SELECT event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', event_id) AS place FROM {events}", "SELECT event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', event_id)::BIGINT AS place FROM events")
shared("k3_lexsort", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_shipdate, l_orderkey, l_linenumber) AS place FROM {lineitem}", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_shipdate, l_orderkey, l_linenumber)::BIGINT AS place FROM lineitem")
shared("k4_top_suppliers", "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20")
shared("k5_k6_report_head", "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM {customer}) x WHERE r <= 5")
shared("k7_kth_with_ties", "SELECT l_suppkey, min(CASE WHEN ge <= 10 THEN l_quantity END) AS thr FROM (SELECT l_suppkey, l_quantity, sum(count(*)) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS ge FROM {lineitem} GROUP BY l_suppkey, l_quantity) x GROUP BY l_suppkey")

# ---- sets
shared("u1_union_all", "SELECT c_nationkey AS nation, c_acctbal AS bal FROM {customer} UNION ALL SELECT s_nationkey, s_acctbal FROM {supplier}", "SELECT c_nationkey::BIGINT AS nation, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")


@query("u2_ragged_union", "SELECT n_name AS name, n_regionkey::BIGINT AS region, -1::BIGINT AS size FROM nation UNION ALL SELECT p_name, -1, p_size FROM part")
def _(spark, d):
    a = src.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return union_all([a, src.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size"))]).fillna(-1)


shared("u4_difference", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
shared("u5_distinct", "SELECT DISTINCT user_id, event_type FROM {events}")


@query("u6_combinations", "SELECT bit_count(m)::BIGINT AS k, m::BIGINT AS mask, (SELECT string_agg(r_name, '|' ORDER BY r_name) FROM region WHERE m // (1 << r_regionkey) % 2 = 1) AS names FROM range(1, 32) t(m)")
def _(spark, d):
    region = src.table(spark, d, "region").select("r_regionkey", "r_name")
    masks = spark.range(1, 32).withColumnRenamed("id", "mask")
    chosen = masks.join(F.broadcast(region), F.expr("shiftright(mask, r_regionkey) % 2 = 1"))
    return chosen.groupBy("mask").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "|").alias("names")).withColumn("k", F.bit_count("mask").cast("long"))


# ---- scalar functions
shared("fn_strings", "SELECT p_partkey, length(p_name) AS n, replace(p_brand, 'Brand', 'B') AS b, substring(p_type, 1, 4) AS t, coalesce(nullif(p_name, ''), '-') AS name FROM {part}", "SELECT p_partkey, length(p_name)::BIGINT AS n, replace(p_brand, 'Brand', 'B') AS b, substring(p_type, 1, 4) AS t, coalesce(nullif(p_name, ''), '-') AS name FROM part")


@query("fn_hex_names", "SELECT DISTINCT aid::BIGINT AS aid, 'hist_0x' || lpad(lower(to_hex(aid)), 3, '0') AS name FROM fr")
def _(spark, d):
    return src.event_frames(spark, d).select("aid", F.concat(F.lit("hist_0x"), F.lpad(F.lower(F.hex("aid")), 3, "0")).alias("name")).distinct()


shared("fn_math", "SELECT event_id, round(log2(value + 1e-9), 6) AS l2, round(ln(1 + value), 6) AS l1p, floor(value) AS f, ceil(value) AS c, abs(value - 50e0) AS a, round(1e0 / (1e0 + exp(-value / 10e0)), 6) AS sig FROM {events}", "SELECT event_id, round(log2(value + 1e-9), 6) AS l2, round(ln(1 + value), 6) AS l1p, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c, round(abs(value - 50e0), 6) AS a, round(1e0 / (1e0 + exp(-value / 10e0)), 6) AS sig FROM events")


@query("fn_payload", f"SELECT seq, {r6('ent')}, allzero, allff FROM msg")
def _(spark, d):
    return bus(spark, d).messages.select("seq", "ent", "allzero", "allff")


@query("fn_json", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events")
def _(spark, d):
    return src.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_job_tags", "SELECT target, model, split_part(target || '_' || model, '_', 1) AS vehicle, lower(md5('f0' || '|' || target || '|' || model)) AS seed FROM (SELECT DISTINCT target, model FROM scores)")
def _(spark, d):
    tags = bus(spark, d).scores.select("target", "model").distinct()
    return tags.select("target", "model", F.split(F.concat_ws("_", "target", "model"), "_")[0].alias("vehicle"), F.md5(F.concat_ws("|", F.lit("f0"), "target", "model")).alias("seed"))


@query("fn_crc_seed")
def _(spark, d):
    return src.table(spark, d, "region").select("r_name", (F.crc32(F.concat_ws("|", F.lit("cross"), "r_name").cast("binary")) % 2147483648).alias("seed"))


# ---- feature tables
@query("fs_b", f"SELECT {W.replace('widx', 'widx::BIGINT AS widx')}, {r6(*[c for c in FS_B if c not in ('dt_mean', 'dt_std', 'dt_p95', 'dt_max')])}, " + ", ".join(f"round({c} / 3600, 6) + 0e0 AS {c}" for c in ("dt_mean", "dt_std", "dt_p95", "dt_max")) + " FROM fsb")
def _(spark, d):
    return bus(spark, d).features.withColumns({c: F.col(c) / 3600 for c in ("dt_mean", "dt_std", "dt_p95", "dt_max")})


@query("fs_b_narrow", f"SELECT capture, widx::BIGINT AS widx, {r6('pr_mean', 'pr_lt_half', 'pr_gt_two', 'dtid_nan_frac', 'ham_mean', 'ent_mean')} FROM fsb")
def _(spark, d):
    return bus(spark, d).features.select("capture", "widx", "pr_mean", "pr_lt_half", "pr_gt_two", "dtid_nan_frac", "ham_mean", "ent_mean")


@query("fs_a_raw", f"SELECT {W.replace('widx', 'widx::BIGINT AS widx')}, {r6(*[c for c in FS_A_RAW if not c.startswith('dt_')])}, " + ", ".join(f"round({c} / 3600, 6) + 0e0 AS {c}" for c in ("dt_mean", "dt_std", "dt_max")) + " FROM fsa")
def _(spark, d):
    return bus(spark, d).raw.withColumns({c: F.col(c) / 3600 for c in ("dt_mean", "dt_std", "dt_max")})


_hours = ", ".join(f"round({c} / 3600, 6) + 0e0 AS {c}" for c in ("dt_mean", "dt_std", "dt_max"))
_raw = ", ".join(f"f.{c}" for c in FS_A_RAW)
_places = ", ".join(f"count(CASE WHEN coalesce(p.pos, {K}) = {i} THEN 1 END) / {N}e0 AS h_{i:02d}" for i in range(K + 1))
_FS_A = f"{W.replace('widx', 'widx::BIGINT AS widx')}, {r6(*[c for c in FS_A_RAW if not c.startswith('dt_')])}, {_hours}, {r6(*[f'h_{i:02d}' for i in range(K + 1)])}"


def _in_hours(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c) / 3600 for c in ("dt_mean", "dt_std", "dt_max")})


@query("fs_a", f"SELECT target, {_FS_A} FROM fsa JOIN (SELECT t.target, wl.capture, wl.widx, {_places} FROM wl CROSS JOIN (SELECT DISTINCT target FROM pvoc) t LEFT JOIN pvoc p ON p.target = t.target AND p.aid = wl.aid GROUP BY t.target, wl.capture, wl.widx) USING (capture, widx)")
def _(spark, d):
    return _in_hours(bus(spark, d).fs_a.drop("y", "q"))


@query("fs_a_rank", f"SELECT {_FS_A} FROM fsa JOIN (SELECT wl.capture, wl.widx, {_places} FROM wl LEFT JOIN voc p ON p.vehicle = wl.vehicle AND p.aid = wl.aid GROUP BY wl.capture, wl.widx) USING (capture, widx)")
def _(spark, d):
    return _in_hours(bus(spark, d).fs_a_rank.drop("y", "q"))


# ---- splits
@query("p1_cross_split", "SELECT capture, widx::BIGINT AS widx, (y = 0 AND q <= 1) AS is_calib, (q >= 2 OR y = 1) AS is_eval FROM lq")
def _(spark, d):
    return splits.cross(bus(spark, d).labelled).select("capture", "widx", "is_calib", "is_eval")


@query("p2_p3_in_domain_folds", "SELECT fold::BIGINT AS fold, capture, widx::BIGINT AS widx, f_train AS is_train, f_calib AS is_calib, f_eval AS is_eval FROM infold")
def _(spark, d):
    labelled = bus(spark, d).labelled
    return union_all([splits.in_domain(labelled, f).select(F.lit(f).alias("fold"), "capture", "widx", "is_train", "is_calib", "is_eval") for f in (0, 1)])


_ORD = "row_number() OVER (PARTITION BY target, y ORDER BY md5('s1' || '|' || capture || '|' || widx), capture, widx)"
_POOL = "(SELECT target, capture, widx::BIGINT AS widx, y, sum(y) OVER (PARTITION BY target) AS p, count(*) OVER (PARTITION BY target) AS n FROM lab JOIN targets ON vehicle <> target)"


@query("p4_capped_pool", f"SELECT target, capture, widx FROM (SELECT *, {_ORD} AS i FROM {_POOL}) WHERE i <= CASE WHEN n <= 100 THEN n WHEN y = 1 THEN least(p, 50) ELSE least(n - p, 100 - least(p, 50)) END")
def _(spark, d):
    pool = splits.pools(windows.labels(bus(spark, d).windows))
    return splits.capped(pool, ["target"], ["capture", "widx"], 100, "s1").select("target", "capture", "widx")


@query("p5_matched_volume", f"SELECT target, capture, widx FROM (SELECT *, {_ORD} AS i FROM {_POOL}) WHERE i <= CASE WHEN y = 1 THEN least(p, 12) ELSE least(n - p, 60 - least(p, 12)) END")
def _(spark, d):
    pool = splits.pools(windows.labels(bus(spark, d).windows))
    return splits.matched(pool, ["target"], ["capture", "widx"], 60, 12, "s1").select("target", "capture", "widx")


@query("p9_stratified_folds", "SELECT capture, widx, (row_number() OVER (PARTITION BY y ORDER BY md5('kf' || '|' || capture || '|' || widx), capture, widx) - 1) % 3 AS fold FROM (SELECT capture, widx::BIGINT AS widx, y FROM lab)")
def _(spark, d):
    return splits.stratified_folds(windows.labels(bus(spark, d).windows), 3, ["capture", "widx"], "kf").select("capture", "widx", "fold")


def _drawn(seed: str, by: str, cells: str, cluster: str, replicates: int) -> str:
    """SQL of resampled clusters: CTEs named caps (numbered clusters) and drawn (cluster and times of each replicate)."""
    keys = " || '|' || ".join(by.split(", "))
    return f"""caps AS (SELECT {by}, {cluster}, row_number() OVER (PARTITION BY {by} ORDER BY {cluster}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, {cluster} FROM {cells})),
    drawn AS (SELECT d.*, {cluster} FROM (SELECT {by}, rep, ('0x' || substr(md5('{seed}|' || rep || '|' || i || '|' || {keys}), 1, 15))::BIGINT % n AS i, count(*) AS times FROM caps, range({replicates}) t(rep) GROUP BY ALL) d JOIN caps USING ({by}, i))"""


@query(
    "p7_bootstrap_vehicles",
    f"""SELECT * FROM (WITH m AS (SELECT * FROM {_FM} WHERE protocol = 'cross' AND metric = 'pr_auc'), {_drawn("0", "feature_set, model", "m", "vehicle", 2000)},
    r AS (SELECT feature_set, model, rep, sum(value * times) / sum(times) AS v FROM drawn JOIN m USING (feature_set, model, vehicle) GROUP BY ALL),
    q AS (SELECT feature_set, model, quantile_cont(v, [0.025, 0.975]) AS p FROM r GROUP BY ALL)
    SELECT feature_set, model, round(avg(value), 6) AS mean, round(any_value(p)[1], 6) AS ci_lo, round(any_value(p)[2], 6) AS ci_hi FROM m JOIN q USING (feature_set, model) GROUP BY feature_set, model)""",
)
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross' AND metric = 'pr_auc'")
    return reports.bootstrap_mean(m, ["feature_set", "model"], "vehicle", 2000, "0")


@query(
    "p8_bootstrap_captures",
    f"""SELECT * FROM (WITH {_drawn("1", "target, model", "(SELECT * FROM scores WHERE is_eval)", "capture", 200)},
    s AS (SELECT target, model, rep, score, sum(times * y) AS p, sum(times * (1 - y)) AS m FROM scores JOIN drawn USING (target, model, capture) WHERE is_eval GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS fp FROM s WINDOW w AS (PARTITION BY target, model, rep ORDER BY score DESC)),
    a AS (SELECT target, model, rep, sum(m * (tp - p / 2e0)) / (sum(p) * sum(m)) AS roc, sum(p * (tp / (tp + fp)::DOUBLE)) / sum(p) AS pr FROM c GROUP BY ALL HAVING sum(p) > 0 AND sum(m) > 0)
    SELECT target, model, count(*) AS n_boot, round(quantile_cont(pr, 0.025), 6) AS lo_pr, round(quantile_cont(pr, 0.975), 6) AS hi_pr, round(quantile_cont(roc, 0.025), 6) AS lo_roc, round(quantile_cont(roc, 0.975), 6) AS hi_roc FROM a GROUP BY target, model)""",
)
def _(spark, d):
    return reports.bootstrap_ranking(bus(spark, d).scores.where("is_eval"), ["target", "model"], 200, "1")


# ---- detectors
for _n, _m in (("r1_periodicity", "Rule:Periodicity"), ("r2_unseen", "Rule:UnseenID"), ("r3_bus_load", "Rule:BusLoad"), ("r4_id_entropy", "Rule:IDEntropy"), ("r5_hamming", "Rule:Hamming"), ("r6_staleness", "Rule:Staleness"), ("r7_combined", "Rule:Combined")):

    def _rule(spark, d, m=_m):
        return bus(spark, d).scores.where(F.col("model").isin(m, f"{m}@target")).select("target", "model", "capture", "widx", "score")

    query(_n, f"SELECT target, model, capture, widx::BIGINT AS widx, score FROM scores WHERE model IN ('{_m}', '{_m}@target')")(_rule)


@query("r_reference", f"SELECT target, scope, feature, {r6('med', 'scale')} FROM refs")
def _(spark, d):
    return bus(spark, d).reference


@query(
    "r8_combined_quantile",
    """SELECT target, model, capture, widx::BIGINT AS widx, round(max(s), 6) AS score FROM (SELECT z.target, CASE WHEN z.scope = 'target' THEN 'Rule:CombinedQ@target' ELSE 'Rule:CombinedQ' END AS model, z.capture, z.widx,
    -ln(1 - (SELECT count(*) FROM zref r WHERE r.target = z.target AND r.scope = z.scope AND r.feature = z.feature AND r.v <= z.v) / (t.n + 1e0)) + ln(1 + greatest(0e0, (z.v - t.top) / greatest(t.top - t.p99, 1e-9))) AS s
    FROM (SELECT *, CASE WHEN feature IN ('id_entropy', 'id_unique_frac', 'dt_mean_norm', 'ent_mean') THEN abs(z) ELSE z END AS v FROM zed WHERE feature <> 'dt_mean') z JOIN ztop t USING (target, scope, feature)) GROUP BY target, model, capture, widx""",
)
def _(spark, d):
    return bus(spark, d).quantile_scores.select("target", "model", "capture", "widx", "score")


_B34 = "CASE WHEN feature IN ('id_entropy', 'id_unique_frac', 'dt_mean', 'ent_mean') THEN abs(z) ELSE z END"
_NOT_B34 = "feature NOT IN ('stale_max', 'dt_mean_norm')"


@query("r9_panel_b34", f"SELECT target, scope, capture, widx::BIGINT AS widx, round(max({_B34}), 6) + 0e0 AS score FROM zed WHERE {_NOT_B34} GROUP BY target, scope, capture, widx")
def _(spark, d):
    scored = rules.rule_scores(bus(spark, d).z, ["target", "scope", "capture", "widx"], rules.HIGH34, rules.TWO_SIDED34)
    return scored.where("model = 'Rule:Combined'").select("target", "scope", "capture", "widx", "score")


@query(
    "r9_panel_b34_quantile",
    f"""SELECT target, scope, capture, widx::BIGINT AS widx, round(max(s), 6) AS score FROM (SELECT z.target, z.scope, z.capture, z.widx,
    -ln(1 - (SELECT count(*) FROM zref34 r WHERE r.target = z.target AND r.scope = z.scope AND r.feature = z.feature AND r.v <= z.v) / (t.n + 1e0)) + ln(1 + greatest(0e0, (z.v - t.top) / greatest(t.top - t.p99, 1e-9))) AS s
    FROM (SELECT *, {_B34} AS v FROM zed WHERE {_NOT_B34}) z JOIN ztop34 t USING (target, scope, feature)) GROUP BY target, scope, capture, widx""",
)
def _(spark, d):
    b = bus(spark, d)
    scored = rules.quantile_scores(b.quantile_rows, ["target", "scope", "capture", "widx"], ["target", "scope"], rules.HIGH34, rules.TWO_SIDED34)
    return scored.select("target", "scope", "capture", "widx", "score")


@query("g1_fit_scopes", "SELECT target, scope, count(*) AS n FROM (SELECT target, 'fleet' AS scope FROM lq JOIN targets ON vehicle <> target WHERE y = 0 UNION ALL SELECT vehicle, 'target' FROM lq WHERE y = 0 AND q <= 1) GROUP BY target, scope")
def _(spark, d):
    return bus(spark, d).fitted_on.where("feature = 'id_entropy'").groupBy("target", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("g2_detector_list")
def _(spark, d):
    rows = [(fs, cross, scope, name) for fs in ("FS-A", "FS-B", "FS-B34") for cross in (True, False) for scope, name in learners.detectors(fs, cross)]
    return spark.createDataFrame(rows, "feature_set string, cross boolean, scope string, model string")


def _ranked(scored: DataFrame, name: str, target: str) -> DataFrame:
    return evaluation.ranking(scored.select(F.lit(target).alias("target"), F.lit(name).alias("model"), "y", "score"))


def _each_target(spark, d, name: str) -> DataFrame:
    """The detector fitted on every vehicle but one, for each vehicle left out in turn: areas over its evaluation windows."""
    b = bus(spark, d)

    def one(target: str) -> DataFrame:
        train, _, test = jobs.split(b, "cross", 0, target, "FS-B", sequences=name in learners.SEQUENCE)
        return _ranked(jobs.written(b, jobs.fit_and_score(name, train, {"ev": test}, FS_B)), name, target)

    return union_all(learners.side_by_side([lambda t=t: one(t) for t in jobs._targets(b)]))


for _n, _k in (
    ("r10_isolation_forest", "IForest"),
    ("l1_logistic", "LogReg"),
    ("l2_random_forest", "RandomForest"),
    ("l3_extra_trees", "ExtraTrees"),
    ("l4_hist_boosting", "HistGB"),
    ("l5_extreme_boosting", "XGBoost"),
    ("l6_leafwise_boosting", "LightGBM"),
    ("l7_ordered_boosting", "CatBoost"),
    ("n1_perceptron", "NN:MLP"),
    ("n2_convolutional", "NN:CNN1D"),
    ("n3_recurrent", "NN:LSTM"),
    ("n4_attention", "NN:Transformer"),
    ("e1_rank_average", "Ens:RankAvg-Trees"),
    ("e1_rank_average_hybrid", "Ens:RankAvg-Hybrid"),
    ("e2_stacking", "Ens:Stack-Trees"),
):
    query(_n)(lambda spark, d, k=_k: _each_target(spark, d, k))


@query("g3_batched_scoring")
def _(spark, d):
    """Scores come in Arrow batches; their size is the session's spark.sql.execution.arrow.maxRecordsPerBatch and changes no score."""
    b = bus(spark, d)
    rows = b.split.select(*windows.WINDOW, "y", *FS_B)
    return learners.IsolationForest(FS_B).fit(rows.where("y = 0"), jobs.KEY).score(rows).select("capture", "widx", "score")


def job_kinds(feature_set: str, protocol: str) -> list[str]:
    """The quick families, the isolation forest and, where the set has their features, all rules; across vehicles also those
    fitted on the target. All in whole settings."""
    named = [name for _, name in learners.detectors(feature_set, protocol == "cross")]
    return [n for n in named if n.startswith(("Rule:", "IForest")) or n in jobs.QUICK_KINDS]


@query("g4_job_loop")
def _(spark, d):
    b = bus(spark, d)
    scores, _ = jobs.run(b, ["FS-A", "FS-B"], job_kinds, sinks.scratch(spark, "jobs"))
    return jobs.results(b, scores)


# ---- evaluation and reports
@query("m1_m2_operating_points", "SELECT target, model, tag, n_calib, k::BIGINT AS k, resolvable FROM points")
def _(spark, d):
    return bus(spark, d).points.select("target", "model", "tag", "n_calib", "k", "resolvable")


@query("m3_thresholds", "SELECT target, model, tag, thr, thr IS NULL AS above FROM limits")
def _(spark, d):
    return bus(spark, d).limits.select("target", "model", "tag", "thr", F.col("thr").isNull().alias("above"))


@query("m4_resolvable", "SELECT tag, count(*) FILTER (WHERE resolvable) AS yes, count(*) AS n FROM points GROUP BY tag")
def _(spark, d):
    return bus(spark, d).points.groupBy("tag").agg(F.count(F.when(F.col("resolvable"), 1)).alias("yes"), F.count(F.lit(1)).alias("n"))


@query("m5_full_evaluation", f"SELECT target, model, tag, {big('tp', 'fp')}, {r6('roc_auc', 'pr_auc')} FROM conf JOIN auc USING (target, model)")
def _(spark, d):
    b = bus(spark, d)
    return b.confusion.select("target", "model", "tag", "tp", "fp").join(b.ranking.select("target", "model", "roc_auc", "pr_auc"), ["target", "model"])


@query("b2_by_vehicle", "SELECT feature_set, model, " + ", ".join(f"round(avg(CASE WHEN vehicle = 'v{i}' THEN value END), 6) AS v{i}" for i in range(5)) + f" FROM {_FM} WHERE metric = 'pr_auc' AND protocol = 'cross' GROUP BY feature_set, model")
def _(spark, d):
    return reports.by_vehicle(results(spark, d), "pr_auc", [f"v{i}" for i in range(5)])


@query("b3_per_family", "SELECT model, " + ", ".join(f"round(avg(CASE WHEN family = '{f}' THEN r END), 6) AS {f}" for f in ("dos", "fuzzing", "suspension")) + " FROM (SELECT target, model, family, avg(pred) AS r FROM preds WHERE y = 1 AND tag = 'fa10' GROUP BY target, model, family) GROUP BY model")
def _(spark, d):
    return evaluation.family_recall(bus(spark, d).predicted.where("tag = 'fa10'")).groupBy("model").pivot("family", ["dos", "fuzzing", "suspension"]).agg(F.avg("recall"))


_FAMS = ("dos", "fuzzing", "suspension")
_PIVOT = ", ".join(f"round(avg(CASE WHEN family = '{f}' THEN r END), 6) AS {f}" for f in _FAMS)


@query("b3_per_family_event", f"SELECT model, {_PIVOT} FROM (SELECT target, model, family, avg(hit) AS r FROM (SELECT target, model, family, capture, max(pred) AS hit FROM preds WHERE y = 1 AND tag = 'fa10' GROUP BY ALL) GROUP BY ALL) GROUP BY model")
def _(spark, d):
    events = evaluation.event_recall(bus(spark, d).predicted.where("tag = 'fa10'")).where("family <> 'all'")
    return events.groupBy("model").pivot("family", list(_FAMS)).agg(F.avg("event_recall"))


@query("b3_per_family_fpr", f"SELECT model, {_PIVOT} FROM (SELECT target, model, family, avg(pred) AS r FROM preds WHERE y = 1 AND tag = 'fpr0.001' GROUP BY ALL) GROUP BY model")
def _(spark, d):
    return evaluation.family_recall(bus(spark, d).predicted.where("tag = 'fpr0.001'")).groupBy("model").pivot("family", list(_FAMS)).agg(F.avg("recall"))


@query("b4_rank_instability", f"SELECT model, round(avg(r), 6) AS mean_rank, min(r) AS best_rank, max(r) AS worst_rank, max(r) - min(r) AS rank_range, round(avg(value), 6) AS mean_value FROM (SELECT *, rank() OVER (PARTITION BY vehicle ORDER BY value DESC) + (count(*) OVER (PARTITION BY vehicle, value) - 1) / 2e0 AS r FROM (SELECT model, vehicle, round(value, 3) AS value FROM {_FM} WHERE protocol = 'cross' AND metric = 'pr_auc' AND feature_set = 'FS-B')) GROUP BY model")
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross' AND metric = 'pr_auc' AND feature_set = 'FS-B'").select("model", "vehicle", F.round("value", 3).alias("value"))
    return reports.rank_instability(m)


@query("b5_resolvability", "SELECT target, model, n_calib, round(3600 / win_seconds, 6) AS windows_per_hour, ceil(3600 / win_seconds)::BIGINT AS min_calib_fa1, ceil(3600 / win_seconds / 10)::BIGINT AS min_calib_fa10 FROM sizes")
def _(spark, d):
    return reports.resolvability(bus(spark, d).points.select("target", "model", "n_calib", "win_seconds").distinct()).drop("win_seconds")


_D = f"(SELECT metric, round(b - a, 9) AS d FROM {_PAIRS})"


@query(
    "b6_signed_ranks",
    f"""SELECT metric, n_pairs, round(mean_diff, 6) AS mean_diff, round(median_diff, 6) AS median_diff, round(frac_better, 6) AS frac_better, n, w_plus, w_minus, tie_sum::BIGINT AS tie_sum FROM
    (SELECT metric, count(*) AS n_pairs, avg(d) AS mean_diff, median(d) AS median_diff, avg((d > 0)::INT) AS frac_better FROM {_D} GROUP BY metric) LEFT JOIN
    (SELECT metric, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t * t - 1) AS tie_sum FROM (SELECT metric, d, count(*) OVER (PARTITION BY metric, abs(d)) AS t, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2e0 AS r FROM {_D} WHERE d <> 0) GROUP BY metric) USING (metric)""",
)
def _(spark, d):
    diff = _pairs(spark, d).select("metric", F.round(F.col("b") - F.col("a"), 9).alias("x"), F.lit(0.0).alias("zero"))
    return reports.signed_ranks(diff, ["metric"], "x", "zero")


#: The tests' four metrics among those that the result table has: orders give two, each by fold.
_TESTED = ("pr_auc", "roc_auc", "pr_auc@f0", "roc_auc@f0")


def _four(spark, d) -> DataFrame:
    r = results(spark, d)
    return r.unionByName(r.where("fold = 0").withColumn("metric", F.concat("metric", F.lit("@f0"))))


def _cell(protocol: str, fs: str, also: str = "") -> str:
    return f"(SELECT metric, model, vehicle, avg(value) AS value FROM (SELECT * FROM {_RES} UNION ALL SELECT * REPLACE (metric || '@f0' AS metric) FROM {_RES} WHERE fold = 0) WHERE protocol = '{protocol}' AND feature_set = '{fs}' {also} GROUP BY ALL)"


_COMPARED = " UNION ALL ".join(
    f"SELECT '{name}' AS comparison, metric, round(x.value - y.value, 9) AS d FROM {_cell(p, f)} x JOIN {_cell(q, g, also)} y USING (metric, model, vehicle)"
    for name, p, f, q, g, also in (
        ("FS-B > FS-A across", "cross", "FS-B", "cross", "FS-A", ""),
        ("within or across, FS-A", "within", "FS-A", "cross", "FS-A", "AND model NOT LIKE '%@target%'"),
        ("within or across, FS-B", "within", "FS-B", "cross", "FS-B", "AND model NOT LIKE '%@target%'"),
    )
)


@query("b6_paired_tests", f"SELECT comparison, metric, count(*) AS n_pairs, round(avg(d), 6) AS mean_diff, round(median(d), 6) AS median_diff, round(avg((d > 0)::INT), 6) AS frac_better FROM ({_COMPARED}) GROUP BY comparison, metric")
def _(spark, d):
    return reports.paired_tests(_four(spark, d), _TESTED).drop("p")


@query("b6_wilcoxon_p")
def _(spark, d):
    return reports.paired_tests(_four(spark, d), _TESTED).select("comparison", "metric", "n_pairs", "p")


@query("b7_ablation", f"SELECT a.target, a.model, round(a.pr_auc, 6) AS pr_all, round(b.pr_auc, 6) AS pr_less FROM auc a JOIN (SELECT target, model, sum(p * (tp / (tp + fp)::DOUBLE)) / nullif(sum(p), 0) AS pr_auc FROM (SELECT *, sum(p) OVER d AS tp, sum(m) OVER d AS fp FROM (SELECT target, model, score, sum(y) AS p, sum(1 - y) AS m FROM scores WHERE is_eval AND family <> 'suspension' GROUP BY target, model, score) WINDOW d AS (PARTITION BY target, model ORDER BY score DESC)) GROUP BY target, model) b USING (target, model)")
def _(spark, d):
    b = bus(spark, d)
    less = evaluation.ranking(b.scores.where("is_eval AND family <> 'suspension'"))
    return b.ranking.select("target", "model", F.col("pr_auc").alias("pr_all")).join(less.select("target", "model", F.col("pr_auc").alias("pr_less")), ["target", "model"])


@query("b8_identical_windows", "SELECT target, model, round(sum(p * (tp / (tp + fp)::DOUBLE)) / nullif(sum(p), 0), 6) AS pr_auc, sum(p + m)::BIGINT AS n_eval FROM (SELECT *, sum(p) OVER d AS tp, sum(m) OVER d AS fp FROM (SELECT s.target, s.model, s.score, sum(s.y) AS p, sum(1 - s.y) AS m FROM scores s JOIN infold i ON s.target = i.vehicle AND s.capture = i.capture AND s.widx = i.widx AND i.fold = 0 AND i.f_eval WHERE s.is_eval GROUP BY s.target, s.model, s.score) WINDOW d AS (PARTITION BY target, model ORDER BY score DESC)) GROUP BY target, model")
def _(spark, d):
    b = bus(spark, d)
    inner = splits.in_domain(b.labelled, 0).where("is_eval").select(F.col("vehicle").alias("target"), "capture", "widx")
    same = b.scores.where("is_eval").join(inner, ["target", "capture", "widx"], "left_semi")
    return evaluation.ranking(same).select("target", "model", "pr_auc", (F.col("pos") + F.col("neg")).alias("n_eval"))


@query("b10_b11_control_tables", f"SELECT model, metric, round(avg(CASE WHEN feature_set = 'FS-A' THEN value END), 6) AS fs_a, round(avg(CASE WHEN feature_set = 'FS-B' THEN value END), 6) AS fs_b FROM {_FM} WHERE protocol = 'cross' GROUP BY model, metric")
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross'")
    return m.groupBy("model", "metric").pivot("feature_set", ["FS-A", "FS-B"]).agg(F.avg("value")).withColumnsRenamed({"FS-A": "fs_a", "FS-B": "fs_b"})


@query("b12_summary", f"SELECT feature_set, metric, arg_max(model, (value, model)) AS best, count(*) FILTER (WHERE value < 0.5) AS low FROM (SELECT feature_set, metric, model, avg(value) AS value FROM {_FM} WHERE protocol = 'cross' GROUP BY ALL) GROUP BY feature_set, metric")
def _(spark, d):
    m = reports.fold_means(results(spark, d)).where("protocol = 'cross'").groupBy("feature_set", "metric", "model").agg(F.avg("value").alias("value"))
    return m.groupBy("feature_set", "metric").agg(F.max_by("model", F.struct("value", "model")).alias("best"), F.count_if(F.col("value") < 0.5).alias("low"))


@query("c1_control_matched_volume")
def _(spark, d):
    return jobs.volume_control(bus(spark, d))


@query("c2_control_sources")
def _(spark, d):
    return jobs.source_control(bus(spark, d))


@query("c3_control_feature_sets")
def _(spark, d):
    return jobs.feature_control(bus(spark, d))


_CHECKS = {
    "clean windows differ between pools": "SELECT greatest(count(DISTINCT n) - 1, 0) FROM (SELECT target, count(*) AS n FROM lq JOIN targets ON vehicle <> target WHERE y = 0 GROUP BY target)",
    "families absent from a fold": "SELECT count(*) FROM (SELECT DISTINCT i.vehicle, fold, a.family FROM (SELECT DISTINCT vehicle, fold FROM infold) i JOIN (SELECT DISTINCT vehicle, family FROM lq WHERE y = 1) a USING (vehicle) EXCEPT SELECT vehicle, fold, family FROM infold WHERE f_eval AND y = 1)",
    "seeds that clash": "SELECT count(*) - count(DISTINCT md5(concat_ws('|', 'f0', target, model))) FROM (SELECT DISTINCT target, model FROM scores)",
    "unresolvable at the primary point": "SELECT count(*) FROM points WHERE NOT resolvable AND tag = 'fa1'",
    "labels that a multiset difference doesn't give": "SELECT count(*) FROM (SELECT capture, sum(y) AS n FROM fr GROUP BY capture) a JOIN (SELECT capture, count(CASE WHEN i > m THEN 1 END) AS n FROM (SELECT capture, row_number() OVER (PARTITION BY capture, aid, dlc, b ORDER BY seq) AS i, count(CASE WHEN y = 0 THEN 1 END) OVER (PARTITION BY capture, aid, dlc, b) AS m FROM fr) GROUP BY capture) e USING (capture) WHERE a.n <> e.n",
    "labelled frames with malformed payloads": "SELECT count(*) FROM fr WHERE y = 1 AND (dlc < 0 OR dlc > 8 OR len([x FOR x IN b IF x >= 0]) <> dlc)",
    "vehicles whose own vocabulary isn't the pool's": "SELECT count(*) FROM (SELECT v.vehicle FROM voc v FULL JOIN pvoc p ON v.vehicle = p.target AND v.pos = p.pos AND v.aid = p.aid WHERE v.aid IS NULL OR p.aid IS NULL GROUP BY v.vehicle HAVING v.vehicle IS NOT NULL)",
    "payload columns that never vary": "SELECT " + " + ".join(f"(max(b{i}_std) <= 0 OR max(b{i}_std) IS NULL)::INT" for i in range(8)) + " FROM fsa",
    "models better without the second set": f"SELECT count(*) FROM (SELECT model, avg(a) AS a, avg(b) AS b FROM {_PAIRS} WHERE metric = 'pr_auc' GROUP BY model HAVING avg(b) < avg(a))",
    "trails that leave their capture": "SELECT count(*) FROM (SELECT capture, widx, row_number() OVER (PARTITION BY capture ORDER BY widx) - 1 AS i FROM lab) WHERE widx <> i",
    "calibrated and evaluated": "SELECT count(*) FROM lq WHERE (y = 0 AND q <= 1) AND (q >= 2 OR y = 1)",
    "models that find suspension": "SELECT count(*) FROM (SELECT target, model, avg(pred) AS r FROM preds WHERE y = 1 AND tag = 'fa10' AND family = 'suspension' GROUP BY target, model HAVING avg(pred) >= 0.1)",
    "vehicles whose window seconds hang on attacks": "SELECT count(*) FROM winsec WHERE abs(win_seconds - win_seconds_all) > 1e-6",
    "negative gaps": "SELECT count(*) FROM m0 WHERE dt < 0",
    "unlabelled windows": "SELECT count(*) FROM lq WHERE q IS NULL OR q > 3",
}


@query("x1_checks", " UNION ALL ".join(f"SELECT '{n.replace(chr(39), chr(39) * 2)}' AS check_name, ({sql})::BIGINT AS bad" for n, sql in _CHECKS.items()))
def _(spark, d):
    b = bus(spark, d)
    cross, one = splits.cross(b.labelled), F.count(F.lit(1)).alias("bad")
    folds = union_all([splits.in_domain(b.labelled, f).withColumn("fold", F.lit(f)) for f in (0, 1)])
    attacked = b.labelled.where("y = 1").select("vehicle", "family").distinct()
    absent = folds.select("vehicle", "fold").distinct().join(attacked, "vehicle").join(folds.where("is_eval AND y = 1").select("vehicle", "fold", "family").distinct(), ["vehicle", "fold", "family"], "left_anti")
    pool = splits.pools(b.labelled.where("y = 0")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    names = b.scores.select("target", "model").distinct()
    frame = ["capture", "aid", "dlc", "b"]
    relabelled = src.relabelled(b.frames.drop("y"), b.frames.where("y = 0"), frame).groupBy("capture").agg(F.sum("y").alias("found"))
    labels = b.frames.groupBy("capture").agg(F.sum("y").alias("given")).join(relabelled, "capture")
    own = b.vocabulary.select("vehicle", "pos", "aid")
    pooled = b.pooled.select(F.col("target").alias("vehicle"), "pos", "aid")
    unlike = own.join(pooled, ["vehicle", "pos", "aid"], "left_anti").select("vehicle").distinct()
    flat = b.raw.agg(*[F.max(f"b{i}_std").alias(f"b{i}") for i in range(8)]).select(sum([F.coalesce((F.col(f"b{i}") <= 0).cast("int"), F.lit(1)) for i in range(1, 8)], F.coalesce((F.col("b0") <= 0).cast("int"), F.lit(1))).alias("bad"))
    pairs = _pairs(spark, d).where("metric = 'pr_auc'").groupBy("model").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    trails = windows.trailing(windows.labels(b.windows), "widx", 8, "t")
    suspension = b.predicted.where("y = 1 AND tag = 'fa10' AND family = 'suspension'").groupBy("target", "model").agg(F.avg("pred").alias("r"))
    counts = {
        "clean windows differ between pools": pool.agg(F.greatest(F.count_distinct("n") - 1, F.lit(0)).alias("bad")),
        "families absent from a fold": absent.agg(one),
        "seeds that clash": names.agg((F.count(F.lit(1)) - F.count_distinct(F.md5(F.concat_ws("|", F.lit("f0"), "target", "model")))).alias("bad")),
        "unresolvable at the primary point": b.points.where("NOT resolvable AND tag = 'fa1'").agg(one),
        "labels that a multiset difference doesn't give": labels.where("given <> found").agg(one),
        "labelled frames with malformed payloads": b.frames.where((F.col("y") == 1) & ((F.col("dlc") < 0) | (F.col("dlc") > 8) | (F.size(F.filter("b", lambda x: x >= 0)) != F.col("dlc")))).agg(one),
        "vehicles whose own vocabulary isn't the pool's": unlike.agg(one),
        "payload columns that never vary": flat,
        "models better without the second set": pairs.where("b < a").agg(one),
        "trails that leave their capture": trails.where(F.exists("t", lambda x: x > F.col("widx")) | (F.element_at("t", -1) != F.col("widx")) | (F.size("t") != 8)).agg(one),
        "calibrated and evaluated": cross.where("is_calib AND is_eval").agg(one),
        "models that find suspension": suspension.where("r >= 0.1").agg(one),
        "vehicles whose window seconds hang on attacks": b.seconds.where("abs(win_seconds - win_seconds_all) > 1e-6").agg(one),
        "negative gaps": b.messages.where("dt < 0").agg(one),
        "unlabelled windows": cross.where("q IS NULL OR q > 3").agg(one),
    }
    return union_all([c.select(F.lit(n).alias("check_name"), F.col("bad").cast("long").alias("bad")) for n, c in counts.items()])


@query("x_streaming_windows", "SELECT event_type, (epoch_us(ts) // 86400000000)::BIGINT AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    from busloom.streaming.windows import daily_counts

    return daily_counts(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bus-load detector end to end: windows, profile, scores, thresholds, recall at each budget."""
    b = bus(spark, sf_dir)
    return b.confusion.where("model IN ('Rule:BusLoad', 'Rule:BusLoad@target')")


_SQL["flagship_bus_load"] = with_pieces(
    "SELECT target, model, tag, "
    + big("tp", "fp", "pos", "n")
    + """, round(win_seconds, 6) AS win_seconds, round(tp / greatest(pos, 1)::DOUBLE, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
    round(fp / greatest(n - pos, 1)::DOUBLE, 6) AS fpr, round(fp / greatest(n - pos, 1)::DOUBLE * 3600 / greatest(win_seconds, 1e-9), 6) AS fa_per_hour FROM conf WHERE model LIKE 'Rule:BusLoad%'"""
)


#: Queries that fit dozens of models each.
LONGEST = ("e1_rank_average_hybrid", "e2_stacking", "c3_control_feature_sets", "c2_control_sources", "c1_control_matched_volume", "g4_job_loop")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship_bus_load": lambda spark, sf_dir: rounded(flagship(spark, sf_dir)), **_QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
