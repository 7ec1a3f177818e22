"""Hand-computed cases of the windowing, splitting and evaluation rules."""

import math

import pytest
from pyspark.sql import functions as F

from busloom.operators import evaluation, messages, profile, reports, rules, splits, windows
from busloom.settings import Settings
from busloom.sources import frames as src

S = Settings(window=4, min_count=2, max_period=100.0, max_rel_iqr=10.0, vocabulary=48)
SHAPE = "vehicle string, capture string, family string, seq long, us long, aid int, dlc int, b array<int>, y int, s0 long, s1 long"


def frame(seq, us, aid=1, dlc=2, b=(1, 2), y=0, capture="c", family="benign", vehicle="v", s0=None, s1=None):
    return (vehicle, capture, family, seq, us, aid, dlc, [*b, *[-1] * (8 - len(b))], y, s0, s1)


def made(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def test_trailing_frames_stay_in_profile_only(spark):
    f = made(spark, [frame(i, i * 1_000_000) for i in range(11)] + [frame(i, i * 1_000_000, capture="short") for i in range(5)])
    ids = profile.id_profile(f, S)
    w = windows.windowed(messages.per_message(f, ids), S)
    assert sorted((r.capture, r.widx, r["count"]) for r in w.groupBy("capture", "widx").count().collect()) == [("c", 0, 4), ("c", 1, 4)]
    assert ids.first().cnt == 16
    assert profile.vehicle_profile(f).first().seconds == 14.0


def test_first_frame_and_hamming(spark):
    f = made(spark, [frame(0, 0, dlc=8, b=range(1, 9)), frame(1, 10, dlc=4, b=(1, 2, 3, 4))])
    m = messages.per_message(f, profile.id_profile(f, S)).orderBy("seq").collect()
    assert (m[0].dt, m[0].dt_id, m[0].ham) == (0.0, None, None)
    assert m[1].ham == 4.0


def test_payload_flags(spark):
    f = made(spark, [frame(0, 0, b=(255, 255)), frame(1, 1, b=(0, 0)), frame(2, 2, dlc=0, b=())])
    m = messages.per_message(f, profile.id_profile(f, S)).orderBy("seq").collect()
    assert [(r.allzero, r.allff) for r in m] == [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    assert m[2].ent == 0.0


def test_fractions_count_missing_ratios(spark):
    # identifiers 7 and 8 occur once a capture: no gap, no ratio
    rows = [frame(i, u, aid=a) for i, (u, a) in enumerate([(0, 7), (1_000_000, 8), (2_000_000, 1), (2_100_000, 1), (3_100_000, 1), (4_100_000, 1), (5_100_000, 1), (6_100_000, 1)])]
    f = made(spark, rows)
    ids = profile.id_profile(f, S)
    m = messages.per_message(f, ids)
    b = windows.features_b(m, ids, profile.vehicle_profile(f), S).orderBy("widx").collect()
    assert b[0].pr_lt_half == 0.25
    assert b[0].dtid_nan_frac == 0.75


def test_quarters_are_not_ntile(spark):
    rows = spark.createDataFrame([("c", i, 0) for i in range(6)], "capture string, widx long, y int")
    assert [r.q for r in windows.quarters(rows).orderBy("widx").collect()] == [0, 0, 1, 2, 2, 3]


@pytest.mark.parametrize(
    ("scores", "k", "thr"), [([1.0, 2.0, 3.0, 3.0], 1, None), ([1.0, 2.0, 3.0, 4.0], 1, 4.0), ([1.0, 2.0, 3.0, 4.0], 0, None), ([1.0, 2.0, 2.0, 4.0], 3, 2.0), ([float("nan"), 5.0], 1, 5.0)]
)
def test_thresholds_step_over_ties(spark, scores, k, thr):
    calib = spark.createDataFrame([("t", "m", s) for s in scores], "target string, model string, score double")
    points = spark.createDataFrame([("t", "m", "x", k)], "target string, model string, tag string, k long")
    assert evaluation.thresholds(calib, points).first().thr == thr


def test_no_calibration_never_alarms(spark):
    calib = spark.createDataFrame([], "target string, model string, score double")
    points = spark.createDataFrame([("t", "m", "x", 1, 1.0)], "target string, model string, tag string, k long, win_seconds double")
    limits = evaluation.thresholds(calib, points)
    scored = spark.createDataFrame([("t", "m", 9.0, 1)], "target string, model string, score double, y int")
    assert evaluation.alarms(scored, limits).first().pred == 0


@pytest.mark.parametrize(("rows", "roc", "ap"), [([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], 0.75, 5 / 6), ([(1.0, 1), (1.0, 0), (1.0, 0), (1.0, 0)], 0.5, 0.25), ([(1.0, 1)], None, None)])
def test_ranking(spark, rows, roc, ap):
    r = evaluation.ranking(spark.createDataFrame([("t", "m", *x) for x in rows], "target string, model string, score double, y int")).first()
    assert (r.roc_auc, r.pr_auc) == (pytest.approx(roc) if roc else None, pytest.approx(ap) if ap else None)


def test_suspension_is_closed(spark):
    rows = [frame(i, i * 10, capture="p", family="suspension", s0=30, s1=35) for i in range(8)]
    f = made(spark, rows)
    w = windows.windowed(messages.per_message(f, profile.id_profile(f, S)), S)
    assert [r.y for r in windows.labels(w).orderBy("widx").collect()] == [1, 0]


def test_label_repair(spark):
    rows = spark.createDataFrame([(1, "0F1\\"), (1, "0F1"), (1, "0F"), (1, ""), (1, None), (0, "zz")], "y int, h string")
    assert [r[0] for r in rows.select(src.repaired(F.col("y"), F.col("h"))).collect()] == [0, 0, 1, 1, 1, 0]


def test_trailing_pads_with_the_first_window(spark):
    rows = spark.createDataFrame([("c", i) for i in range(3)], "capture string, widx long")
    assert windows.trailing(rows, "widx", 8, "t").orderBy("widx").collect()[2].t == [0] * 6 + [1, 2]


@pytest.mark.parametrize(("cap", "pos", "neg"), [(20, 5, 15), (105, 5, 100), (6, 3, 3)])
def test_capped(spark, cap, pos, neg):
    rows = spark.createDataFrame([("g", i, int(i < 5)) for i in range(105)], "g string, i long, y int")
    got = [r.y for r in splits.capped(rows, ["g"], ["i"], cap, "s").collect()]
    assert (sum(got), len(got) - sum(got)) == (pos, neg)


def test_staleness_leaves_out_unseen_and_takes_equal_times(spark):
    rows = [frame(0, 0, aid=1), frame(1, 1_000_000, aid=1), frame(2, 2_000_000, aid=1), frame(3, 5_000_000, aid=2)] + [frame(4, 5_000_000, aid=1)] + [frame(5 + i, 6_000_000 + i * 1_000_000, aid=2) for i in range(3)]
    f = made(spark, rows)
    ids = profile.id_profile(f, S)
    m = messages.per_message(f, ids)
    first = windows.staleness(m, windows.windowed(m, S), ids).orderBy("widx").first()
    assert first.stale_max == 0.0  # identifier 1 arrives at the very end of the first window's time


def test_split_invariants(spark):
    rows = spark.createDataFrame([("v", "c", i, int(i % 3 == 0), i % 4) for i in range(24)], "vehicle string, capture string, widx long, y int, q int")
    c = splits.cross(rows).collect()
    assert not any(r.is_calib and r.is_eval for r in c) and all(r.is_eval for r in c if r.y)
    folds = [splits.in_domain(rows, k).collect() for k in (0, 1)]
    assert all(sum(f[i].is_eval for f in folds) == 1 for i in range(24) if folds[0][i].y)
    assert not any(r.is_train and r.is_eval for f in folds for r in f)


def test_event_recall(spark):
    rows = spark.createDataFrame([("t", "m", "x", "dos", "c", 1, 1), ("t", "m", "x", "dos", "c", 1, 0)], "target string, model string, tag string, family string, capture string, y int, pred int")
    assert {r.event_recall for r in evaluation.event_recall(rows).collect()} == {1.0}
    assert evaluation.family_recall(rows).first().recall == 0.5


def test_ecdf(spark):
    rows = spark.createDataFrame([("g", 1.0, True), ("g", 1.0, True), ("g", 3.0, True), ("g", 1.0, False), ("g", 2.0, False), ("g", 0.0, False)], "g string, x double, is_ref boolean")
    got = {r.x: r.n or 0 for r in rules.ecdf(rows, ["g"], "x", "is_ref", "n").where("NOT is_ref").collect()}
    assert got == {0.0: 0, 1.0: 2, 2.0: 2}


def test_average_ranks_share_ties(spark):
    rows = spark.createDataFrame([("v", "a", 1.0), ("v", "b", 1.0), ("v", "c", 0.5)], "vehicle string, model string, value double")
    got = {r.model: r.r for r in rows.select("model", reports.average_rank(["vehicle"], "value").alias("r")).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_wilcoxon():
    # 10 positive differences without ties: one of 2**10 choices of signs; with a dropped zero z = (55 - 27.5) / sqrt(96.25)
    assert reports.wilcoxon_p(10, 55.0, 0, True) == 1 / 1024
    assert reports.wilcoxon_p(10, 55.0, 0, True, zeros=1) == pytest.approx(0.5 * math.erfc(27.5 / math.sqrt(96.25) / math.sqrt(2)))


def test_count_aware_labels(spark):
    log = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "seq long, k string")
    base = spark.createDataFrame([(5, "a")], "seq long, k string")
    assert [r.y for r in src.relabelled(log, base, ["k"]).orderBy("seq").collect()] == [0, 1, 1]


def test_stream_count_windows(spark, tmp_path):
    from busloom.streaming.windows import count_windows, drained

    spark.createDataFrame([("c", i, i * 10) for i in range(7)], "capture string, seq long, us long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("capture string, seq long, us long").parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in drained(spark, count_windows(stream, 3), "append", "cw").collect())
    assert got == [("c", 0, 0, 20), ("c", 1, 30, 50)]
