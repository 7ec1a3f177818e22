"""The job loop's failures and resuming, rules in every protocol, the controls' vocabularies, exact quantiles and signed-rank tests."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.operators import learners, ordered, reports
from busloom.plans import jobs
from busloom.plans.bus import bus
from busloom.sources import sinks


@pytest.fixture(scope="module")
def b(spark, data):
    return bus(spark, data)


def test_a_failing_detector_leaves_a_row_and_the_others_scores(b, spark):
    kinds = ["Rule:Combined", "Rule:BusLoad", "Rule:None", "NoSuch"]
    store = sinks.scratch(spark, "t")
    scores, done = jobs.run(b, ["FS-B"], kinds, store)
    rows = done.collect()
    assert all(r.n_train > r.n_train_pos >= 0 and r.seconds >= 0 for r in rows)
    log = [r.value for r in spark.read.option("recursiveFileLookup", "true").text(f"{store}/logs").collect()]
    assert len(log) == 9 * 4 and sum("!! ValueError: no learner is called NoSuch" in x for x in log) == 9 and sum(x.endswith(" s scored") for x in log) == 18
    assert len(rows) == 9 * 4 and all((r.error is None) == (r.model in kinds[:2]) for r in rows)
    assert all("no learner is called NoSuch" in r.error for r in rows if r.model == "NoSuch")
    assert {r.model for r in scores.select("model").distinct().collect()} == set(kinds[:2])
    got = jobs.results(b, scores)
    assert {(r.protocol, r.model) for r in got.collect()} == {(p, m) for p in ("cross", "in") for m in kinds[:2]}


def test_a_broken_off_job_is_taken_up_again(b, spark, monkeypatch):
    store, real, ran = sinks.scratch(spark, "t"), jobs.fit_and_score, []

    def breaking(kind, train, parts, features, effort):
        ran.append(1)
        if len(ran) == 5:
            raise KeyboardInterrupt
        return real(kind, train, parts, features, effort)

    monkeypatch.setattr(jobs, "fit_and_score", breaking)
    with pytest.raises(KeyboardInterrupt):
        jobs.run(b, ["FS-B"], ["Rule:BusLoad"], store, threads=1)
    before = jobs.finished(b, store).count()
    assert 4 <= before < 9
    ran[:] = [1] * 10
    _, done = jobs.run(b, ["FS-B"], ["Rule:BusLoad"], store, threads=1)
    assert len(ran) - 10 == 9 - before and done.count() == 9 == done.select(*jobs.SPEC).distinct().count()
    jobs.run(b, ["FS-B"], ["Rule:BusLoad"], store, threads=1)
    assert len(ran) - 10 == 9 - before  # nothing is left to do


def test_rules_across_vehicles_are_those_of_the_rule_queries(b, spark):
    names = ["Rule:Combined", "Rule:Combined@target", "Rule:Periodicity", "Rule:UnseenID"]
    scores, _ = jobs.run(b, ["FS-B"], lambda fs, p: names if p == "cross" else names[:1], sinks.scratch(spark, "t"))
    ours = scores.where("protocol = 'cross' AND side = 'ev'").select("target", "model", "capture", "widx", F.round("score", 5).alias("s"))
    theirs = b.scores.where(F.col("is_eval") & F.col("model").isin(*names)).select("target", "model", "capture", "widx", F.round("score", 5).alias("t"))
    joined = ours.join(theirs, ["target", "model", "capture", "widx"], "full_outer")
    assert ours.count() > 0 and joined.where("s IS NULL OR t IS NULL OR abs(s - t) > 1e-4").count() == 0


def test_a_subset_of_sources_has_its_own_vocabulary(b):
    counts = {}
    for r in b.frames.where("family = 'benign'").groupBy("vehicle", "aid").count().collect():
        counts.setdefault(r["vehicle"], {})[r["aid"]] = r["count"]
    vehicles = sorted(counts)
    target, places = vehicles[0], {}
    for some in [(v,) for v in vehicles[1:]] + [tuple(vehicles[1:])]:
        share = {}
        for v in some:
            for aid, c in counts[v].items():
                share[aid] = share.get(aid, 0) + c / sum(counts[v].values())
        order = sorted(share, key=lambda a: (-round(share[a], 9), a))[: b.s.vocabulary]
        places[some] = order
        got = jobs.table(b, "FS-A", target, True, some)
        assert {r.vehicle for r in got.select("vehicle").distinct().collect()} == {target, *some}
        first = {(r.capture, r.widx): r.h_00 for r in got.collect()}
        windows = {}
        for r in b.windows.where(F.col("vehicle").isin(target, *some)).select("capture", "widx", "aid").collect():
            windows.setdefault((r.capture, r.widx), []).append(r.aid)
        assert first == {k: pytest.approx(v.count(order[0]) / b.s.window) for k, v in windows.items()}
    assert places[(vehicles[1],)] != places[tuple(vehicles[1:])]  # so a pool's vocabulary would be another


@pytest.mark.parametrize(
    ("control", "counts"), [(jobs.volume_control, {"FS-A": 6, "FS-B": 12}), (jobs.source_control, {"FS-A": 9, "FS-B": 18}), (jobs.feature_control, {"FS-A": 3, "FS-A-rank": 3, "FS-B": 6, "FS-B34": 6})]
)
def test_controls_give_every_job_with_all_measures(b, control, counts):
    """Counts are jobs times detectors: three targets by one seed, with two sets of windows, three subsets of sources, or four feature sets."""
    once = {} if control is jobs.feature_control else {"seeds": (0,)}
    got = control(b, ("Rule:Combined", "HistGB"), effort=learners.Effort(0.02), **once).collect()
    found = {}
    for r in got:
        found[r.feature_set] = found.get(r.feature_set, 0) + 1
    assert found == {fs: 5 * n for fs, n in counts.items()}
    assert all(r.recall is not None and r.fpr is not None for r in got) and any(r.event_recall is not None for r in got)


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in ((0, 1000), (1, 7), (2, 1), (3, 2)) for v in np.round(rng.normal(size=n), 1)] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.q for r in ordered.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0], "q").collect()}
    assert set(got) == {0, 1, 2, 3}
    for g, q in got.items():
        assert q == pytest.approx(np.percentile([v for h, v in rows if h == g and v is not None], [0, 25, 50, 99, 100]))


def test_signed_rank_test_by_enumeration():
    for n in range(1, 13):
        totals = np.zeros(n * (n + 1) // 2 + 1)
        for signs in itertools.product((0, 1), repeat=n):
            totals[sum(r for r, s in enumerate(signs, 1) if s)] += 1
        assert reports.signed_rank_counts(n) == totals.astype(int).tolist()
        for w in range(len(totals)):
            upper, lower = totals[w:].sum() / 2**n, totals[: w + 1].sum() / 2**n
            assert reports.wilcoxon_p(n, w, 0, True) == pytest.approx(upper)
            assert reports.wilcoxon_p(n, w, 0, False) == pytest.approx(min(1, 2 * min(upper, lower)))


def test_signed_rank_test_beyond_and_with_ties():
    exact, normal = reports.wilcoxon_p(50, 850, 0, True), reports.wilcoxon_p(51, 850 * 51 * 52 / (50 * 51), 0, True)
    assert 0 < exact < 0.05 and abs(exact - normal) < 0.005
    assert reports.wilcoxon_p(8, 30, 6, True) == pytest.approx(0.5 * np.exp(0) * 1 * (1 - __import__("math").erf((30 - 18) / (8 * 9 * 17 / 24 - 6 / 48) ** 0.5 / 2**0.5)))
    assert np.isnan(reports.wilcoxon_p(0, 0, 0, True))


def test_paired_tests(spark):
    cells = [(p, 0, fs, f"m{m}", f"v{v}", "pr_auc", base + 0.01 * m + 0.003 * v * v + bonus * (1 + m + 3 * v)) for p, fs, base, bonus in (("cross", "FS-A", 0.4, 0.0), ("cross", "FS-B", 0.5, 0.001), ("within", "FS-A", 0.4, -0.002), ("within", "FS-B", 0.5, 0.001)) for m in range(3) for v in range(3)]
    got = {r.comparison: r for r in reports.paired_tests(spark.createDataFrame(cells, "protocol string, fold int, feature_set string, model string, vehicle string, metric string, value double"), ("pr_auc",)).collect()}
    assert got["FS-B > FS-A across"].p == pytest.approx(1 / 512) and got["FS-B > FS-A across"].frac_better == 1
    assert got["within or across, FS-A"].p == pytest.approx(2 / 512) and got["within or across, FS-A"].mean_diff == pytest.approx(-0.01)
    assert got["within or across, FS-B"].p is None or np.isnan(got["within or across, FS-B"].p)  # no difference at all
