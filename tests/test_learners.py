"""Running sums along an order, forests of random cuts, and the settings of the learners."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busloom.operators import learners, ordered, splits


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": np.round(rng.normal(size=3000) ** 3, 1), "n": rng.integers(0, 5, 3000)})
    frame = frame.groupby(["g", "x"], as_index=False).n.sum()
    got = ordered.running(spark.createDataFrame(frame), ["g"], "x", {"c": "n"}, descending).toPandas().sort_values(["g", "x"])
    want = frame.sort_values(["g", "x"], ascending=[True, not descending])
    want["c"] = want.groupby("g").n.cumsum()
    want = want.sort_values(["g", "x"])
    assert got[["g", "x", "c"]].to_numpy().tolist() == want[["g", "x", "c"]].to_numpy().tolist()


def test_row_numbers(spark):
    rows = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    order = splits.hash_order("id", seed="s")
    got = ordered.numbered(rows, ["y"], order, ["id"], "i").withColumn("h", order).toPandas().sort_values(["y", "h", "id"])
    assert all(part.i.tolist() == list(range(1, len(part) + 1)) for _, part in got.groupby("y"))
    assert ordered.numbered(rows.limit(0), ["y"], order, ["id"], "i").count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.8) & (x[:, 1] < 0.5)).astype(int)
    frame = pd.DataFrame(x, columns=list("abcd")).assign(y=y, capture="c", widx=np.arange(400))
    return spark.createDataFrame(frame)


def test_extra_trees(points):
    got = learners.learner("ExtraTrees", list("abcd"), effort=learners.Effort(0.1)).fit(points, ["capture", "widx"]).score(points).toPandas()
    assert ((got.score > 0.5) == (got.y == 1)).mean() > 0.95 and got.score.between(0, 1).all()


def test_isolation_forest_sets_outliers_apart(spark, points):
    far = spark.createDataFrame([(9.0, -9.0, 9.0, 9.0, 1, "c", 999)], points.schema)
    model = learners.IsolationForest(list("abcd"), effort=learners.Effort(0.1)).fit(points, ["capture", "widx"])
    got = model.score(points.unionByName(far)).toPandas().set_index("widx").score
    assert got.idxmax() == 999 and got.between(0, 1).all()


def test_settings_are_whole_by_default():
    assert learners.FULL.rounds("LightGBM") == 500 and learners.FULL.levels("RandomForest") == 30
    assert learners.Effort(0.02, 5).rounds("XGBoost") == 8 and learners.Effort(0.0001).rounds("HistGB") == 3
    assert learners.learner("LightGBM", ["a"]).growth.rounds == 500 and learners.learner("NN:MLP", ["a"]).epochs == 16
    assert {k for kinds in learners.ENSEMBLES.values() for k in kinds} <= set(learners.SETTINGS)
    names = [n for _, n in learners.detectors("FS-B", True)]
    assert len(names) == 8 * 2 + 2 + len(learners.SETTINGS) + len(learners.ENSEMBLES)


def test_forests_read_the_whole_pool_in_one_order(points):
    model = learners.ExtraTrees(list("abcd"))
    whole = model._sample(points, ["capture", "widx"], ["widx", "y"])
    assert sorted(whole[:, 0]) == list(range(400)) and whole[:, 0].tolist() != list(range(400))
    assert model._sample(points.repartition(7), ["capture", "widx"], ["widx", "y"]).tolist() == whole.tolist()
    assert model._sample(points.limit(0), ["capture", "widx"], ["widx"]).shape == (0, 1)


def test_stacking_and_rank_average(points):
    train, test = points.where("widx % 3 > 0"), points.where("widx % 3 = 0")
    for model, keys in ((learners.Stacked(("XGBoost", "ExtraTrees"), list("abcd"), learners.Effort(0.1)), ()), (learners.RankAveraged(("XGBoost", "ExtraTrees"), list("abcd"), learners.Effort(0.1)), (["capture", "widx", "y"],))):
        got = model.fit(train, ["capture", "widx"]).score(test, *keys).toPandas()
        assert len(got) == 134 and got.score[got.y == 1].mean() > got.score[got.y == 0].mean() + 0.3


def test_forest_is_grown_in_tasks(points):
    model = learners.learner("RandomForest", list("abcd"), effort=learners.Effort(0.02)).fit(points, ["capture", "widx"])
    assert isinstance(model, learners.RandomForest) and len(model.trees) == 6
    assert {r["score"] for r in model.score(points).select(F.col("score").between(0, 1).alias("score")).collect()} == {True}


@pytest.mark.parametrize("resampled", [False, True])
def test_grown_trees(resampled):
    """Leaves are their rows' weighted shares, none below two rows; of all cuts the root takes the purest one by exhaustive search."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (3, 400)).astype(float)
    x[2] = 1.0
    y, w = ((x[0] > 2) & (rng.random(400) < 0.8)).astype(float), np.ones(400)
    values, ranks = zip(*[np.unique(c, return_inverse=True) for c in x], strict=True)
    f, cut, left, right, value = learners.grown(np.stack(ranks).astype(np.int32) if resampled else x, y, w, np.random.default_rng(6), 2, 30, values if resampled else None)
    times = np.random.default_rng(6).poisson(1.0, 400) if resampled else np.ones(400, dtype=int)
    at = np.zeros(400, dtype=int)
    while (f[at] >= 0).any():
        some = np.flatnonzero(f[at] >= 0)
        at[some] = np.where(x[f[at[some]], some] < cut[at[some]], left[at[some]], right[at[some]])
    for leaf in np.unique(at[times > 0]):
        mine = at == leaf
        assert times[mine].sum() >= 2 and abs(value[leaf] - (times * y)[mine].sum() / times[mine].sum()) < 1e-12
    assert (f >= 0).sum() > 3 and not (f == 2).any()
    if resampled:

        def gini(c, t):
            sides = [x[c] < t, x[c] >= t]
            return sum((times * y)[s].sum() * (1 - (times * y)[s].sum() / times[s].sum()) for s in sides)

        assert abs(gini(f[0], cut[0]) - min(gini(c, t) for c in (0, 1) for t in (0.5, 1.5, 2.5, 3.5, 4.5))) < 1e-9


def test_rank_average_scores_members_once(points):
    model = learners.RankAveraged(("ExtraTrees",), list("abcd"), learners.Effort(0.01)).fit(points, ["capture", "widx"])
    got = model.score(points, ["capture", "widx"])
    assert got.count() == 400 and "MapInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
