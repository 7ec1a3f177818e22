"""Gradients against finite differences, Spark's sums against one task's, sequences of windows, and nets that learn an order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busloom.operators import evaluation, learners, nets, tape

KINDS = tuple(nets.NETS)


def made(kind, d=3, hidden=8, n=12, seed=0):
    rng = np.random.default_rng(seed)
    w, moments = nets.initial(kind, d, hidden, rng, 5)
    w = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in w.items()}
    x = rng.normal(size=(n, 5, d)) if kind in nets.SEQUENCE else rng.normal(size=(n, d))
    return w, moments, x, rng.integers(0, 2, n).astype(float)


@pytest.mark.parametrize("dropout", [False, True])
@pytest.mark.parametrize("kind", KINDS)
def test_gradients_are_finite_differences(kind, dropout):
    w, moments, x, y = made(kind)
    rng = lambda: np.random.default_rng(9) if dropout else None
    _, g, _ = nets.shard_gradient(kind, w, moments, x, y, 2.5, rng())
    pick = np.random.default_rng(1)
    for name, v in w.items():
        for _ in range(3):
            at, off = tuple(pick.integers(0, s) for s in v.shape), 1e-6
            ends = []
            for sign in (1, -1):
                moved = v.copy()
                moved[at] += sign * off
                ends.append(nets.shard_gradient(kind, {**w, name: moved}, moments, x, y, 2.5, rng())[0])
            assert g[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * off), rel=2e-4, abs=2e-5), name


@pytest.mark.parametrize("kind", KINDS)
def test_spark_sums_are_the_shards_sums(spark, kind):
    features = list("abc")
    net = nets.Net(kind, features, shards=3)
    net.hidden, net.mean, net.scale = 8, np.zeros(3), np.ones(3)
    w, moments, x, y = made(kind, n=31)
    rows = spark.createDataFrame(pd.DataFrame({"x": [v.ravel().tolist() for v in x], "y": y.astype(int), "at": np.arange(31), "shard": np.arange(31) % 3}))
    loss, n, g, seen = net.gradient(rows, w, moments, 1.5, (4, 2, 0))
    parts = [nets.shard_gradient(kind, w, moments, x[i::3], y[i::3], 1.5, np.random.default_rng([4, 2, 0, i])) for i in range(3)]
    assert n == 31 and loss == pytest.approx(sum(p[0] for p in parts))
    assert all(np.allclose(g[k], sum(p[1][k] for p in parts)) for k in w)
    assert all(np.allclose(seen[k][j], sum(p[2][k][j] * len(x[i::3]) / 31 for i, p in enumerate(parts))) for k in moments for j in (0, 1))


def test_adam_steps_by_hand():
    w, adam = {"a": np.array([1.0, -2.0])}, None
    adam = nets.Adam(w)
    adam.step(w, {"a": np.array([0.3, 0.0])})
    assert w["a"] == pytest.approx([1 - 1e-3 * 1e-4 - 1e-3, -2.0 * (1 - 1e-7)], abs=1e-9)
    adam.step(w, {"a": np.array([300.0, 400.0])})  # bounded to a norm of 5
    assert adam.first["a"] == pytest.approx([0.9 * 0.03 + 0.1 * 3, 0.4], rel=1e-6)


@pytest.mark.parametrize("block", [4096, 16])
def test_sequences(spark, block, monkeypatch):
    monkeypatch.setattr(nets, "BLOCK", block)
    rows = spark.createDataFrame([(f"c{c}", i, float(100 * c + i), None if i == 2 else -float(i)) for c, n in ((0, 50), (1, 3), (2, 16), (3, 33)) for i in range(n)], "capture string, widx long, a double, b double")
    got = {(r.capture, r.widx): r.seq for r in nets.sequences(rows, ["a", "b"]).collect()}
    assert len(got) == 102
    for (capture, widx), seq in got.items():
        trail = [max(widx - 7 + i, 0) for i in range(8)]
        assert seq == [v for i in trail for v in (100 * int(capture[1]) + i, 0.0 if i == 2 else -float(i))]


@pytest.fixture(scope="module")
def ordered_pattern(spark):
    """y = 1 where a value swings from window to window, 0 where it lingers; single windows look alike."""
    rng, frames = np.random.default_rng(3), []
    for c in range(24):
        x, keep = np.zeros((40, 2)), -0.9 if c % 2 else 0.9
        x[0] = rng.normal(size=2)
        for i in range(1, 40):
            x[i] = keep * x[i - 1, 0] + np.sqrt(1 - keep**2) * rng.normal(), rng.normal()
        frames.append(pd.DataFrame({"capture": f"c{c:02d}", "widx": np.arange(40), "a": x[:, 0], "b": x[:, 1], "y": c % 2}))
    table = spark.createDataFrame(nets.sequences(spark.createDataFrame(pd.concat(frames)), ["a", "b"]).toPandas())
    return table.where("capture < 'c14' AND widx > 6"), table.where("capture >= 'c14' AND widx > 6")


@pytest.mark.parametrize("kind", nets.SEQUENCE)
def test_nets_learn_what_only_the_order_tells(spark, ordered_pattern, kind, monkeypatch):
    monkeypatch.setattr(nets, "RATE", 5e-3)
    train, test = ordered_pattern
    area = lambda scored: evaluation.ranking(scored.select(F.lit("t").alias("target"), F.lit("m").alias("model"), "y", "score")).first().roc_auc
    net = nets.Net(kind, ["a", "b"], epochs=6, batch=128, shards=2).fit(train, ["capture", "widx"])
    base = learners.Learner("LogReg", ["a", "b"]).fit(train)
    got, plain = area(net.score(test)), area(base.score(test))
    assert got > 0.93 and got > plain + 0.25
    assert net.losses[-1] < 0.8 * net.losses[0]
    again = nets.Net(kind, ["a", "b"], epochs=1, batch=128, shards=2)
    first = again.fit(train, ["capture", "widx"]).losses
    assert first[0] == pytest.approx(net.losses[0], rel=1e-6)  # the same rows, order and shards


def test_perceptron_runs_whole_and_scores_alike(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    table = spark.createDataFrame(pd.DataFrame({"capture": "c", "widx": np.arange(300), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] * x[:, 1] > 0).astype(int)}))
    net = learners.learner("NN:MLP", ["a", "b"])
    net.batch = 64
    scored = net.fit(table, ["capture", "widx"]).score(table).toPandas().sort_values("widx")
    assert len(net.losses) == 16 and net.losses[-1] < net.losses[0]
    weights = {k: tape.T(v) for k, v in net.weights.items()}
    inputs = (table.toPandas().sort_values("widx")[["a", "b"]].to_numpy() - net.mean) / net.scale
    assert np.allclose(scored.score, tape.logistic(nets.perceptron(weights, tape.T(inputs), nets.Pass(net.moments, False)).data))


def test_net_of_no_rows(spark):
    empty = spark.createDataFrame([], "capture string, widx long, a double, y int")
    assert nets.Net("NN:MLP", ["a"]).fit(empty, ["capture", "widx"]).score(empty).collect() == []
