"""Boosted trees against exhaustive search, each way of growing against what sets it apart, and Spark's sums against one task's."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from busloom.operators import boosting, learners
from busloom.operators.boosting import FAMILIES, Block, Local

KEY = ["capture", "widx"]


def block(bins, y, models=1, base=0.0):
    return Block(np.asarray(bins, np.uint8), np.asarray(y, float), np.ones(len(y)), np.arange(len(y)), base, models)


def table(n=500, d=4, seed=0, levels=9):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, levels, (n, d))
    y = (bins[:, 0] * bins[:, 1] + rng.normal(0, 6, n) > 16).astype(float)
    return bins, y


def loss(margin, y):
    return np.mean(np.logaddexp(0, -margin * (2 * y - 1)))


def exhaustive(bins, g, h, rows, l2, least_hessian, depth):
    """(column, cut, left, right) or a leaf's value, by trying every cut of every column."""
    fit = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
    best = (1e-12, None, None)
    if depth:
        for f in range(bins.shape[1]):
            for c in range(bins.max()):
                left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= least_hessian:
                    gain = fit(left) + fit(right) - fit(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, c)
    if best[1] is None:
        return -g[rows].sum() / (h[rows].sum() + l2)
    _, f, c = best
    deeper = [exhaustive(bins, g, h, part, l2, least_hessian, depth - 1) for part in (rows[bins[rows, f] <= c], rows[bins[rows, f] > c])]
    return f, c, *deeper


def shape(tree, node=0):
    if tree.column[node] < 0:
        return tree.values[0, node]
    return tree.column[node], tree.cut[node], shape(tree, tree.left[node]), shape(tree, tree.right[node])


def flat(x):
    return [v for part in x for v in flat(part)] if isinstance(x, tuple) else [x]


def test_depthwise_tree_is_the_exhaustive_search():
    bins, y = table()
    growth = replace(FAMILIES["XGBoost"], rounds=1, step=1.0, depth=3, rows=1.0, columns=1.0)
    tree = boosting.boost(Local(block(bins, y)), growth, 9, 4, 1)[0]
    want = exhaustive(bins, 0.5 - y, np.full(len(y), 0.25), np.arange(len(y)), 2.0, 1.0, 3)
    assert flat(shape(tree)) == pytest.approx(flat(want))


def test_leafwise_growth_spends_leaves_better():
    bins, y = table(4000, seed=3, levels=30)
    deep = replace(FAMILIES["LightGBM"], rounds=1, step=1.0, leaves=16, rows=1.0, columns=1.0)
    level = replace(deep, leaves=None, depth=4)
    sources = [Local(block(bins, y)) for _ in range(2)]
    trees = [boosting.boost(s, g, 30, 4, 1)[0] for s, g in zip(sources, (deep, level), strict=True)]
    assert len(trees[0].leaves()) == 16 >= len(trees[1].leaves())
    assert flat(shape(trees[0])) != flat(shape(trees[1]))

    def fitted(tree, source):  # what growth lowers: the quadratic model of the loss
        g, h = source.block.derivatives(np.zeros(len(y)))
        at = tree.place(source.block.bins)
        return sum(-g[at == i].sum() ** 2 / (h[at == i].sum() + 2.0) for i in tree.leaves())

    assert fitted(trees[0], sources[0]) < fitted(trees[1], sources[1])


def test_leafwise_takes_the_largest_gain_first():
    bins, y = table(800, seed=5)
    growth = replace(FAMILIES["HistGB"], rounds=1, step=1.0, leaves=6)
    tree = boosting.boost(Local(block(bins, y)), growth, 9, 4, 1)[0]
    g, h = 0.5 - y, np.full(len(y), 0.25)
    leaves = [np.arange(len(y))]
    while len(leaves) < 6:
        options = []
        for i, rows in enumerate(leaves):
            for f in range(4):
                for c in range(8):
                    left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                    if min(len(left), len(right)) >= 20:
                        fit = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
                        options.append((fit(left) + fit(right) - fit(rows), -i, left, right))
        gain, i, left, right = max(options, key=lambda o: o[0])
        leaves.pop(-i)
        leaves += [left, right]
    at = tree.place(bins.astype(np.uint8))
    assert sorted(map(tuple, leaves)) == sorted(tuple(np.flatnonzero(at == i)) for i in tree.leaves())


def test_ordered_gradients_are_less_biased_by_their_own_labels():
    """Labels that nothing tells: what margins still say of them is bias. Of ordered margins only the choice of cuts adds some."""
    sums = np.zeros(3)
    for seed in range(5):
        rng = np.random.default_rng(seed)
        bins, y = rng.integers(0, 60, (600, 3)), rng.integers(0, 2, 600).astype(float)
        growth = replace(FAMILIES["CatBoost"], rounds=30)
        own, plain = block(bins, y, 11), block(bins, y)
        trees = boosting.boost(Local(own), growth, 60, 3, 1)
        boosting.boost(Local(plain), replace(growth, symmetric=False, depth=6), 60, 3, 1)
        sums += [np.mean((2 * y - 1) * m) for m in (plain.margins[0], own.margins[-1], own.own_margin())]
        for t in trees:  # one cut a level
            level = [0]
            while t.column[level[0]] >= 0:
                assert len({(t.column[n], t.cut[n]) for n in level}) == 1
                level = [c for n in level for c in (t.left[n], t.right[n])]
    plain, whole, unseen = sums
    assert plain > 1.5 and whole > 0.5 and abs(unseen) < 0.4 * whole and abs(unseen) < 0.2 * plain


def test_ordered_model_has_only_seen_rows_before():
    bins, y = table(200, seed=2)
    growth = replace(FAMILIES["CatBoost"], rounds=4, depth=3)
    one = block(bins, y, 9)
    boosting.boost(Local(one), growth, 9, 4, 1)
    changed = y.copy()
    changed[128:] = 1 - changed[128:]
    # trees' cuts follow all rows, so hold the cuts fixed and refit the leaves alone
    trees = boosting.boost(Local(block(bins, y, 9)), growth, 9, 4, 1)
    for labels in (y, changed):
        other = block(bins, labels, 9)
        for k, t in enumerate(trees):
            sums = other.leaf_sums(t)
            values = -growth.step * sums[..., 0] / (sums[..., 1] + growth.l2)
            if k == 0:
                assert np.allclose(values[:8], trees[0].values[:8])  # models of the first 128 rows at most


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 5)), 2)
    y = ((x[:, 0] * x[:, 1] > 0.2) | (x[:, 2] > 1.2)).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(y=y, capture="c", widx=np.arange(900)))


@pytest.mark.parametrize("kind", list(FAMILIES))
def test_blocks_summed_by_spark_grow_the_same_trees(spark, points, kind, monkeypatch):
    growth = replace(FAMILIES[kind], rounds=2, leaves=FAMILIES[kind].leaves and 8, depth=FAMILIES[kind].depth and 3)
    whole = boosting.Boosted(kind, list("abcde"), growth=growth).fit(points, KEY)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 250)
    monkeypatch.setattr(boosting, "HELD", 2)
    parts = boosting.Boosted(kind, list("abcde"), growth=growth).fit(points, KEY)
    assert [(t.column, t.cut) for t in whole.trees] == [(t.column, t.cut) for t in parts.trees]
    assert all(np.allclose(a.values, b.values) for a, b in zip(whole.trees, parts.trees, strict=True))


@pytest.mark.parametrize("kind", list(FAMILIES))
def test_whole_settings_learn(points, kind):
    train, test = points.where("widx % 3 > 0"), points.where("widx % 3 = 0")
    model = learners.learner(kind, list("abcde")).fit(train, KEY)
    got = model.score(test).toPandas()
    assert len(model.trees) == FAMILIES[kind].rounds
    assert ((got.score > 0.5) == (got.y == 1)).mean() > 0.9 and got.score.between(0, 1).all()


def test_boosting_nothing_one_class_and_nulls(spark, points):
    empty = points.limit(0)
    assert learners.learner("XGBoost", list("ab")).fit(empty, KEY).score(empty).collect() == []
    for kind in FAMILIES:
        model = boosting.Boosted(kind, list("ab"), growth=replace(FAMILIES[kind], rounds=3)).fit(points.where("y = 1"), KEY)
        assert model.score(points).where("score < 0.5").count() == 0
    holed = points.withColumn("a", (points.a * 1).cast("double")).selectExpr("nullif(a, 0.5) a", "b", "y", "capture", "widx")
    assert boosting.Boosted("HistGB", ["a", "b"], growth=replace(FAMILIES["HistGB"], rounds=3)).fit(holed, KEY).score(holed).where("score IS NULL").count() == 0


@pytest.mark.parametrize("kind", FAMILIES)
def test_a_block_remembers_the_rows_of_nodes(kind):
    """Sums over remembered rows are those over all rows, to the last bit, and every job's pool is one block."""
    from busloom.plans import jobs

    assert boosting.BLOCK_ROWS >= jobs.CAP_TRAIN
    rng = np.random.default_rng(4)
    bins, y = rng.integers(0, 9, (600, 4)).astype(np.uint8), (rng.random(600) < 0.3).astype(float)
    growth, asked = replace(FAMILIES[kind], rounds=3, least_rows=2, least_hessian=0.0), []

    class Both(Local):
        def histogram(self, tree, nodes, *about):
            got = super().histogram(tree, nodes, *about)
            asked.append(len(nodes))
            assert np.array_equal(got, self.block.histogram(tree, nodes, *about))
            return got

    models = 11 if growth.symmetric else 1
    boosting.boost(Both(Block(bins, y, np.ones(600), np.arange(600), 0.0, models)), growth, 9, 4, 1)
    assert len(asked) > 9 and (growth.symmetric or growth.depth or set(asked) == {1})
