"""Learned detectors: MLlib classifiers, boosted trees, nets, forests of random cuts grown in tasks, rank averages and stacking, and the detector registry."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import boosting, nets, rules, splits
from busloom.settings import EPS
from busloom.sources import sinks

#: Windows that an isolation forest, or extremely randomised trees, are fitted on, at most: the protocol's greatest training pool, so
#: that no job's pool is cut.
FOREST_ROWS = 150_000
#: Trees of an isolation forest and points of each, at most: fixed values of the detector.
ISOLATION_TREES, TREE_POINTS = 200, 4096
#: The families with their rounds (trees, iterations or epochs) and greatest depth: fixed values of the detectors.
SETTINGS = {
    "LogReg": {"rounds": 3000},
    "RandomForest": {"rounds": 300, "depth": 30},
    "ExtraTrees": {"rounds": 300, "depth": 64},
    **{k: {"rounds": g.rounds, "depth": g.depth} for k, g in boosting.FAMILIES.items()},
    **{k: {"rounds": epochs} for k, (epochs, _) in nets.NETS.items()},
}
#: The members of the ensembles.
ENSEMBLES = {
    "Ens:RankAvg-Trees": ("XGBoost", "LightGBM", "RandomForest"),
    "Ens:Stack-Trees": ("XGBoost", "LightGBM", "RandomForest", "ExtraTrees"),
    "Ens:RankAvg-Hybrid": ("XGBoost", "LightGBM", "RandomForest", "NN:MLP", "NN:CNN1D"),
}
#: Kinds that read sequences of windows.
SEQUENCE = {*nets.SEQUENCE, *[name for name, kinds in ENSEMBLES.items() if set(kinds) & set(nets.SEQUENCE)]}


@dataclass(frozen=True)
class Effort:
    """share of the settings' rounds (3 at least) and a cap on depth; the default is the whole."""

    share: float = 1.0
    depth: int = 64

    def rounds(self, kind: str) -> int:
        return max(3, round(SETTINGS[kind]["rounds"] * self.share))

    def levels(self, kind: str) -> int:
        return min(self.depth, SETTINGS[kind]["depth"])


FULL = Effort()


def side_by_side(tasks: list[Callable], threads: int = 8) -> list:
    """Results of independent Spark jobs that are submitted at the same time."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def scaling(fit_rows: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, in one pass."""
    row = fit_rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 0.0) for f in features}


def scaled(rows: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({f: (F.col(f) - m) / (s if s > EPS else 1.0) for f, (m, s) in by.items()})


def balanced(rows: DataFrame) -> DataFrame:
    """Adds weight: each class counts for half of all rows."""
    n, pos = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    pos = pos or 0
    w1, w0 = n / (2 * max(pos, 1)), n / (2 * max(n - pos, 1))
    return rows.withColumn("weight", F.when(F.col("y") == 1, w1).otherwise(w0))


def classifier(kind: str, seed: int, rows: int, effort: Effort = FULL):
    """An MLlib estimator of the family."""
    column, rounds = {"featuresCol": "vector", "labelCol": "y"}, effort.rounds(kind)
    if kind == "LogReg":
        return LogisticRegression(**column, weightCol="weight", maxIter=rounds, regParam=1 / max(rows, 1))  # C = 1
    if kind == "RandomForest":
        return RandomForestClassifier(**column, weightCol="weight", numTrees=rounds, minInstancesPerNode=2, maxDepth=min(30, effort.levels(kind)), featureSubsetStrategy="sqrt", seed=seed)
    raise ValueError(f"MLlib has no learner for {kind}")


class Learner:
    """fit(rows with features and y), then score(rows): adds score, the probability of y = 1 (the raw margin's sigmoid)."""

    def __init__(self, kind: str, features: list[str], seed: int = 1, effort: Effort = FULL):
        self.kind, self.features, self.seed, self.effort = kind, features, seed, effort
        self.assembler = VectorAssembler(inputCols=features, outputCol="vector")

    def fit(self, rows: DataFrame, key: list[str] | None = None) -> Learner:
        self.by = scaling(rows, self.features)
        made = classifier(self.kind, self.seed, rows.count(), self.effort)
        self.model = made.fit(self.assembler.transform(balanced(scaled(rows, self.by))))
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        plain = scaled(rows.withColumn("_row", F.struct(*rows.columns)), self.by)
        scored = self.model.transform(self.assembler.transform(plain))
        return scored.select("_row.*", vector_to_array("probability")[1].alias(out))


class _Trees:
    """Trees of random cuts, grown side by side in tasks on one bounded, broadcast sample; each is arrays of (feature or -1, cut or a leaf's value, left, right)."""

    def __init__(self, features: list[str], seed: int = 1, effort: Effort = FULL):
        self.features, self.seed, self.effort = features, seed, effort

    def _sample(self, rows: DataFrame, key: list[str], columns: list[str]) -> np.ndarray:
        """All rows in the order of a seeded hash of the key, packed by tasks; of more than FOREST_ROWS, the first ones.

        At most FOREST_ROWS * columns * 8 bytes, 90 MB for the widest feature set.
        """
        first = rows.select(*key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).orderBy(splits.hash_order(*key, seed=str(self.seed)), *key)
        first = first.select("x") if rows.limit(FOREST_ROWS + 1).count() <= FOREST_ROWS else first.select("x").limit(FOREST_ROWS)

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"x": [np.stack(frame["x"]).astype(np.float64).tobytes()]})

        packed = b"".join(r["x"] for r in first.mapInPandas(pack, "x binary").collect())
        return np.frombuffer(packed).reshape(-1, len(columns))

    def _grow(self, spark, shared, trees: int, grow) -> list[tuple[np.ndarray, ...]]:
        sample = spark.sparkContext.broadcast(shared)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in frame["id"]:
                    f, cut, left, right, value = grow(sample.value, np.random.default_rng([self.seed, int(i)]))
                    bound = np.where(np.asarray(f) >= 0, cut, value)  # a leaf's value lies where an inner node's cut does
                    yield pd.DataFrame({"tree": [pickle.dumps((np.asarray(f, np.int16), bound, np.asarray(left, np.int32), np.asarray(right, np.int32)))]})

        parts = min(trees, 2 * spark.sparkContext.defaultParallelism)
        made = [pickle.loads(r["tree"]) for r in spark.range(0, trees, 1, parts).mapInPandas(run, "tree binary").collect()]  # bounded by the parameters
        sample.destroy()
        return made

    def _values(self, rows: DataFrame, out: str, mean_to_score, by: dict | None) -> DataFrame:
        """Adds out: mean_to_score of the mean value of the leaves that a row falls into; Arrow batches against the broadcast trees."""
        shared = rows.sparkSession.sparkContext.broadcast((self.trees, by, self.features))
        shape = rows.select("*", F.lit(0.0).alias(out)).schema

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees, by, features = shared.value
            for frame in frames:
                x = np.column_stack([frame[f].to_numpy(dtype=np.float64) if by is None else (frame[f].to_numpy() - by[f][0]) / (by[f][1] if by[f][1] > EPS else 1.0) for f in features])
                total = np.zeros(len(x))
                for f, bound, left, right in trees:
                    at = np.zeros(len(x), dtype=np.int64)
                    while (inner := f[at] >= 0).any():
                        some = np.flatnonzero(inner)
                        n = at[some]
                        at[some] = np.where(x[some, f[n]] < bound[n], left[n], right[n])
                    total += bound[at]
                yield frame.assign(**{out: mean_to_score(total / max(len(trees), 1))})

        return rows.mapInPandas(run, shape)


class IsolationForest(_Trees):
    """Fitted on attack-free windows; the score rises with the ease of isolation by random cuts."""

    def fit(self, rows: DataFrame, key: list[str]) -> IsolationForest:
        self.by = scaling(rows, self.features)
        sample = self._sample(scaled(rows, self.by), key, self.features)
        self.points = points = max(2, min(TREE_POINTS, len(sample)))
        limit = math.ceil(math.log2(points))

        def grow(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
            nodes: list[tuple] = []

            def node(x: np.ndarray, depth: int) -> int:
                at = len(nodes)
                nodes.append((-1, 0.0, 0, 0, depth + _average_depth(len(x))))
                spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
                if depth < limit and len(spread):
                    f = int(rng.choice(spread))
                    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
                    nodes[at] = (f, cut, node(x[x[:, f] < cut], depth + 1), node(x[x[:, f] >= cut], depth + 1), 0.0)
                return at

            node(sample[rng.choice(len(sample), min(points, len(sample)), replace=False)], 0)
            return tuple(np.array(c) for c in zip(*nodes, strict=True))

        trees = max(3, round(ISOLATION_TREES * self.effort.share))
        self.trees = self._grow(rows.sparkSession, sample, trees, grow) if len(sample) else []
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        usual = max(_average_depth(self.points), 1e-9)
        return self._values(rows, out, lambda mean: 2.0 ** (-mean / usual), self.by)


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, tried: int, levels: int, values: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """One tree, all nodes of a level at once: (feature or -1, cut, left, right, value) as arrays.

    A node draws `tried` of the features that vary in it and takes the purest cut. x has a row for each feature: its values,
    with one random cut each; or, with values, its ranks among these: then rows are resampled and all cuts looked at. Leaves
    have two rows at least.
    """
    times = np.ones(len(y), dtype=np.int64) if values is None else rng.poisson(1.0, len(y))
    w = w * times
    wy = w * y
    rows = np.flatnonzero(times)
    n, made = np.array([len(rows)]), 1  # rows of this level's nodes, all nodes so far
    f, cut, left, value = [np.array([-1])], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1)]
    for depth in range(levels + 1 if len(rows) else 0):
        starts = np.cumsum(n) - n
        all_, ones, count = (np.add.reduceat(q[rows], starts) for q in (w, wy, times))
        value[-1][:] = ones / np.maximum(all_, EPS)
        kept = (count >= 4) & (ones > 0) & (ones < all_ * (1 - 1e-12)) if depth < levels else np.zeros(len(n), dtype=bool)
        if not kept.any():
            break
        at = np.flatnonzero(kept)
        rows, n, totals = rows[np.repeat(kept, n)], n[kept], np.stack([all_, ones, count])[:, kept]
        order = np.argsort(rng.random((len(n), len(x))), axis=1)
        purest, feature, bound, shown = np.full(len(n), np.inf), np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
        found, open_ = np.zeros(len(n), np.int64), np.arange(len(n))
        r, m = rows, n  # of the nodes that still draw features
        for j in range(len(x)):
            if (found[open_] >= tried).any():
                more = found[open_] < tried
                r, open_, m = r[np.repeat(more, m)], open_[more], m[more]
            if not len(open_):
                break
            starts, seg, which, of = np.cumsum(m) - m, np.repeat(np.arange(len(m)), m), order[open_, j], totals[:, open_]
            v = x[which[seg], r]
            low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
            varies = high > low
            found[open_] += varies
            if values is None:
                b = show = low + (high - low) * rng.random(len(m))
                below = v < b[seg]
                impure = _impurity(*(np.add.reduceat(q[r] * below, starts) for q in (w, wy, times)), *of)
            else:
                o = np.argsort(seg * len(y) + v)
                v, sums = v[o], [np.cumsum(q[r[o]]) for q in (w, wy, times)]
                sums = [q - np.repeat(np.r_[0, q[starts[1:] - 1]], m) for q in sums]
                each = _impurity(*sums, *of[:, seg])
                each[np.r_[v[1:] == v[:-1], True]] = np.inf
                each[starts + m - 1] = np.inf
                impure = np.minimum.reduceat(each, starts)
                hit, first = np.flatnonzero(each == impure[seg])[::-1], np.zeros(len(m), np.int64)
                first[seg[hit]] = hit  # the last one written is the first of its node
                b, after = v[first] + 0.5, v[np.minimum(first + 1, len(v) - 1)]
                show = np.array([_middle(values[c], p, q) for c, p, q in zip(which, v[first], after, strict=True)])
            better = varies & (impure < purest[open_])
            chosen = open_[better]
            purest[chosen], feature[chosen], bound[chosen], shown[chosen] = impure[better], which[better], b[better], show[better]
        is_cut = np.isfinite(purest)
        if not is_cut.any():
            break
        inner, seg = at[is_cut], np.repeat(np.arange(len(n)), n)
        f[-1][inner], cut[-1][inner], left[-1][inner] = feature[is_cut], shown[is_cut], made + 2 * np.arange(len(inner))
        rows, seg = rows[is_cut[seg]], (np.cumsum(is_cut) - 1)[seg[is_cut[seg]]]
        side = 2 * seg + (x[feature[is_cut][seg], rows] >= bound[is_cut][seg])
        rows, n = rows[np.argsort(side, kind="stable")], np.bincount(side, minlength=2 * len(inner))
        made += 2 * len(inner)
        for part, fill in ((f, -1), (cut, 0.0), (left, 0), (value, 0.0)):
            part.append(np.full(2 * len(inner), fill))
    f, cut, left, value = (np.concatenate(part) for part in (f, cut, left, value))
    return f, cut, left, np.where(f >= 0, left + 1, 0), value


def _middle(values: np.ndarray, low: int, high: int) -> float:
    """A cut that parts two values: the lower one lies below it."""
    middle = (values[low] + values[high]) / 2
    return middle if middle > values[low] else values[high]


def _impurity(wl, ol, nl, all_, ones, count):
    """Weighted impurity of both sides of a cut; inf with fewer than two rows on one."""
    wr, or_ = all_ - wl, ones - ol
    impure = ol * (1 - ol / np.maximum(wl, EPS)) + or_ * (1 - or_ / np.maximum(wr, EPS))
    return np.where((nl < 2) | (count - nl < 2), np.inf, impure)


class ExtraTrees(_Trees):
    """Extremely randomised trees: at each node one random cut for each of sqrt(features) features, the purest of which is taken."""

    kind, random_cuts = "ExtraTrees", True

    def fit(self, rows: DataFrame, key: list[str]) -> ExtraTrees:
        sample = self._sample(rows, key, [*self.features, "y"])
        positive = sample[:, -1].sum()
        w = np.where(sample[:, -1] > 0, len(sample) / (2 * max(positive, 1)), len(sample) / (2 * max(len(sample) - positive, 1)))
        root, levels = math.sqrt(len(self.features)), self.effort.levels(self.kind)
        x, values = np.ascontiguousarray(sample[:, :-1].T), None
        if not self.random_cuts:
            values, ranks = zip(*[np.unique(c, return_inverse=True) for c in x], strict=True)
            x = np.stack(ranks).astype(np.int32)
        shared = x, sample[:, -1], w, max(1, round(root) if self.random_cuts else math.ceil(root)), values

        def grow(shared: tuple, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
            x, y, w, tried, values = shared
            return grown(x, y, w, rng, tried, levels, values)

        self.trees = self._grow(rows.sparkSession, shared, self.effort.rounds(self.kind), grow) if len(sample) else []
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        return self._values(rows, out, lambda mean: mean, None)


class RandomForest(ExtraTrees):
    """Trees on resampled rows, the purest of all cuts of sqrt(features) features at each node."""

    kind, random_cuts = "RandomForest", False


class Forest:
    """A random forest, grown in tasks up to FOREST_ROWS windows, which no job exceeds, and by MLlib beyond."""

    def __init__(self, features: list[str], seed: int = 1, effort: Effort = FULL):
        self.about = features, seed, effort

    def fit(self, rows: DataFrame, key: list[str]) -> RandomForest | Learner:
        small = rows.limit(FOREST_ROWS + 1).count() <= FOREST_ROWS
        return (RandomForest(*self.about) if small else Learner("RandomForest", *self.about)).fit(rows, key)


def learner(kind: str, features: list[str], seed: int = 1, effort: Effort = FULL):
    if kind not in SETTINGS:
        raise ValueError(f"no learner is called {kind}")
    if kind in ("ExtraTrees", "RandomForest"):
        return (ExtraTrees if kind == "ExtraTrees" else Forest)(features, seed, effort)
    if kind in boosting.FAMILIES:
        growth = boosting.FAMILIES[kind]
        return boosting.Boosted(kind, features, seed, replace(growth, rounds=effort.rounds(kind), depth=growth.depth and effort.levels(kind)))
    if kind in nets.NETS:
        return nets.Net(kind, features, seed, effort.rounds(kind))
    return Learner(kind, features, seed, effort)


def _average_depth(n: int) -> float:
    """The mean depth of an unsuccessful search in a random binary tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def rank_average(scored: DataFrame, reference: DataFrame, members: list[str], keys: list[str], out: str = "score") -> DataFrame:
    """(keys, out): the mean over member detectors of the share of reference scores that are <= a row's."""
    parts = rules.melted(reference, [], members).withColumn("is_ref", F.lit(True)).unionByName(rules.melted(scored, keys, members).withColumn("is_ref", F.lit(False)), allowMissingColumns=True)
    counted = rules.ecdf(parts, ["feature"], "x", "is_ref", "below").where("NOT is_ref")
    sizes = reference.agg(F.count(F.lit(1)).alias("_n"))
    return counted.crossJoin(F.broadcast(sizes)).groupBy(*keys).agg(F.avg(F.col("below") / F.greatest("_n", F.lit(1))).alias(out))


class RankAveraged:
    """Members' scores as shares of their scores on the training rows, averaged."""

    def __init__(self, kinds: tuple[str, ...], features: list[str], effort: Effort = FULL):
        self.kinds, self.features, self.effort = kinds, features, effort
        self.members = [f"s_{i}" for i in range(len(kinds))]

    def _scored(self, rows: DataFrame) -> DataFrame:
        for m, f in zip(self.members, self.fitted, strict=True):
            rows = f.score(rows, m)
        return rows

    def fit(self, train: DataFrame, key: list[str]) -> RankAveraged:
        self.fitted = side_by_side([lambda k=k: learner(k, self.features, effort=self.effort).fit(train, key) for k in self.kinds])
        reference = self._scored(train).select(*self.members)
        path = sinks.scratch(train.sparkSession, "reference")
        reference.write.parquet(path)
        self.reference = train.sparkSession.read.schema(reference.schema).parquet(path)
        return self

    def score(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, score). The members' scores are written first, as ranking reads them twice."""
        scored, path = self._scored(rows).select(*keys, *self.members), sinks.scratch(rows.sparkSession, "members")
        scored.write.parquet(path)
        return rank_average(rows.sparkSession.read.schema(scored.schema).parquet(path), self.reference, self.members, keys)


class Stacked:
    """A logistic model of the members' scores, fitted on scores of rows that the member hasn't seen."""

    def __init__(self, kinds: tuple[str, ...], features: list[str], effort: Effort = FULL, folds: int = 3):
        self.kinds, self.features, self.effort, self.folds = kinds, features, effort, folds
        self.members = [f"s_{i}" for i in range(len(kinds))]

    def fit(self, train: DataFrame, key: list[str]) -> Stacked:
        spark, folder = train.sparkSession, sinks.scratch(train.sparkSession, "stack")
        dealt = splits.stratified_folds(train, self.folds, key, seed="stack")
        dealt.write.parquet(f"{folder}/dealt")  # each fit reads it
        dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
        jobs = [(k, f) for k in self.kinds for f in [*range(self.folds), None]]
        part = lambda f: dealt if f is None else dealt.where(F.col("fold") != f)
        fitted = dict(zip(jobs, side_by_side([lambda k=k, f=f: learner(k, self.features, effort=self.effort).fit(part(f), key) for k, f in jobs]), strict=True))
        unseen = None
        for f in range(self.folds):
            rows = dealt.where(F.col("fold") == f)
            for m, k in zip(self.members, self.kinds, strict=True):
                rows = fitted[k, f].score(rows, m)
            rows = rows.select(*key, "y", *self.members)
            unseen = rows if unseen is None else unseen.unionByName(rows)
        unseen.write.parquet(f"{folder}/unseen")
        self.fitted = [fitted[k, None] for k in self.kinds]
        self.meta = Learner("LogReg", self.members, effort=self.effort).fit(spark.read.schema(unseen.schema).parquet(f"{folder}/unseen"))
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        for m, f in zip(self.members, self.fitted, strict=True):
            rows = f.score(rows, m)
        return self.meta.score(rows, out).drop(*self.members)


def detectors(feature_set: str, cross: bool) -> list[tuple[str, str]]:
    """(scope, name) of the detectors for a feature set. Rules need the full identifier-free set; @target ones are fitted
    on the target's calibration windows and exist across vehicles only."""
    names = ["Rule:CombinedQ", *rules.SINGLE, "Rule:UnseenID", "Rule:Combined"]
    out = []
    if feature_set == "FS-B":
        out += [("fleet", n) for n in names] + ([("target", f"{n}@target") for n in names] if cross else [])
    out += [("fleet", "IForest")] + ([("target", "IForest@target")] if cross else [])
    return out + [("fleet", k) for k in (*SETTINGS, *ENSEMBLES)]
