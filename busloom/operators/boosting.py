"""Second-order boosted trees on binned columns: depth-wise, leaf-wise, and ordered with symmetric trees. Spark sums the histograms."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import ordered, splits
from busloom.operators.tape import logistic
from busloom.sources import sinks

#: Cuts of a column, at most, and the accuracy of the quantiles they lie at.
CUTS, ACCURACY = 254, 10_000
#: Rows whose bins a task holds as one block: the protocol's greatest training pool, 12 MB of bins and 100 MB of their places in
#: histograms at most. A table of one block is boosted inside that task; of several, Spark sums the histograms.
BLOCK_ROWS = 150_000
#: Blocks that a worker remembers with their margins.
HELD = 8


@dataclass(frozen=True)
class Growth:
    """How trees grow: up to `leaves` leaves, the one of largest gain first, or all nodes of a level up to `depth` levels.

    l2 is added to a leaf's hessian; rows and columns are the shares drawn for each tree; balanced gives each class half of
    the weight; symmetric trees cut all nodes of a level alike, and their gradients are ordered.
    """

    rounds: int
    step: float
    l2: float
    depth: int | None = None
    leaves: int | None = None
    least_rows: int = 1
    least_hessian: float = 1e-3
    rows: float = 1.0
    columns: float = 1.0
    balanced: bool = False
    symmetric: bool = False


#: The families' settings: fixed values of the detectors and defaults of their libraries.
FAMILIES = {
    "HistGB": Growth(300, 0.08, 1.0, leaves=31, least_rows=20, balanced=True),
    "XGBoost": Growth(400, 0.08, 2.0, depth=6, least_hessian=1.0, rows=0.85, columns=0.85),
    "LightGBM": Growth(500, 0.06, 2.0, leaves=63, least_rows=20, rows=0.85, columns=0.85),
    "CatBoost": Growth(500, 0.08, 3.0, depth=6, symmetric=True),
}


class Tree:
    """Nodes as lists: column (-1 at a leaf), cut (bins up to it go left), left and right; values[m] are the leaves' values for margin m."""

    def __init__(self):
        self.column, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.values = np.zeros((1, 1))

    def split(self, node: int, column: int, cut: int) -> tuple[int, int]:
        left = len(self.column)
        self.column[node], self.cut[node], self.left[node], self.right[node] = column, cut, left, left + 1
        for part in (self.column, self.cut, self.left, self.right):
            part += [-1, -1] if part is self.column else [0, 0]
        return left, left + 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Each row's node."""
        column, cut, left, right = (np.array(x) for x in (self.column, self.cut, self.left, self.right))
        at = np.zeros(len(bins), dtype=np.int64)
        while len(some := np.flatnonzero(column[at] >= 0)):
            n = at[some]
            at[some] = np.where(bins[some, column[n]] <= cut[n], left[n], right[n])
        return at

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.column) if c < 0]


def drawn(number: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row, by its number alone, so that it doesn't hang on how rows lie in blocks."""
    x = number.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


class Block:
    """Rows with their bins and margins. Margins follow from the trees alone, so a block that is lost is made anew.

    Ordered boosting keeps several: margin j is that of a model of the first 2**j rows by number, the last one of all rows.
    The gradient of row i comes from the largest model that hasn't seen it.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, weight: np.ndarray, number: np.ndarray, base: float, models: int):
        self.bins, self.y, self.weight, self.number = bins, y, weight, number
        self.margins, self.applied = np.full((models, len(y)), base), 0
        unseen = np.floor(np.log2(np.maximum(number, 1))).astype(np.int64)  # rows 0 .. 2**j - 1 don't hold row number >= 2**j
        self.own = np.zeros(len(y), dtype=np.int64) if models == 1 else unseen

    def advance(self, trees: list) -> None:
        """trees: each a Tree, or Spark's broadcast of one."""
        for tree in trees[self.applied :]:
            tree = tree if isinstance(tree, Tree) else tree.value
            self.margins += tree.values[:, tree.place(self.bins)]
        self.applied = len(trees)

    def derivatives(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = logistic(margin)
        return self.weight * (p - self.y), self.weight * p * (1 - p)

    def own_margin(self) -> np.ndarray:
        """Ordered boosting's first row has no model before it; its margin is the base."""
        return self.margins[self.own, np.arange(len(self.y))]

    def histogram(self, tree: Tree, nodes: list[int], width: int, share: float, seed: int, k: int) -> np.ndarray:
        """(nodes, 3, columns, bins): sums of gradients and hessians, and rows, of the rows drawn for tree k."""
        slot = np.full(len(tree.column), -1)
        slot[nodes] = np.arange(len(nodes))
        slot = slot[tree.place(self.bins)]
        some = slot >= 0
        if share < 1:
            some &= drawn(self.number, seed, k) < share
        if self.own.any():
            some &= self.number > 0
        some = np.flatnonzero(some)
        g, h = self.derivatives(self.own_margin())
        d = self.bins.shape[1]
        flat = ((slot[some, None] * d + np.arange(d)) * width + self.bins[some]).ravel()
        size = len(nodes) * d * width
        parts = [np.bincount(flat, np.repeat(x[some], d), size) for x in (g, h)] + [np.bincount(flat, minlength=size)]
        return np.stack([p.reshape(len(nodes), d, width) for p in parts], axis=1)

    def leaf_sums(self, tree: Tree) -> np.ndarray:
        """(models, nodes, 2): each model's gradients and hessians by leaf, of the rows it may see."""
        at, models, out = tree.place(self.bins), len(self.margins), []
        for j in range(models):
            g, h = self.derivatives(self.margins[j])
            seen = np.ones(len(at)) if j == models - 1 else (self.number < 2**j).astype(np.float64)
            out.append(np.stack([np.bincount(at, x * seen, len(tree.column)) for x in (g, h)], axis=-1))
        return np.stack(out)


class Local:
    """One block's sums, taken where it lies: each node's rows are remembered while its tree grows, and each tree's derivatives."""

    ahead = False

    def __init__(self, block: Block):
        self.block, self.trees, self.tree, self.places = block, [], -1, None

    def histogram(self, tree: Tree, nodes: list[int], width: int, share: float, seed: int, k: int) -> np.ndarray:
        """As Block.histogram. Sums are taken in the same order, so that both give the same bits."""
        block, d = self.block, self.block.bins.shape[1]
        if self.places is None:
            self.places = block.bins + np.arange(d, dtype=np.int64) * width
        if self.tree != k:
            some = np.ones(len(block.y), dtype=bool) if share >= 1 else drawn(block.number, seed, k) < share
            if block.own.any():
                some &= block.number > 0
            self.tree, self.rows, self.derivatives = k, {0: np.flatnonzero(some)}, block.derivatives(block.own_margin())
        out = np.empty((len(nodes), 3, d, width))
        for i, node in enumerate(nodes):
            rows = self._rows(tree, node)
            flat = self.places[rows].ravel()
            for j, x in enumerate(self.derivatives):
                out[i, j] = np.bincount(flat, np.repeat(x[rows], d), d * width).reshape(d, width)
            out[i, 2] = np.bincount(flat, minlength=d * width).reshape(d, width)
        return out

    def _rows(self, tree: Tree, node: int) -> np.ndarray:
        """The drawn rows of a node, in their order; those of its parent are parted and forgotten."""
        if node not in self.rows:
            parent = next(i for i, c in enumerate(tree.column) if c >= 0 and node in (tree.left[i], tree.right[i]))
            rows = self._rows(tree, parent)
            low = self.block.bins[rows, tree.column[parent]] <= tree.cut[parent]
            self.rows[tree.left[parent]], self.rows[tree.right[parent]] = rows[low], rows[~low]
            del self.rows[parent]
        return self.rows[node]

    def leaf_sums(self, tree: Tree) -> np.ndarray:
        return self.block.leaf_sums(tree)

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        self.block.advance(self.trees)


_HELD: dict[tuple, Block] = {}


class Spread:
    """Sums over the blocks of a table by Spark: tasks give a block's sums by column, which are added by a shuffle on the column.

    What reaches the driver is as large as the sums, whatever the rows. Workers remember blocks and their margins.
    """

    ahead = True

    def __init__(self, blocks: DataFrame, columns: int, base: float, models: int):
        self.blocks, self.columns, self.base, self.models = blocks, columns, base, models
        self.name, self.trees, self.shared = uuid.uuid4().hex, [], []

    def _each(self, made, parts: int) -> list[np.ndarray]:
        """made(block) is an array with `parts` entries along its first axis; their sums over all blocks."""
        name, base, models, shared = self.name, self.base, self.models, list(self.shared)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    block = _HELD.pop((name, row.block), None) or unpacked(row, base, models)
                    while len(_HELD) >= HELD:
                        _HELD.pop(next(iter(_HELD)))
                    _HELD[name, row.block] = block
                    block.advance(shared)
                    yield pd.DataFrame([(i, x.astype(np.float64).tobytes()) for i, x in enumerate(made(block))], columns=["part", "sums"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": frame["part"][:1], "sums": [np.sum([np.frombuffer(x) for x in frame["sums"]], axis=0).tobytes()]})

        summed = self.blocks.mapInPandas(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary")
        return [np.frombuffer(r["sums"]) for r in sorted(summed.collect(), key=lambda r: r["part"])]

    def histogram(self, tree: Tree, nodes: list[int], width: int, share: float, seed: int, k: int) -> np.ndarray:
        sums = self._each(lambda b: b.histogram(tree, nodes, width, share, seed, k).transpose(2, 0, 1, 3), self.columns)
        return np.stack([s.reshape(len(nodes), 3, width) for s in sums], axis=2)

    def leaf_sums(self, tree: Tree) -> np.ndarray:
        return np.stack([s.reshape(len(tree.column), 2) for s in self._each(lambda b: b.leaf_sums(tree), self.models)])

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        self.shared.append(self.blocks.sparkSession.sparkContext.broadcast(tree))


def _sides(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums up to each cut, beyond it, and in all."""
    low, all_ = sums.cumsum(axis=-1)[..., :-1], sums.sum(axis=-1, keepdims=True)
    return low, all_ - low, all_


def _fit(s: np.ndarray, growth: Growth) -> np.ndarray:
    """What a leaf with these sums lowers the loss by (twice): (nodes, 3, ...) to (nodes, ...)."""
    return s[:, 0] ** 2 / (s[:, 1] + growth.l2)


def gains(sums: np.ndarray, growth: Growth, columns: np.ndarray) -> np.ndarray:
    """(nodes, columns, cuts): what each cut lowers the loss by (twice), -inf where it isn't allowed. sums: (nodes, 3, columns, bins)."""
    low, high, all_ = _sides(sums)
    gain = _fit(low, growth) + _fit(high, growth) - _fit(all_, growth)
    kept = (np.minimum(low[:, 2], high[:, 2]) >= growth.least_rows) & (np.minimum(low[:, 1], high[:, 1]) >= growth.least_hessian)
    barred = np.ones(sums.shape[2], dtype=bool)
    barred[columns] = False
    gain[~kept] = -np.inf
    gain[:, barred] = -np.inf
    return gain


def _smaller_is_left(sums: np.ndarray, column: int, cut: int) -> bool:
    return sums[2, column].sum() >= 2 * sums[2, column, : cut + 1].sum()


def _best(gain: np.ndarray) -> tuple[float, int, int]:
    """The largest gain of a node with its column and cut; ties to the first column and lowest cut."""
    at = int(gain.argmax())
    return float(gain.ravel()[at]), *(int(i) for i in divmod(at, gain.shape[1]))


def _value(s: np.ndarray, growth: Growth) -> float:
    return -growth.step * s[0] / (s[1] + growth.l2)


def leafwise(source, growth: Growth, width: int, columns: np.ndarray, seed: int, k: int) -> Tree:
    """The leaf of largest gain is cut until there are enough leaves.

    A leaf's children are summed when its turn comes, and with it, where a sum is a job (source.ahead), those of all waiting
    leaves that may still be cut: of two siblings only the smaller one, the other is the difference.
    """
    tree = Tree()
    ask = lambda nodes: source.histogram(tree, nodes, width, growth.rows, seed, k)
    sums = {0: ask([0])[0]}
    waiting: list[tuple] = []

    def consider(node: int) -> None:
        gain, column, cut = _best(gains(sums[node][None], growth, columns)[0])
        if gain > 1e-12:
            heapq.heappush(waiting, (-gain, node, column, cut))

    consider(0)
    leaves, ready = 1, {}
    while waiting and leaves < growth.leaves:
        _, node, column, cut = heapq.heappop(waiting)
        if node not in ready:
            others = heapq.nsmallest(growth.leaves - leaves - 1, waiting) if source.ahead else []
            ahead = [(node, column, cut), *[w[1:] for w in others if w[1] not in ready]]
            trial, smaller = _copied(tree), []
            for n, c, b in ahead:
                pair = trial.split(n, c, b)
                low = _smaller_is_left(sums[n], c, b)
                smaller.append((n, pair[0] if low else pair[1], low))
            found = source.histogram(trial, [s for _, s, _ in smaller], width, growth.rows, seed, k)
            ready |= {n: (low, found[i]) for i, (n, _, low) in enumerate(smaller)}
        low, part = ready.pop(node)
        children = tree.split(node, column, cut)
        rest = sums.pop(node) - part
        for child, own in zip(children, (part, rest) if low else (rest, part), strict=True):
            sums[child] = own
            consider(child)
        leaves += 1
    return _finished(tree, {n: s[:, 0].sum(axis=-1) for n, s in sums.items()}, growth)


def _copied(tree: Tree) -> Tree:
    out = Tree()
    out.column, out.cut, out.left, out.right = list(tree.column), list(tree.cut), list(tree.left), list(tree.right)
    return out


def _finished(tree: Tree, sums: dict[int, np.ndarray], growth: Growth) -> Tree:
    tree.values = np.zeros((1, len(tree.column)))
    for node, s in sums.items():
        tree.values[0, node] = _value(s, growth)
    return tree


def depthwise(source, growth: Growth, width: int, columns: np.ndarray, seed: int, k: int) -> Tree:
    """Every node of a level that gains by a cut is cut at its best one; of siblings the smaller one is summed."""
    tree = Tree()
    level, leaves = {0: source.histogram(tree, [0], width, growth.rows, seed, k)[0]}, {}
    for depth in range(growth.depth + 1):
        pairs = []
        for node, sums in level.items():
            gain, column, cut = _best(gains(sums[None], growth, columns)[0]) if depth < growth.depth else (0.0, 0, 0)
            if gain > 1e-12:
                low = _smaller_is_left(sums, column, cut)
                pairs.append((sums, tree.split(node, column, cut), low))
            else:
                leaves[node] = sums[:, 0].sum(axis=-1)
        if not pairs:
            break
        found = source.histogram(tree, [p[0 if low else 1] for _, p, low in pairs], width, growth.rows, seed, k)
        level = {}
        for (sums, (left, right), low), part in zip(pairs, found, strict=True):
            level[left], level[right] = (part, sums - part) if low else (sums - part, part)
    return _finished(tree, leaves, growth)


def symmetric(source, growth: Growth, width: int, columns: np.ndarray, seed: int, k: int) -> Tree:
    """One cut for all nodes of a level: that of the largest total gain. Gradients come from models that haven't seen the row.

    Then each model's leaves are set from the rows it may see. The cuts are chosen by all rows' gradients, so they, unlike the
    leaves, hang a little on a row's own label.
    """
    tree = Tree()
    for _ in range(growth.depth):
        nodes = tree.leaves()
        sums = source.histogram(tree, nodes, width, growth.rows, seed, k)
        low, high, all_ = _sides(sums[sums[:, 2, 0].sum(axis=-1) > 0])  # of nodes with rows
        total = (_fit(low, growth) + _fit(high, growth)).sum(axis=0)
        total[(low[:, 2].sum(axis=0) == 0) | (high[:, 2].sum(axis=0) == 0)] = -np.inf  # a cut that parts nothing
        gain, column, cut = _best(total)
        if not gain > _fit(all_[:, :, 0, 0], growth).sum() + 1e-12:
            break
        for node in nodes:
            tree.split(node, column, cut)
    sums = source.leaf_sums(tree)
    tree.values = -growth.step * sums[..., 0] / (sums[..., 1] + growth.l2)
    return tree


def boost(source, growth: Growth, width: int, columns: int, seed: int) -> list[Tree]:
    """The trees, each fitted to the gradients that those before it leave."""
    grow = symmetric if growth.symmetric else leafwise if growth.leaves else depthwise
    rng = np.random.default_rng(seed)
    for k in range(growth.rounds):
        some = np.sort(rng.choice(columns, max(1, round(growth.columns * columns)), replace=False)) if growth.columns < 1 else np.arange(columns)
        source.add(grow(source, growth, width, some, seed, k))
    return source.trees


def unpacked(row, base: float, models: int) -> Block:
    number, y, weight = (np.frombuffer(x) for x in (row.number, row.y, row.weight))
    return Block(np.frombuffer(row.bins, dtype=np.uint8).reshape(len(y), -1), y, weight, number.astype(np.int64), base, models)


class Boosted:
    """fit(rows with features and y), then score(rows). Null features count as 0."""

    def __init__(self, kind: str, features: list[str], seed: int = 1, growth: Growth | None = None):
        self.kind, self.features, self.seed, self.growth = kind, features, seed, growth or FAMILIES[kind]

    def fit(self, rows: DataFrame, key: list[str]) -> Boosted:
        spark, growth, features = rows.sparkSession, self.growth, self.features
        value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        at = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
        about = rows.agg(F.count(F.lit(1)), F.sum("y"), *[F.percentile_approx(value(f), at, ACCURACY) for f in features], *[F.max(value(f)) for f in features]).first()
        n, positive = about[0], about[1] or 0
        quantiles, tops = about[2 : 2 + len(features)], about[2 + len(features) :]
        self.cuts = cuts = [np.unique([c for c in q or [] if c < top]) for q, top in zip(quantiles, tops, strict=True)]
        weights = (n / (2 * max(n - positive, 1)), n / (2 * max(positive, 1))) if growth.balanced else (1.0, 1.0)
        share = 0.5 if growth.balanced else min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
        self.base = base = 0.0 if growth.symmetric else math.log(share / (1 - share))
        models = 1 + math.ceil(math.log2(max(n, 2))) if growth.symmetric else 1
        plain = rows.select(*key, F.array(*[value(f) for f in features]).alias("x"), F.col("y").cast("int").alias("y"), F.lit(1).alias("_all"))
        numbered = ordered.numbered(plain, ["_all"], splits.hash_order(*key, seed=f"boost|{self.seed}"), key, "_i").select((F.col("_i") - 1).alias("i"), "x", "y")
        count = max(1, math.ceil(n / BLOCK_ROWS))

        def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            x, y = np.stack(frame["x"]), frame["y"].to_numpy(dtype=np.float64)
            bins = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8)
            return pd.DataFrame({"block": [key[0]], "bins": [bins.tobytes()], "y": [y.tobytes()], "weight": [np.where(y > 0, weights[1], weights[0]).tobytes()], "number": [frame["i"].to_numpy(dtype=np.float64).tobytes()]})

        folder = sinks.scratch(spark, "blocks")
        shape = "block long, bins binary, y binary, weight binary, number binary"
        numbered.withColumn("block", F.col("i") % count).groupBy("block").applyInPandas(pack, shape).repartition(count, "block").write.parquet(folder)
        blocks = spark.read.schema(shape).parquet(folder)
        width, d, seed = max((len(c) for c in cuts), default=0) + 1, len(features), self.seed
        if n == 0:
            self.trees = []
        elif count == 1:

            def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                import pickle

                for frame in frames:
                    for row in frame.itertuples(index=False):
                        yield pd.DataFrame({"trees": [pickle.dumps(boost(Local(unpacked(row, base, models)), growth, width, d, seed))]})

            import pickle

            self.trees = pickle.loads(blocks.mapInPandas(whole, "trees binary").collect()[0]["trees"])  # bounded by the settings
        else:
            source = Spread(blocks, d, base, models)
            self.trees = boost(source, growth, width, d, seed)
            for b in source.shared:
                b.destroy()
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """Adds out: the probability of y = 1, by Arrow batches against the broadcast trees."""
        features, base, names = self.features, self.base, rows.columns
        shared = rows.sparkSession.sparkContext.broadcast((self.trees, self.cuts))
        shape = rows.select("*", F.lit(0.0).alias(out)).schema

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trees, cuts = shared.value
            for frame in frames:
                bins = np.column_stack([np.searchsorted(c, np.nan_to_num(frame[f].to_numpy(dtype=np.float64))) for f, c in zip(features, cuts, strict=True)]).astype(np.uint8)
                margin = np.full(len(frame), base)
                for tree in trees:
                    margin += tree.values[-1, tree.place(bins)]
                yield frame[names].assign(**{out: logistic(margin)})

        return rows.mapInPandas(run, shape)
