"""Neural detectors trained data-parallel: Spark tasks sum the gradients of a mini-batch's shards, the driver steps the bounded weights."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators import ordered, splits, tape
from busloom.operators.tape import T
from busloom.settings import EPS
from busloom.sources import sinks

#: Rows of a mini-batch, windows of a sequence, learning rate, weight decay and bound of the gradient's norm: fixed values of the detectors.
BATCH, LENGTH, RATE, DECAY, CLIP = 512, 8, 1e-3, 1e-4, 5.0
#: Kind -> epochs and hidden units: fixed values of the detectors.
NETS = {"NN:MLP": (16, 128), "NN:CNN1D": (8, 128), "NN:LSTM": (8, 128), "NN:Transformer": (8, 64)}
SEQUENCE = ("NN:CNN1D", "NN:LSTM", "NN:Transformer")
HEADS, LAYERS = 4, 2
#: Adam's decay rates and guard; how fast running moments of a batch follow.
BETA1, BETA2, ADAM_EPS, MOMENTUM = 0.9, 0.999, 1e-8, 0.1
#: Parts of a mini-batch whose gradients are summed; each normalises by its own moments. Windows of a capture that are put in order at once.
SHARDS, BLOCK = 4, 4096


def sequences(rows: DataFrame, features: list[str], out: str = "seq", length: int = LENGTH) -> DataFrame:
    """Adds out: array<double>, the features of the `length` windows of the capture that end with each, the oldest first.

    Before a capture's start its first window is repeated. A capture is cut into blocks that begin with the last windows of
    the block before, so that none meets in one task. widx must be gapless from 0.
    """
    block = F.floor(F.col("widx") / BLOCK)
    ahead = (F.col("widx") % BLOCK > BLOCK - length) & F.lit(length > 1)
    dealt = rows.withColumn("_v", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))
    dealt = dealt.withColumn("_block", F.explode(F.when(ahead, F.array(block, block + 1)).otherwise(F.array(block))))
    order = Window.partitionBy("capture", "_block").orderBy("widx")
    own = F.collect_list("_v").over(order.rowsBetween(1 - length, 0))
    first = F.first("_v").over(order.rowsBetween(Window.unboundedPreceding, 0))
    made = dealt.withColumn(out, F.flatten(F.concat(F.array_repeat(first, F.lit(length) - F.size(own)), own)))
    return made.where(F.col("_block") == block).drop("_v", "_block")


class Pass:
    """What one pass through a net needs beside weights: whether it trains, random numbers for dropout, moments of batches."""

    def __init__(self, moments: dict, train: bool, rng: np.random.Generator | None = None):
        self.moments, self.train, self.rng, self.seen = moments, train, rng, {}

    def dropout(self, x: T, rate: float) -> T:
        if not self.train or self.rng is None:
            return x
        return x * ((self.rng.random(x.data.shape) >= rate) / (1 - rate))

    def batch_norm(self, x: T, w: dict, name: str) -> T:
        """Over all axes but the last: by the shard's moments in training, else by the running ones."""
        if not self.train:
            mean, variance = self.moments[name]
            return (x - mean) * (1 / np.sqrt(variance + 1e-5)) * w[f"{name}.scale"] + w[f"{name}.shift"]
        axes = tuple(range(x.data.ndim - 1))
        out, mean, variance = tape.normalized(x, axes, w[f"{name}.scale"], w[f"{name}.shift"])
        n = x.data.size // x.data.shape[-1]
        self.seen[name] = mean.ravel(), variance.ravel() * (n / max(n - 1, 1))
        return out


def _dense(w: dict, name: str, x: T) -> T:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def perceptron(w: dict, x: T, p: Pass) -> T:
    for k in ("1", "2"):
        x = p.dropout(p.batch_norm(tape.relu(_dense(w, k, x)), w, f"n{k}"), 0.2)
    return _dense(w, "out", x)[:, 0]


def _convolved(w: dict, name: str, x: T) -> T:
    """A convolution of width 3 along the second axis, zeros beyond its ends."""
    n, length, d = x.data.shape
    edge = T(np.zeros((n, 1, d)))
    wide = tape.joined([edge, x, edge], 1)
    return _dense(w, name, tape.joined([wide[:, i : i + length] for i in range(3)], 2))


def convolutional(w: dict, x: T, p: Pass) -> T:
    x = p.batch_norm(tape.relu(_convolved(w, "1", x)), w, "n1")
    return _dense(w, "out", tape.relu(_convolved(w, "2", x)).mean(1, keep=False))[:, 0]


def recurrent(w: dict, x: T, p: Pass) -> T:
    n, length, _ = x.data.shape
    size = w["h.w"].data.shape[0]
    h, c = T(np.zeros((n, size))), T(np.zeros((n, size)))
    for t in range(length):
        gates = _dense(w, "x", x[:, t]) + _dense(w, "h", h)
        i, f, o = (tape.sigmoid(gates[:, k * size : (k + 1) * size]) for k in (0, 1, 3))
        c = f * c + i * tape.tanh(gates[:, 2 * size : 3 * size])
        h = o * tape.tanh(c)
    return _dense(w, "out", h)[:, 0]


def attentive(w: dict, x: T, p: Pass) -> T:
    n, length, _ = x.data.shape
    h = _dense(w, "in", x) + w["place"][:length]
    size = h.data.shape[-1]
    part = size // HEADS

    def norm(y: T, name: str) -> T:
        return tape.normalized(y, (2,), w[f"{name}.scale"], w[f"{name}.shift"])[0]

    for k in range(LAYERS):
        three = _dense(w, f"{k}.qkv", norm(h, f"{k}.n1"))
        q, key, v = (three[:, :, i * size : (i + 1) * size].reshape(n, length, HEADS, part).transpose(0, 2, 1, 3) for i in range(3))
        shares = p.dropout(tape.softmax(q @ key.transpose(0, 1, 3, 2) * (1 / math.sqrt(part))), 0.1)
        h = h + p.dropout(_dense(w, f"{k}.mix", (shares @ v).transpose(0, 2, 1, 3).reshape(n, length, size)), 0.1)
        inner = p.dropout(tape.relu(_dense(w, f"{k}.up", norm(h, f"{k}.n2"))), 0.1)
        h = h + p.dropout(_dense(w, f"{k}.down", inner), 0.1)
    return _dense(w, "out", h[:, length - 1])[:, 0]


FORWARD: dict[str, Callable[[dict, T, Pass], T]] = {"NN:MLP": perceptron, "NN:CNN1D": convolutional, "NN:LSTM": recurrent, "NN:Transformer": attentive}


def initial(kind: str, d: int, hidden: int, rng: np.random.Generator, length: int = LENGTH) -> tuple[dict, dict]:
    """Weights and running moments: dense weights uniform within 1/sqrt(inputs), norms 1 and 0, places 0."""
    w: dict[str, np.ndarray] = {}

    def dense(name: str, inputs: int, outputs: int, bound: float | None = None, bias: bool = True) -> None:
        b = bound or 1 / math.sqrt(inputs)
        w[f"{name}.w"], w[f"{name}.b"] = rng.uniform(-b, b, (inputs, outputs)), rng.uniform(-b, b, outputs) if bias else np.zeros(outputs)

    def norm(name: str, size: int) -> None:
        w[f"{name}.scale"], w[f"{name}.shift"] = np.ones(size), np.zeros(size)

    moments = {}
    if kind == "NN:MLP":
        dense("1", d, hidden), norm("n1", hidden), dense("2", hidden, hidden // 2), norm("n2", hidden // 2), dense("out", hidden // 2, 1)
        moments = {"n1": (np.zeros(hidden), np.ones(hidden)), "n2": (np.zeros(hidden // 2), np.ones(hidden // 2))}
    elif kind == "NN:CNN1D":
        dense("1", 3 * d, hidden), norm("n1", hidden), dense("2", 3 * hidden, hidden), dense("out", hidden, 1)
        moments = {"n1": (np.zeros(hidden), np.ones(hidden))}
    elif kind == "NN:LSTM":
        b = 1 / math.sqrt(hidden)
        dense("x", d, 4 * hidden, b), dense("h", hidden, 4 * hidden, b), dense("out", hidden, 1)
    elif kind == "NN:Transformer":
        dense("in", d, hidden), dense("out", hidden, 1)
        w["place"] = np.zeros((length, hidden))
        for k in range(LAYERS):
            norm(f"{k}.n1", hidden), norm(f"{k}.n2", hidden), dense(f"{k}.qkv", hidden, 3 * hidden, math.sqrt(6 / (4 * hidden)), False), dense(f"{k}.mix", hidden, hidden, None, False)
            dense(f"{k}.up", hidden, 2 * hidden), dense(f"{k}.down", 2 * hidden, hidden)
    else:
        raise ValueError(f"no net is called {kind}")
    return w, moments


def shard_gradient(kind: str, w: dict, moments: dict, x: np.ndarray, y: np.ndarray, positive_weight: float, rng: np.random.Generator | None) -> tuple[float, dict, dict]:
    """Sum of losses, gradients and moments of some rows."""
    weights, p = {k: T(v) for k, v in w.items()}, Pass(moments, True, rng)
    loss = tape.log_loss(FORWARD[kind](weights, T(x), p), y, positive_weight)
    loss.backward()
    return float(loss.data), {k: t.grad if t.grad is not None else np.zeros_like(t.data) for k, t in weights.items()}, p.seen


class Adam:
    """Steps with decoupled weight decay, after the gradient's norm has been bounded."""

    def __init__(self, w: dict):
        self.first, self.second, self.steps = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0

    def step(self, w: dict, g: dict) -> None:
        self.steps += 1
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        bound = min(1.0, CLIP / (norm + 1e-6))
        for k in w:
            x = g[k] * bound
            self.first[k] = BETA1 * self.first[k] + (1 - BETA1) * x
            self.second[k] = BETA2 * self.second[k] + (1 - BETA2) * x * x
            size = np.sqrt(self.second[k] / (1 - BETA2**self.steps)) + ADAM_EPS
            w[k] = w[k] * (1 - RATE * DECAY) - RATE * self.first[k] / (1 - BETA1**self.steps) / size


class Net:
    """fit(rows with features, y and, for the kinds of SEQUENCE, seq), then score(rows).

    The rows are numbered once by a hash of their key; each epoch orders them anew by a seeded permutation of the numbers and
    writes them by mini-batch, so that a step reads its own rows alone. A step is one Spark job: the shards of its
    mini-batch give their gradients' sums, which are as large as the weights. A lost executor costs the step under way.
    """

    def __init__(self, kind: str, features: list[str], seed: int = 1, epochs: int | None = None, batch: int = BATCH, shards: int = SHARDS):
        self.kind, self.features, self.seed, self.batch, self.shards = kind, features, seed, batch, shards
        self.epochs, self.hidden = epochs or NETS[kind][0], NETS[kind][1]
        self.losses: list[float] = []

    def _vector(self):
        return F.col("seq") if self.kind in SEQUENCE else F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features])

    def _shaped(self, flat: np.ndarray) -> np.ndarray:
        x = (flat.reshape(len(flat), -1, len(self.features)) - self.mean) / self.scale
        return x if self.kind in SEQUENCE else x[:, 0]

    def gradient(self, rows: DataFrame, w: dict, moments: dict, positive_weight: float, seed: tuple) -> tuple[float, int, dict, dict]:
        """Loss, rows, gradients and moments of a mini-batch (x, y, shard), summed over its shards by Spark tasks.

        Losses and gradients are sums over rows, moments means over shards weighted by rows.
        """
        spark, kind, shaped = rows.sparkSession, self.kind, self._shaped
        shared = spark.sparkContext.broadcast((w, moments))

        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            if len(frame) < 2:
                return pd.DataFrame({"n": [], "out": []})
            frame = frame.sort_values("at")
            w, moments = shared.value
            rng = np.random.default_rng([*seed, int(key[0])])
            loss, g, seen = shard_gradient(kind, w, moments, shaped(np.stack(frame["x"])), frame["y"].to_numpy(dtype=np.float64), positive_weight, rng)
            parts = [np.array([loss]), *[g[k].ravel() for k in w], *[m for k in moments for m in seen[k]]]
            return pd.DataFrame({"n": [len(frame)], "out": [np.concatenate(parts).tobytes()]})

        got = rows.groupBy("shard").applyInPandas(run, "n long, out binary").collect()  # `shards` rows, each of the weights' size
        shared.destroy()
        n = sum(r["n"] for r in got)
        flat = [np.frombuffer(r["out"]) for r in got]
        if not n:
            return 0.0, 0, {}, {}
        sizes = [v.size for v in w.values()]
        split = 1 + sum(sizes)
        sums = np.sum([f[:split] for f in flat], axis=0)
        means = np.sum([f[split:] * (r["n"] / n) for f, r in zip(flat, got, strict=True)], axis=0)
        g = {k: part.reshape(v.shape) for (k, v), part in zip(w.items(), np.split(sums[1:], np.cumsum(sizes)[:-1]), strict=True)}
        halves = iter(np.split(means, np.cumsum([len(m) for k in moments for m in moments[k]])[:-1]) if moments else [])
        return float(sums[0]), n, g, {k: (next(halves), next(halves)) for k in moments}

    def fit(self, rows: DataFrame, key: list[str]) -> Net:
        spark, d = rows.sparkSession, len(self.features)
        about = rows.agg(F.count(F.lit(1)), F.sum("y"), *[F.avg(f) for f in self.features], *[F.stddev_pop(f) for f in self.features]).first()
        n, positive = about[0], about[1] or 0
        self.mean = np.array([v or 0.0 for v in about[2 : 2 + d]])
        self.scale = np.array([s if s and s > EPS else 1.0 for s in about[2 + d :]])
        rng = np.random.default_rng(self.seed)
        w, moments = initial(self.kind, d, self.hidden, rng)
        positive_weight, adam = (n - max(positive, 1)) / max(positive, 1), Adam(w)
        folder = sinks.scratch(spark, "net")
        plain = rows.select(*key, self._vector().alias("x"), F.col("y").cast("int").alias("y"), F.lit(1).alias("_all"))
        ordered.numbered(plain, ["_all"], splits.hash_order(*key, seed=f"net|{self.seed}"), key, "_i").select((F.col("_i") - 1).alias("i"), "x", "y").write.parquet(f"{folder}/rows")
        table = spark.read.schema("i long, x array<double>, y int").parquet(f"{folder}/rows")
        for epoch in range(self.epochs if n > 1 else 0):
            step = int(rng.integers(1, n))
            while math.gcd(step, n) > 1:
                step = step % n + 1
            at = (F.col("i") * step + int(rng.integers(n))) % n
            dealt = table.select("x", "y", at.alias("at")).select("*", F.floor(F.col("at") / self.batch).alias("batch"), (F.col("at") % self.shards).alias("shard"))
            dealt.repartitionByRange("batch", "shard").sortWithinPartitions("batch").write.option("parquet.block.size", 1 << 20).parquet(f"{folder}/epoch={epoch}")
            now, total = spark.read.schema(dealt.schema).parquet(f"{folder}/epoch={epoch}"), 0.0
            for b in range(math.ceil(n / self.batch)):
                loss, size, g, seen = self.gradient(now.where(F.col("batch") == b), w, moments, positive_weight, (self.seed, epoch, b))
                if size:
                    adam.step(w, {k: x / size for k, x in g.items()})
                    moments = {k: tuple((1 - MOMENTUM) * old + MOMENTUM * new for old, new in zip(moments[k], seen[k], strict=True)) for k in moments}
                    total += loss
            self.losses.append(total / n)
        self.weights, self.moments = w, moments
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """Adds out: the probability of y = 1, by Arrow batches against the broadcast weights."""
        names, kind, shaped = rows.columns, self.kind, self._shaped
        shared = rows.sparkSession.sparkContext.broadcast((self.weights, self.moments))
        shape = rows.select("*", F.lit(0.0).alias(out)).schema

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, moments = shared.value
            weights = {k: T(v) for k, v in w.items()}
            for frame in frames:
                margin = FORWARD[kind](weights, T(shaped(np.stack(frame["_x"]))), Pass(moments, False)).data if len(frame) else np.zeros(0)
                yield frame[names].assign(**{out: tape.logistic(margin)})

        return rows.withColumn("_x", self._vector()).mapInPandas(run, shape)
