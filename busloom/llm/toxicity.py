"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.llm.common import ordered_hash, staged

#: log2 of the hashed terms; interaction factors of a term; labelled documents that the model is fitted on, at most.
BITS, FACTORS, MAX_TRAINING = 20, 8, 16_000
#: Candidate terms of all those documents together, at most: very long texts make the sample smaller.
MAX_ENTRIES = 8_000_000
#: A term is a candidate from this many training texts on, however many there are.
MIN_TEXTS = 4
#: A term's weight must be worth this many standard deviations of its gradient under no effect.
SIGMAS = 4.0
#: Bytes of a word's stem.
STEM = 6
#: Letters, digits and all non-ASCII bytes make terms; every other ASCII byte parts them.
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def buckets(text: str | None) -> np.ndarray:
    """The hashed terms of a whole text, sorted: its distinct lower-case words, the stems (first STEM bytes) of longer
    words, and the stems that two, or three, distinct words share. A null or empty text has none."""
    words = set((text or "").lower().encode(errors="replace").translate(_TERMS).split())
    stems = Counter([w[:STEM] for w in words if len(w) >= STEM])
    hashed = [*map(zlib.crc32, words), *(zlib.crc32(s, 1) for s in stems)]
    hashed += [zlib.crc32(s, level) for s, n in stems.items() if n > 1 for level in (2, 3)[: n - 1]]
    return np.unique(np.array(hashed, dtype=np.uint32) & np.uint32((1 << BITS) - 1)).astype(np.int32)


def remainder(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id's text modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Model:
    """score = sigmoid(bias + sum of weights + sum over pairs of <factors_i, factors_j>) over the terms in slots."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def slots(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, dtype=np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def score(self, slots: np.ndarray, found: np.ndarray) -> float:
        s = slots[found]
        s = s[s >= 0]
        v = self.factors[s]
        z = self.bias + self.weights[s].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0))))


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)


def _gathered(values: np.ndarray, source: np.ndarray, target: np.ndarray, n: int, chunk: int = 1 << 18) -> np.ndarray:
    """The sums of values[source] by target, in chunks that bound the memory."""
    out = np.zeros(n)
    for a in range(0, len(source), chunk):
        out += np.bincount(target[a : a + chunk], weights=values[source[a : a + chunk]], minlength=n)
    return out


def _counted(index: np.ndarray, n: int, chunk: int = 1 << 20) -> np.ndarray:
    """How often each of 0 .. n-1 is in index, in chunks, as bincount makes long integers of what it counts."""
    out = np.zeros(n, dtype=np.int64)
    for a in range(0, len(index), chunk):
        out += np.bincount(index[a : a + chunk], minlength=n)
    return out


def _divergence(m: np.ndarray, share: np.ndarray, q: np.ndarray) -> np.ndarray:
    """m times the relative entropy of share to q: the Chernoff exponent of that share of m texts being toxic where q is expected."""
    q = np.clip(q, 1e-9, 1 - 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(share > 0, share * np.log(share / q), 0.0)
        return m * (up + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - q)), 0.0))


def _paired(row: np.ndarray, flat: np.ndarray, y: np.ndarray, p: np.ndarray, candidates: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Those candidates that are in a pair that is toxic, or clean, more often than the additive p and than either term alone.

    Entries (row, flat) come by row and term. All pairs that occur together are counted. A pair's evidence must pass the logarithm of the number of tests. Terms whose
    counts cannot give that much with any partner are left out first, which loses no pair and makes tests fewer.
    """
    terms = len(candidates)
    seen = _counted(flat, 1 << BITS)[candidates].astype(np.float64)
    toxic = _gathered(y, row, flat, 1 << BITS)[candidates]
    share = toxic / np.maximum(seen, 1)
    most = np.maximum(_divergence(toxic, np.ones(terms), share), _divergence(seen - toxic, np.zeros(terms), share))
    falling = -np.sort(-most)
    limits = 2 * np.log(np.arange(1, terms + 1))
    short = np.flatnonzero(falling < limits)
    limit = limits[short[0]] if len(short) else limits[-1] if terms else 0.0
    able = np.flatnonzero(most >= limit)
    renumber = np.full(1 << BITS, -1, dtype=np.int32)
    renumber[candidates[able]] = np.arange(len(able))
    col = renumber[flat]
    kept = col >= 0
    row, col = row[kept], col[kept]
    del kept
    t, share = len(able), share[able]
    # an entry's partners are those that follow it in its row
    after = np.cumsum(_counted(row, len(y))).astype(np.int32)[row]
    after -= np.arange(1, len(row) + 1, dtype=np.int32)
    by_term = np.argsort(col, kind="stable").astype(np.int32)
    by_term = by_term[after[by_term] > 0]
    cuts = np.append(0, np.cumsum(_counted(col[by_term], t)))
    chosen = np.zeros(t, dtype=bool)
    wide = max(1, block // max(t, 1))

    def cells(own: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in own, cell of the block) of every pair that begins in own, a part at a time."""
        sizes = after[own].astype(np.int64)
        ends = np.cumsum(sizes)
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + block, side="right")))
            place = np.repeat(np.arange(a, b), sizes[a:b])
            partner = np.arange(len(place)) + np.repeat(own[a:b] + 1 - (ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])), sizes[a:b])
            yield place, np.repeat((col[own[a:b]].astype(np.int64) - low) * t, sizes[a:b]) + col[partner]
            a = b

    for low in range(0, t, wide):
        own = by_term[cuts[low] : cuts[min(low + wide, t)]]
        m, k = np.zeros(min(wide, t - low) * t, dtype=np.int64), np.zeros(min(wide, t - low) * t)
        for _, cell in cells(own, low):
            m += np.bincount(cell, minlength=len(m))
        marked = own[y[row[own]] > 0]
        for place, cell in cells(marked, low):
            k += np.bincount(cell, weights=y[row[marked]][place], minlength=len(k))
        some = np.flatnonzero(m)
        i, j, n, got = low + some // t, some % t, m[some], k[some] / m[some]

        def evidence(high: np.ndarray, less: np.ndarray, n: np.ndarray, got: np.ndarray) -> np.ndarray:
            return _divergence(n, got, np.where(got > high, high, np.where(got < less, less, got)))

        # the additive probabilities can only lessen the evidence, so they are added up where it is enough without them
        high, less = np.maximum(share[i], share[j]), np.minimum(share[i], share[j])
        left = np.flatnonzero(evidence(high, less, n, got) > limit)
        if not len(left):
            continue
        own = own[np.isin(col[own], i[left])]
        expected = np.zeros(len(m))
        for place, cell in cells(own, low):
            expected += np.bincount(cell, weights=p[row[own]][place], minlength=len(m))
        additive = expected[some[left]] / n[left]
        sure = left[evidence(np.maximum(high[left], additive), np.minimum(less[left], additive), n[left], got[left]) > limit]
        chosen[i[sure]] = chosen[j[sure]] = True
    return candidates[able[chosen]]


def _adam(row: np.ndarray, col: np.ndarray, y: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Fits bias, weights and factors jointly over all rows, with a little L2. Also the rows' probabilities in the last step."""
    n, p = len(y), np.zeros(len(y))
    shrink = min(5e-4, 1.5 / n)  # a fixed number of texts: rare pairs must not fade as the training set grows
    params = [np.array([bias]), w, v]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        bias_, w, v = params
        z = bias_[0] + _gathered(w, col, row, n)
        sums = [_sums(v[col, f], row, n) for f in range(v.shape[1])]
        if sums:
            z = z + 0.5 * (np.square(sums).sum(axis=0) - _sums((v[col] ** 2).sum(axis=1), row, n))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        e = (p - y) / n
        grads = [np.array([e.sum()]), _gathered(e, row, col, len(w)) + 2e-5 * w, np.zeros_like(v)]
        for f, vx in enumerate(sums):
            grads[2][:, f] = _sums(e[row] * (vx[row] - v[col, f]), col, len(w)) + shrink * v[:, f]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            params[k] = params[k] - 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2], p


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fits the machine: terms by an L1-regularised linear model and by a test of all pairs, then weights and factors of those jointly.

    Each term's L1 penalty is SIGMAS standard deviations of its gradient under no effect, so that rare chance terms stay
    at zero whatever the sample's size; terms without such an effect of their own come in by their pairs. Interactions
    exist among all these. Without rows the score is 0 throughout.
    """
    n, none = len(rows), np.zeros(0, dtype=np.int64)
    if not n:
        return Model(-60.0, none, np.zeros(0), np.zeros((0, FACTORS)))
    y = labels.astype(np.float64)
    rate = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(rate / (1 - rate)))
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    flat = np.concatenate([*map(np.sort, rows), none.astype(np.int32)]).astype(np.int32, copy=False)
    seen = _counted(flat, 1 << BITS)
    candidates = np.flatnonzero((seen >= MIN_TEXTS) & (seen < n))

    def entries(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.full(1 << BITS, -1, dtype=np.int32)
        slot[terms] = np.arange(len(terms))
        found = slot[flat]
        kept = found >= 0
        return row[kept], found[kept]

    terms = candidates
    at, col = entries(terms)
    w, grown = np.zeros(len(terms)), np.full(len(terms), 1e-12)
    penalty = SIGMAS * np.sqrt(rate * (1 - rate) * seen[terms] / n / n)
    for step in range(120):
        p = 1 / (1 + np.exp(-np.clip(bias + _gathered(w, col, at, n), -60, 60)))
        gradient = _gathered(p - y, at, col, len(terms)) / n
        grown += gradient**2
        rate_i = 0.5 / np.sqrt(grown)
        w = w - rate_i * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate_i * penalty, 0)
        bias -= 0.5 * float((p - y).mean()) / max(0.05, rate * (1 - rate)) ** 0.5
        if step == 60:  # what is zero by now stays so
            live = np.flatnonzero(w)
            terms, w, grown, penalty = terms[live], w[live], grown[live], penalty[live]
            at, col = entries(terms)
    # pairs are held against weights that the penalty doesn't shorten
    bias, w, _, p = _adam(at, col, y, bias, w, np.zeros((len(terms), 0)), 150)
    del at, col
    paired = _paired(row, flat, y, p, candidates)
    weights = np.zeros(1 << BITS)
    weights[terms] = w
    terms = np.union1d(terms, paired)
    v = np.random.default_rng(seed).normal(0, 0.01, (len(terms), FACTORS))
    bias, w, v, _ = _adam(*entries(terms), y, bias, weights[terms], v, 400)
    return Model(bias, terms, w, v)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_TRAINING, entries: int = MAX_ENTRIES) -> DataFrame:
    """Candidate terms (_terms) and labels (_y) of labelled documents outside the held-out fold, the first by a hash of the id: up to `limit`
    documents, and as many as have `entries` candidate terms together, in that order in one partition.

    Several labels of one id count as toxic if one is; several texts of an id give the one of least checksum; equal
    sets of terms count once, as toxic if one is. Null ids and null labels take no part. How many texts have a term is
    counted in Spark, and only terms of MIN_TEXTS texts and more, fewer than 2**BITS, reach the driver.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col) != 0))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_y"))
        .withColumn("_h", ordered_hash("_id", seed="toxicity"))
        .orderBy("_h", "_id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets(t.as_py()) for t in batch.column("_text")]
            sums = [xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_y", "_h")), pa.array(sums, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["_id", "_y", "_h", "_sum", "_terms"])

    shape = texts.select("_id", "_y", "_h", F.lit(0).cast("long").alias("_sum"), F.array().cast("array<int>").alias("_terms")).schema
    one = texts.select("_id", "_text", "_y", "_h").mapInArrow(run, shape).groupBy("_id").agg(F.min(F.struct("_sum", "_y", "_h", "_terms")).alias("r")).select("_id", "r.*")
    once = one.groupBy("_sum").agg(F.max("_y").alias("_y"), F.min(F.struct("_h", "_id", "_terms")).alias("r")).select("_y", "r.*")
    once = staged(once, "training")
    often = once.select(F.explode("_terms").alias("term")).groupBy("term").count().where(F.col("count") >= MIN_TEXTS).toArrow()["term"].to_numpy()
    candidate = np.zeros(1 << BITS, dtype=bool)
    candidate[often] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(candidate))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidate = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found = [f[candidate[f]] for f in (t.values.to_numpy() if len(t) else np.zeros(0, dtype=np.int32) for t in batch.column("_terms"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_h", "_id", "_y")), pa.array(found, pa.list_(pa.int32()))], names=["_h", "_id", "_y", "_terms"])

    rows = once.select("_h", "_id", "_y", "_terms").mapInArrow(narrow, once.select("_h", "_id", "_y", "_terms").schema)
    so_far = F.sum(F.size("_terms")).over(Window.orderBy("_h", "_id"))  # limit rows at most
    return rows.withColumn("_n", so_far).where(F.col("_n") <= entries).select("_terms", "_y")


def _arrays(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    found = [t.values.to_numpy() if len(t) else np.zeros(0, dtype=np.int32) for t in table["_terms"]]
    return found, table["_y"].to_numpy().astype(np.float64)


def training(docs: DataFrame, labels: DataFrame, **settings) -> tuple[list[np.ndarray], np.ndarray]:
    """The terms and labels of sample(), on the driver."""
    return _arrays(sample(docs, labels, **settings).toArrow())


def learnt(docs: DataFrame, labels: DataFrame, **settings) -> Model:
    """fit() of sample()'s rows, in the task that has put them in order: the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            m = fit(*_arrays(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_pydict({"bias": [m.bias], **{k: [np.ascontiguousarray(x).tobytes()] for k, x in (("terms", m.terms.astype(np.int64)), ("weights", m.weights), ("factors", m.factors))}})

    row = sample(docs, labels, **settings).mapInArrow(run, "bias double, terms binary, weights binary, factors binary").toArrow().to_pylist()
    if not row:
        return fit([], np.zeros(0))
    terms, weights, factors = (np.frombuffer(row[0][k], kind) for k, kind in (("terms", np.int64), ("weights", np.float64), ("factors", np.float64)))
    return Model(row[0]["bias"], terms, weights, factors.reshape(len(terms), FACTORS))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds out (not a name that docs has): double, from the whole text; null and empty texts have no terms. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = docs.select("*", F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = m.slots()
        for batch in batches:
            scores = [m.score(slots, buckets(t.as_py())) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, shape)


def op1(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return scored(docs, learnt(docs, labels)).select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
