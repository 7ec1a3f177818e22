"""Blocks, buckets and connected components for the near-duplicate operators, on long node ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace


#: Rows of a table that is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST = 200_000


def few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast where it has up to MAX_BROADCAST of them; itself where it has more."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST else table


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """Of (key, node) rows, each node once a key: the keys of two nodes and more with their sizes n, keys of the same nodes once."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n >= 2")
    return sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")


def blocks_of(n: Column, most: int, spread: int = 256, tasks: int = 8) -> Column:
    """The blocks of a group of n: of `most` rows at most; a group of over `spread` rows has up to `tasks`, so that it spreads."""
    return F.greatest(F.ceil(n / F.lit(float(most))), F.least(F.lit(tasks), F.ceil(n / F.lit(float(spread)))))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, copies: str, share: int = 1000) -> DataFrame:
    """rows with the columns of facts (one for each key but null, copies: how many rows it has); those of null keys get nulls.

    Keys that have more than 1 / share of all rows, fewer than share of them, are joined by broadcast, the others by shuffle.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(copies) > total / share))
    some = rows.where(F.col(key).isNotNull())
    cold = some.join(hot.select(key), key, "left_anti").join(facts.where(F.col(copies) <= total / share), key)
    return some.join(hot, key).unionByName(cold).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def block_pairs(rows: DataFrame, blocks) -> DataFrame:
    """Deals each key's nodes into `blocks` (a column) blocks and gives each pair of blocks (lo <= hi) the rows of both; own: a row's block.

    With one block that is the key's rows; more blocks bound a task's rows, and every pair of nodes meets in one task.
    """
    dealt = rows.withColumn("_b", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_b")).cast("int"))
    return (
        dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("lo", F.least("own", "_j"))
        .withColumn("hi", F.greatest("own", "_j"))
        .drop("_b", "_j")
    )


def together(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted by (key, lo, hi), for runs()."""
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The rows of each (key, lo, hi) of a sorted partition, and whether they are of two different blocks."""
    left: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        k, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi"))
        return np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    def out(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, bool]:
        return batch, batch.column("lo")[0].as_py() != batch.column("hi")[0].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        if left:  # only the seam is compared, so a long run is put together once
            first = whole([left[-1].slice(left[-1].num_rows - 1), batch.slice(0, 1)])
            if len(cut(first)):
                yield out(whole(left))
                left = []
        edges = cut(batch)
        if not len(edges):
            left.append(batch)
            continue
        yield out(whole([*left, batch.slice(0, edges[0])]))
        for a, b in zip(edges, edges[1:], strict=False):
            yield out(batch.slice(a, b - a))
        left = [batch.slice(edges[-1])]
    if left:
        yield out(whole(left))


def local_roots(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: each row's smallest reachable row number."""
    label = np.arange(len(near))
    while True:
        low = label.copy()
        for a in range(0, len(near), 256):
            np.minimum(low[a : a + 256], np.where(near[a : a + 256], label[None, :], len(near)).min(axis=1), out=low[a : a + 256])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def reached(content: np.ndarray, near) -> np.ndarray:
    """Each row's smallest row that ties lead to; near(content of rest, a's content, rest, a) says which of the rows rest are tied to row a.

    A row reached is held against those alone that nothing has reached yet, so that rows all tied to each other cost no more than one pass.
    """
    root = np.arange(len(content))
    rest, left = root.copy(), content
    while len(rest):
        first, rest, left = rest[0], rest[1:], left[1:]
        queue = [first]
        while queue and len(rest):
            a = queue.pop()
            tied = near(left, content[a], rest, a)
            if tied.any():
                root[rest[tied]] = first
                queue += rest[tied].tolist()
                rest, left = rest[~tied], left[~tied]
    return root


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for each node of edges (a, b), the smallest node it reaches.

    First each node a is tied to the least of its partners, and so are its other partners: nodes that share partners, as
    those of one group do in many buckets, then share edges, which count once. Least labels pass along the edges, and each round a node also takes its label's label, so rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder; a lost executor costs one round.
    """
    folder = workspace(edges.sparkSession, name)
    tied = edges.where("a <> b").select("a", "b").withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    pairs = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for x in ("a", "b") for a, b in ((x, "m"), ("m", x))]
    both = staged(tied.select(F.explode(F.array(*pairs)).alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "edges", folder)
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    label = staged(label, "round-0", folder)
    done, k = label.isEmpty(), 0
    while not done:
        k += 1
        known = few(label)
        offered = both.join(known.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        met = offered.join(known, "node").select("node", F.col("root").alias("was"), F.least("root", "offer").alias("via"))
        jump = met.join(known.select(F.col("node").alias("via"), F.col("root").alias("next")), "via", "left")
        label = staged(jump.select("node", F.least("via", F.coalesce("next", "via")).alias("root"), (F.least("via", F.coalesce("next", "via")) != F.col("was")).alias("changed")), f"round-{k}", folder)
        done = label.where("changed").isEmpty()
        label = label.select("node", "root")
    return label
