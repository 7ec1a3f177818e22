"""Near-duplicate vectors by p-stable hashing of normalised vectors and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace
from busloom.llm.grouping import block_pairs, blocks_of, components, distinct_buckets, local_roots, runs, spread_join, together
from busloom.llm.hashing import mixed

#: Least cosine of a link; least share of pairs at that cosine that the tables bring together; width of a projection's cells.
COSINE, RECALL, WIDTH = 0.9, 0.99, 2.0
#: Unrelated vectors in a bucket, about; vectors in a block of comparisons.
CROWD, BLOCK = 4.0, 1024
SEED = 20_240


def collision(distance: float, width: float = WIDTH) -> float:
    """The probability that two vectors at this Euclidean distance fall into one cell of a quantised Gaussian projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables): unrelated (orthogonal) vectors share a bucket with about CROWD others, and a pair
    at the cosine shares one of the tables' buckets with probability recall."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * cosine))
    projections = max(4, math.ceil(math.log(max(rows, 2) / CROWD) / -math.log(far)))
    return projections, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**projections)))


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _keys(nodes: DataFrame, projections: int, tables: int) -> DataFrame:
    """(key, node) of every table's bucket; vectors of different lengths share none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, lists = batch.column("node").to_numpy(), batch.column("vector")
            lengths = np.diff(lists.offsets.to_numpy())
            for d in np.unique(lengths):
                if d not in drawn:
                    rng = np.random.default_rng([SEED, int(d)])
                    drawn[d] = rng.normal(size=(int(d), tables * projections)), rng.uniform(0, WIDTH, tables * projections)
                directions, shifts = drawn[d]
                rows = np.flatnonzero(lengths == d)
                for a in range(0, len(rows), 2048):
                    some = rows[a : a + 2048]
                    x = unit(lists.take(pa.array(some)).flatten().to_numpy().reshape(len(some), d))
                    cells = np.floor((x @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(some), tables, projections)
                    key = np.broadcast_to(mixed(np.arange(tables, dtype=np.uint64) + np.uint64(1_000_003 * int(d))), cells.shape[:2]).copy()
                    for k in range(projections):
                        key = mixed(key + cells[:, :, k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[some], tables))], names=["key", "node"])

    return nodes.select("node", "vector").mapInArrow(run, "key long, node long")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _edges(rows: DataFrame, cosine: float, counts: bool) -> DataFrame:
    """Of block pairs of (key, node, copies, vector): a star of the links of each, and with counts the links of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, across in runs(batches):
            nodes, own, copies = (batch.column(c).to_numpy() for c in ("node", "own", "copies"))
            x = unit(_matrix(batch.column("vector")))
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if across:
                near &= own[:, None] != own[None, :]
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                root = local_roots(near)
                links = near @ copies if counts else copies
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

    return together(rows).mapInArrow(run, "a long, b long, links long")


def links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id and kept (vec_id = component_id).

    Two rows link where the cosine of their vectors, in double precision, is at least `cosine`. Null vectors, zero vectors and those with
    null or non-finite components link with nothing; nor do vectors of different lengths. Equal vectors are one node
    with a count of copies, so a vector that a third of the rows have is hashed once. Buckets of any size are compared
    whole, by blocks. The tables only need to join a component: within it, all pairs of nodes are then compared, by
    blocks, so n_links is exact for every component that the tables find whole. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    folder = workspace(spark, "vectors")
    good = vectors.where(usable(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    nodes = good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # ids of the nodes are given once, in the written table
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", folder)
    projections, tables = plan(nodes.count(), cosine, recall)
    keys = staged(_keys(nodes, projections, tables), "keys", folder)
    buckets = distinct_buckets(keys.distinct())
    content = nodes.select("node", "copies", "vector")
    members = keys.distinct().join(buckets, "key").join(content, "node")
    found = staged(_edges(block_pairs(members, blocks_of(F.col("n"), BLOCK)), cosine, False).select("a", "b").distinct(), "found", folder)
    near = components(found, "vector-components")
    grouped = near.select("node", F.col("root").alias("key"))
    sizes = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    whole = block_pairs(grouped.join(sizes, "key").join(content, "node"), blocks_of(F.col("n"), BLOCK))
    counts = _edges(whole, cosine, True).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    facts = nodes.join(near, "node", "left").join(counts, "node", "left").withColumn("class", F.coalesce("root", "node"))
    facts = staged(facts.select("node", "vector", "rep", "copies", "class", F.coalesce("links", F.lit(0)).alias("links")), "facts", folder)
    heads = facts.groupBy("class").agg(F.min("rep").alias("component_id"))
    facts = facts.join(heads, "class").select("vector", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = vectors.where(~usable(vector_col)).select(F.col(id_col).alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    out = spread_join(good, staged(facts, "joined", folder), "vector", "copies").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.9."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
