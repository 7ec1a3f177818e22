"""Exact top-k inner products by a dual-tree search over cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace

#: Cells of the top level, at least and at most: one for each DATA_ROWS rows in between. Their pivots are sampled rows.
MIN_CELLS, MAX_CELLS = 16, 4096
#: Rows of data, and queries, in one tree.
DATA_ROWS, QUERY_ROWS = 4096, 16_384
#: Points in a leaf, unless they are equal; points below which a ball shares a leaf; points of data compared at once with a leaf of queries.
LEAF, SMALL, BLOCK = 64, 8, 256


def quantised(lists: pa.Array, dimension: int, scale: float) -> np.ndarray:
    """floor(scale * component) as doubles, held within 2**62 on both sides, a row for each vector; shorter vectors end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dimension))
    where = np.arange(dimension)[None, :] < lengths[:, None]
    out[where] = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -(2.0**62), 2.0**62)
    return out


def compact(points: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    top = np.abs(points).max(initial=0)
    return points.astype(next((t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max), np.float64))


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where those suffice, else in longs, else in Python's integers (held at a long's ends)."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if top < 2.0**53:
        kind = np.float32 if top < 2.0**24 else np.float64
        return x.astype(kind) @ y.astype(kind).T
    if top < 2.0**63:
        return x.astype(np.int64) @ y.astype(np.int64).T
    as_int = lambda a: np.array([[int(c) for c in r] for r in a], dtype=object)
    return np.clip(as_int(x) @ as_int(y).T, -(2**63), 2**63 - 1).astype(np.int64)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :], 0)


def _balls(points: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """members cut into balls of this radius, each led by its centre; no centre lies in an earlier centre's ball."""
    rest, out = members, []
    while len(rest):
        lead = rest[:LEAF]
        near = _squares(points[lead], points[rest]) <= radius * radius
        owner = np.full(len(rest), -1)
        for i in range(len(lead)):
            if owner[i] < 0:
                near[i, i] = True
                owner[near[i] & (owner < 0)] = i
        taken = np.flatnonzero(owner >= 0)
        taken = taken[np.argsort(owner[taken], kind="stable")]
        out += np.split(rest[taken], np.flatnonzero(np.diff(owner[taken])) + 1)
        rest = rest[owner < 0]
    return out


def _bundles(points: np.ndarray, balls: list[np.ndarray]) -> list[np.ndarray]:
    """Small balls put together with their nearest ones, up to LEAF points a bundle."""
    centres = points[[b[0] for b in balls]]
    sizes, left, out = np.array([len(b) for b in balls]), np.arange(len(balls)), []
    while len(left):
        by = left[np.argsort(_squares(centres[left[:1]], centres[left])[0], kind="stable")[:LEAF]]
        take = by[: max(1, int((np.cumsum(sizes[by]) <= LEAF).sum()))]
        out.append(np.concatenate([balls[i] for i in take]))
        left = left[~np.isin(left, take)]
    return out


@dataclass
class CoverTree:
    """Points in the order of the tree. A node covers points[begin:end] within radius of its first point, its centre.

    A node is cut into balls of half its radius, whose centres lie further apart than that half, however many they are.
    Balls of more than LEAF points are cut in turn, those of fewer than SMALL are put together with their nearest into
    leaves, whose radius is what it then is. Node 0 is the root; a node's children follow each other.
    """

    ids: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    norm: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> CoverTree:
        x, n = points.astype(np.float64), len(ids)
        order = np.arange(n)
        if n:  # the point nearest to the mean leads
            lead = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
            order[0], order[lead] = lead, 0
        spans, radius, child, children = ([(0, n)] if n else []), [], [], []
        k = 0
        while k < len(spans):  # level by level
            a, b = spans[k]
            k += 1
            r = float(np.sqrt(((x[order[a:b]] - x[order[a]]) ** 2).sum(axis=1)).max()) * (1 + 1e-12)
            radius.append(r)
            child.append(len(spans))
            if b - a <= LEAF or r == 0:
                children.append(0)
                continue
            balls = _balls(x, order[a:b].copy(), r / 2)
            small = [g for g in balls if len(g) < SMALL]
            parts = [g for g in balls if len(g) >= SMALL] + (_bundles(x, small) if small else [])
            order[a:b] = np.concatenate(parts)
            cuts = a + np.concatenate(([0], np.cumsum([len(g) for g in parts])))
            spans += list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            children.append(len(parts))
        begin, end = (np.array([s[i] for s in spans], dtype=np.int64) for i in (0, 1))
        norm = np.sqrt((x[order[begin]] ** 2).sum(axis=1)) if n else np.zeros(0)
        return cls(ids[order], compact(points[order]), begin, end, np.array(radius), np.array(child, dtype=np.int64), np.array(children, dtype=np.int64), norm)


def search(queries: CoverTree, data: CoverTree, k: int, floors: np.ndarray, counted: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of each query's best k, scores at least its floor; floors rise as results come in.

    Nodes of queries are descended with the nodes of data that are left for them. A pair is left out where no inner product
    across it can reach the worst floor of the query node's queries: by the triangle inequality it is at most
    <cq, cd> + rq |cd| + rd |cq| + rq rd. Equal scores are examined for their ids. counted: products computed, pairs of nodes.
    """
    n = len(queries.ids)
    floors = floors.astype(np.float64).copy()
    best_s, best_i, have = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64), np.zeros(n, dtype=np.int64)
    counted = {} if counted is None else counted
    counted.setdefault("products", 0), counted.setdefault("pairs", 0)
    d_centres = data.points[data.begin].astype(np.float64) if len(data.ids) else np.zeros((0, 1))

    def bounds(q: int, ds: np.ndarray) -> np.ndarray:
        counted["pairs"] += len(ds)
        cq, rq, rd = queries.points[queries.begin[q]].astype(np.float64), queries.radius[q], data.radius[ds]
        top = d_centres[ds] @ cq + rq * data.norm[ds] + rd * queries.norm[q] + rq * rd
        return top + 1e-9 * (np.abs(top) + 1)

    def compare(a: int, b: int, at: np.ndarray) -> None:
        ids, scores = data.ids[at], dots(queries.points[a:b], data.points[at])
        counted["products"] += scores.size
        fit = (scores >= floors[a:b, None]) & (queries.ids[a:b, None] != ids[None, :])
        r, c = np.nonzero(fit)
        if not len(r):
            return
        rows = np.unique(r)
        old = np.flatnonzero(np.arange(k)[None, :] < have[a + rows][:, None])
        who = np.concatenate([r, rows[old // k]])
        s = np.concatenate([scores[r, c], best_s[a + rows].reshape(-1)[old]])
        i = np.concatenate([ids[c], best_i[a + rows].reshape(-1)[old]])
        by = np.lexsort((i, -s, who))
        who, s, i = who[by], s[by], i[by]
        first = np.concatenate(([0], np.flatnonzero(np.diff(who)) + 1))
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        top = place < k
        best_s[a + who[top], place[top]], best_i[a + who[top], place[top]] = s[top], i[top]
        have[a + rows] = np.minimum(k, np.diff(np.append(first, len(who))))
        full = a + rows[have[a + rows] == k]
        floors[full] = np.maximum(floors[full], best_s[full, k - 1])

    stack = [(0, np.zeros(1, dtype=np.int64))] if n and len(data.ids) else []
    while stack:
        q, front = stack.pop()
        a, b = queries.begin[q], queries.end[q]
        reach = bounds(q, front)
        keep = reach >= floors[a:b].min()
        front, reach = front[keep], reach[keep]
        if not len(front):
            continue
        wide = data.children[front] > 0
        if queries.children[q]:
            wide &= data.radius[front] >= queries.radius[q]
        if wide.any():
            kids = [np.arange(data.child[d], data.child[d] + data.children[d]) for d in front[wide]]
            stack.append((q, np.concatenate([front[~wide], *kids])))
        elif queries.children[q]:
            stack += [(c, front) for c in range(queries.child[q], queries.child[q] + queries.children[q])]
        else:  # leaves, the most promising first
            by = np.argsort(-reach, kind="stable")
            front, reach = front[by], reach[by]
            sizes = np.cumsum(data.end[front] - data.begin[front])
            j = 0
            while j < len(front) and reach[j] >= floors[a:b].min():
                stop = max(j + 1, int(np.searchsorted(sizes, (sizes[j - 1] if j else 0) + BLOCK, side="right")))
                for e in range(j, stop) if data.end[front[j]] - data.begin[front[j]] > BLOCK else ():
                    for low in range(data.begin[front[e]], data.end[front[e]], BLOCK):
                        compare(a, b, np.arange(low, min(low + BLOCK, data.end[front[e]])))
                if data.end[front[j]] - data.begin[front[j]] <= BLOCK:
                    compare(a, b, np.concatenate([np.arange(data.begin[d], data.end[d]) for d in front[j:stop]]))
                j = stop
    at = np.flatnonzero(np.arange(k)[None, :] < have[:, None])
    return at // k, best_i.reshape(-1)[at], best_s.reshape(-1)[at]


def _usable(id_col: str, vector: str) -> Column:
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(id_col).isNotNull() & F.coalesce(~bad, F.lit(False))


def candidates(ids: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The places of rows that can be results: of equal vectors those of the k + 1 smallest ids, of one id k rows at most."""
    _, same = np.unique(points, axis=0, return_inverse=True)
    same = same.reshape(-1)
    by = np.lexsort((ids, same))
    same, ids = same[by], ids[by]
    new_group = np.concatenate(([True], same[1:] != same[:-1]))
    new_id = new_group | np.concatenate(([True], ids[1:] != ids[:-1]))
    groups, firsts = np.flatnonzero(new_group), np.flatnonzero(new_id)
    rank = np.cumsum(new_id) - 1
    rank = rank - np.repeat(rank[groups], np.diff(np.append(groups, len(ids))))
    repeat = np.arange(len(ids)) - np.repeat(firsts, np.diff(np.append(firsts, len(ids))))
    return np.sort(by[(rank <= k) & (repeat < k)])


def _trees(rows: DataFrame, k: int, data: bool) -> DataFrame:
    """(grp, cell, tree, centre, radius) of rows (grp, cell, vec_id, point: whole doubles): a cover tree of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def out() -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held])
            points = np.concatenate([p for _, p in held])
            order = np.argsort(ids, kind="stable")
            ids, points = ids[order], points[order]
            if data:
                keep = candidates(ids, points, k)
                ids, points = ids[keep], points[keep]
            tree = CoverTree.build(ids, points)
            row = [[now[0]], [now[1]], [pickle.dumps(tree)], [tree.points[0].astype(np.float64).tolist()], [float(tree.radius[0])]]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["grp", "cell", "tree", "centre", "radius"])

        for batch in batches:
            groups = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and now[0] != groups[a]:
                    yield out()
                    held = []
                now = (int(groups[a]), batch.column("cell")[a].as_py())
                points = batch.column("point").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                held.append((batch.column("vec_id").slice(a, b - a).to_numpy(), points))
        if held:
            yield out()

    rows = rows.select("grp", "cell", "vec_id", "point").repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(run, "grp long, cell int, tree binary, centre array<double>, radius double")


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of all rows but the query's own for each query row.

    Vectors are quantised to floor(scale * component); the score is the integer inner product, ties go to the smaller
    id. Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part; a shorter
    vector counts as ending in zeros, an empty one as zero. Rows of the query's id are all its own. Repeated rows of
    queries give one set of results for each distinct id. Components beyond 2**62 and scores beyond a long count as
    those bounds. Other columns are ignored; an empty table gives an empty result.

    Queries and data are indexed together: sampled pivots give the top level's cells, to which every row is dealt, and
    each cell's rows lie in cover trees of bounded size. Each query is first searched in the trees of its own cells,
    which gives its floor; then cells of queries are held against the roots of all other trees, in a table of roots and
    radii, and only the trees of pairs that the floors leave are moved and searched.
    """
    spark = vectors.sparkSession
    folder = workspace(spark, "topk")
    rows = vectors.where(_usable(id_col, vector_col)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    facts = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    dimension, n = max(1, facts[0] or 1), facts[1]
    cells = max(MIN_CELLS, min(MAX_CELLS, -(-n // DATA_ROWS)))
    drawn = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).toArrow().combine_chunks()
    pivots = quantised(drawn["vector"].combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float32())), dimension, scale)
    pivots = np.unique(pivots, axis=0) if len(pivots) else np.zeros((1, dimension))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = quantised(batch.column("vector"), dimension, scale)
            cell, far = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for a in range(0, len(x), 1024):
                d = _squares(x[a : a + 1024], pivots)
                cell[a : a + 1024] = d.argmin(axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) * (1 + 1e-12)
            data = np.zeros(len(x), dtype=bool)
            data[candidates(batch.column("vec_id").to_numpy(), x, k)] = True  # equal vectors are few before they move
            point = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dimension, pa.array(x.reshape(-1)))
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("query"), pa.array(data), pa.array(cell), pa.array(far), point], names=["vec_id", "query", "data", "cell", "far", "point"])
            yield out.filter(pa.array(data | batch.column("query").to_numpy(zero_copy_only=False)))

    ids = dict(rows.dtypes)["vec_id"]
    dealt = staged(rows.mapInArrow(deal, f"vec_id {ids}, query boolean, data boolean, cell int, far double, point array<double>"), "dealt", folder)
    data = _dealt(dealt.where("data"), DATA_ROWS)
    asked = _dealt(dealt.where("query").dropDuplicates(["vec_id"]), QUERY_ROWS, len(pivots))
    asked = staged(asked, "asked", folder)
    data_trees = staged(_trees(data, k, True), "data", folder)
    query_trees = staged(_trees(asked, k, False).select("grp", "tree"), "queries", folder)
    parts = asked.groupBy("grp", "cell").agg(F.max("far").alias("far")).select(F.col("grp").alias("asked"), "cell", "far")
    own = parts.join(data_trees.select("grp", "cell"), "cell").select("asked", "grp").distinct()
    none = asked.select(F.col("grp").alias("asked"), F.lit(None).cast("array<struct<id:long,floor:double>>").alias("floors")).limit(0)
    first = staged(_searched(own, data_trees, query_trees, none, k), "first", folder)
    # a query's floor is its k-th best score so far
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    floors = floors.where(F.col("n") >= k).select("vec_id", F.col("s")[k - 1].cast("double").alias("floor"))
    with_floor = staged(asked.select("grp", "cell", "vec_id", "far").join(floors, "vec_id", "left"), "floors", folder)
    worst = with_floor.groupBy("cell").agg(F.max("far").alias("far"), F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("floor"))
    table = worst.toArrow().sort_by("cell")  # MAX_CELLS rows at most
    near = _unpruned(data_trees.select("grp", "centre", "radius"), pivots[table["cell"].to_numpy()], table["cell"].to_numpy(), table["far"].to_numpy(), table["floor"].to_numpy())
    more = near.join(parts.select("asked", "cell"), "cell").select("asked", "grp").distinct().join(own, ["asked", "grp"], "left_anti")
    by_group = with_floor.where("floor IS NOT NULL").groupBy(F.col("grp").alias("asked")).agg(F.collect_list(F.struct(F.col("vec_id").cast("long").alias("id"), "floor")).alias("floors"))
    best = first.unionByName(_searched(more, data_trees, query_trees, by_group, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(rows: DataFrame, per_group: int, together: int = 0) -> DataFrame:
    """Adds grp: cells of more rows than per_group are dealt by a hash of the id; with together, neighbouring small cells share one.

    Only counts of cells, of which there are MAX_CELLS at most, meet in one window and are broadcast.
    """
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    if together:
        before = F.sum("n").over(Window.orderBy("cell")) - F.col("n")
        plan = counts.withColumn("base", F.floor(before / per_group)).withColumn("parts", F.ceil(F.col("n") / per_group))
        plan = plan.withColumn("base", F.col("base") * (together + 1) + F.when(F.col("parts") > 1, F.col("cell") + 1).otherwise(0))
    else:
        plan = counts.withColumn("parts", F.ceil(F.col("n") / per_group)).withColumn("base", F.col("cell").cast("long"))
    joined = rows.join(F.broadcast(plan.select("cell", "base", "parts")), "cell")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return joined.withColumn("grp", (F.col("base") * F.lit(1 << 24) + part).cast("long")).drop("base", "parts")


def _unpruned(roots: DataFrame, centres: np.ndarray, cells: np.ndarray, far: np.ndarray, floor: np.ndarray) -> DataFrame:
    """(grp, cell): each tree with the cells of queries that it may hold results for, by centres, radii and worst floors."""
    norms = np.sqrt((centres**2).sum(axis=1))
    shared = roots.sparkSession.sparkContext.broadcast((centres, cells, far, floor, norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, cells, far, floor, norms = shared.value
        for batch in batches:
            for grp, c, r in zip(batch.column("grp").to_pylist(), batch.column("centre"), batch.column("radius").to_pylist(), strict=True):
                c = c.values.to_numpy()
                top = centres @ c + far * np.sqrt((c * c).sum()) + r * norms + far * r
                some = cells[top + 1e-9 * (np.abs(top) + 1) >= floor]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), grp)), pa.array(some.astype(np.int32))], names=["grp", "cell"])

    return roots.mapInArrow(run, "grp long, cell int")


def _searched(pairs: DataFrame, data_trees: DataFrame, query_trees: DataFrame, floors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the pairs (asked, grp) of trees, searched with the queries' floors (asked, floors)."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries: CoverTree = pickle.loads(batch.column("queries")[i].as_py())
                low = np.full(len(queries.ids), -np.inf)
                known = batch.column("floors")[i].values
                if known is not None and len(known):
                    ids, values = known.field("id").to_numpy(), known.field("floor").to_numpy()
                    order = np.argsort(ids)
                    at = np.minimum(np.searchsorted(ids[order], queries.ids), len(ids) - 1)
                    low = np.where(ids[order][at] == queries.ids, values[order][at], low)
                place, found, scores = search(queries, pickle.loads(batch.column("tree")[i].as_py()), k, low)
                yield pa.RecordBatch.from_arrays([pa.array(queries.ids[place].astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(scores.astype(np.int64))], names=["query_id", "vec_id", "score"])

    moved = pairs.join(query_trees.select(F.col("grp").alias("asked"), F.col("tree").alias("queries")), "asked").join(floors, "asked", "left")
    moved = moved.join(data_trees.select("grp", "tree"), "grp").select("queries", "floors", "tree")
    return moved.mapInArrow(seek, "query_id long, vec_id long, score long")


def op2(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20)
