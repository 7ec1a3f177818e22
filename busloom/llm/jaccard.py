"""Near-duplicate texts by a chosen-path join on sets of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace
from busloom.llm.grouping import block_pairs, blocks_of, components, distinct_buckets, few, local_roots, reached, runs, spread_join, together
from busloom.llm.hashing import WordHasher, mixed

#: Words of a shingle; least Jaccard similarity; least share of the pairs at that similarity that the runs find.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.995
#: Sampled tokens of a set (the least of a hash over its shingles, position by position). Only their low bytes move: equal tokens stay equal.
POSITIONS = 128
#: A bucket of up to SMALL sets is compared by brute force; larger ones are split again, until they are DEPTH deep.
SMALL, DEPTH = 512, 3
#: Standard deviations of the estimate by POSITIONS tokens that a pair may lie below SIMILARITY and still be verified.
SLACK = 5.0
#: Shingles, and sets, in a block of the exact comparison.
BLOCK_SHINGLES, BLOCK_SETS = 400_000, 2_048
_MULTIPLY = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(10_001, 10_001 + POSITIONS, dtype=np.uint64))


def shingles(text: str | None, hasher: WordHasher, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the lower-cased text's runs of `words` words.

    Words are parted by white space. A text of fewer words is one shingle of all of them; null, empty and blank texts have none.
    """
    h = hasher((text or "").lower().encode(errors="replace").split())
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The sampled tokens: at each position the least value of its hash over the set."""
    out = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(hashes), 2048):
        values = _MULTIPLY[:, None] * hashes[None, a : a + 2048] + _ADD[:, None]
        np.minimum(out, (values >> np.uint64(32)).min(axis=1).astype(np.uint32), out=out)
    return out


def plan_runs(similarity: float, recall: float, depth: int) -> int:
    """Runs so that a pair at the similarity shares a bucket with probability recall, even if each split goes `depth` deep.

    A split samples a Poisson number of positions with mean m = 1 / similarity, or one where that is none. A pair shares each
    position's sub-bucket with probability similarity, so it survives d levels with q(d) = 1 - (exp(-m x) - exp(-m) x) at
    x = similarity * q(d-1).
    """
    q, m = 1.0, 1 / similarity
    for _ in range(depth):
        x = similarity * q
        q = 1 - (math.exp(-m * x) - math.exp(-m) * x)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def sampled(path: int, similarity: float) -> np.ndarray:
    """The positions by which the bucket at this path is split: each with probability 1 / (similarity * POSITIONS), one at least."""
    draws = mixed(np.uint64(path & 0xFFFFFFFFFFFFFFFF) + mixed(np.arange(POSITIONS, dtype=np.uint64) + np.uint64(77)))
    some = np.flatnonzero(draws < np.uint64(2**64 / (similarity * POSITIONS)))
    return some if len(some) else draws.argmin(keepdims=True)


def roots(similarity: float, recall: float) -> list[tuple[int, int]]:
    """The (run, position) pairs by which the runs first split all sets."""
    return [(r, int(i)) for r in range(plan_runs(similarity, recall, DEPTH)) for i in sampled(r + 1, similarity)]


def _sets(docs: DataFrame, positions: list[int]) -> DataFrame:
    """doc_id, text_hash, node (the hash of the set of shingles; null without any), size (its shingles), heads (the sampled
    tokens at the positions, whole) and tokens (the low bytes of all)."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    shape = docs.select("doc_id", "text_hash", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("heads"), F.lit(b"").alias("tokens")).schema
    for f in shape:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            nodes, sizes, heads, tokens = [], [], [], []
            for t in batch.column("text"):
                s = shingles(t.as_py(), hasher)
                k = sketch(s) if len(s) else None
                nodes.append(None if k is None else xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                sizes.append(len(s))
                heads.append(None if k is None else k[positions].tobytes())
                tokens.append(None if k is None else k.astype(np.uint8).tobytes())
            new = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=shape.names)

    return docs.mapInArrow(run, shape)


def _split(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, node, tokens) of the sub-buckets of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            tokens = _matrix(batch.column("tokens"))
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                for i in sampled(int(key), similarity):
                    new = mixed(mixed(key.astype(np.uint64) + np.uint64(i + 1)) + tokens[at, i]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(nodes[at]), batch.column("tokens").take(pa.array(at))], names=["key", "node", "tokens"])

    return rows.select("key", "node", "tokens").mapInArrow(run, "key long, node long, tokens binary")


def _star(nodes: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    some = root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["a", "b"])


def least_tokens(similarity: float) -> float:
    """Equal sampled tokens below which a pair isn't verified: SLACK standard deviations below what the similarity gives."""
    return POSITIONS * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / POSITIONS))


def _matrix(tokens: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(tokens.to_pylist()), dtype=np.uint8).reshape(len(tokens), POSITIONS)


def _alike(tokens: np.ndarray, one: np.ndarray) -> np.ndarray:
    """At how many positions each row of tokens has those of one."""
    eights = (tokens == one).view(np.uint64).sum(axis=1, dtype=np.uint64)  # a byte counts POSITIONS / 8 positions
    return (eights * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _candidates(sets: DataFrame, similarity: float, recall: float, folder: str) -> DataFrame:
    """(node, root): sets tied by buckets that they share and sampled tokens that don't rule the similarity out.

    Every bucket of over SMALL sets is split again down to DEPTH, where it is compared by blocks. All runs go together, and
    buckets of the same sets count once. Inside a bucket a set that is tied is not compared with those tied already.
    """
    least = least_tokens(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, across in runs(batches):
            nodes, own = batch.column("node").to_numpy(), batch.column("own").to_numpy()

            def near(tokens: np.ndarray, one: np.ndarray, rest: np.ndarray, a: int, own=own, across=across) -> np.ndarray:
                some = _alike(tokens, one) >= least
                return some & (own[rest] != own[a]) if across else some

            yield _star(nodes, reached(_matrix(batch.column("tokens")), near))

    places = [F.xxhash64(F.lit(r), F.lit(i), F.substring("heads", 4 * k + 1, 4)) for k, (r, i) in enumerate(roots(similarity, recall))]
    rows, edges = sets.select(F.explode(F.array(*places)).alias("key"), "node", "tokens"), None
    for level in range(1, DEPTH + 1):
        buckets = staged(distinct_buckets(rows.select("key", "node")), f"buckets-{level}", folder)
        some = few(buckets)
        if some is not buckets or level > 1:
            members = rows.join(some, "key")
        else:  # only the members' tokens move
            members = rows.select("key", "node").join(buckets, "key").join(sets.select("node", "tokens"), "node")
        members = staged(members.select("key", "node", "tokens", "n"), f"members-{level}", folder)
        done = F.col("n") <= SMALL if level < DEPTH else F.lit(True)
        pairs = block_pairs(members.where(done), blocks_of(F.col("n"), BLOCK_SETS, spread=SMALL, tasks=4))
        found = staged(together(pairs).mapInArrow(compare, "a long, b long"), f"edges-{level}", folder)
        edges = found if edges is None else edges.union(found)
        large = members.where(~done)
        if level == DEPTH or large.isEmpty():
            break
        rows = staged(_split(large, similarity), f"rows-{level + 1}", folder)
    return components(edges, "groups")


def _verified(docs: DataFrame, members: DataFrame, similarity: float, folder: str) -> DataFrame:
    """Exact similarities within each candidate group (rep, node, key, copies, size, tokens): rows (a, b) of links and (a, links) of counts.

    One text of each set is read again. A group's sets are dealt into blocks of bounded size; each pair of blocks is one
    task's work, so that a group of any size is compared whole, and what leaves a task is a row or two a set. Pairs that
    their sampled tokens rule out cost no more than the comparison of those, so a chain of texts that are
    alike by twos is cheap.
    """
    shape = "key long, node long, copies long, blocks long, hashes binary"

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [shingles(t.as_py(), hasher).tobytes() for t in batch.column("text")]
            # several texts may have the representative's id; the one whose set is the node's is meant
            right = [xxhash.xxh3_64_intdigest(h) - (1 << 63) == n for h, n in zip(sets, batch.column("node").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "copies", "blocks")), pa.array(sets, pa.binary())], names=["key", "node", "copies", "blocks", "hashes"])
            yield out.filter(pa.array(right, pa.bool_()))

    members = staged(members, "members", folder)
    blocks = F.greatest(F.ceil(F.sum("size") / F.lit(float(BLOCK_SHINGLES))), blocks_of(F.count(F.lit(1)), BLOCK_SETS))
    sizes = staged(members.groupBy("key").agg(blocks.cast("long").alias("blocks")), "sizes", folder)
    listed = members.select("rep", "key", "node", "copies").join(few(sizes), "key")
    if few(members) is not members:  # only candidates' texts move
        listed = F.broadcast(listed)
    texts = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "node", "copies", "blocks", "text").mapInArrow(again, shape)
    sets = texts.dropDuplicates(["node"]).join(members.select("node", "tokens"), "node")
    dealt = block_pairs(sets, F.col("blocks")).drop("blocks")
    least = least_tokens(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, across in runs(batches):
            nodes, own, copies = (batch.column(c).to_numpy() for c in ("node", "own", "copies"))
            tokens = _matrix(batch.column("tokens"))
            parts = [np.frombuffer(h, dtype=np.uint64) for h in batch.column("hashes").to_pylist()]
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes)
            values, codes = np.unique(np.concatenate(parts), return_inverse=True)
            mark = np.zeros(len(values), dtype=np.int32)
            near = np.zeros((len(nodes), len(nodes)), dtype=bool)
            for a in range(len(nodes)):
                some = _alike(tokens[a + 1 :], tokens[a]) >= least
                if across:
                    some &= own[a + 1 :] != own[a]
                some = np.flatnonzero(some) + a + 1
                if not len(some):
                    continue
                mine = codes[ends[a] - sizes[a] : ends[a]]
                mark[mine] = 1
                theirs = mark[np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in some])]
                shared = np.add.reduceat(theirs, np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
                mark[mine] = 0
                near[a, some] = shared / (sizes[some] + sizes[a] - shared) >= similarity
            near |= near.T
            links = near @ copies
            some = np.flatnonzero(links)
            root = local_roots(near)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

    return staged(together(dealt).mapInArrow(compare, "a long, b long, links long"), "links", folder)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_links, class_id, kept and text_hash (xxhash64).

    Two rows link where the Jaccard similarity of their sets of five-word shingles is at least `similarity`; n_links counts a row's links,
    class_id is the smallest doc_id that links lead to, its own included, and kept marks one row of each class (of
    several with that id, one of them). Rows of the same set link with each other. Null, empty and blank texts link with
    nothing; null ids are left out of a class's smallest unless it has no other. Equal ids are counted as rows.

    The join recursively splits all sets by sampled shared tokens and compares small buckets; runs are repeated until a pair
    at the threshold is found with probability `recall`. What is found together is then compared exactly and whole, by blocks.
    Sets count once however many rows have them, and a bucket or group that holds any share of the rows is dealt to many tasks.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = _sets(docs, [i for _, i in roots(similarity, recall)])
    rows = staged(sets.withColumn("row", F.monotonically_increasing_id()), "rows", folder)
    # a set's smallest id, and one of the rows that have it; null ids come after all others
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), F.col("row").alias("first"))).alias("one")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(one, F.count(F.lit(1)).alias("copies"), *[F.any_value(c).alias(c) for c in ("size", "heads", "tokens")])
    nodes = staged(nodes.select("node", "one.rep", "one.first", "copies", "size", "heads", "tokens"), "nodes", folder)
    near = _candidates(nodes, similarity, recall, folder)
    members = nodes.drop("first", "heads").join(few(near.select("node", F.col("root").alias("key"))), "node")
    links = _verified(docs, members, similarity, folder)
    root = components(links.select("a", "b"), "classes")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = nodes.select("node", "rep").join(few(staged(root.join(counts, "node"), "counts", folder)), "node")
    linked = staged(linked.withColumnRenamed("root", "class"), "linked", folder)
    # a class's row that stays: the smallest id's, and of several sets with that id the smallest node's
    heads = staged(linked.groupBy("class").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("head")), "heads", folder)
    classed = staged(linked.join(few(heads), "class").select("node", "links", F.col("head.rep").alias("class_id"), (F.col("head.node") == F.col("node")).alias("head")), "classed", folder)
    facts = nodes.select("node", "rep", "first", "copies").join(few(classed), "node", "left")
    facts = facts.select("node", "copies", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("head").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head", F.lit(True)).alias("head"))
    out = spread_join(rows.select("doc_id", "node", "row", "text_hash"), staged(facts, "facts", folder), "node", "copies")
    return out.select(
        "doc_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("node").isNull() | (F.col("head") & (F.col("row") == F.col("first")))).alias("kept"),
        "text_hash",
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns, whatever their names), one of each class of near-duplicates.

    Texts without words are no near-duplicates: all of those rows stay.
    """
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    kept = near_duplicates(plain, similarity, recall).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = plain.withColumn("_h", F.xxhash64("text"))
    out = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi")
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    if not hashed.where(~wordless).groupBy("doc_id", "_h").count().where("count > 1").isEmpty():  # whole rows' ids and texts repeat: one of them stays
        out = out.where(wordless).unionByName(out.where(~wordless).dropDuplicates(["doc_id", "_h"]))
    return out.drop("_h").toDF(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates and its number of links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
