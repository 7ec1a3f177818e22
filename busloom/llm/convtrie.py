"""The prefix trie of conversations: what they share at their beginnings, summed up from the leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns in a bin of a conversation's running sums; repeats of a turn that are made at once; identifiers in a bin of those that end at a node.
TURN_BIN, REPEAT_BIN, END_BIN = 4096, 65_536, 1024
#: A prefix is known by its depth and sums of PARTS hashes of PART_BITS bits, 144 bits in all: sums stay within a long up to 2**27 turns.
PARTS, PART_BITS = 4, 36
_S, _P, _Q = ([f"{x}{k}" for k in range(PARTS)] for x in "spq")
KEY = ["depth", *_S]


def numbered(turns: DataFrame, folder: str) -> DataFrame:
    """(conv_id, d, content, words): every turn with its number from 1 within its conversation and the md5 of role and text.

    Order: turn, null first, then the md5, so that ties have an order; repeated rows are turns of their own. Null roles and
    texts are empty; rows without conv_id take no part. Texts stay where they are read. Repeated rows are counted before
    anything is sorted, and a conversation's turns are sorted by ranges, however many one has.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    own = ["conv_id", "turn", "content"]
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("content")]
    ranges = staged(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges", folder)
    along = Window.partitionBy("conv_id").orderBy("part")  # a row for each range that a conversation reaches into
    before = ranges.groupBy("conv_id", "part").agg(F.sum("n").alias("in_part")).select("conv_id", "part", (F.sum("in_part").over(along) - F.col("in_part")).alias("before"))
    within = Window.partitionBy("conv_id", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("upto", F.sum("n").over(within)).join(before, ["conv_id", "part"])
    placed = placed.select("conv_id", "content", "words", "n", (F.col("before") + F.col("upto") - F.col("n") + 1).alias("first"))
    runs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(REPEAT_BIN))).alias("run"))
    turn = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + REPEAT_BIN, F.col("n")) - 1))
    return runs.select("conv_id", "content", "words", "first", turn.alias("again")).select("conv_id", (F.col("first") + F.col("again")).alias("d"), "content", "words")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("d").alias("length"))


def rebuilt(turns: DataFrame, own: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and lengths of conversations that begin like their group's first one.

    Conversation c gets the first h turns of c - c % group (what it has of them) in place of its own first h; h is the crc32
    of c in decimal digits modulo shared. A conversation may so have no turn at all.
    """
    convs = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared})
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    convs = convs.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    begun = turns.where((F.col("conv_id") % group == 0) & (F.col("d") < shared)).withColumnRenamed("conv_id", "base")
    head = convs.select("conv_id", "base", "taken").join(begun, "base").where("d <= taken").select("conv_id", "d", "content", "words")
    tail = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "content", "words")
    return head.unionByName(tail), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, KEY, parent's sums, words, words_upto, ends): a row for each conversation and prefix of it, the empty one too."""
    parts = [F.shiftrightunsigned(F.xxhash64(F.lit(k), "d", "content"), 64 - PART_BITS) for k in range(PARTS)]
    at_root = own.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(p) for p in _P])
    rows = turns.select("conv_id", "d", "words", *[x.alias(p) for x, p in zip(parts, _P, strict=True)]).unionByName(at_root)
    rows = rows.withColumn("bin", F.floor(F.col("d") / TURN_BIN))
    summed = {"words_upto": "words", **dict(zip(_S, _P, strict=True))}
    within = Window.partitionBy("conv_id", "bin").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for TURN_BIN turns
    whole = rows.groupBy("conv_id", "bin").agg(*[F.sum(c).alias(c) for c in summed.values()])
    before = whole.select("conv_id", "bin", *[F.sum(c).over(along).alias(f"before_{o}") for o, c in summed.items()]).where("bin > 0")
    rows = rows.withColumns({o: F.sum(c).over(within) for o, c in summed.items()}).join(before, ["conv_id", "bin"], "left")
    rows = rows.withColumns({o: F.col(o) + F.coalesce(f"before_{o}", F.lit(0)) for o in summed}).join(own, "conv_id")
    return rows.select("conv_id", F.col("d").alias("depth"), *_S, *[(F.col(s) - F.col(p)).alias(q) for s, p, q in zip(_S, _P, _Q, strict=True)], "words", "words_upto", (F.col("d") == F.col("length")).alias("ends"))


def ends_digests(ended: DataFrame) -> DataFrame:
    """(KEY, ends_sha256): the digest of the conv_ids that end at a node, ascending, joined by commas.

    Bins of END_BIN identifiers are joined side by side. A node with one bin is digested there; of the others a task takes
    in the bins one after the other, never a node's whole list.
    """
    bins = ended.withColumn("bin", F.floor(F.col("conv_id") / END_BIN)).groupBy(*KEY, "bin").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("listed"))
    sizes = bins.groupBy(*KEY).agg(F.count(F.lit(1)).alias("bins"), F.first("listed").alias("only"))
    single = sizes.where("bins = 1").select(*KEY, F.sha2(F.col("only").cast("binary"), 256).alias("ends_sha256"))
    several = bins.join(sizes.where("bins > 1").select(*KEY), KEY).repartition(*KEY).sortWithinPartitions(*KEY, "bin")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        node, digest = None, None
        for frame in frames:
            done = []
            for *key, listed in frame[[*KEY, "listed"]].itertuples(index=False):
                if key == node:
                    digest.update(b"," + listed.encode())
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(listed.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    return single.unionByName(several.select(*KEY, "listed").mapInPandas(run, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string"))


def runs_of(nodes: DataFrame) -> DataFrame:
    """The trie with each run of nodes that have the same members as one: (conv_id, n_convs) name a run, from its top to bottom depth.

    Nodes of one least member lie on its path; of those, equal numbers of members mean the same members. Only a run's bottom
    has several children, or conversations that end. Adds the run above: up_conv, up_n.
    """
    top = F.min_by(F.struct("depth", *_Q, (F.col("words_upto") - F.col("words")).alias("words_before")), "depth")
    runs = nodes.groupBy("conv_id", "n_convs").agg(F.max("depth").alias("bottom"), F.max("words_upto").alias("words_upto"), top.alias("top"))
    runs = runs.select("conv_id", "n_convs", "bottom", "words_upto", F.col("top.depth").alias("top"), ((F.col("n_convs") - 1) * (F.col("words_upto") - F.col("top.words_before"))).alias("saved"), (F.col("top.depth") - 1).alias("depth"), *[F.col(f"top.{q}").alias(s) for q, s in zip(_Q, _S, strict=True)])
    above = nodes.select(*KEY, F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    return runs.join(above, KEY, "left").drop(*KEY)


def peeled(runs: DataFrame, folder: str) -> DataFrame:
    """(conv_id, n_convs, kids, leaves, below): for each run its child runs, the leaves under it and the savings under its bottom.

    Leaves are done from the start. In each round the runs just done send their totals up, summed by receiver; a receiver's
    counter of children still open falls by the number of senders, and at 0 it is done itself. The last one done is the
    root's run. Rounds: the height of the tree of runs.
    """
    spark = runs.sparkSession
    kids = runs.where("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count(F.lit(1)).alias("kids"))
    state = runs.select("conv_id", "n_convs", "saved", "up_conv", "up_n").join(kids, ["conv_id", "n_convs"], "left")
    zero = F.lit(0).cast("long")
    state = state.select("*", F.coalesce("kids", zero).alias("open"), F.when(F.col("kids").isNull(), F.lit(1)).otherwise(zero).cast("long").alias("leaves"), zero.alias("below"))
    state, done, k = staged(state, "round-0", folder), [], 0
    while True:
        done.append(state.where("open = 0"))
        waiting = state.where("open > 0")
        if waiting.isEmpty():
            break
        sent = done[-1].groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count(F.lit(1)).alias("senders"), F.sum("leaves").alias("more"), F.sum(F.col("saved") + F.col("below")).alias("total"))
        told = waiting.join(sent, ["conv_id", "n_convs"], "left")
        state = told.select("conv_id", "n_convs", "saved", "up_conv", "up_n", "kids", (F.col("open") - F.coalesce("senders", zero)).alias("open"), (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("below") + F.coalesce("total", zero)).alias("below"))
        k += 1
        state = staged(state, f"round-{k}", folder)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("conv_id", "n_convs", F.coalesce("kids", zero).alias("kids"), "leaves", "below")


def trie(turns: DataFrame, own: DataFrame) -> DataFrame:
    """A row for each distinct beginning of conversations, with members, children, leaves, saved words and who ends there.

    turns: numbered turns; own: every conversation's length, 0 for one without turns, which is a member of the root alone.
    Without conversations there is no node. No conversation, node or list of members meets in one task.
    """
    folder = workspace(turns.sparkSession, "convtrie")
    rows = staged(prefixes(turns, own), "prefixes", folder)
    grouped = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.first(c).alias(c) for c in (*_Q, "words", "words_upto")])
    nodes = staged(grouped, "nodes", folder)
    runs = staged(runs_of(nodes), "runs", folder)
    totals = peeled(runs, folder).join(runs, ["conv_id", "n_convs"])
    about = nodes.withColumnRenamed("words_upto", "upto").join(totals, ["conv_id", "n_convs"]).join(ends_digests(rows.where("ends").select(*KEY, "conv_id")), KEY, "left")
    at_bottom = F.col("depth") == F.col("bottom")
    saved = F.col("below") + (F.col("n_convs") - 1) * (F.col("words_upto") - F.col("upto") + F.col("words"))
    return about.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_bottom, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def of_table(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """The trie of a table of (conv_id, turn, role, text); with rebuild, of its conversations as rebuilt() makes them."""
    folder = workspace(conversations.sparkSession, "conversations")
    turns = staged(numbered(conversations, folder), "turns", folder)
    own = lengths(turns)
    return trie(*rebuilt(turns, own)) if rebuild else trie(turns, own)


def op13(spark, sf_dir: str) -> DataFrame:
    """The trie of the conversations, each rebuilt to begin like the first of its twenty."""
    return of_table(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
