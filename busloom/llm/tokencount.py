"""Token counts of documents in flat token files, found by scanning for the end-of-document id."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busloom.llm.common import staged, workspace
from busloom.llm.wordpieces import Output, filesystem, rounds, word_encoder

#: Tokens in a scanned block.
BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every row's ids and end_id after them, 16 bits each, into flat files in folder: one for each task.

    The files have no index. Returned (and to be written once, as each evaluation writes files anew) is what a reader
    needs to name the documents: file, ordinal in the file, doc_id. Null and empty texts are a lone end_id.
    """
    shape = docs.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("ordinal"), F.col(id_col).alias("doc_id")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, name, out, n = word_encoder(tokenizer, plain_specials=True), f"{uuid.uuid4().hex}.tok", None, 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            out = out or Output(f"{folder}/{name}")
            for _, texts in rounds([None] * batch.num_rows, batch.column(1).to_pylist()):
                out.write(end.join([*encoder.encode(texts), b""]))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.string()), pa.array(np.arange(n, n + m)), batch.column(0)], names=["file", "ordinal", "doc_id"])
            n += m
        if out:
            out.close()

    return docs.select(id_col, text_col).mapInArrow(run, shape)


def scan_blocks(spark: SparkSession, folder: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each block of each flat file: how it cuts into documents, as seen from inside the block.

    file, block, tokens, ends (end_ids in it), head (tokens before the first end_id), last (tokens up to and with the
    last end_id, null without one), inner (tokens between neighbouring end_ids). A folder without files, or with empty
    ones, has no blocks.
    """
    from pyarrow import fs as pafs

    fs, path = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    files = [(f.base_name, f.size // 2) for f in found if f.base_name.endswith(".tok")]
    blocks = (
        spark.createDataFrame(files, "file string, tokens long")
        .where("tokens > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {block_tokens}L)")))
        .drop("tokens")
    )
    blocks = blocks.repartition(spark.sparkContext.defaultParallelism * 4, "file", "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for frame in frames:
            for file, block in zip(frame["file"], frame["block"], strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    f.seek(int(block) * block_tokens * 2)
                    ids = np.frombuffer(f.read(block_tokens * 2), dtype="<u2")
                ends = np.flatnonzero(ids == end_id)
                yield pd.DataFrame(
                    {
                        "file": [file],
                        "block": [block],
                        "tokens": [len(ids)],
                        "ends": [len(ends)],
                        "head": [int(ends[0]) if len(ends) else len(ids)],
                        "last": pd.array([int(ends[-1]) + 1 if len(ends) else None], dtype="Int64"),
                        "inner": [(np.diff(ends) - 1).astype(np.int64)],
                    }
                )

    return blocks.mapInPandas(run, "file string, block long, tokens long, ends long, head long, last long, inner array<long>")


def stitch(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents' tokens (file, ordinal, n_tokens; the end_id isn't counted) by a prefix scan over a file's blocks.

    Before a block lie the sum of the earlier blocks' end_ids, and the place after the latest of them; what lies
    between that place and the block belongs to the document that ends with the block's first end_id. Tokens after a
    file's last end_id are a last document without one. No blocks give no documents.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    start = F.col("block") * F.lit(block_tokens).cast("long")
    scanned = (
        blocks.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
        .withColumn("since", F.coalesce(F.max(start + F.col("last")).over(before), F.lit(0)))
        .withColumn("carry", start - F.col("since"))
        .withColumn("rest", F.when(F.col("block") == F.max("block").over(whole), F.when(F.col("ends") > 0, F.col("tokens") - F.col("last")).otherwise(F.col("carry") + F.col("tokens"))))
    )
    ended = scanned.where("ends > 0").select("file", "first", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("i", "n_tokens"))
    open_ = scanned.where("rest > 0").select("file", (F.col("first") + F.col("ends")).alias("ordinal"), F.col("rest").alias("n_tokens"))
    return ended.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens").unionByName(open_)


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files of the public word-level vocabulary."""
    import public_tokenizers

    end_id = 49407
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = workspace(spark, "flat")
    names = staged(write_flat(docs, public_tokenizers.path("word_bpe_49k.json"), end_id, f"{folder}/files"), "names", folder)
    counts = stitch(scan_blocks(spark, f"{folder}/files", end_id))
    # a task that was run twice left a second file, which names doesn't mention
    return names.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
