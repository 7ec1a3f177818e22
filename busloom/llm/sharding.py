"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.llm.common import HASH_BITS, bins_for, ordered_hash, ranked


def interleave(
    docs: DataFrame, shards: int, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: str = "shard-1", keep: bool = False
) -> DataFrame:
    """Puts every row into one of `shards` shards so that each holds every stratum's share.

    Rows of a stratum are shuffled by a seeded hash and ranked; the fractional rank (rank + phase) / rows of the
    stratum, with a phase in [0, 1) hashed from the stratum's name, spreads each stratum evenly over (0, 1). All rows
    in the order of that fraction are cut into `shards` runs whose row counts differ by one at most, so a shard has
    each stratum's rows to within about one of proportion. The phase keeps thousands of one-row strata from meeting at 1/2.

    Adds size (UTF-8 bytes + 1; null text: 1), text_crc32 (null text: as empty), fraction, position (0 .. rows-1),
    shard and slot (position within the shard). Null strata form one stratum of their own. Rows that are equal in
    id, size, checksum and stratum are interchangeable. An empty table gives an empty result. With keep, row holds all
    columns of docs, whatever their names; without it only the assignment moves.
    """
    n = docs.count()
    bins = bins_for(n)
    shift = HASH_BITS - (bins.bit_length() - 1)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s:"), F.col(stratum).cast("string")), F.lit("n")).alias("stratum"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        ordered_hash(id_col, seed=seed).alias("_h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []),
    ).withColumn("_bin", F.shiftright("_h", shift).cast("int"))
    rows = ranked(rows, ["stratum"], "_bin", ["_h", "doc_id", "size", "text_crc32"], "_rank")
    totals = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_total"))
    phase = ordered_hash("stratum", seed=f"{seed}-phase") / F.lit(float(1 << HASH_BITS))
    rows = (
        rows.join(totals, "stratum")
        .withColumn("fraction", (F.col("_rank") + phase) / F.col("_total"))
        .withColumn("_cut", F.floor(F.col("fraction") * bins).cast("int"))
        .drop("_bin")
    )
    rows = ranked(rows, [], "_cut", ["fraction", "stratum", "_h", "doc_id", "size", "text_crc32"], "position")
    # shard s holds the positions p with floor(p * shards / n) = s; it begins at ceil(s * n / shards)
    shard = F.expr(f"(position * {shards}L) div {max(n, 1)}L")
    start = F.expr(f"(_s * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return (
        rows.withColumn("_s", shard)
        .withColumn("slot", F.col("position") - start)
        .select("doc_id", "stratum", "size", "text_crc32", "fraction", "position", F.col("_s").cast("int").alias("shard"), "slot", *["row"] * keep)
    )


def write_shards(docs: DataFrame, shards: int, path: str, **how) -> DataFrame:
    """Writes whole documents as Parquet, a folder shard=s each, in the order of their slots; returns the assignment as written.

    A shard's files are named in the order of its slots, and rows lie in it within a file, so a reader gets the mixture in any
    prefix. A hot shard is written by several tasks. how: interleave's other parameters.
    """
    placed = interleave(docs, shards, keep=True, **how)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleave(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
