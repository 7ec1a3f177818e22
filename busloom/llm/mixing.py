"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.llm.common import HASH_BITS, bins_for, ordered_hash, ranked, staged

#: Sources, and values of their distribution functions, up to which the table is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_RATES, MAX_BROADCAST_VALUES = 20_000, 2_000_000
#: Copies of a document that are made of one row at once.
COPIES = 1 << 16
#: What mixed() adds.
ADDED = ("copies", "copy", "position")
#: Exponent on a source's share of rows in the default target weights.
TEMPERATURE = 0.7


def source_key(stratum: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(stratum).cast("string")), F.lit("n"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, stratum: str = "source", temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """Per source: rows, target share and rate = the mean number of copies of one of its rows.

    weights maps a source to its relative target weight; a source it leaves out gets 0. Without weights a source's
    weight is rows ** temperature. The rates are such that epochs * rows are expected in all.
    """
    sizes = docs.groupBy(source_key(stratum).alias("_key"), F.col(stratum).alias("_source")).agg(F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        weight = F.pow(F.col("_rows").cast("double"), F.lit(float(temperature)))
    else:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.col("_source").cast("string")), F.lit(0.0))
    sums = sizes.withColumn("_weight", weight).agg(F.sum("_weight").alias("_all_weight"), F.sum("_rows").alias("_all_rows"))
    share = F.when(F.col("_all_weight") > 0, F.col("_weight") / F.col("_all_weight")).otherwise(F.lit(0.0))
    # one row of sums meets the sources
    return sizes.withColumn("_weight", weight).join(F.broadcast(sums)).select(
        "_key", "_source", "_rows", share.alias("_share"), (share * F.col("_all_rows") * F.lit(float(epochs)) / F.col("_rows")).alias("_rate")
    )


def poisson_table(rate_rows: DataFrame) -> DataFrame:
    """_key, _first and _cdf: the Poisson distribution function at _first, _first + 1, ... as far as a double tells it from 0 and 1.

    A source's table begins 12 standard deviations below its rate and ends as far above, so it grows with the root of the
    rate. Logarithms of factorials and probabilities are running sums over its rows.
    """
    reach = 12 * F.sqrt("_rate") + 30
    low = F.floor(F.col("_rate") - reach)
    low = F.when(low >= 32, low).otherwise(F.lit(0))
    x = F.col("_first").cast("double")
    # ln of _first!, by Stirling's series, exact to the last digits from 32 on
    fact = F.when(x > 0, x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)).otherwise(F.lit(0.0))
    along = Window.partitionBy("_key").orderBy("_k")
    rows = rate_rows.select("_key", "_rate", low.alias("_first"), F.explode(F.sequence(low, F.ceil(F.col("_rate") + reach))).alias("_k"))
    k = F.col("_k").cast("double")
    rows = rows.withColumn("_fact", F.sum(F.when(F.col("_k") == F.col("_first"), fact).otherwise(F.log(F.greatest(k, F.lit(1.0))))).over(along))
    p = F.when(F.col("_rate") > 0, F.exp(-F.col("_rate") + k * F.log("_rate") - F.col("_fact"))).otherwise(F.when(F.col("_k") == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("_p", p).withColumn("_f", F.sum("_p").over(along))
    return rows.groupBy("_key", "_first").agg(F.sort_array(F.collect_list(F.struct("_k", "_f"))).alias("_cdf")).select("_key", "_first", F.col("_cdf._f").alias("_cdf"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, stratum: str = "source", id_col: str = "doc_id", temperature: float = TEMPERATURE, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Replicates every row a Poisson-distributed number of times, its source's rate as mean, and shuffles all copies.

    The number is the Poisson distribution inverted at a uniform value hashed from (seed, id): the same document always
    gets the same number, whatever the partitioning. Rows with equal ids get equal numbers; null ids share one value.
    Null sources form one source. Adds copies, copy (from 0) and position: copies are ordered by a hash of
    (seed, id, copy), a global shuffle, numbered gaplessly from 0. Columns of docs stay, whatever their names; those called
    as an added one are replaced. An empty table gives an empty result.
    """
    names = docs.columns
    id_col, stratum = (f"c{names.index(c)}" for c in (id_col, stratum))
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    table = staged(poisson_table(rates(docs, weights, stratum, temperature, epochs)), "rates")
    size = table.agg(F.count(F.lit(1)), F.sum(F.size("_cdf"))).first()
    small = size[0] <= MAX_BROADCAST_RATES and (size[1] or 0) <= MAX_BROADCAST_VALUES
    u = ordered_hash(id_col, seed=seed) / F.lit(float(1 << HASH_BITS))
    drawn = (
        docs.withColumn("_key", source_key(stratum))
        .join(F.broadcast(table) if small else table, "_key")
        .withColumn("_u", u)
        .withColumn("copies", (F.col("_first") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).cast("int"))
        .where("copies > 0")
        .drop("_cdf", "_first", "_u", "_key")
    )
    n = docs.count()
    bins = bins_for(int(n * epochs) + 1)
    copies = (
        drawn.withColumn("_run", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}").cast("int"))))
        .withColumn("copy", F.explode(F.sequence(F.col("_run") * COPIES, F.least((F.col("_run") + 1) * COPIES, "copies") - 1)))
        .drop("_run")
        .withColumn("_h", ordered_hash(id_col, "copy", seed=f"{seed}-order"))
        .withColumn("_bin", F.shiftright("_h", HASH_BITS - (bins.bit_length() - 1)).cast("int"))
    )
    placed = ranked(copies, [], "_bin", ["_h", id_col, "copy"], "position")
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in ADDED], *ADDED)


def op9(spark, sf_dir: str) -> DataFrame:
    """The documents, texts and all, mixed to shares that grow as a source's rows to the power TEMPERATURE; texts as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "source", "copies", "copy", "position", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
