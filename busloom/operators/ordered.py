"""Running sums and row numbers along an order, of groups of any size: no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators import exact
from busloom.sources import sinks

#: Parts of a group's order; accuracy of the quantiles that part it, which matters for balance only.
PARTS, ACCURACY = 64, 1000


def running(steps: DataFrame, group: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, for each out: column of sums, the sum of column over the group's rows up to value and with it.

    A group's values (not null) are parted at approximate quantiles; the parts' sums are added up along the group, and a window
    orders each part alone. Equal values lie in one part. The rows are written first, as they are read three times.
    """
    steps = _written(steps)
    order = F.desc(value) if descending else F.asc(value)
    edges = steps.groupBy(*group).agg(F.percentile_approx(value, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), ACCURACY).alias("_edges"))
    dealt = steps.join(edges, group).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    along = Window.partitionBy(*group).orderBy(F.desc("_part") if descending else F.asc("_part"))
    parts = dealt.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
    before = parts.select(*group, "_part", *[(F.sum(f"_s_{o}").over(along) - F.col(f"_s_{o}")).alias(f"_b_{o}") for o in sums])
    within = Window.partitionBy(*group, "_part").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(before, [*group, "_part"])
    return out.withColumns({o: F.col(f"_b_{o}") + F.sum(c).over(within) for o, c in sums.items()}).drop("_part", *[f"_b_{o}" for o in sums])


def numbered(rows: DataFrame, group: list[str], order_hash: Column, key: list[str], out: str) -> DataFrame:
    """Adds out: the row's number from 1 within its group, by a hash's hex digits, then key.

    Parts are the hash's first two digits; only their counts are added up along a group.
    """
    dealt = rows.withColumn("_hash", order_hash).withColumn("_part", F.substring("_hash", 1, 2))
    along = Window.partitionBy(*group).orderBy("_part")
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(*group, "_part", (F.sum("_c").over(along) - F.col("_c")).alias("_before"))
    within = Window.partitionBy(*group, "_part").orderBy("_hash", *key)
    return dealt.join(before, [*group, "_part"]).withColumn(out, F.col("_before") + F.row_number().over(within)).drop("_hash", "_part", "_before")


def quantiles(rows: DataFrame, group: list[str], value: str, probabilities: list[float], out: str) -> DataFrame:
    """(group, out): an array of the exact quantiles of value, linear between neighbours as percentile has them; nulls don't count.

    Each is read off at its rank among running counts of distinct values, for all groups and probabilities at once; no
    group's values meet in one buffer. Groups without a value have no row.
    """
    steps = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    counted = _written(running(steps, group, value, {"_upto": "_c"}))
    sizes = counted.groupBy(*group).agg(F.max("_upto").alias("_n"))
    at = [(F.col("_n") - 1) * p for p in probabilities]
    reached = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    ends = counted.join(sizes, group).groupBy(*group, "_n").agg(*[reached(end(x)).alias(f"_{k}{i}") for i, x in enumerate(at) for end, k in ((F.floor, "l"), (F.ceil, "h"))])
    between = [exact.between(F.col(f"_l{i}").cast("double"), F.col(f"_h{i}").cast("double"), x - F.floor(x)) for i, x in enumerate(at)]
    return ends.select(*group, F.array(*between).alias(out))


def _written(rows: DataFrame) -> DataFrame:
    path = sinks.scratch(rows.sparkSession, "ordered")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
