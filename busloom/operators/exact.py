"""Sums, deviations, quantiles and rounding whose every bit follows from the rows' order, as the SQL twins compute them.

Scores divide by small scales, and shares of whole numbers lie on ties of the sixth place, so last bits decide what is shown.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from busloom.settings import EPS


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def rounded(c: Column, digits: int) -> Column:
    """c * 10**digits to the nearest whole number, halves away from 0, over 10**digits; what leaves the range of doubles stays."""
    unit = float(10**digits)

    def places(x: Column) -> Column:
        near = F.rint(x * unit)
        whole = F.when(F.abs(x * unit - near) == 0.5, x * unit + F.signum(x) * 0.5).otherwise(near)
        return F.when(F.abs(x * unit) < F.lit(float("inf")), whole / unit + F.lit(0.0)).otherwise(x)

    return let(c, places)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with the product's rounding error added (Dekker's product and Knuth's sum), as a fused multiply-add gives it."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p = a * b
    error = ((high(a) * high(b) - p) + high(a) * (b - high(b)) + (a - high(a)) * high(b)) + (a - high(a)) * (b - high(b))
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))
    return F.when(F.abs(s) < 1e290, s + (rest + error)).otherwise(s)


def between(low: Column, high: Column, part: Column) -> Column:
    """The value at the share part of the way from low to high."""
    return F.when(part == 0, low).otherwise(fused(low, 1 - part, high * part))


def quantile(ascending: Column, p: float) -> Column:
    """Of an ascending array without nulls; null of an empty one."""
    at = (F.size(ascending) - 1) * F.lit(p)
    ends = F.struct(F.get(ascending, F.floor(at).cast("int")).alias("l"), F.get(ascending, F.ceil(at).cast("int")).alias("h"), (at - F.floor(at)).alias("d"))
    return F.when(F.size(ascending) > 0, let(ends, lambda e: between(e["l"], e["h"], e["d"])))


def moments(values: Column) -> Column:
    """(n, total, mean, sd) of an array's values, nulls left out, added up in its order; sd is the population's (Welford)."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def add(a: Column, x: Column) -> Column:
        return let(
            F.struct((a["n"] + 1).alias("n"), (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m")),
            lambda s: F.struct(s["n"].alias("n"), (a["total"] + x).alias("total"), s["m"].alias("m"), (a["q"] + (x - a["m"]) * (x - s["m"])).alias("q")),
        )

    some = lambda a, x: F.when(a["n"] > 0, x)
    out = lambda a: F.struct(a["n"].alias("n"), some(a, a["total"]).alias("total"), some(a, a["total"] / a["n"]).alias("mean"), some(a, F.sqrt(a["q"] / a["n"])).alias("sd"))
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), start, add, out)


def bits_of(count: int, of: int) -> float:
    """-p log2(p + EPS) at p = count / of. A number of the driver, as engines' logarithms differ in the last place."""
    return -(count / of) * math.log2(count / of + EPS)


def bits(count: Column, of: int) -> Column:
    """bits_of counts of 0 to `of`, read off a table."""
    return F.get(F.array(*[F.lit(bits_of(i, of)) for i in range(of + 1)]), count.cast("int"))


def log2(count: Column, most: int) -> Column:
    """log2(count + EPS) of counts of 0 to `most`, read off a table."""
    return F.get(F.array(*[F.lit(math.log2(i + EPS)) for i in range(most + 1)]), count.cast("int"))
