"""Scalar expressions shared by the operators: missing values, guarded division, the normal tail, keyed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The missing-value mark and the smallest denominator of a ratio.
SENTINEL, MIN_DENOM = -9999.0, 1e-6
#: Two-sided 90, 95 and 99 % points of the normal distribution.
Z90, Z95, Z99 = 1.6448536269514722, 1.959963984540054, 2.5758293035489004


def finite(v: Column) -> Column:
    """Neither null, NaN, infinite nor the missing-value mark."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)) & (v != SENTINEL)


def clean(v: Column) -> Column:
    return F.when(finite(v), v)


def ratio(a: Column, b: Column, least: float = MIN_DENOM) -> Column:
    """a / b, null where the denominator is not above ``least``."""
    return F.when(b > least, a / b)


def two_sided(z: Column) -> Column:
    """2 P(Z > |z|) by the series of the error function; exact to about 1e-15 up to |z| = 8, where it ends at 0."""
    x = F.abs(z) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * x * x / (2 * n + 1).cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step, lambda acc: acc["total"])
    return F.when(F.abs(z) > 8, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x * x) * total))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m."""
    return F.when(m < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long")), F.lit(0.0), lambda s, i: s + 1.0 / i.cast("double")))


def draw(*parts: Column | str | int) -> Column:
    """A number below 2^32 that depends on its key alone, not on partitions or order."""
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def block_id(x: Column, y: Column, size: float, ox: float = 0.0, oy: float = 0.0) -> Column:
    return F.concat_ws("_", F.floor((x - ox) / size), F.floor((y - oy) / size))


def hinge(t: Column, at: Column) -> Column:
    return F.greatest(F.lit(0.0), (t - at).cast("double"))


def normalised_difference(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return (a - b) / (a + b + eps)


def bits_clear(qa: Column, mask: int) -> Column:
    return qa.bitwiseAND(mask) == 0
