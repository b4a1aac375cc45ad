"""False-discovery-rate control by levels.

P-values are first counted by distinct value. Ranks and minima over these levels are carried from range to range of the
global order, so a family may have any number of distinct p-values; no task holds a family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import harmonic
from veldt.operators import ranges
from veldt.sources.shared import cut


def levels(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """family, p, k, m, q_bh, q_by: one row a distinct p of a family; null p take no part."""
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*family, F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("k"))
    ranked = ranges.running_sum(ranges.by_ranges(counts, family, "p"), family, "k", "rank", "m")
    raw = ranked.withColumn("raw", F.col("p") * F.col("m") / F.col("rank"))
    bh = ranges.suffix_min(raw, family, "raw", "low").withColumn("q_bh", F.least(F.lit(1.0), "low"))
    return ranges.settled(bh.withColumn("q_by", F.least(F.lit(1.0), F.col("low") * harmonic(F.col("m")))).drop("raw", "low", "rank"))


def adjust(tests: DataFrame, family: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests with q_bh, q_by and the two-stage q_bky; null p stay null."""
    lv = cut(levels(tests, family, p))
    strict = alpha / (1 + alpha)
    first = lv.groupBy(*[F.col(c).alias(f"f{i}") for i, c in enumerate(family)]).agg(F.sum(F.when(F.col("q_bh") <= strict, F.col("k")).otherwise(0)).alias("r1"))
    lv = lv.join(first, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"f{i}")) for i, c in enumerate(family)])).withColumn("q_bky", F.least(F.lit(1.0), F.col("q_bh") * F.greatest(F.lit(1), F.col("m") - F.col("r1")) / F.col("m")))
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}")) for c in family] + [F.col(f"t.{p}") == F.col("l.p")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return tests.alias("t").join(lv.alias("l"), cond, "left").select("t.*", "l.q_bh", "l.q_by", "l.q_bky")


def discrete(counts: DataFrame, draws: int) -> DataFrame:
    """k, n -> k, n, p, q_bh, q_by with p = (1 + k) / (draws + 1); at most draws + 1 rows."""
    tests = counts.withColumn("p", (1 + F.col("k")) / F.lit(float(draws + 1)))
    whole = Window.partitionBy(F.lit(1))
    up, down = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), whole.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    out = tests.withColumn("m", F.sum("n").over(whole)).withColumn("raw", F.col("p") * F.col("m") / F.sum("n").over(up))
    out = out.withColumn("low", F.min("raw").over(down))
    return out.select("k", "n", "p", F.least(F.lit(1.0), "low").alias("q_bh"), F.least(F.lit(1.0), F.col("low") * harmonic(F.col("m"))).alias("q_by"))
