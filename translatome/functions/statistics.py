"""Statistics as expressions and grouped operators that never gather a group in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from translatome.functions import ordered


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null where undefined."""
    return F.when(bottom != 0, top / bottom)


def entropy_bits(counts: list[Column]) -> Column:
    """Shannon entropy of a few counts; empty classes add nothing."""
    total = reduce(lambda a, b: a + b, counts)
    part = lambda n: F.when((n > 0) & (total > 0), -(n / total) * F.log2(n / total)).otherwise(0.0)
    return F.when(total > 0, reduce(lambda a, b: a + b, [part(n) for n in counts]))


def quantiles_type8(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], total: str | None = None) -> DataFrame:
    """Median-unbiased quantiles (Hyndman and Fan's type 8) of value in each group.

    Equal values are counted first (with partial aggregation), so that the ordered pass sees one row for each
    distinct value; it is dealt out by ranges of values, so that a group may have any size. `total` names a column of group sizes to return.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counted = ordered.ranged(counted, keys, [value])
    ranked = ordered.running(counted, keys, [value], {"_hi": ("sum", F.col("_c"))}, {"_n": F.col("_c")})
    aggregates = []
    for name, p in wanted.items():
        t = F.lit(1 / 3) + F.lit(p) * (F.col("_n") + F.lit(1 / 3))
        j = F.floor(t + F.lit(4 * 2.220446049250313e-16))
        h = t - j
        h = F.when(F.abs(h) < 4 * 2.220446049250313e-16, 0.0).otherwise(h)
        at = [F.least(F.greatest(j + k, F.lit(1)), F.col("_n")) for k in (0, 1)]
        pick = [F.max(F.when((F.col("_hi") - F.col("_c") < a) & (a <= F.col("_hi")), F.col(value))) for a in at]
        aggregates.append(((1 - F.max(h)) * pick[0] + F.max(h) * pick[1]).alias(name))
    if total:
        aggregates.append(F.max("_n").alias(total))
    return ranked.groupBy(*keys).agg(*aggregates)


def mid_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per distinct value of a group (of all rows without keys): value, its count, upto (rows up to it) and its mid-rank."""
    counted = ordered.ranged(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties")), keys, [value])
    upto = ordered.running(counted, keys, [value], {"upto": ("sum", F.col("ties"))}).drop(ordered.BLOCK)
    return upto.withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2)


def values_at_ranks(ranked: DataFrame, targets: DataFrame, value: str, stretch: int = 4096) -> DataFrame:
    """targets (with rank, 1 for the least) and the value at each rank; ranked: value, ties, upto (as of mid_ranks without keys).

    Each value is dealt to the stretches of ranks that it takes up: one for each value and one for each `stretch` rows, and a target
    meets those of its stretch.
    """
    first = F.floor((F.col("upto") - F.col("ties")) / stretch)
    dealt = ranked.select(F.col(value), "upto", "ties", F.explode(F.sequence(first, F.floor((F.col("upto") - 1) / stretch))).alias("_stretch"))
    inside = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("ties"))
    own = targets.withColumn("_stretch", F.floor((F.col("rank") - 1) / stretch))
    return own.join(dealt, "_stretch").filter(inside).drop("_stretch", "upto", "ties")


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, by Abramowitz and Stegun's formula 26.2.17 (error below 7.5e-8)."""
    #: Fixed values of the formula.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + F.lit(p) * z)
    series = reduce(lambda s, c: F.lit(c) + s * t, reversed(b), F.lit(0.0)) * t
    return F.exp(-z * z / 2) / F.lit(2.5066282746310002) * series


def l2_normalized(values: Column) -> Column:
    """Unit vector of an array of numbers; all zeros stay zeros."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    # the norm beside each value: inside the function it would be worked out again for each of them
    return F.zip_with(values, F.array_repeat(norm, F.size(values)), lambda x, n: F.when(n > 0, x / n).otherwise(0.0))
