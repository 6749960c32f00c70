"""Read-length distributions: histograms, distances and winsorizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from translatome.functions.statistics import quantiles_type8

#: The last bin takes all longer reads.
LAST = 51


def histogram(reads: DataFrame, keys: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """keys, bin, n over observed lengths; weight: a column that says how many reads a row is."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return reads.groupBy(*keys, F.least(F.col("len"), F.lit(LAST)).alias("bin")).agg(n.alias("n"))


def cumulative(counts: DataFrame) -> DataFrame:
    """All bins 0 .. LAST with n, fract and the share of shorter reads."""
    grid = counts.sparkSession.range(LAST + 1).withColumnRenamed("id", "bin")
    full = grid.join(counts, "bin", "left").na.fill(0)
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 52 rows
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("n").over(whole)
    return full.select("bin", "n", (F.col("n") / total).alias("fract"), (F.coalesce(F.sum("n").over(below), F.lit(0)) / total).alias("below"))


def distances(counts: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """keys, l1 (total variation) and l2 of each group's distribution from the reference's; bins that are missing count as 0."""
    group = Window.partitionBy(*keys)
    own = counts.withColumn("p", F.col("n") / F.sum("n").over(group)).select(*keys, "bin", "p")
    total = reference.agg(F.sum("n").alias("t"))
    other = reference.crossJoin(F.broadcast(total)).select("bin", (F.col("n") / F.col("t")).alias("q"))
    grid = own.select(*keys).distinct().crossJoin(F.broadcast(other))  # at most LAST + 1 bins for each group
    both = grid.join(own, [*keys, "bin"], "left").withColumn("d", F.coalesce("p", F.lit(0.0)) - F.col("q"))
    extra = own.join(F.broadcast(other), "bin", "left_anti").select(*keys, F.col("p").alias("d"))
    return both.select(*keys, "d").union(extra).groupBy(*keys).agg((F.sum(F.abs("d")) / 2).alias("l1"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"))


def winsorized(by_position: DataFrame, keys: list[str], at: str, positions: DataFrame) -> DataFrame:
    """keys, q95, bin, n: position totals above w = max(95 % quantile of all positions, 1) are scaled down to w.

    by_position: keys, at, bin, n; positions: keys, n_positions (positions without reads count for the quantile).
    """
    totals = by_position.groupBy(*keys, at).agg(F.sum("n").alias("ttl"))
    empty = positions.join(totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("hit")), keys, "left")
    zeros = empty.select(*keys, (F.col("n_positions") - F.coalesce("hit", F.lit(0))).alias("c"), F.lit(0).cast("bigint").alias("ttl")).filter("c > 0")
    q95 = _weighted_quantile(totals.groupBy(*keys, "ttl").agg(F.count(F.lit(1)).alias("c")).unionByName(zeros), keys)
    scaled = by_position.join(totals, [*keys, at]).join(q95, keys)
    limit = F.greatest("q95", F.lit(1.0))
    share = F.when(F.col("ttl") > limit, F.col("n") * limit / F.col("ttl")).otherwise(F.col("n").cast("double"))
    return scaled.groupBy(*keys, "q95", "bin").agg(F.sum(share).alias("n"))


def _weighted_quantile(counted: DataFrame, keys: list[str]) -> DataFrame:
    """95 % quantile (type 8) of values ttl that occur c times each."""
    group = Window.partitionBy(*keys)
    ranked = counted.withColumn("hi", F.sum("c").over(group.orderBy("ttl").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(group))
    t = F.lit(1 / 3) + F.lit(0.95) * (F.col("all") + F.lit(1 / 3))
    j, h = F.floor(t), t - F.floor(t)
    at = [F.least(F.greatest(j + k, F.lit(1)), F.col("all")) for k in (0, 1)]
    x = [F.max(F.when((F.col("hi") - F.col("c") < a) & (a <= F.col("hi")), F.col("ttl"))) for a in at]
    return ranked.groupBy(*keys).agg(((1 - F.max(h)) * x[0] + F.max(h) * x[1]).alias("q95"))


__all__ = ["LAST", "cumulative", "distances", "histogram", "quantiles_type8", "winsorized"]
