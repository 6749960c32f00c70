"""Running values along an order in two levels: within blocks of the order, and carried from block to block.

A window over a group takes the whole group into one task. Here windows are over blocks: ranges of positions that the caller names, or
ranges that Spark deals out by sampling. What is carried is one row for each block of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from translatome.sources import folders

BLOCK = "_block"


def ranged(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df with _block, ranges of (keys, order) that one task sorts; written, so that all that follows sees the same ranges.

    Rows that tie in all of these fall into one range: reduce them first.
    """
    spark = df.sparkSession
    folder = folders.fresh(spark, "ranges")
    dealt = df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id())
    dealt.write.parquet(folder)
    return spark.read.schema(dealt.schema).parquet(folder)


def _joined(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their block; null keys are a group."""
    own = [*keys, BLOCK]
    other = blocks.select(*(F.col(k).alias(f"_of_{k}") for k in own), *(c for c in blocks.columns if c not in own))
    same = F.lit(True)
    for k in own:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}")) if k != BLOCK else F.col(k) == F.col(f"_of_{k}")
    return rows.join(other, same, "left").drop(*(f"_of_{k}" for k in own))


def running(
    df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, tuple[str, Column]],
    totals: dict[str, Column] | None = None, beside: dict[str, tuple[str, bool]] | None = None,
) -> DataFrame:
    """df (with _block, which follows the order) and for each name of values the running "sum" or "max" of a column in its group, its own row included.

    totals are sums over the whole group. beside are (column, back): the column's next value in the group (or, back, the one before), null at the end;
    df must be in order of such columns.
    """
    totals, beside = totals or {}, beside or {}
    own, blocks = Window.partitionBy(*keys, BLOCK).orderBy(*order), Window.partitionBy(*keys)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    earlier = blocks.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    of = {"sum": F.sum, "max": F.max}
    each = df.groupBy(*keys, BLOCK).agg(
        *(of[kind](c).alias(f"_all_{n}") for n, (kind, c) in values.items()),
        *(F.sum(c).alias(f"_all_{n}") for n, c in totals.items()),
        *((F.max if back else F.min)(at).alias(f"_end_{n}") for n, (at, back) in beside.items()),
    )
    carried = each.select(
        *keys, BLOCK,
        *(of[kind](f"_all_{n}").over(earlier).alias(f"_before_{n}") for n, (kind, _) in values.items()),
        *(F.sum(f"_all_{n}").over(blocks).alias(n) for n in totals),
        *((F.lag if back else F.lead)(f"_end_{n}").over(blocks.orderBy(BLOCK)).alias(f"_beside_{n}") for n, (_, back) in beside.items()),
    )
    within = {n: of[kind](c).over(upto) for n, (kind, c) in values.items()} | {n: (F.lag if back else F.lead)(at).over(own) for n, (at, back) in beside.items()}
    rows = _joined(df.withColumns(within), carried, keys)
    plus = lambda n: F.coalesce(F.col(n) + F.col(f"_before_{n}"), F.col(n), F.col(f"_before_{n}"))
    both = {n: plus(n) if kind == "sum" else F.greatest(F.col(n), F.col(f"_before_{n}")) for n, (kind, _) in values.items()}
    both |= {n: F.coalesce(F.col(n), F.col(f"_beside_{n}")) for n in beside}
    return rows.withColumns(both).drop(*(f"_before_{n}" for n in values), *(f"_beside_{n}" for n in beside))


def blocked(df: DataFrame, at: str, size: int = 1 << 16) -> DataFrame:
    """df with _block: stretches of `size` positions. A group has as many as its reference has stretches, however many rows it has."""
    return df.withColumn(BLOCK, F.floor(F.col(at) / size))
