"""Interval joins as equi-joins on bins of several sizes.

A pure range predicate would be planned as a nested loop. Both sides are dealt to the bins that they touch, joined on (keys, level, bin),
and a pair is kept only in the later of the two first bins, so it appears once. Skewed bins are split by the adaptive join; smaller bins
spread a hot reference further.

Bins are of `bin_size` bases and, level by level, STEP times wider. A span belongs to the level where it touches STEP + 1 bins at most, so a gene of
megabases is some 60 rows, not thousands. A pair meets at the higher of its two levels: a side's rows are dealt to their own level and to those
above it that the other side may be on. Which levels there are is told by the right side, the smaller one (by both where the left is an annotation,
too): without long spans there, there is one level and nothing is dealt twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN, STEP, LEVELS = 1000, 64, 4


def level_of(start: Column, end: Column, size: int, top: int = LEVELS - 1) -> Column:
    """The level of a span: the first one where it is no longer than STEP bins."""
    out = F.lit(top)
    for k in reversed(range(top)):
        out = F.when(end - start <= size * STEP ** (k + 1), k).otherwise(out)
    return out


def _dealt(df: DataFrame, start: str, end: str, size: int, levels: list[int], name: str) -> DataFrame:
    """df at the levels that are its own or above: _level, _bin, the first bin there and its own level (name is put to both)."""
    a, b = F.col(start), F.greatest(F.col(end), F.col(start) + 1)
    own = level_of(a, b, size, max(levels))
    if levels == [0]:
        one = df.withColumns({"_level": F.lit(0), f"_level_{name}": F.lit(0)})
    else:
        at = F.filter(F.lit(levels), lambda k: k >= F.col(f"_level_{name}"))
        one = df.withColumn(f"_level_{name}", own).withColumn("_level", F.explode(F.array_union(F.array(f"_level_{name}"), at)))
    width = F.lit(float(size)) * F.pow(F.lit(float(STEP)), F.col("_level")) if levels != [0] else F.lit(size)
    first, last = F.floor(a / width), F.floor((b - 1) / width)
    return one.withColumn(f"_first_{name}", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int = BIN,
    extra: Column | None = None, long_left: bool = False,
) -> DataFrame:
    """Pairs on equal keys whose half-open spans overlap. Columns other than keys must have distinct names.

    With long_left, the levels of left are looked up too, so that its long spans are few rows even if right's are short.
    """
    level = lambda s: level_of(F.col(s[0]), F.greatest(F.col(s[1]), F.col(s[0]) + 1), bin_size).alias("level")
    asked = right.select(level(right_span))
    if long_left:
        asked = asked.union(left.select(level(left_span)))
    seen = {r[0] for r in asked.distinct().collect()} - {None}  # LEVELS at most
    top = max(seen, default=0)
    a = _dealt(left, *left_span, bin_size, sorted(seen | {top}), "a")
    b = _dealt(right, *right_span, bin_size, list(range(top + 1)), "b")
    touch = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    once = (F.col("_bin") == F.greatest("_first_a", "_first_b")) & (F.col("_level") == F.greatest("_level_a", "_level_b"))
    joined = a.join(b.hint("merge"), [*keys, "_level", "_bin"]).filter(touch & once)  # b is larger than its files tell: never broadcast it
    if extra is not None:
        joined = joined.filter(extra)
    return joined.drop("_level", "_bin", "_first_a", "_first_b", "_level_a", "_level_b")


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Rows of left that overlap nothing of right. Equal spans of either side meet once."""
    hits = overlap_join(
        left.select(*keys, F.col(left_span[0]).alias("_ls"), F.col(left_span[1]).alias("_le")).distinct(),
        right.select(*keys, F.col(right_span[0]).alias("_rs"), F.col(right_span[1]).alias("_re")).distinct(),
        keys, ("_ls", "_le"), ("_rs", "_re"), bin_size, long_left=True,
    ).select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_ls", "_le").distinct()
    same = (F.col(left_span[0]) == F.col("_ls")) & (F.col(left_span[1]) == F.col("_le"))
    for k in keys:
        same &= F.col(k) == F.col(f"_of_{k}")
    return left.join(hits, same, "left_anti")


def first_offenders(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], order: list[str], bin_size: int = BIN
) -> DataFrame:
    """Rows of left that overlap anything of right, with the first one there by `order` (columns of right) as the struct offender.

    What without_overlap leaves out, and why; rows of left that repeat are one. Equal spans meet once: of those of right the first one does.
    """
    spans = left.select(*keys, F.col(left_span[0]).alias("_ls"), F.col(left_span[1]).alias("_le")).distinct()
    others = right.select(*keys, F.struct(*order).alias("_offender"), F.col(right_span[0]).alias("_rs"), F.col(right_span[1]).alias("_re"))
    firsts = others.groupBy(*keys, "_rs", "_re").agg(F.min("_offender").alias("_offender"))
    pairs = overlap_join(spans, firsts, keys, ("_ls", "_le"), ("_rs", "_re"), bin_size, long_left=True)
    found = pairs.groupBy(*keys, "_ls", "_le").agg(F.min("_offender").alias("offender"))
    found = found.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_ls", "_le", "offender")
    same = (F.col(left_span[0]) == F.col("_ls")) & (F.col(left_span[1]) == F.col("_le"))
    for k in keys:
        same &= F.col(k) == F.col(f"_of_{k}")
    return left.distinct().join(found, same).select(*left.columns, "offender")
