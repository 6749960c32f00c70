"""Mixing sources to target weights, in DataFrame operations only.

Tokens are added up per source, each source gets a repetition rate (target / size), and each document is
taken floor(rate) times plus once more if a hash of its id, read as a uniform number, lies below the fraction
of the rate. Of a few hash seeds each source uses the one whose draws come nearest to its target, which takes
most of the chance out of small sources and of long documents. Reruns agree, as draws depend on the data alone.

Defined cases: a null source is a source of its own, last in order; a null or blank text has size 0 and is
taken 0 times; an empty table gives an empty result; rows that repeat (same doc_id) draw alike, each counted; of seeds that come equally
near the first is used; very long texts are counted whole and taken as any other;
further columns are carried by `mix` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from translatome.llm.common import word_count, written

#: Up to this many sources (a few MB) the rates are broadcast; beyond it documents are salted and joined.
BROADCAST_SOURCES = 20_000
SALTS = 64


def weight_by_rank(rank: Column, weights: tuple[int, ...]) -> Column:
    """Weights in turn over a rank from 0."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, share: float, ceiling: float, weights: tuple[int, ...]) -> DataFrame:
    """Adds target to one row per source (source, source_size).

    target = least(ceiling * size, level * weight), with one level for all sources at which the targets add up
    to share * all sizes: the fixed point of passing on by weight what exceeds a ceiling. Sources are sorted by
    the level at which they reach their ceiling, so that prefix sums give the level. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight_by_rank(F.row_number().over(order) - 1, weights))
        .withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    return (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_weights", F.sum("weight").over(whole))
        .withColumn("own_level", level)
        .withColumn("level", F.max(F.when(F.col("own_level") <= F.col("full_at"), F.col("own_level"))).over(whole))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def _times(size: Column, rate: Column, seed: Column) -> Column:
    """floor(rate), and one more if the hash of seed and doc_id falls below the rate's fraction."""
    uniform = F.shiftrightunsigned(F.xxhash64(seed, F.col("doc_id")), 11) / F.lit(float(1 << 53))
    extra = (uniform < rate - F.floor(rate)).cast("bigint")
    return F.when(size > 0, F.floor(rate) + extra).otherwise(F.lit(0)).cast("bigint")


def _with_rates(sized: DataFrame, rates: DataFrame, few: bool) -> DataFrame:
    """sized with the columns of rates (whose source is _source); few: the sources fit a broadcast."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return sized.join(F.broadcast(rates), same, "left").drop("_source")
    there = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_size"), F.lit(SALTS)))
    return salted.join(rates.withColumn("_there", there), same & (F.col("_salt") == F.col("_there")), "left").drop("_salt", "_there", "_source")


def planned(docs: DataFrame, **how) -> DataFrame:
    """docs with _size, _source_size, _target and _times (how often the mix takes the row)."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    return _planned(sized, written(sized.select("doc_id", "source", "_size"), "sizes"), **how)


def planned_sizes(docs: DataFrame, **how) -> DataFrame:
    """The same without the texts, which are read once: doc_id, source, _size, _source_size, _target and _times."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size")), "sizes")
    return _planned(sized, sized, **how)


def _planned(
    rows: DataFrame,
    sized: DataFrame,
    share: float = 1.5,
    ceiling: float = 2.0,
    weights: tuple[int, ...] = (5, 2, 1),
    seeds: tuple[int, ...] = tuple(range(1, 33)),
) -> DataFrame:
    """rows, planned by the sizes of all of them (sized: doc_id, source, _size)."""
    sizes = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    rates = written(source_targets(sizes, share, ceiling, weights), "rates").select(
        F.col("source").alias("_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    )
    few = rates.count() <= BROADCAST_SOURCES
    drawn = _with_rates(sized, rates, few)
    misses = [
        F.abs(F.sum(F.col("_size") * _times(F.col("_size"), F.col("_rate"), F.lit(k))) - F.first("_target")) for k in seeds
    ]
    nearest = drawn.groupBy("source").agg(F.array(*misses).alias("misses"))
    best = F.element_at(F.array(*[F.lit(k) for k in seeds]), F.array_position("misses", F.array_min("misses")).cast("int"))
    seeded = rates.join(
        nearest.select(F.col("source").alias("_of"), best.alias("_seed")), F.col("_source").eqNullSafe(F.col("_of"))
    ).drop("_of")
    joined = _with_rates(rows, written(seeded, "seeds"), few)
    return joined.withColumn("_times", _times(F.col("_size"), F.col("_rate"), F.col("_seed"))).drop("_rate", "_seed")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, with the columns of docs."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    copies = F.explode(F.expr("if(_times > 0, sequence(1, _times), cast(array() as array<bigint>))"))
    return planned(rows, **how).withColumn("_copy", copies).select("row.*")
