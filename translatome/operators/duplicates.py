"""Duplicate suppression by site and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE = ["ref", "pos", "strand"]
#: The site of a spliced or clipped alignment; pass it as site where rows have a cigar.
ALIGNED_SITE = [*SITE, "cigar"]


def umi_tag(name: Column) -> Column:
    """What a read name has from its first #; empty without one or if the name starts with it."""
    at = F.instr(name, "#")
    return F.when(at > 1, F.substr(name, at, F.length(name))).otherwise(F.lit(""))


def tag_groups(reads: DataFrame, site: list[str] = SITE, consecutive: bool = False) -> DataFrame:
    """Adds group_first (the read_ord that stands for the read's tag group) and group_size.

    Reads of a site with the same non-empty tag are one group; with consecutive, only reads that follow one another at a
    site (by read_ord). Untagged reads and reads with a null site field are groups of their own.
    """
    known = F.lit(True)
    for c in site:
        known &= F.col(c).isNotNull()
    alone = (F.coalesce(F.col("tag"), F.lit("")) == "") | ~known
    own = F.when(alone, F.col("read_ord"))
    if not consecutive:
        group = Window.partitionBy(*site, "tag", own)
        return reads.withColumn("group_first", F.min("read_ord").over(group)).withColumn("group_size", F.count(F.lit(1)).over(group))
    order = Window.partitionBy(*site).orderBy("read_ord")
    starts = alone | F.coalesce(F.lag("tag").over(order) != F.col("tag"), F.lit(True))
    run = F.max(F.when(starts, F.col("read_ord"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = reads.withColumn("group_first", F.when(alone, F.col("read_ord")).otherwise(run))
    return marked.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(*site, "group_first")))


def site_counts(grouped: DataFrame, site: list[str] = SITE) -> DataFrame:
    """total reads and unique groups of each site."""
    return grouped.groupBy(*site).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("group_first") == F.col("read_ord"), 1).otherwise(0)).alias("unique")
    )


def site_histogram(sites: DataFrame) -> DataFrame:
    """Number of sites by (total, unique)."""
    return sites.groupBy("total", "unique").agg(F.count(F.lit(1)).alias("n_sites"))


def totals(sites: DataFrame) -> DataFrame:
    """Reads, duplicates, sites, and sites with duplicates."""
    return sites.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("n_reads"),
        F.coalesce(F.sum(F.col("total") - F.col("unique")), F.lit(0)).alias("n_dups"),
        F.count(F.lit(1)).alias("n_sites"),
        F.coalesce(F.sum(F.when(F.col("total") > F.col("unique"), 1).otherwise(0)), F.lit(0)).alias("n_dup_sites"),
    )
