"""Deterministic reads, transcripts, sites and sequences over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment for each event: read_ord, ref, pos, len, strand, nh, tag, blocks."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("read_ord"),
        (e % 50).alias("ref"),
        F.round(F.col("value") * 100).cast("bigint").alias("pos"),
        (24 + e % 13).alias("len"),
        F.when(e % 2 == 0, "+").otherwise("-").alias("strand"),
        (1 + e % 3).alias("nh"),
        F.col("event_type").alias("tag"),
    ).withColumn("blocks", F.array(F.struct(F.col("pos").alias("start"), F.col("len").alias("len"))))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-exon transcript for each part: trx_id, gene_id, ref, strand, blocks, cds_start, cds_len."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    block = F.floor(p / 100)
    g = block * 50 + p % 50
    s0 = (g * g * 31 + g * 977) % 12000
    l0 = 200 + 4 * size
    return table(spark, sf_dir, "part").select(
        p.alias("trx_id"),
        g.alias("gene_id"),
        (p % 50).alias("ref"),
        F.when(block % 2 == 0, "+").otherwise("-").alias("strand"),
        F.array(
            F.struct(s0.alias("start"), l0.alias("len")),
            F.struct((s0 + l0 + 50 + size).alias("start"), F.lit(300).cast("bigint").alias("len")),
        ).alias("blocks"),
        F.when(size % 7 == 0, None).otherwise(F.lit(60)).cast("bigint").alias("cds_start"),
        F.when(size % 7 == 0, None).otherwise(3 * (40 + size)).cast("bigint").alias("cds_len"),
    )


def asites(spark: SparkSession) -> DataFrame:
    """A-site offset of each read length from 26 to 34: half the length."""
    return spark.range(26, 35).select(F.col("id").alias("read_len"), F.floor(F.col("id") / 2).alias("delta"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DNA sequence for each benchmark item: item_id, seq."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"),
    )


def thousandths(x: Column) -> Column:
    """Whole thousandths of a 4-byte number, as a double; the product is rounded to 4 bytes first, as x * 1000 is in SQL."""
    return F.round(x * F.lit(1000).cast("float")).cast("double")


#: The same views for DuckDB; each is one entry of a WITH clause.
READS = """reads AS (SELECT CAST(event_id AS BIGINT) AS read_ord, CAST(event_id % 50 AS BIGINT) AS ref,
 CAST(round(value * 100) AS BIGINT) AS pos, CAST(24 + event_id % 13 AS BIGINT) AS len,
 CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(1 + event_id % 3 AS BIGINT) AS nh, event_type AS tag FROM events)"""
TRX = """trx0 AS (SELECT CAST(p_partkey AS BIGINT) AS trx_id, CAST((p_partkey // 100) * 50 + p_partkey % 50 AS BIGINT) AS gene_id,
 CAST(p_partkey % 50 AS BIGINT) AS ref, CASE WHEN (p_partkey // 100) % 2 = 0 THEN '+' ELSE '-' END AS strand,
 CAST(p_size AS BIGINT) AS size FROM part),
trx AS (SELECT trx_id, gene_id, ref, strand, (gene_id * gene_id * 31 + gene_id * 977) % 12000 AS s0, 200 + 4 * size AS l0,
 (gene_id * gene_id * 31 + gene_id * 977) % 12000 + 200 + 4 * size + 50 + size AS s1, 300 AS l1, 500 + 4 * size AS total,
 CASE WHEN size % 7 = 0 THEN NULL ELSE 60 END AS cds_start, CASE WHEN size % 7 = 0 THEN NULL ELSE 3 * (40 + size) END AS cds_len FROM trx0)"""
ASITES = "asites AS (SELECT range AS read_len, range // 2 AS delta FROM range(26, 35))"
DNA = """dna AS (SELECT CAST(item_id AS BIGINT) AS item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'),
 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark)"""


def placed(margin: int) -> str:
    """Pairs of a read and a transcript of its strand that it fits into; lo is the coordinate of its 5' base."""
    return f"""placed AS (SELECT r.read_ord, r.ref, r.pos, r.len, r.nh, r.tag, t.trx_id, t.gene_id, t.total, t.cds_start, t.cds_len, t.strand,
 CASE WHEN t.strand = '+' THEN CASE WHEN r.pos + r.len <= t.s0 + t.l0 THEN r.pos - t.s0 ELSE t.l0 + r.pos - t.s1 END
 ELSE t.total - 1 - CASE WHEN r.pos + r.len <= t.s0 + t.l0 THEN r.pos + r.len - 1 - t.s0 ELSE t.l0 + r.pos + r.len - 1 - t.s1 END END AS lo
 FROM reads r JOIN trx t ON r.ref = t.ref AND r.strand = t.strand
 AND ((r.pos >= t.s0 - {margin} AND r.pos + r.len <= t.s0 + t.l0) OR (r.pos >= t.s1 AND r.pos + r.len <= t.s1 + t.l1 + {margin})))"""
