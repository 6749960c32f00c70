"""Alignments: SAM text and BAM files in and out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.sources.bam import MOST_REGIONS, BamSource

#: Fixed values of the format: flag bits.
UNMAPPED, REVERSE = 4, 16


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Blocks on the reference: M, =, X and D stay in a block, N starts the next one, I, S, H and P use no reference."""
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,len:bigint>>")
    zero = F.lit(0).cast("bigint")

    def step(s: Column, op: Column) -> Column:
        n = F.substr(op, F.lit(1), F.length(op) - 1).cast("bigint")
        kind = F.substr(op, F.length(op), F.lit(1))
        skip, uses = kind == "N", kind.isin("M", "=", "X", "D")
        done = F.when(skip & (s["len"] > 0), F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["len"].alias("len"))))).otherwise(s["out"])
        return F.struct(
            F.when(skip, s["start"] + s["len"] + n).otherwise(s["start"]).alias("start"),
            F.when(skip, zero).when(uses, s["len"] + n).otherwise(s["len"]).alias("len"),
            done.alias("out"),
        )

    start = F.struct(pos.cast("bigint").alias("start"), zero.alias("len"), empty.alias("out"))
    end = lambda s: F.when(s["len"] > 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["len"].alias("len"))))).otherwise(s["out"])
    return F.aggregate(ops, start, step, end)


def with_derived(df: DataFrame) -> DataFrame:
    """Adds is_reverse, strand, blocks, nh, hi, nm and len to rows of bam.FIELDS; unmapped rows have null blocks."""
    mapped = (F.col("flag").bitwiseAND(UNMAPPED) == 0) & F.col("pos").isNotNull()
    reverse = F.col("flag").bitwiseAND(REVERSE) != 0
    tag = lambda t: F.try_element_at("tags", F.lit(t)).cast("int")
    return (
        df.withColumn("is_reverse", reverse)
        .withColumn("strand", F.when(reverse, "-").otherwise("+"))
        .withColumn("blocks", F.when(mapped, cigar_blocks(F.col("pos"), F.col("cigar"))))
        .withColumn("nh", tag("NH")).withColumn("hi", tag("HI")).withColumn("nm", tag("NM"))
        .withColumn("len", F.col("query_len"))
    )


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of bam.FIELDS and what with_derived adds; positions are 0-based, header lines are left out."""
    f = F.split("value", "\t")
    star = lambda c: F.when(c != "*", c)
    pairs = F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.split(x, ":", 3))
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    return with_derived(rows.select(
        F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), star(F.get(f, F.lit(2))).alias("ref"),
        F.when(F.get(f, F.lit(3)).cast("bigint") > 0, F.get(f, F.lit(3)).cast("bigint") - 1).alias("pos"), star(F.get(f, F.lit(5))).alias("cigar"),
        F.when(F.get(f, F.lit(9)) != "*", F.length(F.get(f, F.lit(9)))).alias("query_len"),
        F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)), F.get(p, F.lit(2))))).alias("tags"),
        F.get(f, F.lit(9)).alias("seq"), F.get(f, F.lit(10)).alias("qual"),
    ))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, length of each reference, in order. Headers are short."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ")).coalesce(1).withColumn("tid", F.monotonically_increasing_id())
    return lines.select("tid", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("bigint").alias("length"))


def write_sam(df: DataFrame, path: str) -> None:
    """Rows of bam.FIELDS with seq and qual as SAM text lines (no header); tags are written as strings or integers."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], F.when(e["value"].rlike("^-?[0-9]+$"), "i").otherwise("Z"), e["value"]))
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    line = F.concat_ws(
        "\t", "qname", F.col("flag").cast("string"), star("ref"), (F.coalesce(F.col("pos"), F.lit(-1)) + 1).cast("string"), F.lit("255"), star("cigar"),
        F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), star("qual"), tags,
    )
    df.select(line.alias("value")).write.text(path)


def read_bam(spark: SparkSession, uri: str, split_bytes: int | None = None) -> DataFrame:
    """Rows of bam.FIELDS and what with_derived adds, from a BAM file or a folder of them (a file:, hdfs: or s3: URI).

    Filters on ref (equal to, one of) and pos (ranges) read only what the files' indexes say may pass.
    """
    return with_derived(_bam_reader(spark, split_bytes).load(uri))


def _bam_reader(spark: SparkSession, split_bytes: int | None):
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses readers that take filters
    reader = spark.read.format("bam")
    return reader.option("splitBytes", split_bytes) if split_bytes else reader


def read_bam_regions(spark: SparkSession, uri: str, regions: list[tuple[str, int, int]], margin: int = 0, split_bytes: int | None = None) -> DataFrame:
    """As read_bam, but only alignments that overlap any of the regions (ref, start, end; half-open), widened by margin at both ends.

    The regions go to every task, so they are a bounded list; for those of a whole annotation, join its table.
    """
    if len(regions) > MOST_REGIONS:
        raise ValueError(f"over {MOST_REGIONS} regions: join them as a table")
    wide = [(ref, max(0, start - margin), end + margin) for ref, start, end in regions]
    return with_derived(_bam_reader(spark, split_bytes).option("regions", json.dumps(wide)).load(uri))


def write_bam(df: DataFrame, refs: list[tuple[str, int]], uri: str, ordered: bool = False) -> None:
    """Rows of bam.FIELDS with seq and qual as BAM files of a folder, one for each task; refs (name, length) are the header's.

    With `ordered`, rows are dealt by ranges of place first, so that each file is in order and has an index beside it.
    """
    spark = df.sparkSession
    spark.dataSource.register(BamSource)
    if ordered:
        place = [F.array_position(F.lit([n for n, _ in refs]), F.col("ref")).asc_nulls_last(), F.col("pos").asc_nulls_last()]
        df = df.repartitionByRange(*place).sortWithinPartitions(*place)
    rows = df.select("qname", "flag", "ref", "pos", "cigar", "query_len", "tags", "seq", "qual")
    rows.write.format("bam").option("refs", json.dumps(refs)).mode("append").save(uri)


def write_alignments(df: DataFrame, refs: list[tuple[str, int]], uri: str, text: bool = False) -> None:
    """SAM text lines if text is set, else BAM."""
    if text:
        write_sam(df, uri)
    else:
        write_bam(df, refs, uri)
