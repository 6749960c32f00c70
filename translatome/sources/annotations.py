"""Transcripts as BED12, and other interval formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.functions import coords
from translatome.sources.reads import prefixed

BED12 = (
    "ref string, start bigint, end bigint, name string, score string, strand string, thick_start bigint, thick_end bigint, rgb string, "
    "n_blocks int, block_sizes string, block_starts string"
)
#: Positions under one header of a WIG file, as many as the reference buffers.
WIG_STRETCH = 4_194_304
BEDPE = "ref1 string, left1 bigint, right1 bigint, ref2 string, left2 bigint, right2 bigint, name string, score string, strand1 string, strand2 string"


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """trx_id, gene_id, ref, strand, blocks, cds_start, cds_len; several paths are read one after the other."""
    bed = spark.read.csv(path, sep="\t", schema=BED12, comment="#")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    zipped = F.arrays_zip(numbers("block_starts").alias("s"), numbers("block_sizes").alias("n"))
    blocks = F.transform(zipped, lambda z: F.struct((F.col("start") + z["s"]).alias("start"), z["n"].alias("len")))
    with_blocks = bed.withColumn("blocks", F.coalesce(blocks, F.array(F.struct(F.col("start").alias("start"), (F.col("end") - F.col("start")).alias("len")))))
    low = coords.bases_before(F.col("blocks"), F.col("thick_start"))
    high = coords.bases_before(F.col("blocks"), F.col("thick_end"))
    coding = F.coalesce(F.col("thick_end") > F.col("thick_start"), F.lit(False)) & (high > low)
    first = F.when(F.col("strand") == "-", coords.blocks_length(F.col("blocks")) - high).otherwise(low)
    return with_blocks.select(
        F.col("name").alias("trx_id"), F.col("name").alias("gene_id"), "ref", F.coalesce("strand", F.lit("+")).alias("strand"), "blocks",
        F.when(coding, first).alias("cds_start"), F.when(coding, high - low).alias("cds_len"),
    )


def find_transcript(transcripts: DataFrame, trx_id: str) -> DataFrame:
    """The one transcript of that name; none or several are an error."""
    rows = transcripts.filter(F.col("trx_id") == trx_id)
    n = rows.count()
    if n != 1:
        raise ValueError(f"{n} transcripts are named {trx_id}")
    return rows


def bed12_lines(transcripts: DataFrame) -> DataFrame:
    """value: one BED12 line for each transcript."""
    start, end = coords.blocks_start(F.col("blocks")), coords.blocks_end(F.col("blocks"))
    at = lambda x: coords.genome_position(x, F.col("blocks"), F.col("strand"))
    edges = [at(F.col("cds_start")), at(F.col("cds_start") + F.col("cds_len") - 1)]
    low = F.coalesce(F.least(*edges), start)
    high = F.coalesce(F.greatest(*edges) + 1, start)
    text = lambda c: c.cast("string")
    sizes = F.concat(F.array_join(F.transform("blocks", lambda b: text(b["len"])), ","), F.lit(","))
    starts = F.concat(F.array_join(F.transform("blocks", lambda b: text(b["start"] - start)), ","), F.lit(","))
    line = F.concat_ws("\t", text(F.col("ref")), text(start), text(end), text(F.col("trx_id")), F.lit("0"), "strand", text(low), text(high), F.lit("0"), text(F.size("blocks")), sizes, starts)
    return transcripts.select(line.alias("value"))


def write_bed12(transcripts: DataFrame, path: str) -> None:
    bed12_lines(transcripts).write.text(path)


def read_bedpe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed pairs, and the lines that aren't (too few columns, or left beyond right)."""
    rows = spark.read.csv(path, sep="\t", schema=BEDPE + ", bad string", columnNameOfCorruptRecord="bad", mode="PERMISSIVE")
    ordered = lambda k: (F.col(f"ref{k}") == ".") | (F.col(f"left{k}") <= F.col(f"right{k}"))
    ok = F.coalesce(F.col("bad").isNull() & ordered(1) & ordered(2), F.lit(False))
    marked = rows.withColumn("ok", ok)
    return marked.filter("ok").drop("ok", "bad"), marked.filter("not ok").drop("ok")


def write_wig(track: DataFrame, path: str) -> None:
    """A variable-step track (ref, at, n; 0-based) as text, in order, 1-based, with two decimals, a header for each reference.

    A reference has a header again every WIG_STRETCH positions: a stretch is in one file, so no file goes on without the name of its reference.
    """
    text = F.concat_ws(" ", (F.col("at") + 1).cast("string"), F.format_string("%.2f", F.col("n").cast("double")))
    stretch = F.floor(F.col("at") / WIG_STRETCH).alias("stretch")
    rows = track.select("ref", stretch, F.lit(1).alias("kind"), F.col("at").cast("bigint").alias("at"), text.alias("value"))
    head = F.concat(F.lit("variableStep chrom="), F.col("ref").cast("string"), F.lit(" span=1"))
    heads = track.select("ref", stretch).distinct().select("ref", "stretch", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"), head.alias("value"))
    dealt = rows.unionByName(heads).repartitionByRange("ref", "stretch").sortWithinPartitions("ref", "stretch", "kind", "at")
    dealt.select("value").write.text(path)


def write_wig_pair(track: DataFrame, path: str, scale: float = 1.0) -> None:
    """A track of both strands (ref, strand, at, n) as two, path_fwd.wig and path_rev.wig, with n times scale."""
    for strand, name in (("+", "fwd"), ("-", "rev")):
        write_wig(track.filter(F.col("strand") == strand).select("ref", "at", (F.col("n") * scale).alias("n")), f"{path}_{name}.wig")


def read_wig(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ref, at (0-based) and n of variable-step tracks of span 1."""
    head = F.when(F.col("value").startswith("variableStep"), F.regexp_extract("value", "chrom=(\\S+)", 1))
    lines = prefixed(spark, path, head).filter("not is_head and head is not null and value <> ''")
    f = F.split("value", "\\s+")
    return lines.select(F.col("head").alias("ref"), (F.get(f, F.lit(0)).cast("bigint") - 1).alias("at"), F.get(f, F.lit(1)).cast("double").alias("n"))


def write_sizes(refs: DataFrame, path: str) -> None:
    """Lengths of references (ref, length) as tab-separated lines."""
    refs.select("ref", "length").write.csv(path, sep="\t")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="ref string, length bigint")
