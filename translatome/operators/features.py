"""Sub-features of transcripts: CDS, stop region, untranslated regions, introns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.functions import coords
from translatome.operators.asites import with_extent
from translatome.operators.intervals import first_offenders, without_overlap


def _sub(transcripts: DataFrame, start, length, keep) -> DataFrame:
    kept = transcripts.filter("cds_start is not null").withColumn("f_start", start).withColumn("f_len", length).filter(keep)
    cut = coords.sub_blocks(F.col("blocks"), F.col("strand"), F.col("f_start"), F.col("f_len"))
    return kept.withColumn("blocks", cut).select("trx_id", "gene_id", "ref", "strand", "blocks", "f_len")


def cds_features(transcripts: DataFrame) -> DataFrame:
    return _sub(transcripts, F.col("cds_start"), F.col("cds_len"), F.lit(True))


def stop_features(transcripts: DataFrame, before: int = 27, after: int = 25) -> DataFrame:
    """From before the last CDS base to after it, where the transcript has all of that."""
    last = F.col("cds_start") + F.col("cds_len") - 1
    inside = (last - before >= 0) & (last + after < coords.blocks_length(F.col("blocks")))
    return _sub(transcripts, last - before, F.lit(before + after + 1).cast("bigint"), inside)


def utr3_features(transcripts: DataFrame, trim: int = 3) -> DataFrame:
    """The 3' UTR without its first bases."""
    end = F.col("cds_start") + F.col("cds_len")
    return _sub(transcripts, end + trim, coords.blocks_length(F.col("blocks")) - end - trim, F.col("f_len") > 0)


def utr5_features(transcripts: DataFrame, trim: int = 3) -> DataFrame:
    """The 5' UTR without its last bases."""
    return _sub(transcripts, F.lit(0).cast("bigint"), F.col("cds_start") - trim, F.col("f_len") > 0)


def intron_features(transcripts: DataFrame) -> DataFrame:
    """trx_id, ref, strand, number (from 1), start, end of each gap between blocks."""
    gaps = transcripts.select("trx_id", "ref", "strand", F.posexplode(coords.introns(F.col("blocks"))).alias("i", "gap"))
    return gaps.select("trx_id", "ref", "strand", (F.col("i") + 1).cast("bigint").alias("number"), F.col("gap.start").alias("start"), (F.col("gap.start") + F.col("gap.len")).alias("end"))


def clear_of(features: DataFrame, others: DataFrame) -> DataFrame:
    """Features (with blocks) of which no block overlaps any block of others on the same reference."""
    blocks = features.withColumn("b", F.explode("blocks")).select("trx_id", "ref", F.col("b.start").alias("fs"), (F.col("b.start") + F.col("b.len")).alias("fe"))
    targets = others.withColumn("o", F.explode("blocks")).select("ref", F.col("o.start").alias("os"), (F.col("o.start") + F.col("o.len")).alias("oe")).distinct()
    clear = without_overlap(blocks, targets, ["ref"], ("fs", "fe"), ("os", "oe"))
    n = blocks.groupBy("trx_id").agg(F.count(F.lit(1)).alias("n"))
    whole = clear.groupBy("trx_id").agg(F.count(F.lit(1)).alias("c")).join(n, "trx_id").filter("c = n")
    return features.join(whole.select("trx_id"), "trx_id", "left_semi")


def clear_introns(transcripts: DataFrame) -> DataFrame:
    """Introns that overlap no block of any transcript on the same reference."""
    targets = transcripts.withColumn("o", F.explode("blocks")).select("ref", F.col("o.start").alias("os"), (F.col("o.start") + F.col("o.len")).alias("oe")).distinct()
    return without_overlap(intron_features(transcripts), targets, ["ref"], ("start", "end"), ("os", "oe"))


def extent(features: DataFrame) -> DataFrame:
    return with_extent(features, "blocks", "start", "end")


def intron_offenders(transcripts: DataFrame) -> DataFrame:
    """The introns that clear_introns leaves out, each with the first block that overlaps it: by transcript, then by place."""
    blocks = transcripts.withColumn("o", F.explode("blocks"))
    targets = blocks.select("ref", F.col("trx_id").alias("other"), F.col("o.start").alias("os"), (F.col("o.start") + F.col("o.len")).alias("oe"))
    found = first_offenders(intron_features(transcripts), targets, ["ref"], ("start", "end"), ("os", "oe"), ["other", "os"])
    return found.select("trx_id", "ref", "number", F.col("offender.other").alias("other"), F.col("offender.os").alias("other_start"))
