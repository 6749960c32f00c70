"""Reading-frame analysis: every read gets a status, every table is an aggregation over one classified DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from translatome.functions import coords
from translatome.functions.statistics import entropy_bits, ratio
from translatome.operators.asites import CODING, SHAPE, overlapping, with_extent
from translatome.operators.intervals import overlap_join

BAD_ALIGNMENT = ("NoHit", "TooShort", "TooLong", "MultiHit")
BAD_ANNOTATION = ("NoGene", "NoncodingOnly", "NoncodingOverlap", "MultiCoding", "NoCompatible", "AmbigFrame")
GOOD = "Good"


def unique_hit(multi_first: bool = False) -> Column:
    """A missing NH counts as unique; multi_first also takes the first of several hits (column hi)."""
    one = F.coalesce(F.col("nh") == 1, F.lit(True))
    return one | F.coalesce(F.col("hi") == 0, F.lit(False)) if multi_first else one


def classified(
    reads: DataFrame, transcripts: DataFrame, lengths: tuple[int, int] = (26, 34), body: tuple[int, int] = (34, 31), multi_first: bool = False
) -> DataFrame:
    """read_ord, len, status, gene_id, vs_start, vs_end, frame, one row per read.

    Offsets are given where all compatible coding isoforms of the one gene agree; body bounds the offsets from the start
    (at least) and from the stop codon (at most) between which a frame is read. Reads of one place, and transcripts of one structure, are looked at once.
    """
    gate = (
        F.when(F.col("len").isNull(), "NoHit")
        .when(F.col("len") < lengths[0], "TooShort")
        .when(F.col("len") > lengths[1], "TooLong")
        .when(~unique_hit(multi_first), "MultiHit")
    )
    gated = reads.withColumn("gate", gate)
    alike = gated.filter("gate is null").select(*SHAPE).distinct()
    gene = F.col("gene_id")
    shapes = transcripts.groupBy(*CODING).agg(F.min("gene_id").alias("gene_first"), F.max("gene_id").alias("gene_last"), F.max(gene.isNull()).alias("gene_null"))
    pairs = overlapping(alike, shapes)
    lo = coords.five_prime(F.col("blocks"), F.col("trx_blocks"), F.col("trx_strand"))
    fits = F.col("cds_start").isNotNull() & coords.compatible(F.col("blocks"), F.col("trx_blocks"))
    at = pairs.select(*SHAPE, "gene_first", "gene_last", "gene_null", "cds_start", "cds_len", F.when(fits, lo).alias("lo"))
    vs, ve = F.col("lo") - F.col("cds_start"), F.col("lo") - (F.col("cds_start") + F.col("cds_len") - 3)
    frame = F.when((F.col("vs") >= body[0]) & (F.col("ve") <= body[1]), F.pmod("vs", F.lit(3)))
    placed = at.withColumn("vs", vs).withColumn("ve", ve).withColumn("fr", frame)
    agree = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(f"vs_{'start' if c == 'vs' else 'end'}")
    first, last = F.min("gene_first"), F.max("gene_last")
    # where one gene is met, all that is met is that gene's
    met = placed.groupBy(*SHAPE).agg(
        first.alias("gene_id"), F.coalesce((first < last) | (F.max("gene_null") & first.isNotNull()), F.lit(False)).alias("several"), F.max(F.col("cds_start").isNotNull()).alias("coding"),
        F.count("vs").alias("fitting"), agree("vs"), agree("ve"), F.min("fr").alias("frame"), (F.min("fr") < F.max("fr")).alias("ambiguous"),
    )
    bare = _noncoding_only(alike, transcripts).withColumn("bare", F.lit(True))
    by_read = met.join(bare.hint("merge"), [*SHAPE], "left")
    found = (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(F.col("coding").isNull(), "NoGene")
        .when(~F.col("coding"), "NoncodingOnly")
        .when(F.col("several") & F.col("bare").isNotNull(), "NoncodingOverlap")
        .when(F.col("several"), "MultiCoding")
        .when(F.col("fitting") == 0, "NoCompatible")
        .when(F.col("ambiguous"), "AmbigFrame")
        .otherwise(GOOD)
    )
    joined = gated.select("read_ord", "len", "gate", *SHAPE).join(by_read.hint("merge"), [*SHAPE], "left").withColumn("status", found)
    good = F.col("status") == GOOD
    return joined.select("read_ord", "len", "status", *[F.when(good, F.col(c)).alias(c) for c in ("gene_id", "vs_start", "vs_end", "frame")])


def _noncoding_only(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Reads (ref, strand, blocks) that overlap a gene's noncoding transcripts and none of its coding ones.

    Only the extents matter for that: genes with the same extents are one.
    """
    span = F.struct(coords.blocks_start(F.col("blocks")).alias("low"), coords.blocks_end(F.col("blocks")).alias("high"))
    of = lambda coding: F.array_sort(F.collect_set(F.when(F.col("cds_start").isNotNull() == coding, span)))
    genes = transcripts.groupBy("ref", "strand", "gene_id").agg(of(F.lit(False)).alias("noncoding"), of(F.lit(True)).alias("coding_spans"))
    spans = genes.select("ref", "strand", "coding_spans", F.inline("noncoding")).distinct()
    r = with_extent(reads, "blocks", "read_from", "read_to")
    free = ~F.exists("coding_spans", lambda s: (s["low"] < F.col("read_to")) & (F.col("read_from") < s["high"]))
    return overlap_join(r, spans, ["ref", "strand"], ("read_from", "read_to"), ("low", "high"), extra=free).select(*SHAPE).distinct()


def status_table(rows: DataFrame) -> DataFrame:
    """status, n, and its share of all reads."""
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", "n", (F.col("n") / F.col("total")).alias("fract"))


def length_table(rows: DataFrame) -> DataFrame:
    """Frames by read length: len, fract, n0, n1, n2, p0, p1, p2 and the information in bits."""
    of = [F.sum(F.when(F.col("frame") == f, 1).otherwise(0)) for f in range(3)]
    counts = rows.filter("frame is not null").groupBy("len").agg(*[c.alias(f"n{f}") for f, c in enumerate(of)])
    n = F.col("n0") + F.col("n1") + F.col("n2")
    total = counts.agg(F.sum(n).alias("total"))
    bits = F.lit(1.584962500721156) - entropy_bits([F.col("n0"), F.col("n1"), F.col("n2")])
    return counts.crossJoin(F.broadcast(total)).select(
        "len", ratio(n, F.col("total")).alias("fract"), "n0", "n1", "n2",
        *[ratio(F.col(f"n{f}"), n).alias(f"p{f}") for f in range(3)], bits.alias("info"),
    )


def metagene(rows: DataFrame, offset: str, bounds: tuple[int, int] = (-100, 100), lengths: tuple[int, int] = (26, 34)) -> DataFrame:
    """Reads around a landmark: pos, ttl and a column for each read length, over all positions of bounds."""
    near = rows.filter(F.col(offset).between(*bounds))
    counts = near.groupBy(F.col(offset).alias("pos")).agg(
        F.count(F.lit(1)).alias("ttl"), *[F.sum(F.when(F.col("len") == k, 1).otherwise(0)).alias(f"len{k}") for k in range(lengths[0], lengths[1] + 1)]
    )
    grid = rows.sparkSession.range(bounds[0], bounds[1] + 1).withColumnRenamed("id", "pos")
    return grid.join(counts, "pos", "left").na.fill(0)


def framing_tag(rows: DataFrame) -> DataFrame:
    """read_ord and the tag gene/start/end/frame, with * for what is undefined, or the failure's name."""
    shown = lambda c: F.coalesce(F.when(F.col(c) >= 0, F.concat(F.lit("+"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")), F.lit("*"))
    tag = F.concat_ws("/", F.col("gene_id").cast("string"), shown("vs_start"), shown("vs_end"), F.coalesce(F.col("frame").cast("string"), F.lit("*")))
    return rows.select("read_ord", F.when(F.col("status") == GOOD, tag).otherwise(F.col("status")).alias("tag"))
