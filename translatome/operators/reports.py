"""Reports: hits of reads as strings, transcripts base by base, summary tables, sequence context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from translatome.functions import coords, ordered, sequences
from translatome.operators import asites, framing
from translatome.sources.reads import padded

#: Bins in which reads of one block meet exons.
BIN = 64
#: Bytes of the texts of a task's places. Parquet writers keep equal texts of a file once while those that differ take 1 MB at most.
TEXT = 850_000
#: Most tasks, beyond which they have more text.
TASKS = 100_000
#: Reads of one place in a row, beyond which a hash deals them to several.
CROWD = 1 << 18


def annotated(reads: DataFrame, transcripts: DataFrame, strands: str = "same") -> DataFrame:
    """read_ord, names, starts and relative strands of all transcripts that each read lies in, comma separated; null without any.

    One place is looked up once, for all reads there (some CROWD of them in a row, so that no list grows without bound) and all transcripts of one structure.
    Reads of one block meet the exons of their bin as one row, so neither pairs nor the texts made of them are shuffled. A task has places of some TEXT bytes of text,
    and all reads of a place side by side: the output grows with reads times transcripts, but what differs in it with places times transcripts only.
    """
    shapes = transcripts.groupBy(*asites.SHAPE).agg(F.collect_list("trx_id").alias("ids"))
    unnamed = reads.filter("read_ord IS NULL").select("read_ord", *(F.lit(None).cast("string").alias(c) for c in ("names", "starts", "strands")))
    known = reads.filter("read_ord IS NOT NULL")
    one = F.coalesce(F.size("blocks") == 1, F.lit(False))

    widest = F.length(coords.blocks_length(F.col("blocks")).cast("string"))
    chars = F.aggregate("ids", F.lit(0).cast("bigint"), lambda n, i: n + F.greatest(F.length(i.cast("string")), widest) + 1)
    exons = asites.exons_in_bins(shapes.withColumn("chars", chars), strands, BIN)
    places, n = _dealt_places(known.filter(one), exons)
    keys = ["ref", "strand", "bin", "part"]
    spans = places.groupBy(*keys).agg(F.min("low").alias("first"), F.max("low").alias("last"))
    each = F.struct("exon_from", "exon_to", "exon_before", "trx_len", F.when(F.col("strand") == F.col("trx_strand"), "+").otherwise("-").alias("side"), (F.col("trx_strand") == "+").alias("forward"), "ids")
    near = exons.join(spans, keys[:3]).filter("exon_from <= last AND first < exon_to").select(*keys, each.alias("exon"))
    lists = near.repartitionById(n, F.col("part")).groupBy(*keys).agg(F.sort_array(F.collect_list("exon")).alias("exons"))
    met = places.repartitionById(n, F.col("part")).join(_by_transcript(lists).hint("merge"), keys, "left")
    found = met.select("ords", *_texts()).select(F.explode("ords").alias("read_ord"), "names", "starts", "strands")

    others = known.filter(~one).select("read_ord", *asites.SHAPE)
    pairs = asites.placed(others.select(*asites.SHAPE).distinct(), shapes, 0, strands=strands)
    hit = F.struct("ids", "lo", F.when(F.col("strand") == F.col("trx_strand"), "+").otherwise("-").alias("side"))
    rows = pairs.groupBy(*asites.SHAPE).agg(F.collect_list(hit).alias("h")).withColumn("h", F.sort_array(_each_of(F.col("h"))))
    text = lambda f: F.when(F.size("h") > 0, F.array_join(F.transform("h", lambda x: x[f].cast("string")), ","))
    rows = rows.select(*asites.SHAPE, text("trx_id").alias("names"), text("lo").alias("starts"), text("side").alias("strands"))
    return found.unionByName(others.join(rows.hint("merge"), [*asites.SHAPE], "left").drop(*asites.SHAPE)).unionByName(unnamed)


def _dealt_places(reads: DataFrame, exons: DataFrame) -> tuple[DataFrame, int]:
    """Places of reads of one block (ref, strand, low, high, bin, ords) with the part of the work, a number, that each belongs to; and the number of parts.

    Parts are stretches of (ref, strand, low, high) whose texts take some TEXT bytes; there are as many as there are shuffle partitions, but TASKS at most.
    """
    spark, block = reads.sparkSession, F.get("blocks", F.lit(0))
    each = reads.select("read_ord", "ref", "strand", block["start"].alias("low"), (block["start"] + block["len"]).alias("high"))
    place = ["ref", "strand", "low", "high"]
    crowds = each.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("pieces")).filter("pieces > 1")  # a row for each CROWD of reads at most
    same = F.lit(True)
    for c in place:
        same &= F.col(f"_each.{c}").eqNullSafe(F.col(f"_crowd.{c}"))
    piece = F.coalesce(F.pmod(F.xxhash64("_each.read_ord"), F.col("_crowd.pieces")), F.lit(0)).alias("piece")
    split = each.alias("_each").join(F.broadcast(crowds.alias("_crowd")), same, "left").select("_each.*", piece)
    places = split.groupBy(*place, "piece").agg(F.collect_list("read_ord").alias("ords")).withColumn("bin", F.floor(F.col("low") / BIN))
    keys = ["ref", "strand", "bin"]
    lists = exons.groupBy(*keys).agg(F.collect_list(F.struct("exon_from", "exon_to", "chars")).alias("exons"))
    text = F.aggregate("exons", F.lit(0).cast("bigint"), lambda n, e: n + F.when(_holds(e), e["chars"]).otherwise(0))
    weighed = places.join(lists.hint("merge"), keys, "left").withColumn("bytes", F.coalesce(text, F.lit(0)) + 16 * F.size("ords")).drop("exons")

    order = [*place, "piece"]
    rows = ordered.ranged(weighed, [], order)
    total = rows.agg(F.sum("bytes")).first()[0] or 1
    most = max(min(TEXT, total // int(spark.conf.get("spark.sql.shuffle.partitions"))), total // TASKS, 1)
    upto = ordered.running(rows, [], order, {"upto": ("sum", F.col("bytes"))})
    return upto.withColumn("part", F.floor((F.col("upto") - F.col("bytes")) / most).cast("int")).select(*place, "bin", "ords", "part"), (total - 1) // most + 1


def _holds(exon: Column) -> Column:
    """Whether a place (low, high) lies in an exon."""
    low, high = F.col("low"), F.col("high")
    return (exon["exon_from"] <= low) & (high <= exon["exon_to"]) & (low < exon["exon_to"]) & (exon["exon_from"] < high)


def _by_transcript(lists: DataFrame) -> DataFrame:
    """lists with exons without their ids, and ids, all of them in order as text, with of, the exon that each belongs to."""
    pairs = F.flatten(F.transform("exons", lambda e, k: F.transform(e["ids"], lambda i: F.struct(i.alias("id"), k.alias("k")))))
    return lists.withColumn("pairs", F.sort_array(pairs)).select(
        *(c for c in lists.columns if c != "exons"), F.transform("exons", lambda e: e.dropFields("ids")).alias("exons"),
        F.transform("pairs", lambda p: p["id"].cast("string")).alias("ids"), F.transform("pairs", lambda p: p["k"]).alias("of"),
    )


def _each_of(hits: Column) -> Column:
    """Hits of structures (ids, lo, side) as hits of transcripts."""
    return F.flatten(F.transform(hits, lambda x: F.transform(x["ids"], lambda i: F.struct(i.alias("trx_id"), x["lo"].alias("lo"), x["side"].alias("side")))))


def _texts() -> list[Column]:
    """names, starts and strands of a place (low, high) from exons, ids and of: each is looked up by its exon, and array_join leaves out the nulls of those that the place isn't in."""
    low, high = F.col("low"), F.col("high")
    lo = lambda e: F.when(e["forward"], e["exon_before"] + low - e["exon_from"]).otherwise(e["trx_len"] - e["exon_before"] - high + e["exon_from"])
    starts = F.transform("exons", lambda e: F.when(_holds(e), lo(e).cast("string")))
    sides = F.transform("exons", lambda e: F.when(_holds(e), e["side"]))

    def joined(by_exon: Column, each: Callable[[Column], Column]) -> Column:
        """by_exon is worked out once: it is the argument of a function."""
        text = lambda x: F.when(F.exists(x, lambda y: y.isNotNull()), F.array_join(each(x), ","))
        return F.get(F.transform(F.array(by_exon), text), F.lit(0))

    looked_up = lambda x: F.transform("of", lambda k: F.get(x, k))
    names = joined(starts, lambda x: F.zip_with("ids", "of", lambda i, k: F.when(F.get(x, k).isNotNull(), i)))
    return [names.alias("names"), joined(starts, looked_up).alias("starts"), joined(sides, looked_up).alias("strands")]


def junctions(blocks: Column, strand: Column) -> Column:
    """Transcript offsets of the last base before and the first after each junction, as `donor/acceptor` parted by blanks."""
    along = F.when(strand == "-", F.reverse(blocks)).otherwise(blocks)
    ends = F.transform(along, lambda b, i: coords.blocks_length(F.slice(along, F.lit(1), i + 1)))
    inner = F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))
    return F.array_join(F.transform(inner, lambda e: F.concat((e - 1).cast("string"), F.lit("/"), e.cast("string"))), " ")


def location_fields(nt: Column, cds_start: Column) -> list[Column]:
    """Offset from the CDS start, codon and frame of a transcript base; null without a CDS."""
    x = nt - cds_start
    return [x.alias("cds_off"), coords.codon_of(x).alias("codon"), coords.frame_of(x).alias("frame")]


def by_base(arrays: DataFrame, names: tuple[str, ...] = ("n",)) -> DataFrame:
    """One row for each base of each transcript (trx_id, blocks, cds_start, seq): location fields, base, amino acid of its codon, and the counts called names.

    arrays: transcripts with their dense counts, as asites.dense_arrays gives them. Bases are dealt out last, so nothing is shuffled for each of them.
    """
    n = coords.blocks_length(F.col("blocks"))
    letters = arrays.select("trx_id", "cds_start", *names, F.col("seq").isNotNull().alias("known"), F.split("seq", "").alias("letters"), sequences.safe_range(F.lit(0), n - 1).alias("nts"))
    at = letters.withColumn("nt", F.explode("nts")).withColumn("nt", F.col("nt").cast("bigint"))
    letter = lambda i: F.coalesce(F.get("letters", (F.col("nt") + i).cast("int")), F.lit(""))
    of_known = lambda c: F.when(F.col("known"), c)
    return at.select(
        "trx_id", "nt", *location_fields(F.col("nt"), F.col("cds_start")),
        of_known(letter(0)).alias("base"), sequences.amino(F.upper(of_known(F.concat(letter(0), letter(1), letter(2))))).alias("amino"),
        *(F.get(c, F.col("nt").cast("int")).alias(c) for c in names),
    )


def by_codon(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """trx_id, codon, n for each codon of each CDS, zeros included; hits: asites.sites."""
    cds = transcripts.filter("cds_start is not null")
    last = F.ceil(F.col("cds_len") / 3) - 1
    grid = cds.select("trx_id", F.explode(sequences.safe_range(F.lit(0), last)).alias("codon")).withColumn("codon", F.col("codon").cast("bigint"))
    counts = asites.codon_profile(hits)
    return grid.join(counts, ["trx_id", "codon"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def by_length(arrays: DataFrame, lengths: tuple[int, int] = (26, 34)) -> DataFrame:
    """One row for each base: location fields, base, total n and a column for each read length, all of them dense arrays in arrays."""
    return by_base(arrays, ("n", *(f"len{k}" for k in range(lengths[0], lengths[1] + 1)))).drop("amino")


def report_heads(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The head of each transcript's report: junctions, and counts, density and framing over its CDS (null without one); hits: asites.sites."""
    stats = asites.profile_statistics(hits, transcripts)
    return transcripts.select("trx_id", junctions(F.col("blocks"), F.col("strand")).alias("junctions")).join(stats, "trx_id", "left")


def framing_summary(rows: DataFrame) -> DataFrame:
    """part, status, n, and its shares of all reads and of those aligned well; statuses that no read has are given as 0.

    rows: framing.classified. Parts: total, BadAlignment, GoodAlignment, BadAnnotation, GoodAnnotation, each with its sum (status '').
    """
    spark = rows.sparkSession
    names = [("BadAlignment", s) for s in framing.BAD_ALIGNMENT] + [("BadAnnotation", s) for s in framing.BAD_ANNOTATION] + [("GoodAnnotation", framing.GOOD)]
    known = spark.createDataFrame(names, "part string, status string")
    counts = known.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("part", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    of = lambda *parts: F.sum(F.when(F.col("part").isin(*parts), F.col("n")).otherwise(0))
    sums = counts.agg(
        F.sum("n").alias("total"), of("BadAlignment").alias("BadAlignment"), of("BadAnnotation", "GoodAnnotation").alias("GoodAlignment"),
        of("BadAnnotation").alias("BadAnnotation"), of("GoodAnnotation").alias("GoodAnnotation"),
    )
    long = sums.unpivot([], ["total", "BadAlignment", "GoodAlignment", "BadAnnotation", "GoodAnnotation"], "part", "n").select("part", F.lit("").alias("status"), "n")
    every = counts.filter(F.col("status") != framing.GOOD).unionByName(long).crossJoin(F.broadcast(sums.select("total", F.col("GoodAlignment").alias("good"))))
    share = lambda c: F.when(F.col(c) > 0, F.col("n") / F.col(c))
    of_good = F.when(F.col("part").isin("BadAnnotation", "GoodAnnotation"), share("good"))
    return every.select("part", "status", "n", share("total").alias("of_all"), of_good.alias("of_good"))


def forward_counts(reads: DataFrame) -> DataFrame:
    """ref, pos, len and the number of reads: those on the forward strand with a place and a length."""
    return reads.filter("strand = '+' AND pos IS NOT NULL AND len IS NOT NULL").groupBy("ref", "pos", "len").agg(F.count(F.lit(1)).alias("n"))


def gate_counts(reads: DataFrame) -> DataFrame:
    """ref, n_input, n_rrna (forward, with a place and a length) and n_kept (all others: reverse, unmapped or without a length)."""
    gate = F.coalesce((F.col("strand") == "+") & F.col("pos").isNotNull() & F.col("len").isNotNull(), F.lit(False))
    return reads.groupBy("ref").agg(F.count(F.lit(1)).alias("n_input"), F.count_if(gate).alias("n_rrna"), F.count_if(~gate).alias("n_kept"))


def position_lengths(reads: DataFrame, lengths: tuple[int, int] = (25, 34)) -> DataFrame:
    """Reads that start at each position of a reference, by length: ref, pos and a column for each length."""
    each = [F.count(F.when(F.col("len") == k, 1)).alias(f"len{k}") for k in range(lengths[0], lengths[1] + 1)]
    return reads.groupBy("ref", "pos").agg(*each)


def position_shares(cover: DataFrame, total: int) -> DataFrame:
    """Counts of starts, ends and cover at each position, each also as its share of all reads."""
    share = [(F.col(c) / F.lit(float(total))).alias(f"{c}_share") for c in ("n_start", "n_end", "cover")] if total else []
    return cover.select("ref", "pos", "n_start", "n_end", "cover", *share)


def pause_context(seq: Column, cds_start: Column, codon: Column) -> list[Column]:
    """The 48 bases from ten codons before a codon of a CDS to five after it (N outside of the sequence), and their peptide."""
    low = cds_start + codon * 3 - 30
    context = padded(seq, low, low + 47)
    return [context.alias("context"), sequences.translated(F.substr(context, F.lit(1), F.lit(45))).alias("peptide")]


def pars_items(features: DataFrame, scores: DataFrame) -> DataFrame:
    """gene, start (of the CDS in its transcript) and scores, for genes that have both and whose CDS lies in the transcript.

    features: gene, ftype, start, end (inclusive); scores: gene, scores.
    """
    of = lambda kind: features.filter(F.col("ftype") == kind).select("gene", F.col("start").alias(f"{kind}_start"), F.col("end").alias(f"{kind}_end"))
    genes = of("Transcript").join(of("CDS"), "gene", "left")
    inside = (F.col("CDS_start") >= F.col("Transcript_start")) & (F.col("CDS_end") <= F.col("Transcript_end"))
    start = F.when(inside, F.col("CDS_start") - F.col("Transcript_start"))
    return genes.join(scores, "gene").select("gene", start.alias("start"), "scores").filter("start is not null")
