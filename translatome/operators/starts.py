"""Translation starts: open reading frames, upstream frames, enrichment, features and a trained caller."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.functions import coords, sequences
from translatome.functions.statistics import l2_normalized, ratio
from translatome.operators import svm

#: Groups of codons whose counts make the default features; training positions around a start.
CODON_GROUPS = ((-2, -1), (0,), (1,), (2,), (3, 4), (5, 6, 7), (8, 9, 10), (11, 12, 13))
NEGATIVES = (-6, -3, 3, 9, 18, 30, 60, 90, 120, 150)


def bases_of(codons: tuple[tuple[int, ...], ...]) -> tuple[tuple[int, ...], ...]:
    """Groups of codons as groups of bases: each codon's middle one and its neighbours."""
    return tuple(tuple(3 * c + k for c in group for k in (-1, 0, 1)) for group in codons)


GROUPS = bases_of(CODON_GROUPS)


def orf_class(start: Column, cds_start: Column, cds_len: Column, orf_len: Column) -> Column:
    """Category of an ORF at start: orf_len includes the stop codon and is null without one."""
    so = start - cds_start
    eo = start - 1 + orf_len - (cds_start + cds_len - 1)
    return (
        F.when(cds_start.isNull(), "sprc")
        .when(so == 0, "canonical")
        .when((so > 0) & F.coalesce(eo == 0, F.lit(False)), "truncation")
        .when(so > 0, "internal-out-of-frame")
        .when(F.coalesce(orf_len + so < 0, F.lit(False)), "uorf")
        .when(F.coalesce(eo == 0, F.lit(False)), "extension")
        .otherwise("uorf-overlapping")
    )


def peak_codons(seq: Column, any_first: Column, any_last: Column, both_first: Column, both_last: Column) -> Column:
    """Start codons of a peak: the first of AUG in both, AUG in any, near-cognate in both, near-cognate in any that is not empty."""
    none = F.array().cast("array<int>")
    found = [
        F.coalesce(sequences.codon_starts(seq, low, high, wanted), none)
        for wanted in (("ATG",), sequences.NEAR_STARTS)
        for low, high in ((both_first, both_last), (any_first, any_last))
    ]
    return reduce(lambda rest, own: F.when(F.size(own) > 0, own).otherwise(rest), reversed(found), none)


def orfs(items: DataFrame, wanted: tuple[str, ...] = ("ATG",)) -> DataFrame:
    """items (with seq) exploded to the ORFs of all wanted start codons: start, stop_codons (to the first stop), orf_len, peptide."""
    starts = sequences.codon_starts(F.col("seq"), F.lit(0), F.length("seq") - 3, wanted)
    at = items.withColumn("start", F.explode(starts)).withColumn("rest", F.substr(F.col("seq"), F.col("start") + 1, F.length("seq")))
    stop = sequences.first_stop_codon(F.col("rest"))
    orf_len = stop * 3 + 3
    peptide = sequences.translated(F.when(stop.isNull(), F.col("rest")).otherwise(F.substr(F.col("rest"), F.lit(1), orf_len.cast("int"))))
    return at.select(*items.columns, F.col("start").cast("bigint").alias("start"), stop.alias("stop_codons"), orf_len.alias("orf_len"), peptide.alias("peptide")).drop("seq")


def uorf_candidates(items: DataFrame, downstream: bool = False) -> DataFrame:
    """Candidate codons from the transcript's start to the CDS start, and on request from the last CDS base on.

    items: seq, cds_start, cds_len. Adds nt, codon, codons (to the first stop), quant_end (where a uORF's counts end) and context.
    """
    found = sequences.codon_starts(F.col("seq"), F.lit(0), F.col("cds_start"), sequences.CANDIDATE_STARTS)
    if downstream:
        last = F.col("cds_start") + F.col("cds_len") - 1
        found = F.concat(found, sequences.codon_starts(F.col("seq"), last, F.length("seq"), sequences.CANDIDATE_STARTS))
    at = items.withColumn("nt", F.explode(found))
    rest = F.substr(F.col("seq"), F.col("nt") + 1, F.length("seq"))
    codons = sequences.first_stop_codon(rest)
    return at.select(
        *[c for c in items.columns if c != "seq"],
        F.col("nt").cast("bigint").alias("nt"),
        F.substr(rest, F.lit(1), F.lit(3)).alias("codon"),
        codons.alias("codons"),
        F.least(F.col("cds_start") - 2, F.col("nt") + 3 * codons + 1).alias("quant_end"),
        F.when(F.col("nt") >= 3, F.substr(F.col("seq"), F.col("nt") - 2, F.lit(7))).alias("context"),
    )


def uorf_sums(counts: Column, nt: Column, quant_end: Column, cds_start: Column) -> list[Column]:
    """Sum over a candidate's bases nt + 2 .. quant_end (null if one is off the profile), and over the leader 0 .. cds_start - 2."""
    total = lambda low, count: F.aggregate(F.slice(counts, (low + 1).cast("int"), count.cast("int")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    count = F.greatest(quant_end - nt - 1, F.lit(0).cast("bigint"))
    of_uorf = F.when((count == 0) | (quant_end < F.size(counts)), total(nt + 2, count))
    of_leader = F.when((cds_start > 1) & (cds_start - 1 <= F.size(counts)), total(F.lit(0), cds_start - 1))
    return [F.when(quant_end.isNotNull(), of_uorf).alias("uorf_sum"), of_leader.alias("leader_sum")]


def uorf_transcripts(candidates: DataFrame) -> DataFrame:
    """Each candidate that reaches beyond its first base as a transcript that is all CDS.

    candidates: trx_id, ref, strand, blocks, nt, quant_end.
    """
    rows = candidates.filter(F.col("quant_end") > F.col("nt"))
    length = F.col("quant_end") - F.col("nt") + 1
    own = coords.sub_blocks(F.col("blocks"), F.col("strand"), F.col("nt"), length)
    name = F.concat_ws("_", F.col("trx_id").cast("string"), F.col("nt").cast("string"))
    return rows.select(name.alias("name"), "ref", "strand", own.alias("blocks"), F.lit(0).cast("bigint").alias("cds_start"), length.alias("cds_len"))


def peak_cds(seq: Column, codons: Column) -> list[Column]:
    """CDS of a peak with one start codon: from there to the base before the stop codon's last, or to the end; null otherwise."""
    at = F.get(codons, F.lit(0))
    rest = F.substr(seq, at + 1, F.length(seq))
    length = F.coalesce(first_stop(rest) + 2, F.length(rest))
    one = F.size(codons) == 1
    return [F.when(one, at).cast("bigint").alias("cds_start"), F.when(one, length).cast("bigint").alias("cds_len")]


def first_stop(seq: Column) -> Column:
    return sequences.first_stop_codon(seq) * 3


def start_ratio(ltm: Column, chx: Column, st: Column) -> Column:
    """Counts of ltm at st + 2 .. st + 4 over what chx lets expect; -1 without chx, the counts alone if chx has none there, 0 off the end."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    window = lambda c: F.get(c, st + 2) + F.get(c, st + 3) + F.get(c, st + 4)
    expected = window(chx) * total(ltm) / total(chx)
    found = F.when(total(chx) == 0, -1.0).when(window(chx) == 0, window(ltm).cast("double")).otherwise(window(ltm) / expected)
    return F.when(st + 4 >= F.size(ltm), 0.0).otherwise(found)


def codon_count(counts: Column, nt: Column) -> Column:
    """Sum over nt - 1 .. nt + 1; null if any of them leaves the profile."""
    inside = (nt >= 1) & (nt + 1 < F.size(counts))
    return F.when(inside, F.get(counts, nt - 1) + F.get(counts, nt) + F.get(counts, nt + 1))


def start_test(counts: Column, nt: Column, least_count: int, least_ratio: float, least_frame: float) -> Column:
    """struct<before, after, frame, log_ratio, is_start> of a candidate: a rise of counts, in frame, at its codon."""
    before, after = codon_count(counts, nt), codon_count(counts, nt + 3)
    frame = ratio(F.get(counts, nt + 3), after)
    risen = F.when(before > 0, after / before >= least_ratio).otherwise(after > 0)
    logged = F.when((before > 0) & (after > 0), F.least(F.lit(10.0), F.log2(after / before))).when((before == 0) & (after > 0), 10.0)
    ok = (before + after >= least_count) & risen & (frame >= least_frame)
    return F.struct(before.alias("before"), after.alias("after"), frame.alias("frame"), logged.alias("log_ratio"), F.coalesce(ok, F.lit(False)).alias("is_start"))


def enrichment(profile: DataFrame, least_reads: int = 4, least_diff: float = 0, least_ratio: float = 2) -> DataFrame:
    """trx, st, ltm_sum, expected, is_start: windows st + 2 .. st + 4 that are enriched in one treatment over the other.

    profile: trx, ltm, chx, both dense arrays of a transcript.
    """
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda s, x: s + x)
    n = F.least(F.size("ltm"), F.size("chx"))
    sums = profile.withColumn("ltm_total", total("ltm")).withColumn("chx_total", total("chx")).withColumn("n", n)
    at = sums.withColumn("st", F.explode(sequences.safe_range(F.lit(0), F.col("n") - 5)))
    window = lambda c: F.get(F.col(c), F.col("st") + 2) + F.get(F.col(c), F.col("st") + 3) + F.get(F.col(c), F.col("st") + 4)
    expected = ratio(window("chx") * F.col("ltm_total"), F.col("chx_total"))
    rows = at.select("trx", F.col("st").cast("bigint").alias("st"), window("ltm").alias("ltm_sum"), expected.alias("expected"))
    c, e = F.col("ltm_sum"), F.col("expected")
    ok = e.isNotNull() & (c >= least_reads) & (c - e >= least_diff) & (c >= e * least_ratio)
    return rows.withColumn("is_start", F.coalesce(ok, F.lit(False)))


def grouped_sums(counts: Column, at: Column, groups: tuple[tuple[int, ...], ...] = GROUPS) -> Column:
    """Array of the sums of each group of offsets; null if any offset leaves the profile."""
    low, high = min(map(min, groups)), max(map(max, groups))
    inside = (at + low >= 0) & (at + high < F.size(counts))
    sums = [reduce(lambda a, b: a + b, [F.get(counts, at + o) for o in g]) for g in groups]
    return F.when(inside, F.array(*[s.cast("double") for s in sums]))


def start_features(
    profiles: DataFrame, at: Column, samples: list[str], least_total: int = 50, groups: tuple[tuple[int, ...], ...] = GROUPS
) -> DataFrame:
    """Adds features: the samples' grouped sums, concatenated and scaled to unit length; null below least_total or off the profile."""
    parts = [grouped_sums(F.col(s), at, groups) for s in samples]
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    scaled = F.transform(F.array(F.concat(*parts)), lambda v: F.when(total(v) >= least_total, l2_normalized(v)))
    # sums are a function's argument and features come from a generator: both are worked out once, however often they are used
    return profiles.select(*[c for c in profiles.columns if c != "features"], F.explode(F.array(F.get(scaled, F.lit(0)))).alias("features"))


def training_positions(items: DataFrame) -> DataFrame:
    """items (with cds_start) at the start (label 1) and at fixed distances from it (label 0): adds at and label."""
    shifts = F.array(F.lit(0), *[F.lit(k) for k in NEGATIVES])
    return items.withColumn("shift", F.explode(shifts)).withColumn("at", F.col("cds_start") + F.col("shift")).withColumn("label", (F.col("shift") == 0).cast("double")).drop("shift")


def call_starts(model: svm.Model, rows: DataFrame) -> DataFrame:
    """Adds score (null without features) and called (score > 0)."""
    return svm.scored(model, rows).withColumn("called", F.coalesce(F.col("score") > 0, F.lit(False)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of a column of lists as doubles (null: NaN), and where each list begins and how long it is; -1 for null."""
    begins = column.offsets.to_numpy()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(begins), -1)
    return column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), begins[:-1].astype(np.int64), sizes.astype(np.int64)


def called_positions(
    model: svm.Model, profiles: DataFrame, samples: list[str], least_total: int = 50, groups: tuple[tuple[int, ...], ...] = GROUPS, part: int = 4096
) -> DataFrame:
    """profiles at each position 0 .. length of the first sample, the last included: adds at, score and called.

    The same as every_position, start_features and call_starts, which make a row of each position first. Here a profile goes to Python
    whole and once, and `part` positions at a time have their features there.
    """
    low, high = min(map(min, groups)), max(map(max, groups))

    def scores(*columns: pa.Array) -> pa.Array:
        lists = [_lists(c) for c in columns]
        sizes = lists[0][2]
        ends = np.cumsum(sizes + 1)  # of each profile's scores
        out, known = np.zeros(ends[-1] if len(ends) else 0), np.zeros(ends[-1] if len(ends) else 0, bool)
        first = max(0, -low)
        last = np.minimum(sizes, np.min([n for _, _, n in lists], axis=0) - high - 1)  # of the positions that have all offsets
        inside = np.maximum(last - first + 1, 0)
        upto = np.cumsum(inside)
        for begin in range(0, upto[-1] if len(upto) else 0, part):
            k = np.arange(begin, min(begin + part, upto[-1]))
            row = np.searchsorted(upto, k, side="right")
            at = first + k - (upto - inside)[row]
            x = np.column_stack([reduce(np.add, [values[begins[row] + at + o] for o in g]) for values, begins, _ in lists for g in groups])
            enough = x.sum(axis=1) >= least_total
            x = x[enough]
            norm = np.sqrt((x * x).sum(axis=1))[:, None]
            place = ((ends - sizes - 1)[row] + at)[enough]
            out[place] = model.scores(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
            known[place] = True
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out, mask=~known), mask=pa.array(sizes < 0))

    found = F.arrow_udf(scores, "array<double>")(*[F.col(s) for s in samples])
    rows = profiles.select("*", F.posexplode(found).alias("at", "score"))  # not from a column: Spark would ask for its size first and score twice
    return rows.withColumn("called", F.coalesce(F.col("score") > 0, F.lit(False)))


def every_position(items: DataFrame, length: Column) -> DataFrame:
    """items at each position 0 .. length, the last included: adds at."""
    return items.withColumn("at", F.explode(sequences.safe_range(F.lit(0), length.cast("int"))))


def score_buckets(called: DataFrame) -> DataFrame:
    """Adds bucket (tp, fp, tn, fn) to rows of label and called; rows without a score count as not called."""
    actual = F.col("label") > 0
    return called.withColumn("bucket", F.when(actual & F.col("called"), "tp").when(F.col("called"), "fp").when(actual, "fn").otherwise("tn"))


def write_scores(bucketed: DataFrame, path: str) -> None:
    """Scores as text in one folder for each bucket, one a line; NaN where there is none."""
    bucketed.select("bucket", F.coalesce(F.col("score").cast("string"), F.lit("NaN")).alias("value")).write.partitionBy("bucket").mode("errorifexists").text(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """bucket and score (null where there is none)."""
    rows = spark.read.text(path)
    return rows.select("bucket", F.when(F.col("value") != "NaN", F.col("value").cast("double")).alias("score"))


def predicted(positions: DataFrame, a: DataFrame | None, b: DataFrame | None) -> DataFrame:
    """positions (trx, nt) with a and b of two predictors (trx, nt, called); the column of a missing predictor is null.

    A position that a predictor has no row for is not called by it.
    """
    out = positions
    for name, rows in (("a", a), ("b", b)):
        if rows is None:
            out = out.withColumn(name, F.lit(None).cast("boolean"))
        else:
            out = out.join(rows.select("trx", "nt", F.col("called").alias(name)), ["trx", "nt"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def called_by_either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions that one of two predictors (trx, nt, called) calls: trx, nt and whether a and b do. All others are of no peak."""
    no = F.lit(False)
    rows = a.filter("called").select("trx", "nt", F.col("called").alias("a"), no.alias("b")).unionByName(b.filter("called").select("trx", "nt", no.alias("a"), F.col("called").alias("b")))
    return rows.groupBy("trx", "nt").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def write_caller(model: svm.Model, samples: list[str], least_total: int, path: str, groups: tuple[tuple[int, ...], ...] = GROUPS) -> None:
    """The trained model and what its features were made of, as a folder."""
    svm.write(model, {"samples": samples, "least_total": least_total, "groups": [list(g) for g in groups]}, path)


def read_caller(spark: SparkSession, path: str) -> tuple[svm.Model, dict]:
    """The model and its configuration: samples, least_total and groups of offsets, as start_features takes them."""
    return svm.read(spark, path)


def pars_windows(items: DataFrame) -> DataFrame:
    """Sums of 30 scores around a CDS start: gene, size, total, average, first30, start30, max30_pos, max30, plus15 .. plus75.

    items: gene, start, scores. Genes whose start is 0 are left out; windows that leave the scores are null.
    """
    start, n = F.col("start"), F.size("scores")
    total = lambda low, count: F.aggregate(F.slice(F.col("scores"), (low + 1).cast("int"), F.lit(count) if isinstance(count, int) else count.cast("int")), F.lit(0.0), lambda s, x: s + x)
    spans = F.transform(F.when(start >= 18, sequences.safe_range(F.lit(18), start)), lambda i: F.struct(total(start - i, 30).alias("sum"), i.alias("i")))
    best = F.array_max(spans)  # of equal sums the farthest from the start
    plus = [F.when((start + c >= 14) & (n > start + c + 15), total(start + c - 14, 30)).alias(f"plus{c}") for c in (15, 30, 45, 60, 75)]
    return items.filter(start > 0).withColumn("best", best).select(
        "gene", (start + 1).cast("bigint").alias("size"), total(F.lit(0), start).alias("total"), (total(F.lit(0), start) / (start + 1)).alias("average"),
        F.when(n >= 30, total(F.lit(0), 30)).alias("first30"),
        F.when((start >= 15) & (n > start + 15), total(F.greatest(start - 15, F.lit(0)), 30)).alias("start30"),
        (-F.col("best.i")).cast("bigint").alias("max30_pos"), F.col("best.sum").alias("max30"), *plus,
    )


def bedpe_fate(row: dict[str, Column], most: int = 1_000_000) -> Column:
    """Fate of a read pair: row has ref1, left1, right1, strand1 and the same with 2; '.' is an unmapped mate."""
    r = row
    none1, none2 = r["ref1"] == ".", r["ref2"] == "."
    forward = (r["strand1"] == "+") & (r["strand2"] == "-")
    low, high = F.when(forward, r["left1"]).otherwise(r["left2"]), F.when(forward, r["right2"]).otherwise(r["right1"])
    return (
        F.when(none1 & none2, "nomatch")
        .when(none1 | none2, "onematch")
        .when(r["ref1"] != r["ref2"], "diffchr")
        .when(r["strand1"] == r["strand2"], "samestrand")
        .when(low + most <= high, "toolong")
        .when(low <= high, "good")
        .otherwise("inverted")
    )
