"""Barcodes: distances, generation, selection, demultiplexing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.functions import sequences

#: Barcodes that a selection may start from; the pairs of their distances are a small matrix on the driver.
MOST_CANDIDATES = 5000
#: Samples whose indexes (some 40 each, of one mismatch) are broadcast.
FEW = 10_000


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of two barcode lists (name, seq; at most thousands) with their distance."""
    left = a.select(F.col("name").alias("name_a"), F.col("seq").alias("seq_a"))
    right = b.select(F.col("name").alias("name_b"), F.col("seq").alias("seq_b"))
    return left.crossJoin(right).withColumn("distance", sequences.hamming(F.col("seq_a"), F.col("seq_b")))


def _close(some: DataFrame, every: DataFrame, most: int, least: int) -> DataFrame:
    """Pairs (seq_a of some, seq_b, first_b of every) of different sequences with at most `most` mismatches, some others too.

    Of most + 1 pieces of the first `least` letters, such a pair has one in common.
    """
    cuts = [i * least // (most + 1) for i in range(most + 2)]
    pieces = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.substr(F.col("seq"), F.lit(a + 1), F.lit(b - a)).alias("t")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]))
    left = some.select(F.col("seq").alias("seq_a"), pieces.alias("piece"))
    right = every.select(F.col("seq").alias("seq_b"), F.col("first").alias("first_b"), pieces.alias("piece"))
    return left.join(right, "piece").filter("seq_a != seq_b").select("seq_a", "seq_b", "first_b")


def nearest(barcodes: DataFrame, order: str = "name") -> DataFrame:
    """For each barcode (name, seq; distinct names, case ignored, null sequences left out) the other one at the least distance.

    On ties the first by `order`: the name, or a column with the place in the input, say.

    Equal sequences are found by grouping. For the others, pairs of distinct sequences that share one of 2, 4, 8, ... pieces are
    compared until each has a neighbour; what shares no letter in place with any other (no two of those start with the same
    letter, so they are no more than the alphabet) is compared with all.
    """
    named = barcodes.filter("seq is not null").select(F.struct(F.col(order).alias("at"), "name").alias("own"), F.upper("seq").alias("seq"))
    groups = named.groupBy("seq").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
    least = groups.agg(F.min(F.length("seq")).alias("least")).first().least or 0
    left, found = groups.filter("n = 1").select("seq"), None

    def best(pairs: DataFrame, most: int | None) -> DataFrame:
        rows = pairs.withColumn("distance", sequences.hamming(F.col("seq_a"), F.col("seq_b"), ignore_case=False))
        rows = rows if most is None else rows.filter(F.col("distance") <= most)
        return rows.groupBy(F.col("seq_a").alias("seq")).agg(F.min(F.struct("distance", F.col("first_b").alias("nearest"))).alias("best"))

    most = min(1, least - 1)
    while most >= 0:
        own = best(_close(left, groups, most, least), most)
        found = own if found is None else found.unionByName(own)
        left = left.join(own.select("seq"), "seq", "left_anti")
        most = -1 if most == least - 1 else min(2 * most + 1, least - 1)
    rest = F.broadcast(left.withColumnRenamed("seq", "seq_a")) if least else left.withColumnRenamed("seq", "seq_a")
    own = best(groups.select(F.col("seq").alias("seq_b"), F.col("first").alias("first_b")).join(rest, F.col("seq_a") != F.col("seq_b")), None)
    single = own if found is None else found.unionByName(own)
    several = groups.filter("n > 1").select("seq", "first")
    second = named.join(several, "seq").filter("own != first").groupBy("seq", "first").agg(F.min("own").alias("second"))
    other_one = F.when(F.col("own") == F.col("first"), F.col("second.name")).otherwise(F.col("first.name"))
    equal = named.join(second, "seq").select(F.col("own.name").alias("name"), other_one.alias("nearest"), F.lit(0).cast("bigint").alias("distance"))
    other = named.join(single, "seq").select(F.col("own.name").alias("name"), F.col("best.nearest.name").alias("nearest"), F.col("best.distance").alias("distance"))
    return equal.unionByName(other)


def generated(spark: SparkSession, length: int) -> DataFrame:
    """All sequences in which each base differs from the two before it: 4, 12, 24, 48, ... of them."""
    return grown(spark.range(1).select(F.lit("").alias("seq")), length)


def grown(stems: DataFrame, more: int) -> DataFrame:
    """seq: each distinct stem (seq) with all tails of `more` bases of which each differs from the two before it."""
    alphabet = F.array(*[F.lit(b) for b in sequences.BASES[:4]])
    out = stems.select("seq").distinct()
    for _ in range(more):
        grown = out.select("seq", F.explode(alphabet).alias("base"))
        fresh = (F.substr(F.col("seq"), F.greatest(F.length("seq") - 1, F.lit(1)), F.lit(2)).contains(F.col("base"))) == F.lit(False)
        out = grown.filter(fresh).select(F.concat("seq", "base").alias("seq"))
    return out


def pool(candidates: DataFrame, extant: DataFrame) -> DataFrame:
    """seq, extant: each sequence of either list once; one that is in both is extant."""
    both = extant.select("seq", F.lit(True).alias("extant")).union(candidates.select("seq", F.lit(False)))
    return both.groupBy("seq").agg(F.max("extant").alias("extant"))


def selected(candidates: DataFrame, extant: DataFrame, least: int) -> DataFrame:
    """Greedy selection: extant barcodes first, then always the one that rules out the fewest others (distance < least)."""
    spark = candidates.sparkSession
    rows = pool(candidates, extant).orderBy(F.col("extant").desc(), "seq").limit(MOST_CANDIDATES + 1).collect()
    if len(rows) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} barcodes to select from")
    every, old = [r.seq for r in rows], [r.seq for r in rows if r.extant]
    width = max(map(len, every), default=0)
    letters = np.array([list(s.upper().ljust(width)) for s in every]).reshape(len(every), width)
    near = (letters[:, None, :] != letters[None, :, :]).sum(axis=2) < least
    active, picked = np.ones(len(every), bool), []
    for i in range(len(old)):
        picked.append(i)
        active &= ~near[i]
    while active.any():
        cost = np.where(active, (near & active[None, :]).sum(axis=1), np.iinfo(np.int64).max)
        i = int(cost.argmin())
        picked.append(i)
        active &= ~near[i]
    return spark.createDataFrame([(k, every[i], i < len(old)) for k, i in enumerate(picked)], "ord int, seq string, extant boolean")


def parse_layout(layout: str) -> list[tuple[int, str]]:
    """Slots of a linker: (1-based position, I or N)."""
    if set(layout) - {"I", "N"}:
        raise ValueError(f"a linker consists of I and N, not {layout!r}")
    return [(k + 1, c) for k, c in enumerate(layout)]


def split_linker(seq: Column, qual: Column, prefix: str, suffix: str, least_insert: int = 0) -> Column:
    """struct<short, barcode, sample_index, insert, insert_qual> of a read with linkers at both ends."""
    ends = len(prefix) + len(suffix)
    n = F.length(seq)
    tail = n - len(suffix)

    def slots(kind: str) -> Column:
        own = [F.substr(seq, F.lit(k), F.lit(1)) for k, c in parse_layout(prefix) if c == kind]
        own += [F.substr(seq, tail + k, F.lit(1)) for k, c in parse_layout(suffix) if c == kind]
        return F.concat(*own) if own else F.lit("")

    short = (n < ends) | (n - ends < least_insert)
    cut = lambda s: F.substr(s, F.lit(len(prefix) + 1), F.greatest(n - ends, F.lit(0)))
    return F.struct(
        short.alias("short"), F.when(~short, slots("N")).alias("barcode"), F.when(~short, F.upper(slots("I"))).alias("sample_index"),
        F.when(~short, cut(seq)).alias("insert"), F.when(~short, cut(qual)).alias("insert_qual"),
    )


def sample_lookup(samples: DataFrame, perfect: bool = False) -> DataFrame:
    """idx, sample, sample_idx: each sample's index and all of one mismatch; indexes that two samples claim are an error."""
    own = samples.select(F.upper("idx").alias("idx"), F.col("name").alias("sample"), F.upper("idx").alias("sample_idx"))
    if perfect:
        every = own
    else:
        every = own.union(own.select(F.explode(sequences.neighbours(F.col("sample_idx"))).alias("idx"), "sample", "sample_idx"))
    owners = every.groupBy("idx").agg(F.min("sample").alias("sample"), F.min("sample_idx").alias("sample_idx"), F.count_distinct("sample").alias("n"))
    clash = F.raise_error(F.concat(F.lit("samples clash on index "), F.col("idx"))).cast("boolean")
    return owners.filter(F.when(F.col("n") > 1, clash).otherwise(True)).drop("n")


def demultiplexed(fastq: DataFrame, samples: DataFrame, prefix: str, suffix: str, least_insert: int = 0) -> DataFrame:
    """fastq (name, seq, qual) with fate (a sample, UnknownIndex or TooShort), barcode, insert and mismatches.

    The indexes of up to FEW samples are broadcast, a sheet of more is joined as Spark sees fit.
    """
    split = fastq.withColumn("s", split_linker(F.col("seq"), F.col("qual"), prefix, suffix, least_insert)).select(*fastq.columns, "s.*")
    lookup = sample_lookup(samples)
    if samples.limit(FEW + 1).count() <= FEW:
        lookup = F.broadcast(lookup)
    joined = split.join(lookup, split["sample_index"] == F.col("idx"), "left").drop("idx")
    fate = F.when(F.col("short"), "TooShort").when(F.col("sample").isNull(), "UnknownIndex").otherwise(F.col("sample"))
    mismatches = F.when(F.col("sample").isNotNull(), sequences.hamming(F.col("sample_index"), F.col("sample_idx"), ignore_case=False))
    return joined.withColumn("fate", fate).withColumn("mismatches", mismatches)


def renamed(demultiplexed_rows: DataFrame) -> DataFrame:
    """Adds new_name: first word # barcode, the rest of the name, and index:mismatches:sample index; the index of no sample is all N."""
    words = F.split("name", " ")
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    none = F.repeat(F.lit("N"), F.length("sample_index"))
    off = F.coalesce(F.col("mismatches"), sequences.hamming(F.col("sample_index"), none, ignore_case=False))
    mark = F.concat_ws(":", "sample_index", off.cast("string"), F.coalesce("sample_idx", none))
    head = F.concat(F.get(words, F.lit(0)), F.lit("#"), F.col("barcode"))
    return demultiplexed_rows.withColumn("new_name", F.concat_ws(" ", head, F.when(rest != "", rest), mark))


def fates(rows: DataFrame) -> DataFrame:
    """fate, n and percent of all reads."""
    counts = rows.groupBy("fate").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("fate", "n", (100 * F.col("n") / F.col("t")).alias("percent"))


def barcode_counts(rows: DataFrame, length: int) -> DataFrame:
    """sample, barcode, n over all 5^length barcodes of each sample, zeros included."""
    kept = rows.filter("sample is not null")
    grid = kept.select("sample").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5**length - 1))))
    grid = grid.select("sample", sequences.from_base5(F.col("k"), F.lit(length)).alias("barcode"))
    counts = kept.groupBy("sample", "barcode").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["sample", "barcode"], "left").na.fill(0, ["n"])
