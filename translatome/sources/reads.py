"""FASTQ and FASTA."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from translatome.functions import sequences


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file and line (from 0 in each file) of text files, from counts of lines in each split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # ids are compared within one pass over a split only: another pass may deal splits to other tasks
    own = Window.partitionBy("file", "split").orderBy("id")
    placed = lines.withColumn("id", F.monotonically_increasing_id()).withColumn("at", F.row_number().over(own) - 1)
    return placed.join(splits, ["file", "split"]).select("value", "file", (F.col("at") + F.col("first")).alias("line"))


def prefixed(spark: SparkSession, path: str | list[str], head: Column) -> DataFrame:
    """value, file, line, head (the last non-null head up to the line) and before (letters of lines without a head since then).

    Sums run within splits; one row for each split carries them on.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")
    )
    within = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("own", head).withColumn("letters", F.when(F.col("own").isNull(), F.length("value")).otherwise(0))
    own = own.withColumn("part", F.count("own").over(within)).withColumn("near", F.last("own", ignorenulls=True).over(within))
    run = Window.partitionBy("file", "split", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("letters").over(run), F.lit(0)))
    tail = own.groupBy("file", "split", "part").agg(F.sum("letters").alias("n"), F.max_by("near", "line").alias("near"))
    splits = tail.groupBy("file", "split").agg(F.max_by("n", "part").alias("n"), F.max_by("near", "part").alias("near"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("far", F.last("near", ignorenulls=True).over(before)).withColumn("block", F.count("near").over(upto))
    # what the splits since the last head hold: the one with the head has block b, as have those after it without one
    same = Window.partitionBy("file", "block").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    splits = splits.withColumn("total", F.sum("n").over(same))
    splits = splits.withColumn("carried", F.coalesce(F.lag("total").over(Window.partitionBy("file").orderBy("split")), F.lit(0)))
    joined = own.join(splits.select("file", "split", "far", "carried"), ["file", "split"])
    first = F.col("part") == 0
    return joined.select(
        "value", "file", "line", F.when(first, F.col("far")).otherwise(F.col("near")).alias("head"), F.col("own").isNotNull().alias("is_head"),
        (F.col("inside") + F.when(first, F.col("carried")).otherwise(0)).alias("before"),
    )


def read_fasta_chunks(spark: SparkSession, path: str | list[str], size: int = 65536) -> DataFrame:
    """ref, chunk and text: the sequence of each reference, upper case, in pieces of `size` bases, whatever its lines are."""
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", "^>\\s*(\\S+)", 1))
    lines = prefixed(spark, path, head).filter("not is_head and head is not null and value <> ''")
    at, n = F.col("before"), F.length("value")
    dealt = lines.select(F.col("head").alias("ref"), at.alias("at"), F.upper("value").alias("value"), F.explode(F.sequence(F.floor(at / size), F.floor((at + n - 1) / size))).alias("chunk"))
    low, high = F.greatest(F.col("chunk") * size, F.col("at")), F.least((F.col("chunk") + 1) * size, F.col("at") + F.length("value"))
    piece = F.struct(low.alias("low"), F.substr("value", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("text"))
    body = F.sort_array(F.collect_list(piece))
    return dealt.groupBy("ref", "chunk").agg(body.alias("body")).select("ref", "chunk", F.array_join(F.transform("body", lambda b: b["text"]), "").alias("text"))


def fetched(regions: DataFrame, chunks: DataFrame, key: str, size: int = 65536) -> DataFrame:
    """key and seq of spliced regions (key, ref, strand, blocks) from chunks of references, by an equi-join on the chunks that blocks touch.

    Bases beyond a reference are left out; a region without any base there has no row.
    """
    block = regions.select(key, "ref", "strand", F.explode("blocks").alias("b"))
    at, end = F.col("b.start"), F.col("b.start") + F.col("b.len")
    dealt = block.filter("b.len > 0").select(key, "ref", "strand", at.alias("at"), end.alias("end"), F.explode(F.sequence(F.floor(at / size), F.floor((end - 1) / size))).alias("chunk"))
    low, high = F.greatest(F.col("chunk") * size, F.col("at")), F.least((F.col("chunk") + 1) * size, F.col("end"))
    piece = F.struct(low.alias("low"), F.substr("text", (low - F.col("chunk") * size + 1).cast("int"), (high - low).cast("int")).alias("text"))
    found = dealt.join(chunks, ["ref", "chunk"]).groupBy(key, "strand").agg(F.sort_array(F.collect_list(piece)).alias("body"))
    joined = F.array_join(F.transform("body", lambda b: b["text"]), "")
    return found.select(key, F.when(F.col("strand") == "-", sequences.reverse_complement(joined)).otherwise(joined).alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name (without @), seq, qual, file and ord; a record that isn't four lines, or starts with no @, is an error."""
    lines = numbered(spark, path)
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    rows = lines.groupBy("file", F.floor(F.col("line") / 4).alias("ord")).agg(part(0).alias("head"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("qual"))
    ok = F.coalesce(F.col("head").startswith("@") & F.col("plus").startswith("+") & F.col("qual").isNotNull(), F.lit(False))
    trailing = F.col("seq").isNull() & (F.col("head") == "")
    checked = rows.filter(~F.coalesce(trailing, F.lit(False))).withColumn(
        "name", F.when(ok, F.substr(F.col("head"), F.lit(2), F.length("head"))).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), "head")).cast("string"))
    )
    return checked.select("name", "seq", "qual", "file", "ord")


def fastq_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual"))


def write_fastq_by_sample(df: DataFrame, path: str, sample: str = "fate") -> None:
    """FASTQ text in one folder for each sample; the path must not exist."""
    fastq_lines(df).select(sample, "value").write.partitionBy(sample).mode("errorifexists").text(path)


def write_split_fastq(df: DataFrame, path: str, settings: dict) -> None:
    """Demultiplexed reads (fate, new_name, insert and insert_qual; name, seq and qual) under a path that must not exist.

    samples/fate=... has the named inserts of each sample and of UnknownIndex, tooshort the reads of which nothing is left, as they came, and
    config.txt the settings, one a line. That is written last: readers take a folder without it as unfinished.
    """
    short = F.col("fate") == "TooShort"
    kept = df.filter(~short).select("fate", F.col("new_name").alias("name"), F.col("insert").alias("seq"), F.col("insert_qual").alias("qual"))
    write_fastq_by_sample(kept, f"{path}/samples")
    fastq_lines(df.filter(short).select(F.col("name").cast("string").alias("name"), "seq", "qual")).select("value").write.mode("errorifexists").text(f"{path}/tooshort")
    lines = [(f"{k}\t{json.dumps(v)}",) for k, v in sorted(settings.items())]
    df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/config.txt")


def read_split_fastq(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """name, seq, qual and fate of what write_split_fastq wrote, and its settings."""
    try:
        settings = {k: json.loads(v) for k, v in (r.value.split("\t", 1) for r in spark.read.text(f"{path}/config.txt").collect())}
    except AnalysisException as e:
        raise ValueError(f"{path} is not finished: it has no config.txt") from e
    own = read_fastq(spark, f"{path}/samples/*").withColumn("fate", F.url_decode(F.url_decode(F.regexp_extract("file", "/fate=([^/]*)/", 1))))
    short = read_fastq(spark, f"{path}/tooshort").withColumn("fate", F.lit("TooShort"))
    return own.unionByName(short).select("name", "seq", "qual", "fate"), settings


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ref (first word of the head line) and seq, upper case, of each record."""
    lines = numbered(spark, path)
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.when(F.col("value").startswith(">"), F.col("line"))
    owned = lines.withColumn("head", F.max(heads).over(upto))
    name = F.max(F.when(F.col("line") == F.col("head"), F.regexp_extract("value", "^>\\s*(\\S+)", 1)))
    body = F.sort_array(F.collect_list(F.when(F.col("line") != F.col("head"), F.struct("line", F.trim("value").alias("text")))))
    return owned.groupBy("file", "head").agg(name.alias("ref"), body.alias("body")).select("ref", F.upper(F.array_join(F.transform("body", lambda b: b["text"]), "")).alias("seq"))


def spliced(seq: Column, blocks: Column, strand: Column) -> Column:
    """The sequence of blocks of a reference's sequence, reverse-complemented on the minus strand."""
    joined = F.array_join(F.transform(blocks, lambda b: F.substr(seq, (b["start"] + 1).cast("int"), b["len"].cast("int"))), "")
    return F.when(strand == "-", sequences.reverse_complement(joined)).otherwise(joined)


def padded(seq: Column, low: Column, high: Column) -> Column:
    """seq[low .. high] with N for positions that it lacks; low <= high."""
    left = F.repeat(F.lit("N"), F.greatest(F.least(-low, high - low + 1), F.lit(0)).cast("int"))
    body = F.substr(seq, (F.greatest(low, F.lit(0)) + 1).cast("int"), F.greatest(high - F.greatest(low, F.lit(0)) + 1, F.lit(0)).cast("int"))
    return F.rpad(F.concat(left, body), (high - low + 1).cast("int"), F.lit("N"))
