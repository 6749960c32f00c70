"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which separate words.
BLANKS = " \t\n\u000b\f\r"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="translatome-"))
    return f"file://{_own_dir[0]}"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of 4 MB, whatever their number: the default allows 64 MB in the JVM and in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, is computed once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/translatome-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ as bigint; null text has none.

    Texts whose words are parted by single blanks are counted without a regular expression.
    """
    flat = F.btrim(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    counted = (
        F.when(F.length(flat) == 0, F.lit(0))
        .when(F.instr(flat, "  ") > 0, F.regexp_count(flat, F.lit("[^ ]+")))
        .otherwise(spaces + 1)
    )
    return F.coalesce(counted, F.lit(0)).cast("bigint")


def without_blanks(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that long texts can't fill a worker's memory."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows < 2 or col.nbytes <= most:
            yield batch
            continue
        step = max(1, int(batch.num_rows * most / col.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
