"""Exact deduplication by a persistent digest index, in DataFrame operations only.

The index is a Parquet table, bucketed and sorted by digest. A batch of documents is first reduced to one row
per digest; those rows are anti-joined against the index bucket by bucket and appended to it. A new index gets as many buckets as
its first batch has rows for; `compacted` rewrites one that has grown, with one sorted file for each bucket.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Of equal texts in a
batch the row with the most code points stays, then the smallest doc_id; texts that the index has from an earlier
batch don't stay. Defined cases: a null text counts as empty, and all empty texts are equal; rows that repeat
(same doc_id and text) are all marked as their group's keeper, and `deduplicated` returns one of them; a null
doc_id loses against others; very long texts are hashed whole; an empty batch leaves the index as it is; further columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.llm.common import shared_dir, without_blanks, written


#: Buckets of an index at least, and the rows that one is meant for.
LEAST_BUCKETS, ROWS_A_BUCKET = 64, 5_000_000


def buckets_for(n: int) -> int:
    return max(LEAST_BUCKETS, -(-n // ROWS_A_BUCKET))


class DigestIndex:
    """A persistent index of digests at `path`, in `buckets` buckets."""

    SCHEMA = "text_sha256 string, keep_id bigint, group_size bigint, batch string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet CLUSTERED BY (text_sha256) "
            f"SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def append(self, groups: DataFrame) -> str:
        """Adds what the index lacks of `groups` (text_sha256, keep_id, group_size); returns the batch's name."""
        batch = uuid.uuid4().hex
        known = self.spark.table(self.table).select("text_sha256")
        new = groups.join(known.hint("merge"), "text_sha256", "left_anti")
        self._add(new.select("text_sha256", "keep_id", "group_size", F.lit(batch).alias("batch")))
        return batch

    def _add(self, rows: DataFrame) -> None:
        (
            rows.repartition(self.buckets, "text_sha256")
            .write.format("parquet")
            .bucketBy(self.buckets, "text_sha256")
            .sortBy("text_sha256")
            .mode("append")
            .option("path", self.path)
            .saveAsTable(self.table)
        )

    def compacted(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same index at another path, each bucket one sorted file; by default as many buckets as its rows need now."""
        new = DigestIndex(self.spark, path, buckets or buckets_for(self.rows().count()))
        new._add(self.rows())
        return new

    def unregistered(self) -> None:
        """Takes the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def rows(self) -> DataFrame:
        """The index read as plain files, so that joins against hot digests can be split at run time."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points of the text) and text_sha256 for each row."""
    return docs.select("doc_id", F.length("text").alias("n"), F.sha2(without_blanks(F.col("text")), 256).alias("text_sha256"))


def groups_of(digests: DataFrame) -> DataFrame:
    """One row per digest: who stays, and how many rows have it. Partial aggregation takes hot groups."""
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id")))
    return (
        digests.withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    )


def _appended(groups: DataFrame, index: DigestIndex | None, n: int) -> tuple[DataFrame, str]:
    """The index's rows and the batch's name, after `groups` went to the index or to a new one for n rows."""
    spark = groups.sparkSession
    own = index is None
    if index is None:
        index = DigestIndex(spark, f"{shared_dir(spark)}/translatome-digests-{uuid.uuid4().hex}", buckets_for(n))
    batch = index.append(groups)
    if own:
        index.unregistered()
    return index.rows(), batch


def decided(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; appends to the index (a new one if None).

    Texts are read and hashed once: digests are written, and both the groups and the rows come from there.
    """
    rows = written(digests_of(docs), "digests")
    known, batch = _appended(groups_of(rows), index, rows.count())
    kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.drop("n").join(known, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    known, batch = _appended(groups_of(digests_of(docs)), index, docs.count() if index is None else 0)
    # the join and the removal of repeated rows have the same keys, so that one exchange of the rows serves both
    id_keys = lambda c: [F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("none")]
    keepers = known.filter(F.col("batch") == batch).select(F.col("text_sha256").alias("digest"), *id_keys(F.col("keep_id")))
    digest = F.sha2(without_blanks(F.col("text")), 256).alias("digest")
    mine = docs.select(digest, *id_keys(F.col("doc_id").cast("bigint")), F.struct("*").alias("row"))
    keys = ["digest", "id", "none"]
    return mine.join(keepers, keys, "left_semi").dropDuplicates(keys).select("row.*")
