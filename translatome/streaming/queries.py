"""Streaming forms over a folder of Parquet files, run to the end of what is there (trigger availableNow).

State is kept by Spark in the checkpoint folder that the caller names; results are the same as those of the batch operators
on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.plans.registry import query
from translatome.sources import folders


def position_windows(reads: DataFrame, size: int, step: int) -> DataFrame:
    """Counts of a stream of reads (ref, pos, nh) in sliding position windows; state is one row for each window."""
    first = F.greatest(F.floor((F.col("pos") - size) / step) + 1, F.lit(0))
    dealt = reads.filter("pos >= 0").withColumn("w", F.explode(F.sequence(first, F.floor(F.col("pos") / step))))
    return dealt.groupBy("ref", (F.col("w") * step).alias("win_start")).agg(
        F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("nh") == 1, 1)).alias("uniq")
    )


def first_of_site(reads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Reads of a stream (ts, ref, pos, strand, tag) without those that repeat a site and tag within the watermark's delay."""
    return reads.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ref", "pos", "strand", "tag"])


def event_windows(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts of a stream of events (ts, event_type) by tumbling event-time window; late events beyond the delay are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Runs a streaming DataFrame over all that is available, giving each batch to sink."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("""SELECT CAST(event_id % 50 AS BIGINT) AS ref, CAST((CAST(round(value * 100) AS BIGINT) // 1000) * 1000 AS BIGINT) AS win_start, count(*) AS raw,
 count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS uniq FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position windows of reads, counted by a stream and read back from the table that it completes."""
    e = F.col("event_id")
    reads = _event_stream(spark, sf_dir).select((e % 50).alias("ref"), F.round(F.col("value") * 100).cast("bigint").alias("pos"), (1 + e % 3).alias("nh"))
    folder = folders.fresh(spark, "stream")
    run_available(position_windows(reads, 1000, 1000), lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/state", "complete")
    return spark.read.parquet(f"{folder}/out")


@query("""SELECT event_type, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) // 3600 AS hour, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of events, counted by a stream with a watermark."""
    folder = folders.fresh(spark, "stream")
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = event_windows(events).select("event_type", F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "n")
    run_available(counts, lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/state", "complete")
    return spark.read.parquet(f"{folder}/out")
