"""Duplicates of a stream of alignments that comes in order of place, but for some that are late.

A stream's batches move along each reference. A read more than `reach` before the furthest place that earlier batches have seen on its reference is late:
it is put aside, neither kept nor compared. Of all other reads with one site and tag the first is kept, whatever batches they come in. So a site needs
no state once a read there would be late: state is the sites within `reach` of the furthest places, and those places.

Each batch writes its results and the state after it as tables under its number and reads the state of the batch before, so a
batch that is run again after a failure replaces what it wrote. All steps are joins and aggregations by site: a hot reference is many sites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.operators.duplicates import SITE
from translatome.plans import views
from translatome.plans.registry import query
from translatome.sources import folders
from translatome.streaming.queries import run_available

FATES = ("kept", "duplicate", "late")


def _state(spark: SparkSession, folder: str, batch: int, schema: str, name: str) -> DataFrame:
    """What the batch before wrote; nothing before the first."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}/{batch - 1}") if batch else spark.createDataFrame([], schema)


def suppressing(folder: str, reach: int, site: list[str] = SITE) -> Callable[[DataFrame, int], None]:
    """A sink of batches of reads (read_ord, tag and the site's columns): reads with their fate under folder/fates.

    Untagged reads and those with a null in their site are kept.
    """
    key = [*site, "tag"]

    def sink(reads: DataFrame, batch: int) -> None:
        spark = reads.sparkSession
        kinds = dict(reads.dtypes)
        seen = _state(spark, folder, batch, ", ".join(f"{c} {kinds[c]}" for c in key), "sites")
        clocks = _state(spark, folder, batch, f"ref {kinds['ref']}, furthest {kinds['pos']}", "clocks")
        late = F.coalesce(F.col("pos") < F.col("furthest") - reach, F.lit(False))
        marked = reads.join(clocks, "ref", "left").withColumn("_late", late).drop("furthest")
        marked.write.mode("overwrite").parquet(f"{folder}/marked/{batch}")
        marked = spark.read.schema(marked.schema).parquet(f"{folder}/marked/{batch}")

        known = F.coalesce(F.col("tag"), F.lit("")) != ""
        for c in site:
            known &= F.col(c).isNotNull()
        own = marked.filter(known & ~F.col("_late"))
        new = own.groupBy(*key).agg(F.min("read_ord").alias("_first")).join(seen, key, "left_anti")
        fates = own.join(new, key, "left").withColumn("fate", F.when(F.col("read_ord") == F.col("_first"), "kept").otherwise("duplicate")).drop("_first")
        rest = marked.filter(~known | F.col("_late")).withColumn("fate", F.when(F.col("_late"), "late").otherwise("kept"))
        fates.unionByName(rest).drop("_late").write.mode("overwrite").partitionBy("fate").parquet(f"{folder}/fates/batch={batch}")

        after = clocks.unionByName(marked.groupBy("ref").agg(F.max("pos").alias("furthest"))).filter("ref IS NOT NULL AND furthest IS NOT NULL")
        after.groupBy("ref").agg(F.max("furthest").alias("furthest")).write.mode("overwrite").parquet(f"{folder}/clocks/{batch}")
        after = spark.read.schema(clocks.schema).parquet(f"{folder}/clocks/{batch}")
        kept = seen.unionByName(new.select(*key)).join(after, "ref").filter(F.col("pos") >= F.col("furthest") - reach)
        kept.select(*key).write.mode("overwrite").parquet(f"{folder}/sites/{batch}")

    return sink


def fates(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All reads so far, with their fate and the batch they came in. schema: that of the reads."""
    return spark.read.schema(f"{schema}, batch int, fate string").parquet(f"{folder}/fates")


def state_size(spark: SparkSession, folder: str, batch: int) -> int:
    """Sites that are held after a batch."""
    return spark.read.parquet(f"{folder}/sites/{batch}").count()


#: Reads come in five parts by place, every 97th two parts late.
_PART = "least(4, least(4, pos // 2500) + CASE WHEN read_ord % 97 = 0 THEN 2 ELSE 0 END)"


@query(f"""WITH {views.READS}, p AS (SELECT *, {_PART} AS part FROM reads),
f AS (SELECT ref, part, max(pos) AS furthest FROM p GROUP BY 1, 2),
m AS (SELECT p.*, coalesce(pos < (SELECT max(f.furthest) FROM f WHERE f.ref = p.ref AND f.part < p.part) - 300, FALSE) AS late FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY late, ref, pos, strand, tag ORDER BY part, read_ord) AS k FROM m)
SELECT read_ord, ref, pos, strand, tag, CASE WHEN late THEN 'late' WHEN k = 1 THEN 'kept' ELSE 'duplicate' END AS fate FROM k""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that come in parts, one stream run for each, with what is kept, suppressed or late."""
    folder = folders.fresh(spark, "dedup")
    part = F.least(F.lit(4), F.least(F.lit(4), F.floor(F.col("pos") / 2500)) + F.when(F.col("read_ord") % 97 == 0, 2).otherwise(0))
    reads = views.reads(spark, sf_dir).select("read_ord", "ref", "pos", "strand", "tag", part.cast("int").alias("part"))
    reads.write.partitionBy("part").parquet(f"{folder}/all")
    schema = "read_ord bigint, ref bigint, pos bigint, strand string, tag string"
    for k in range(5):
        spark.read.parquet(f"{folder}/all").filter(F.col("part") == k).drop("part").write.parquet(f"{folder}/in/part={k}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        run_available(stream, suppressing(folder, 300), f"{folder}/state", "append")
    return fates(spark, folder, schema).select("read_ord", "ref", "pos", "strand", "tag", "fate")
