"""Small text tables: A-sites, gene maps, quantities, barcodes, sets, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.sources.reads import numbered


def _field(text: Column, k: int) -> Column:
    return F.get(text, F.lit(k))



def read_asites(spark: SparkSession, path: str) -> DataFrame:
    """read_len, delta from lines of a length and a (signed) offset; a file without lines is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if lines.isEmpty():
        raise ValueError(f"no A-site in {path}")
    f = F.split(F.trim("value"), "\\s+")
    return lines.select(_field(f, 0).cast("bigint").alias("read_len"), _field(f, 1).cast("bigint").alias("delta"))


def _map_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are neither blank nor comments, with their fields and ord: place of the path, name of the file, line."""
    paths = [path] if isinstance(path, str) else path
    parts = [numbered(spark, p).select("value", F.struct(F.lit(k).alias("path"), "file", "line").alias("ord")) for k, p in enumerate(paths)]
    lines = reduce(DataFrame.unionByName, parts)
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))


def read_gene_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """trx_id, gene_id (null: suppressed); of repeated transcripts the last line of the last path counts. See bad_map_lines."""
    rows = _map_lines(spark, path).filter(F.size("f") <= 2).select(_field(F.col("f"), 0).alias("trx_id"), _field(F.col("f"), 1).alias("gene_id"), "ord")
    return rows.groupBy("trx_id").agg(F.max_by(F.struct("gene_id"), "ord").alias("m")).select("trx_id", "m.gene_id")


def bad_map_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the lines of a gene map that have more than two fields and are passed over."""
    return _map_lines(spark, path).filter(F.size("f") > 2).select("value")


def known_only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list of ids."""
    return rows.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def write_quant_matrix(wide: DataFrame, path: str) -> None:
    """A gene, its size and one column for each sample, tab-separated, under the header that read_quant_matrix takes."""
    gene, *rest = wide.columns
    wide.select(F.col(gene).alias("# gene"), *rest).write.csv(path, sep="\t", header=True)


def remapped(transcripts: DataFrame, gene_map: DataFrame) -> DataFrame:
    """Transcripts with mapped genes; those that the map suppresses are left out, those that it lacks stay."""
    entries = gene_map.select("trx_id", F.col("gene_id").alias("_new"), F.lit(True).alias("_listed"))
    joined = transcripts.join(entries, "trx_id", "left").filter("_listed is null or _new is not null")
    return joined.withColumn("gene_id", F.coalesce("_new", F.col("gene_id").cast("string"))).drop("_new", "_listed")


def read_quants(spark: SparkSession, samples: dict[str, str]) -> DataFrame:
    """gene, size, count, sample from one file for each sample."""
    parts = [spark.read.csv(p, sep="\t", schema="gene string, size bigint, count bigint").withColumn("sample", F.lit(s)) for s, p in samples.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def read_quant_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gene, size, sample, count from a wide table with the header `# gene<TAB>size<TAB>samples`."""
    wide = spark.read.csv(path, sep="\t", header=True)
    gene, size, *samples = wide.columns
    long = wide.unpivot([gene, size], samples, "sample", "count")
    return long.select(F.col(gene).alias("gene"), F.col(size).cast("bigint").alias("size"), "sample", F.col("count").cast("bigint").alias("count"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("id")).distinct()


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, seq string", comment="#")


def read_samples(spark: SparkSession, path: str, index_length: int) -> DataFrame:
    """name, idx; an index of another length is an error."""
    rows = spark.read.csv(path, schema="name string, idx string")
    ok = F.length("idx") == index_length
    return rows.withColumn("idx", F.when(ok, F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("wrong index length: "), F.coalesce("idx", F.lit("")))).cast("string")))


def read_length_counts(spark: SparkSession, path: str) -> DataFrame:
    """bin, n; the first column must count the lines from 0 (the file has a few dozen)."""
    lines = spark.read.text(path).coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    index = _field(f, 0).cast("bigint")
    bad = F.raise_error(F.concat(F.lit("bad count line: "), "value")).cast("bigint")
    return lines.select(F.when(index == F.col("ord"), index).otherwise(bad).alias("bin"), _field(f, 1).cast("bigint").alias("n"))


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_name, key, rest: one row for each distinct key of each set."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter("value <> ''").select(_field(f, 0).alias("set_name"), F.array_distinct(F.split(_field(f, 1), ",")).alias("keys"), F.array_join(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))), "\t").alias("rest"))
    return rows.select("set_name", F.explode("keys").alias("key"), "rest")


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """key, value; a line that isn't exactly these is an error."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).filter("value <> ''")
    value = F.when(F.size(f) == 2, F.expr("try_cast(element_at(split(value, '\t'), 2) as double)"))
    checked = F.coalesce(value, F.raise_error(F.concat(F.lit("bad data line: "), "value")).cast("double"))
    return lines.select(_field(f, 0).alias("key"), checked.alias("value"))


def read_pars_features(spark: SparkSession, path: str) -> DataFrame:
    """gene and start and end of Transcript, CDS, 3UTR and 5UTR; a repeated feature or one of another type is an error."""
    rows = spark.read.csv(path, sep="\t", schema="gene string, ftype string, start bigint, end bigint")
    unknown = F.raise_error(F.concat(F.lit("unknown feature type: "), F.coalesce("ftype", F.lit("")))).cast("string")
    rows = rows.withColumn("ftype", F.when(F.col("ftype").isin("Transcript", "CDS", "3UTR", "5UTR"), F.col("ftype")).otherwise(unknown))
    counted = rows.groupBy("gene", "ftype").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.count(F.lit(1)).alias("n"))
    ok = F.when(F.col("n") == 1, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("repeated feature of "), "gene")).cast("bigint"))
    return counted.withColumn("start", ok).groupBy("gene").pivot("ftype", ["Transcript", "CDS", "3UTR", "5UTR"]).agg(F.first("start").alias("start"), F.first("end").alias("end"))


def read_pars_scores(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="gene string, len string, text string")
    return rows.select("gene", "len", F.transform(F.split("text", ";"), lambda x: x.cast("double")).alias("scores"))


def write_site_histogram(sites: DataFrame, path: str) -> None:
    """total, unique and the number of sites that have them, tab-separated, in order: the files by name, the lines in a file."""
    sites.orderBy("total", "unique").select("total", "unique", "n_sites").write.csv(path, sep="\t")


def read_site_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="total bigint, unique bigint, n_sites bigint")


def write_tsv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """Tab-separated text with a header; doubles with a fixed number of decimals if that is given."""
    shown = [F.format_string(f"%.{decimals}f", c).alias(c) if t == "double" and decimals is not None else F.col(c) for c, t in df.dtypes]
    df.select(*shown).write.csv(path, sep="\t", header=True)


