"""Queries that write a format and read it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.functions import coords
from translatome.operators import duplicates, lengths
from translatome.plans import views
from translatome.plans.registry import query
from translatome.plans.table_queries import EVENT_TYPES, QUANTS, quant_table
from translatome.plans.views import DNA, READS, TRX, table
from translatome.sources import alignments, annotations, folders, reads, tables

ALIGNED = f"""WITH {READS} SELECT 'r' || read_ord::VARCHAR AS qname, CASE WHEN strand = '+' THEN 0 ELSE 16 END AS flag, 'c' || ref::VARCHAR AS ref, pos,
 len::VARCHAR || 'M' AS cigar, strand, CAST(nh AS INTEGER) AS nh, CAST(len AS INTEGER) AS len FROM reads"""
REFS = [(f"c{i}", 60000) for i in range(50)]


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reads(spark, sf_dir)
    none = F.lit(None).cast("string")
    return r.select(
        F.concat(F.lit("r"), F.col("read_ord").cast("string")).alias("qname"), F.when(F.col("strand") == "+", 0).otherwise(16).alias("flag"),
        F.concat(F.lit("c"), F.col("ref").cast("string")).alias("ref"), "pos", F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"),
        F.col("len").cast("int").alias("query_len"), F.create_map(F.lit("NH"), F.col("nh").cast("string"), F.lit("ZT"), "tag").alias("tags"),
        F.repeat(F.lit("A"), F.col("len").cast("int")).alias("seq"), none.alias("qual"),
    )


@query(ALIGNED)
def sam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folders.fresh(spark, "sam")
    alignments.write_alignments(_aligned(spark, sf_dir), REFS, folder, text=True)
    return alignments.read_sam(spark, folder).select("qname", "flag", "ref", "pos", "cigar", "strand", "nh", "len")


@query(ALIGNED)
def bam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folders.fresh(spark, "bam")
    alignments.write_alignments(_aligned(spark, sf_dir), REFS, folder)
    return alignments.read_bam(spark, folder).select("qname", "flag", "ref", "pos", "cigar", "strand", "nh", "len")


@query(ALIGNED)
def bam_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one file, read in many splits that are cut anywhere."""
    folder = folders.fresh(spark, "bam")
    alignments.write_bam(_aligned(spark, sf_dir), REFS, folder)
    return alignments.read_bam(spark, folder, split_bytes=40_000).select("qname", "flag", "ref", "pos", "cigar", "strand", "nh", "len")


@query(f"SELECT * FROM ({ALIGNED}) WHERE ref IN ('c3', 'c7', 'c49') AND pos >= 10000 AND pos < 30000")
def bam_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in order of place; the filter reads what their indexes name."""
    folder = folders.fresh(spark, "bam")
    alignments.write_bam(_aligned(spark, sf_dir), REFS, folder, ordered=True)
    found = alignments.read_bam(spark, folder).filter(F.col("ref").isin("c3", "c7", "c49") & (F.col("pos") >= 10_000) & (F.col("pos") < 30_000))
    return found.select("qname", "flag", "ref", "pos", "cigar", "strand", "nh", "len")


@query(f"""SELECT * FROM ({ALIGNED}) a WHERE EXISTS (SELECT 1 FROM nation n WHERE a.ref = 'c' || (n.n_nationkey * 2)::VARCHAR
 AND a.pos < 2000 * n.n_regionkey + 1500 + 100 AND a.pos + a.len > 2000 * n.n_regionkey + 500 - 100)""")
def bam_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments over a region for each nation, 100 bases wider at both ends, by index."""
    folder = folders.fresh(spark, "bam")
    alignments.write_bam(_aligned(spark, sf_dir), REFS, folder, ordered=True)
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()  # one region each
    regions = [(f"c{2 * n.n_nationkey}", 2000 * n.n_regionkey + 500, 2000 * n.n_regionkey + 1500) for n in nations]
    return alignments.read_bam_regions(spark, folder, regions, 100).select("qname", "flag", "ref", "pos", "cigar", "strand", "nh", "len")


@query(f"""WITH {READS}, g AS (SELECT ref, pos, strand, len, tag, count(*) AS n FROM reads GROUP BY ALL)
SELECT 'c' || ref::VARCHAR AS ref, pos, strand, len::VARCHAR || 'M' AS cigar, CAST(sum(n) AS BIGINT) AS total, count(*) AS "unique" FROM g GROUP BY ref, pos, strand, len""")
def dedup_sites_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that differ in their CIGAR are different sites."""
    rows = alignments.with_derived(_aligned(spark, sf_dir)).withColumn("read_ord", F.substring("qname", 2, 20).cast("bigint")).withColumn("tag", F.col("tags")["ZT"])
    return duplicates.site_counts(duplicates.tag_groups(rows, duplicates.ALIGNED_SITE), duplicates.ALIGNED_SITE).withColumn("unique", F.col("unique").cast("bigint"))


@query(f"""WITH {READS}, g AS (SELECT ref, pos, strand, tag, count(*) AS n FROM reads GROUP BY ALL),
s AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS "unique" FROM g GROUP BY ref, pos, strand) SELECT total, "unique", count(*) AS n_sites FROM s GROUP BY 1, 2""")
def site_histogram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folders.fresh(spark, "sites")
    sites = duplicates.site_counts(duplicates.tag_groups(views.reads(spark, sf_dir)))
    tables.write_site_histogram(duplicates.site_histogram(sites), folder)
    return tables.read_site_histogram(spark, folder)


@query(f"""WITH {TRX} SELECT trx_id::VARCHAR AS trx_id, ref::VARCHAR AS ref, strand, CAST(s0 AS BIGINT) AS start, CAST(s1 + l1 AS BIGINT) AS "end", CAST(total AS BIGINT) AS length,
 CAST(cds_start AS BIGINT) AS cds_start, CAST(cds_len AS BIGINT) AS cds_len FROM trx""")
def bed12_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folders.fresh(spark, "bed12")
    annotations.write_bed12(views.transcripts(spark, sf_dir), folder)
    b = F.col("blocks")
    return annotations.read_transcripts(spark, folder).select(
        "trx_id", "ref", "strand", coords.blocks_start(b).alias("start"), coords.blocks_end(b).alias("end"), coords.blocks_length(b).alias("length"), "cds_start", "cds_len"
    )


@query(f"WITH {DNA} SELECT 'i' || item_id::VARCHAR AS name, seq, CASE WHEN item_id % 3 = 0 THEN 'UnknownIndex' ELSE 's' || (item_id % 3)::VARCHAR END AS fate FROM dna")
def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of FASTQ for each sample, read one by one."""
    folder, k = folders.fresh(spark, "fastq"), F.col("item_id") % 3
    fate = F.when(k == 0, "UnknownIndex").otherwise(F.concat(F.lit("s"), k.cast("string")))
    rows = views.dna(spark, sf_dir).select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("name"), "seq", F.repeat(F.lit("I"), F.length("seq")).alias("qual"), fate.alias("fate"))
    reads.write_fastq_by_sample(rows, folder)
    parts = [reads.read_fastq(spark, f"{folder}/fate={f}").select("name", "seq", F.lit(f).alias("fate")) for f in ("UnknownIndex", "s1", "s2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {DNA} SELECT 'i' || item_id::VARCHAR AS name, CASE WHEN item_id % 2 = 0 THEN substr(seq, 4, 20) || substr(seq, 31, 25)
 ELSE reverse(translate(substr(seq, 4, 20) || substr(seq, 31, 25), 'ACGT', 'TGCA')) END AS seq FROM dna WHERE length(seq) > 3""")
def fasta_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of every sequence, fetched from a FASTA file of lines of 60 bases in chunks of 32."""
    folder, size = folders.fresh(spark, "fasta"), 32
    dna = views.dna(spark, sf_dir).select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("ref"), "seq", (F.col("item_id") % 2 == 0).alias("even"))
    text = F.concat(F.lit(">"), "ref", F.lit("\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n"))
    dna.filter("seq <> ''").select(text.alias("value")).write.text(folder)
    blocks = F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(n).cast("bigint").alias("len")) for a, n in ((3, 20), (30, 25))])
    regions = dna.select(F.col("ref").alias("name"), "ref", F.when(F.col("even"), "+").otherwise("-").alias("strand"), blocks.alias("blocks"))
    found = reads.fetched(regions, reads.read_fasta_chunks(spark, folder, size), "name", size)
    return found.filter("seq <> ''")


@query(f"""WITH {READS} SELECT 'c' || ref::VARCHAR AS ref, strand, pos AS at, 0.5::DOUBLE * count(*) AS n FROM reads GROUP BY 1, 2, 3""")
def wig_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of reads by strand, scaled by a half, as two WIG tracks."""
    folder = folders.fresh(spark, "wig")
    track = views.reads(spark, sf_dir).groupBy(F.concat(F.lit("c"), F.col("ref").cast("string")).alias("ref"), "strand", F.col("pos").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    annotations.write_wig_pair(track, f"{folder}/starts", 0.5)
    parts = [annotations.read_wig(spark, f"{folder}/starts_{n}.wig").select("ref", F.lit(s).alias("strand"), "at", "n") for n, s in (("fwd", "+"), ("rev", "-"))]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {QUANTS} SELECT gene::VARCHAR AS gene, CAST(100 AS BIGINT) AS size, sample, n AS count FROM quants""")
def quant_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folders.fresh(spark, "quants")
    tables.write_quant_matrix(quant_table(spark, sf_dir).select("gene", F.lit(100).alias("size"), *EVENT_TYPES), folder)
    return tables.read_quant_matrix(spark, folder)


@query("""SELECT user_id::VARCHAR AS gene, CAST(100 AS BIGINT) AS size, count(*) AS count, event_type AS sample FROM events GROUP BY 1, 4""")
def quant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of quantities for each sample."""
    folder = folders.fresh(spark, "quant")
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    for sample in EVENT_TYPES:
        counts.filter(F.col("event_type") == sample).select("user_id", F.lit(100), "n").write.csv(f"{folder}/{sample}", sep="\t")
    return tables.read_quants(spark, {s: f"{folder}/{s}" for s in EVENT_TYPES})


@query(f"""WITH {TRX} SELECT trx_id::VARCHAR AS trx_id, CASE WHEN trx_id % 3 = 0 THEN (gene_id + 1000000)::VARCHAR ELSE gene_id::VARCHAR END AS gene_id FROM trx WHERE trx_id % 3 <> 1""")
def gene_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps: the second renames every third transcript that the first suppresses, and suppresses every third that it lacks."""
    folder = folders.fresh(spark, "map")
    trx = views.transcripts(spark, sf_dir).withColumn("trx_id", F.col("trx_id").cast("string"))
    k = F.col("trx_id").cast("bigint") % 3
    trx.filter(k == 0).select("trx_id").write.text(f"{folder}/one")
    new = F.concat_ws("\t", "trx_id", F.when(k == 0, (F.col("gene_id") + 1000000).cast("string")))
    trx.filter(k < 2).select(new.alias("value")).write.text(f"{folder}/two")
    return tables.remapped(trx, tables.read_gene_map(spark, [f"{folder}/one", f"{folder}/two"])).select("trx_id", "gene_id")


@query(f"""WITH {TRX} SELECT count(DISTINCT CASE WHEN trx_id % 3 = 0 THEN (gene_id + 1000000)::VARCHAR ELSE gene_id::VARCHAR END) AS genes FROM trx WHERE trx_id % 3 <> 1""")
def remapped_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gene_map_files(spark, sf_dir).agg(F.count_distinct("gene_id").alias("genes"))


@query(f"WITH {TRX} SELECT trx_id, gene_id FROM trx WHERE cds_start IS NOT NULL")
def known_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of a list of ids: those with a CDS."""
    folder, trx = folders.fresh(spark, "ids"), views.transcripts(spark, sf_dir)
    trx.filter("cds_start is not null").select(F.col("trx_id").cast("string")).write.text(folder)
    return tables.known_only(trx.select("trx_id", "gene_id"), tables.read_ids(spark, folder).select(F.col("id").cast("bigint").alias("id")), "trx_id")


@query("""SELECT c_mktsegment AS set_name, c_custkey::VARCHAR AS key, 'all of it' AS rest, c_acctbal::DOUBLE AS value FROM customer""")
def set_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets as lines of a name, keys and a remark, and values of keys, read and joined."""
    folder, c = folders.fresh(spark, "sets"), table(spark, sf_dir, "customer")
    keys = F.array_join(F.collect_list(F.col("c_custkey").cast("string")), ",")
    line = F.concat_ws("\t", "c_mktsegment", "keys", F.lit("all of it"))
    c.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 100)).agg(keys.alias("keys")).select(line.alias("value")).write.text(f"{folder}/sets")
    c.select("c_custkey", F.col("c_acctbal").cast("double").cast("string")).write.csv(f"{folder}/data", sep="\t")
    return tables.read_sets(spark, f"{folder}/sets").join(tables.read_data(spark, f"{folder}/data"), "key").select("set_name", "key", "rest", "value")


@query(f"WITH {READS} SELECT DISTINCT len AS read_len, len // 2 AS delta FROM reads")
def asite_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The A-sites of all lengths that reads have."""
    folder = folders.fresh(spark, "asites")
    sites = views.reads(spark, sf_dir).select(F.col("len").alias("read_len"), F.floor(F.col("len") / 2).alias("delta")).distinct()
    sites.write.csv(folder, sep="\t")
    return tables.read_asites(spark, folder)


@query("SELECT 'n' || n_nationkey::VARCHAR AS name, 'AC' || chr(65 + CAST(n_nationkey AS INTEGER)) AS seq FROM nation")
def barcode_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, n = folders.fresh(spark, "barcodes"), table(spark, sf_dir, "nation")
    n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("AC"), F.char(F.lit(65) + F.col("n_nationkey")))).write.csv(folder, sep="\t")
    return tables.read_barcodes(spark, folder)


@query("SELECT 'n' || n_nationkey::VARCHAR AS name, 'AC' || chr(65 + CAST(n_nationkey AS INTEGER)) AS idx FROM nation")
def sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, n = folders.fresh(spark, "samples"), table(spark, sf_dir, "nation")
    n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("AC"), F.char(F.lit(65) + F.col("n_nationkey")))).write.csv(folder)
    return tables.read_samples(spark, folder, 3)


@query(f"WITH {READS} SELECT 'c' || ref::VARCHAR AS ref, CAST(max(pos + len) AS BIGINT) AS length FROM reads GROUP BY 1")
def sizes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of references: where their last read ends."""
    folder = folders.fresh(spark, "sizes")
    lengths = views.reads(spark, sf_dir).groupBy(F.concat(F.lit("c"), F.col("ref").cast("string")).alias("ref")).agg(F.max(F.col("pos") + F.col("len")).alias("length"))
    annotations.write_sizes(lengths, folder)
    return annotations.read_sizes(spark, folder)


@query(f"""WITH {TRX} SELECT trx_id::VARCHAR AS trx_id, ref::VARCHAR AS ref, strand, CAST(s0 AS BIGINT) AS start, CAST(s1 + l1 AS BIGINT) AS "end" FROM trx WHERE trx_id = 42""")
def bed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one transcript of a name, from a BED12 file."""
    folder = folders.fresh(spark, "bed12")
    annotations.write_bed12(views.transcripts(spark, sf_dir), folder)
    b = F.col("blocks")
    found = annotations.find_transcript(annotations.read_transcripts(spark, folder), "42")
    return found.select("trx_id", "ref", "strand", coords.blocks_start(b).alias("start"), coords.blocks_end(b).alias("end"))


@query(f"WITH {READS}, h AS (SELECT least(len, 51) AS bin, count(*) AS n FROM reads GROUP BY 1) SELECT g.range AS bin, coalesce(h.n, 0) AS n FROM range(0, 52) g LEFT JOIN h ON h.bin = g.range")
def length_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read lengths as a table of counts by line."""
    folder = folders.fresh(spark, "lengths")
    counts = lengths.histogram(views.reads(spark, sf_dir).withColumn("all", F.lit(0)), ["all"])
    every = spark.range(52).select(F.col("id").alias("bin")).join(counts.select("bin", "n"), "bin", "left").na.fill(0, ["n"])
    every.orderBy("bin").coalesce(1).write.csv(folder, sep="\t")
    return tables.read_length_counts(spark, folder)


@query("""SELECT p_partkey::VARCHAR AS gene, CAST(0 AS BIGINT) AS "Transcript_start", CAST(10 + 3 * p_size AS BIGINT) AS "Transcript_end",
 CASE WHEN p_partkey % 4 > 0 THEN 3 END::BIGINT AS "CDS_start", CASE WHEN p_partkey % 4 > 0 THEN p_size + 3 END::BIGINT AS "CDS_end", CAST(2 AS BIGINT) AS n, p_size / 2.0::DOUBLE + 0.25 AS total FROM part""")
def pars_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and scores of a gene for each part, as two files."""
    folder, part = folders.fresh(spark, "pars"), table(spark, sf_dir, "part")
    gene, size = F.col("p_partkey").cast("string").alias("gene"), F.col("p_size")
    whole = part.select(gene, F.lit("Transcript"), F.lit(0), 10 + 3 * size)
    whole.union(part.filter("p_partkey % 4 > 0").select(gene, F.lit("CDS"), F.lit(3), size + 3)).write.csv(f"{folder}/features", sep="\t")
    part.select(gene, size, F.concat((size / 2).cast("string"), F.lit(";0.25"))).write.csv(f"{folder}/scores", sep="\t")
    f, s = tables.read_pars_features(spark, f"{folder}/features"), tables.read_pars_scores(spark, f"{folder}/scores")
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return f.join(s, "gene").select("gene", "Transcript_start", "Transcript_end", "CDS_start", "CDS_end", F.size("scores").cast("bigint").alias("n"), total.alias("total"))


@query("""SELECT l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR AS name, l_partkey::VARCHAR AS ref1, CAST(l_suppkey AS BIGINT) AS left1, CAST(l_quantity AS BIGINT) + 20 AS right1,
 CASE WHEN l_returnflag = 'R' THEN '+' ELSE '-' END AS strand1, l_suppkey <= CAST(l_quantity AS BIGINT) + 20 AS good FROM lineitem""")
def bedpe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs as a BEDPE file; those that end before they start are told apart."""
    folder, li = folders.fresh(spark, "bedpe"), table(spark, sf_dir, "lineitem")
    end, strand = F.col("l_quantity").cast("bigint") + 20, F.when(F.col("l_returnflag") == "R", "+").otherwise("-")
    name = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    li.select("l_partkey", "l_suppkey", end, F.lit("."), F.lit(-1), F.lit(-1), name, F.lit(0), strand, F.lit(".")).write.csv(folder, sep="\t")
    good, bad = annotations.read_bedpe(spark, folder)
    columns = ["name", "ref1", "left1", "right1", "strand1"]
    return good.select(*columns, F.lit(True).alias("good")).unionByName(bad.select(*columns, F.lit(False).alias("good")))


@query("""SELECT event_type, printf('%.4f', avg(value)) AS mean, count(*)::VARCHAR AS n FROM events GROUP BY 1""")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as text, fractions with four decimals under a header."""
    folder = folders.fresh(spark, "report")
    tables.write_tsv(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")), folder, 4)
    return spark.read.csv(folder, sep="\t", header=True)


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'r' || event_id::VARCHAR WHEN 1 THEN '#' || event_type ELSE 'r' || event_id::VARCHAR || '#' || event_type || '#' || user_id::VARCHAR END AS name FROM events)
SELECT event_id, CASE WHEN strpos(name, '#') > 1 THEN substr(name, strpos(name, '#')) ELSE '' END AS tag FROM e""")
def umi_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What read names have from their first mark on."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    plain, mark = F.concat(F.lit("r"), F.col("event_id").cast("string")), F.concat(F.lit("#"), "event_type")
    name = F.when(k == 0, plain).when(k == 1, mark).otherwise(F.concat(plain, mark, F.lit("#"), F.col("user_id").cast("string")))
    return e.select("event_id", duplicates.umi_tag(name).alias("tag"))
