"""Queries of reports: annotation by strand, transcript reports, summaries, upstream frames and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.functions import coords, sequences
from translatome.operators import asites, framing, reports, starts
from translatome.plans import read_queries, table_queries, views
from translatome.plans.read_queries import COVER, FRAMING, HITS, IN_CDS
from translatome.plans.registry import query
from translatome.plans.views import DNA, READS, TRX
from translatome.sources import tables

#: Reads of the other strand.
_TURNED = READS.replace("THEN '+' ELSE '-'", "THEN '-' ELSE '+'")
_SEQ = "list_transform(range(0, total), lambda i: substr('ACGT', CAST((trx_id + i * i + i // 3) % 4 + 1 AS INT), 1))"
SEQS = f"{TRX}, seqs AS (SELECT *, array_to_string({_SEQ}, '') AS seq FROM trx)"


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with a sequence."""
    return _sequenced(views.transcripts(spark, sf_dir))


def _sequenced(trx: DataFrame) -> DataFrame:
    letter = lambda i: F.substr(F.lit("ACGT"), ((F.col("trx_id") + i * i + F.floor(i / 3)) % 4 + 1).cast("int"), F.lit(1))
    places = sequences.safe_range(F.lit(0), coords.blocks_length(F.col("blocks")) - 1)
    return trx.withColumn("seq", F.array_join(F.transform(places, letter), ""))


@query(f"""{HITS.replace(READS, _TURNED)} SELECT t.trx_id, CAST((t.cds_len + 1) // 3 - 20 AS BIGINT) AS length, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
FROM trx t LEFT JOIN (SELECT trx_id, count(*) AS n FROM hits WHERE {IN_CDS} GROUP BY 1) c ON t.trx_id = c.trx_id""")
def fp_count_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_queries._counted(spark, sf_dir, reverse=True)


def _strands(which: str) -> str:
    hits = views.placed(0).replace("r.ref = t.ref AND r.strand = t.strand", f"r.ref = t.ref AND {which}").replace("t.strand,", "t.strand, r.strand AS read_strand,")
    return f"""WITH {READS}, {TRX}, {hits}, agg AS (SELECT read_ord, string_agg(trx_id::VARCHAR, ',' ORDER BY trx_id) AS names,
 string_agg(lo::VARCHAR, ',' ORDER BY trx_id) AS starts, string_agg(CASE WHEN strand = read_strand THEN '+' ELSE '-' END, ',' ORDER BY trx_id) AS strands FROM placed GROUP BY 1)
SELECT r.read_ord, a.names, a.starts, a.strands FROM reads r LEFT JOIN agg a ON r.read_ord = a.read_ord"""


@query(_strands("TRUE"))
def annotate_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotated(views.reads(spark, sf_dir), views.transcripts(spark, sf_dir), "any")


@query(_strands("r.strand <> t.strand"))
def annotate_opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotated(views.reads(spark, sf_dir), views.transcripts(spark, sf_dir), "opposite")


_FIELDS = """nt - cds_start AS cds_off, CAST(floor((nt - cds_start + 1) / 3.0) AS BIGINT) AS codon, ((nt - cds_start + 1) % 3 + 3) % 3 - 1 AS frame, substr(seq, CAST(nt + 1 AS INT), 1) AS base"""
_BASES = f"{HITS}, seqs AS (SELECT *, array_to_string({_SEQ}, '') AS seq FROM trx), grid AS (SELECT s.*, unnest(range(0, total)) AS nt FROM seqs s)"


def _hits(spark: SparkSession, sf_dir: str, trx: DataFrame) -> DataFrame:
    return asites.sites(views.reads(spark, sf_dir), trx, views.asites(spark))


def _arrays(spark: SparkSession, sf_dir: str, lengths: tuple[int, ...] = ()) -> DataFrame:
    """Transcripts with a sequence, and dense counts of all A-sites and of those of each length."""
    reads, names = views.reads(spark, sf_dir), {"n": "n"} | {f"n{i}": f"len{k}" for i, k in enumerate(lengths)}

    def counted(t: DataFrame) -> DataFrame:
        found = asites.base_counts(reads, t, views.asites(spark), "len" if lengths else None, lengths)
        return asites.dense_arrays(found, t, tuple(names)).withColumnsRenamed(names)

    return _sequenced(asites.by_shape(views.transcripts(spark, sf_dir), counted, own=("blocks", "cds_start")))


@query(f"""{_BASES}, d AS (SELECT trx_id, off AS nt, count(*) AS n FROM hits GROUP BY 1, 2)
SELECT g.trx_id, g.nt, {_FIELDS.replace("nt -", "g.nt -").replace("nt + 1 AS", "g.nt + 1 AS")}, {table_queries._CODON.format("substr(seq, CAST(g.nt + 1 AS INT), 3)")} AS amino, coalesce(d.n, 0) AS n
FROM grid g LEFT JOIN d ON d.trx_id = g.trx_id AND d.nt = g.nt""")
def trx_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_base(_arrays(spark, sf_dir))


@query(f"""{HITS}, g AS (SELECT trx_id, unnest(range(0, CAST(ceil(cds_len / 3.0) AS BIGINT))) AS codon FROM trx WHERE cds_start IS NOT NULL),
d AS (SELECT trx_id, CAST(floor((off - cds_start + 1) / 3.0) AS BIGINT) AS codon, count(*) AS n FROM hits WHERE cds_start IS NOT NULL GROUP BY 1, 2)
SELECT g.trx_id, g.codon, coalesce(d.n, 0) AS n FROM g LEFT JOIN d ON d.trx_id = g.trx_id AND d.codon = g.codon""")
def trx_report_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asites.by_shape(views.transcripts(spark, sf_dir), lambda t: reports.by_codon(_hits(spark, sf_dir, t), t), asites.CODING)


_EACH = ", ".join(f"count(CASE WHEN len = {k} THEN 1 END) AS len{k}" for k in range(26, 35))
_EACH_OUT = ", ".join(f"coalesce(d.len{k}, 0) AS len{k}" for k in range(26, 35))


@query(f"""{_BASES}, d AS (SELECT trx_id, off AS nt, count(*) AS n, {_EACH} FROM hits GROUP BY 1, 2)
SELECT g.trx_id, g.nt, {_FIELDS.replace("nt -", "g.nt -").replace("nt + 1 AS", "g.nt + 1 AS")}, coalesce(d.n, 0) AS n, {_EACH_OUT}
FROM grid g LEFT JOIN d ON d.trx_id = g.trx_id AND d.nt = g.nt""")
def trx_report_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_length(_arrays(spark, sf_dir, tuple(range(26, 35))))


@query(f"""{HITS}, s AS (SELECT trx_id, count(*) AS total FROM hits WHERE off - cds_start >= -1 AND off - cds_start < cds_len - 1 GROUP BY 1)
SELECT t.trx_id, CASE WHEN t.strand = '+' THEN (l0 - 1)::VARCHAR || '/' || l0::VARCHAR ELSE (l1 - 1)::VARCHAR || '/' || l1::VARCHAR END AS junctions,
 CAST(CASE WHEN cds_start IS NOT NULL THEN cds_len // 3 END AS BIGINT) AS codons, CASE WHEN cds_start IS NOT NULL THEN coalesce(s.total, 0) END AS total,
 round(CASE WHEN cds_start IS NOT NULL THEN coalesce(s.total, 0)::DOUBLE / (cds_len // 3) END, 9) AS density FROM trx t LEFT JOIN s ON s.trx_id = t.trx_id""")
def trx_report_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = asites.by_shape(views.transcripts(spark, sf_dir), lambda t: reports.report_heads(_hits(spark, sf_dir, t), t), asites.CODING)
    return heads.select("trx_id", "junctions", "codons", "total", F.round("density", 9).alias("density"))


_KNOWN = ", ".join(f"('BadAlignment', '{s}')" for s in framing.BAD_ALIGNMENT) + ", " + ", ".join(f"('BadAnnotation', '{s}')" for s in framing.BAD_ANNOTATION)


@query(f"""{FRAMING}, known AS (SELECT * FROM (VALUES {_KNOWN}, ('GoodAnnotation', 'Good')) v(part, status)),
c AS (SELECT k.part, k.status, count(f.read_ord) AS n FROM known k LEFT JOIN framed f ON f.status = k.status GROUP BY 1, 2),
s AS (SELECT sum(n) AS total, sum(n) FILTER (part = 'BadAlignment') AS ba, sum(n) FILTER (part <> 'BadAlignment') AS ga, sum(n) FILTER (part = 'BadAnnotation') AS bn, sum(n) FILTER (part = 'GoodAnnotation') AS gn FROM c),
u AS (SELECT part, status, n FROM c WHERE status <> 'Good' UNION ALL SELECT 'total', '', total FROM s UNION ALL SELECT 'BadAlignment', '', ba FROM s UNION ALL SELECT 'GoodAlignment', '', ga FROM s
 UNION ALL SELECT 'BadAnnotation', '', bn FROM s UNION ALL SELECT 'GoodAnnotation', '', gn FROM s)
SELECT part, status, CAST(n AS BIGINT) AS n, round(n::DOUBLE / total, 9) AS of_all, round(CASE WHEN part IN ('BadAnnotation', 'GoodAnnotation') THEN n::DOUBLE / ga END, 9) AS of_good FROM u CROSS JOIN s""")
def framing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framing.classified(views.reads(spark, sf_dir), views.transcripts(spark, sf_dir))
    return reports.framing_summary(rows).withColumns({c: F.round(c, 9) for c in ("of_all", "of_good")})


@query(f"WITH {READS} SELECT ref, pos, {', '.join(f'count(CASE WHEN len = {k} THEN 1 END) AS len{k}' for k in range(25, 35))} FROM reads WHERE strand = '+' GROUP BY 1, 2")
def rrna_pos_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.position_lengths(views.reads(spark, sf_dir).filter("strand = '+'"))


@query(f"""WITH {COVER}, t AS (SELECT count(*) AS total FROM reads) SELECT ref, pos, n_start, n_end, cover, round(n_start::DOUBLE / total, 9) AS n_start_share,
 round(n_end::DOUBLE / total, 9) AS n_end_share, round(cover::DOUBLE / total, 9) AS cover_share FROM cover CROSS JOIN t WHERE pos < 60000""")
def rrna_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = reports.position_shares(read_queries._cover(spark, sf_dir), views.reads(spark, sf_dir).count())
    return shares.withColumns({f"{c}_share": F.round(f"{c}_share", 9) for c in ("n_start", "n_end", "cover")})


_STARTS = ", ".join(f"'{c}'" for c in sequences.CANDIDATE_STARTS)
CANDIDATES = f"""c AS (SELECT *, unnest(list_filter(range(0, cds_start + 1), lambda i: substr(seq, i + 1, 3) IN ({_STARTS}))) AS nt FROM items),
r AS (SELECT *, substr(seq, nt + 1) AS rest FROM c), s AS (SELECT *, {table_queries._stop('rest')} AS codons FROM r),
cand AS (SELECT *, CASE WHEN codons IS NULL THEN NULL ELSE least(cds_start - 2, nt + 3 * codons + 1) END AS quant_end FROM s)"""


@query(f"""WITH {DNA}, items AS (SELECT item_id, seq, 60 AS cds_start, list_transform(range(0, length(seq) - 40), lambda i: (item_id * 7 + i * i) % 5) AS counts FROM dna WHERE length(seq) >= 60), {CANDIDATES}
SELECT item_id, nt, CAST(CASE WHEN quant_end IS NULL THEN NULL WHEN quant_end < nt + 2 THEN 0 WHEN quant_end < len(counts) THEN list_sum(counts[nt + 3:quant_end + 1]) END AS BIGINT) AS uorf_sum,
 CAST(CASE WHEN 59 <= len(counts) THEN list_sum(counts[1:59]) END AS BIGINT) AS leader_sum FROM cand""")
def uorf_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.transform(sequences.safe_range(F.lit(0), F.length("seq") - 41), lambda i: (F.col("item_id") * 7 + i * i) % 5)
    items = views.dna(spark, sf_dir).filter(F.length("seq") >= 60).withColumn("counts", counts)
    items = items.withColumn("cds_start", F.lit(60).cast("bigint")).withColumn("cds_len", F.lit(30).cast("bigint"))
    found = starts.uorf_candidates(items)
    end = F.when(F.col("codons").isNotNull(), F.col("quant_end"))
    return found.select("item_id", "nt", *starts.uorf_sums(F.col("counts"), F.col("nt"), end, F.col("cds_start")))


_AT = "CASE WHEN {0} < l0 THEN s0 + {0} ELSE s1 + {0} - l0 END"


@query(f"""WITH {SEQS}, items AS (SELECT * FROM seqs WHERE cds_start IS NOT NULL), {CANDIDATES},
g AS (SELECT *, CASE WHEN strand = '+' THEN nt ELSE total - 1 - quant_end END AS a, CASE WHEN strand = '+' THEN quant_end ELSE total - 1 - nt END AS b FROM cand WHERE quant_end > nt)
SELECT trx_id::VARCHAR || '_' || nt::VARCHAR AS name, ref, strand, {_AT.format('a')} AS "start", {_AT.format('b')} + 1 AS "end", CAST(CASE WHEN a < l0 AND b >= l0 THEN 2 ELSE 1 END AS BIGINT) AS n_blocks,
 quant_end - nt + 1 AS cds_len FROM g""")
def uorf_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _transcripts(spark, sf_dir).filter("cds_start is not null")
    found = starts.uorf_candidates(items).withColumn("quant_end", F.when(F.col("codons").isNotNull(), F.col("quant_end")))
    b = F.col("blocks")
    return starts.uorf_transcripts(found).select(
        "name", "ref", "strand", coords.blocks_start(b).alias("start"), coords.blocks_end(b).alias("end"), F.size(b).cast("bigint").alias("n_blocks"), "cds_len"
    )


@query(f"""WITH {DNA}, t AS (SELECT item_id, seq, {table_queries._PEAK.format(12, 21, "'ATG'")} AS a, {table_queries._PEAK.format(5, 41, "'ATG'")} AS b, {table_queries._PEAK.format(12, 21, table_queries._NEAR)} AS c,
 {table_queries._PEAK.format(5, 41, table_queries._NEAR)} AS d FROM dna), u AS (SELECT item_id, seq, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c ELSE d END AS found FROM t),
v AS (SELECT *, substr(seq, found[1] + 1) AS rest FROM u), w AS (SELECT *, {table_queries._stop('rest')} AS stop FROM v)
SELECT item_id, CASE WHEN len(found) = 1 THEN found[1] END AS cds_start, CAST(CASE WHEN len(found) = 1 THEN coalesce(3 * stop + 2, length(rest)) END AS BIGINT) AS cds_len FROM w""")
def peak_orf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = starts.peak_codons(F.col("seq"), F.lit(5), F.lit(40), F.lit(12), F.lit(20))
    return views.dna(spark, sf_dir).withColumn("found", found).select("item_id", *starts.peak_cds(F.col("seq"), F.col("found")))


@query(f"""WITH {table_queries.LTM}, p AS (SELECT trx, nt AS st FROM pr)
SELECT p.trx, p.st, round(CASE WHEN p.st > 55 THEN 0.0 WHEN e.ct = 0 THEN -1.0 WHEN e.x = 0 THEN e.c::DOUBLE ELSE e.c::DOUBLE / ((e.x * e.lt)::DOUBLE / e.ct) END, 9) AS ratio FROM p JOIN en e ON e.trx = p.trx AND e.st = p.st""")
def start_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table_queries._arrays(spark, sf_dir).withColumn("st", F.explode(F.sequence(F.lit(0), F.lit(59))))
    return at.select("trx", F.col("st").cast("bigint").alias("st"), F.round(starts.start_ratio(F.col("ltm"), F.col("chx"), F.col("st")), 9).alias("ratio"))


@query(f"""WITH {DNA}, i AS (SELECT item_id, seq, unnest(range(0, 30, 5)) AS codon FROM dna), p AS (SELECT item_id, codon, repeat('N', 40) || seq || repeat('N', 200) AS padded, codon * 3 + 40 AS place FROM i),
c AS (SELECT item_id, codon, substr(padded, CAST(place + 1 AS INT), 48) AS context FROM p) SELECT item_id, codon, context, {table_queries._peptide('substr(context, 1, 45)')} AS peptide FROM c""")
def pause_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = views.dna(spark, sf_dir).withColumn("codon", F.explode(F.sequence(F.lit(0), F.lit(25), F.lit(5)))).withColumn("codon", F.col("codon").cast("bigint"))
    return at.select("item_id", "codon", *reports.pause_context(F.col("seq"), F.lit(30).cast("bigint"), F.col("codon")))


@query("""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS gene, CAST(vec_id % 40 AS BIGINT) AS st, [(round(x * 1000))::DOUBLE FOR x IN embedding] AS sc FROM embeddings
 WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND vec_id % 40 < 38)
SELECT gene, st + 1 AS size, round(coalesce(list_sum(sc[1:st]), 0), 6) AS total FROM e WHERE st > 0""")
def pars_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all genes, scores of two thirds of them; CDS are missing or leave their transcript for some."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("gene"), "embedding")
    g, first = F.col("gene"), F.col("gene") % 7
    whole = e.select("gene", F.lit("Transcript").alias("ftype"), first.alias("start"), (first + 40).alias("end"))
    cds = e.filter(g % 5 != 0).select("gene", F.lit("CDS").alias("ftype"), (first + g % 40).alias("start"), (first + g % 40 + 3).alias("end"))
    scores = e.filter(g % 3 != 0).select("gene", F.transform("embedding", lambda x: views.thousandths(x)).alias("scores"))
    stats = starts.pars_windows(reports.pars_items(whole.unionByName(cds), scores))
    return stats.select("gene", "size", F.round("total", 6).alias("total"))


@query(f"WITH {TRX} SELECT count(DISTINCT CASE WHEN trx_id % 3 = 0 THEN gene_id + 1000000 ELSE gene_id END) AS genes FROM trx WHERE trx_id % 3 <> 1")
def distinct_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes after the map's renaming and suppression."""
    trx = views.transcripts(spark, sf_dir)
    gene_map = trx.filter("trx_id % 3 < 2").select("trx_id", F.when(F.col("trx_id") % 3 == 0, (F.col("gene_id") + 1000000).cast("string")).alias("gene_id"))
    return tables.remapped(trx, gene_map).agg(F.count_distinct("gene_id").alias("genes"))
