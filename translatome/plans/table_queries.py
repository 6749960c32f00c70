"""Queries over quantities, sequences, barcodes and starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.functions import sequences
from translatome.functions.statistics import quantiles_type8
from translatome.operators import asites, barcodes, quantities, starts, svm, windows
from translatome.plans import views
from translatome.plans.registry import also, query
from translatome.plans.views import DNA, table
from translatome.sources import folders, reads

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def q8(rows: str, group: str, value: str, p: float) -> str:
    """A DuckDB expression for the type-8 quantile over rows numbered k of n in their group."""
    t = f"(1/3.0::DOUBLE + {p} * (n + 1/3.0::DOUBLE))"
    j = f"floor({t} + 8.881784197001252e-16)"
    h = f"({t} - {j})"
    low, high = f"least(greatest({j}, 1), n)", f"least(greatest({j} + 1, 1), n)"
    return f"((1 - max({h})) * max(CASE WHEN k = {low} THEN {value} END) + max({h}) * max(CASE WHEN k = {high} THEN {value} END))"


@query(f"""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k,
 count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, round({q8('r', 'l_returnflag', 'v', 0.25)}, 4) AS q25, round({q8('r', 'l_returnflag', 'v', 0.5)}, 4) AS q50,
 round({q8('r', 'l_returnflag', 'v', 0.95)}, 4) AS q95 FROM r GROUP BY 1""")
def quantile_type8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles_type8(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q95": 0.95})
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q95")])


@query(f"""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k,
 count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, round({q8('r', '', 'v', 0.75)} - {q8('r', '', 'v', 0.25)}, 4) AS iqr FROM r GROUP BY 1""")
def iqr_type8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles_type8(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"a": 0.25, "b": 0.75})
    return q.select("o_orderpriority", F.round(F.col("b") - F.col("a"), 4).alias("iqr"))


QUANTS = """quants AS (SELECT g.gene, s.sample, count(e.event_id) AS n FROM (SELECT DISTINCT user_id AS gene FROM events) g
 CROSS JOIN (SELECT DISTINCT event_type AS sample FROM events) s LEFT JOIN events e ON e.user_id = g.gene AND e.event_type = s.sample GROUP BY 1, 2)"""


def _quants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    grid = e.select(F.col("user_id").alias("gene")).distinct().crossJoin(F.broadcast(e.select(F.col("event_type").alias("sample")).distinct()))
    counts = e.groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("sample")).agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, ["gene", "sample"], "left").na.fill(0, ["count"])


_SUMS = ", ".join(f"CAST(sum(CASE WHEN sample = '{s}' THEN n END) AS BIGINT) AS {s}" for s in EVENT_TYPES)


@query(f"WITH {QUANTS} SELECT gene, {_SUMS} FROM quants GROUP BY gene")
def quant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.quant_matrix(_quants(spark, sf_dir), list(EVENT_TYPES))


@query(f"""WITH {QUANTS}, kept AS (SELECT * FROM quants WHERE gene IN (SELECT gene FROM quants GROUP BY gene HAVING max(n) > 0)),
r AS (SELECT sample, n AS v, row_number() OVER (PARTITION BY sample ORDER BY n) AS k, count(*) OVER (PARTITION BY sample) AS n FROM kept),
q AS (SELECT sample, {q8('r', '', 'v', 0.75)} AS q3 FROM r GROUP BY 1), m AS (SELECT sample, q3, q3 * (SELECT sum(n) FROM quants) / (SELECT sum(q3) FROM q) AS norm FROM q)
SELECT sample, round(q3, 6) AS q3, round(norm, 4) AS norm, round(1e6 / norm, 4) AS factor FROM m""")
def uq_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = quantities.upper_quartile_norm(_quants(spark, sf_dir))
    return n.select("sample", F.round("q3", 6).alias("q3"), F.round("norm", 4).alias("norm"), F.round("factor", 4).alias("factor"))


PAUSES = f"""prof0 AS (SELECT l_suppkey AS gene, CAST(l_partkey % 60 AS BIGINT) AS idx, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
prof AS (SELECT g.gene, i.range AS idx, coalesce(p.n, 0) AS n, 60 AS len FROM (SELECT DISTINCT gene FROM prof0) g CROSS JOIN range(0, 60) i
 LEFT JOIN prof0 p ON p.gene = g.gene AND p.idx = i.range),
inner0 AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n) AS k, count(*) OVER (PARTITION BY gene) AS size FROM prof WHERE idx >= 15 AND idx < len - 5),
st AS (SELECT gene, sum((n0 = 0)::INT) AS zeros, max(size) AS size, {q8('', '', 'n0', 0.5).replace('(n +', '(40 +').replace(', n)', ', 40)')} AS median,
 {q8('', '', 'n0', 0.75).replace('(n +', '(40 +').replace(', n)', ', 40)')} - {q8('', '', 'n0', 0.25).replace('(n +', '(40 +').replace(', n)', ', 40)')} AS iqr
 FROM (SELECT gene, n AS n0, k, size FROM inner0) GROUP BY gene)"""


def _pause_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.col("l_suppkey").alias("gene"), (F.col("l_partkey") % 60).alias("idx")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    grid = rows.select("gene").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(59).cast("bigint"))))
    return grid.join(rows, ["gene", "idx"], "left").na.fill(0, ["n"]).withColumn("len", F.lit(60).cast("bigint"))


@query(f"""WITH {PAUSES}, pz AS (SELECT p.gene, count(*) AS pauses FROM prof p JOIN st ON st.gene = p.gene WHERE p.idx >= 5 AND p.idx < 58 AND p.n >= 1.5 * st.median GROUP BY 1),
c AS (SELECT st.*, coalesce(pz.pauses, 0) AS np, CASE WHEN zeros * 2 > size THEN 'zeros' WHEN median < 3 - 1e-6 THEN 'low' WHEN iqr > 3 * median THEN 'spread' ELSE 'ok' END AS class
 FROM st LEFT JOIN pz ON pz.gene = st.gene)
SELECT gene, class, round(CASE WHEN class <> 'zeros' THEN median END, 6) AS median, round(CASE WHEN class IN ('spread', 'ok') THEN iqr END, 6) AS iqr,
 CASE WHEN class = 'ok' THEN np END AS pauses FROM c""")
def pause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quantities.pause_statistics(_pause_profile(spark, sf_dir), least_pause=1.5)
    return s.select("gene", "class", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"), "pauses")


@query(f"""WITH {PAUSES} SELECT p.gene, p.idx, 59 - p.idx AS to_stop, p.n, round(p.n / nullif(st.median, 0), 6) AS over_median FROM prof p JOIN st ON st.gene = p.gene
 WHERE p.idx >= 5 AND p.idx < 58 AND p.n >= 1.5 * st.median""")
def pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _pause_profile(spark, sf_dir)
    inner = profile.filter((F.col("idx") >= 15) & (F.col("idx") < F.col("len") - 5))
    rows = quantities.pause_rows(profile, quantiles_type8(inner, ["gene"], "n", {"median": 0.5}), 1.5)
    return rows.withColumn("over_median", F.round("over_median", 6))


also("quant_table", "uq_norm", "pause_stats", "pauses")


SETS = """data AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer),
sets AS (SELECT 'nation ' || c_nationkey::VARCHAR AS set_name, c_custkey AS key FROM customer UNION ALL SELECT c_mktsegment, c_custkey FROM customer),
ranks AS (SELECT key, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM data),
us AS (SELECT s.set_name, count(*) AS n_in, (SELECT count(*) FROM data) - count(*) AS n_out, sum(r.r) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS u_in
 FROM sets s JOIN ranks r ON r.key = s.key GROUP BY 1)"""


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    nations = c.select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("set_name"), F.col("c_custkey").alias("key"))
    return c.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")), nations.union(c.select("c_mktsegment", "c_custkey"))


@query(f"WITH {SETS} SELECT set_name, n_in, n_out, round(u_in, 1) AS u_in, round(n_in::DOUBLE * n_out - u_in, 1) AS u_out FROM us")
def rank_sum_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.rank_sums(*_data(spark, sf_dir)).select("set_name", "n_in", "n_out", F.round("u_in", 1).alias("u_in"), F.round("u_out", 1).alias("u_out"))


@query(f"""WITH {SETS}, g AS (SELECT count(*)::DOUBLE AS t FROM data GROUP BY value), n AS (SELECT sum(t) AS n, sum(t * t * t - t) AS tied FROM g),
z AS (SELECT set_name, abs(u_in - n_in::DOUBLE * n_out / 2) / sqrt(n_in::DOUBLE * n_out / 12 * (n + 1 - tied / (n * (n - 1)))) AS z FROM us CROSS JOIN n),
t AS (SELECT set_name, z, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z)
SELECT set_name, round(least(1.0::DOUBLE, 2 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE
 + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))), 9) AS pval FROM t""")
def rank_sum_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significance of rank sums, with the variance that equal values leave."""
    data, sets = _data(spark, sf_dir)
    return quantities.significance(quantities.rank_sums(data, sets), data).select("set_name", F.round("pval", 9).alias("pval"))


@query(f"""WITH {SETS}, n AS (SELECT DISTINCT set_name FROM sets), i AS (SELECT s.set_name, median(d.value) AS m FROM sets s JOIN data d ON d.key = s.key GROUP BY 1),
o AS (SELECT n.set_name, median(d.value) AS m FROM n CROSS JOIN data d LEFT JOIN sets s ON s.set_name = n.set_name AND s.key = d.key WHERE s.key IS NULL GROUP BY 1)
SELECT i.set_name, round(i.m, 4) AS median_in, round(o.m, 4) AS median_out, round(i.m - o.m, 4) AS difference FROM i JOIN o ON o.set_name = i.set_name""")
def subset_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quantities.subset_medians(*_data(spark, sf_dir))
    return m.select("set_name", *[F.round(c, 4).alias(c) for c in ("median_in", "median_out", "difference")])


@query(f"""WITH {SETS}, z AS (SELECT set_name, abs(u_in - n_in::DOUBLE * n_out / 2) / sqrt(n_in::DOUBLE * n_out * (n_in + n_out + 1) / 12) AS z FROM us),
t AS (SELECT set_name, z, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z),
pv AS (SELECT set_name, least(1.0::DOUBLE, 2 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE
 + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))) AS pval FROM t),
cuts AS (SELECT 0.1::DOUBLE / pow(sqrt(2.0::DOUBLE), range) AS cut FROM range(0, 50)), tr AS (SELECT cut, count(*) AS n_all, sum((pval <= cut)::INT) AS n_sig FROM pv CROSS JOIN cuts GROUP BY 1),
g AS (SELECT cut, cut * n_all / n_sig AS fdr FROM tr WHERE n_sig > 0)
SELECT p.set_name, round(least(1.0, coalesce(min(g.cut), 1.0)), 9) AS p, round(least(1.0, coalesce(min(g.fdr), 1.0)), 9) AS q FROM pv p LEFT JOIN g ON p.pval <= g.cut GROUP BY 1""")
def fdr_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quantities.fdr_scan(quantities.rank_sums(*_data(spark, sf_dir)))
    return f.select("set_name", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


BUCKETS = """b AS (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'tp' WHEN toxic = 1 THEN 'fp' WHEN quality = 1 THEN 'fn' ELSE 'tn' END AS bucket, count(*) AS n FROM labels GROUP BY 1)"""


@query(f"WITH {BUCKETS} SELECT bucket, n FROM b")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query(f"""WITH {BUCKETS}, w AS (SELECT coalesce(CAST(sum(n) FILTER (bucket = 'tp') AS BIGINT), 0) AS tp, coalesce(CAST(sum(n) FILTER (bucket = 'fp') AS BIGINT), 0) AS fp,
 coalesce(CAST(sum(n) FILTER (bucket = 'tn') AS BIGINT), 0) AS tn, coalesce(CAST(sum(n) FILTER (bucket = 'fn') AS BIGINT), 0) AS fn FROM b)
SELECT tp, fp, tn, fn, round(tn::DOUBLE / nullif(tn + fp, 0), 9) AS specificity, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS sensitivity FROM w""")
def sens_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quantities.sensitivity_specificity(confusion(spark, sf_dir))
    return s.withColumn("specificity", F.round("specificity", 9)).withColumn("sensitivity", F.round("sensitivity", 9))


#: Two dense profiles of 60 bases for each user.
PROFILES = """pr AS (SELECT u.user_id AS trx, g.range AS nt, count(e.event_id) FILTER (e.event_id % 3 <> 0) AS ltm, count(e.event_id) FILTER (e.event_id % 3 = 0) AS chx
 FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(0, 60) g LEFT JOIN events e ON e.user_id = u.user_id AND (e.event_id // 7) % 60 = g.range GROUP BY 1, 2)"""


def _arrays(spark: SparkSession, sf_dir: str, size: int = 60) -> DataFrame:
    """trx, ltm, chx: dense arrays, from the covered bases alone."""
    e = table(spark, sf_dir, "events")
    nt = F.floor(F.col("event_id") / 7) % size
    third = F.col("event_id") % 3 == 0
    counts = e.groupBy(F.col("user_id").alias("trx"), nt.alias("nt")).agg(F.count(F.when(~third, 1)).alias("ltm"), F.count(F.when(third, 1)).alias("chx"))
    known = F.col("trx").isNotNull() & (F.col("nt") >= 0)
    # a fixed number of parts: what is done with an array takes far more than its few bytes tell
    dealt = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "trx")
    rows = dealt.groupBy("trx").agg(F.sort_array(F.collect_list(F.when(known, F.struct("nt", "ltm", "chx")))).alias("at"))
    return rows.select("trx", *(asites.dense_counts(F.col("at"), F.lit(size), c).alias(c) for c in ("ltm", "chx")))


def _profiles(spark: SparkSession, sf_dir: str, size: int = 60) -> DataFrame:
    each = _arrays(spark, sf_dir, size).select("trx", F.posexplode(F.arrays_zip("ltm", "chx")).alias("nt", "n"))
    return each.select("trx", F.col("nt").cast("bigint").alias("nt"), "n.ltm", "n.chx")


#: Profiles of 90 bases for the caller, whose features reach from 7 bases before a start to 40 behind it.
LONG_PROFILES = PROFILES.replace("range(0, 60)", "range(0, 90)").replace("% 60", "% 90")


@query(f"""WITH {LONG_PROFILES}, f AS (SELECT trx, [
 sum(ltm) FILTER (nt BETWEEN 13 AND 18), sum(ltm) FILTER (nt BETWEEN 19 AND 21), sum(ltm) FILTER (nt BETWEEN 22 AND 24), sum(ltm) FILTER (nt BETWEEN 25 AND 27),
 sum(ltm) FILTER (nt BETWEEN 28 AND 33), sum(ltm) FILTER (nt BETWEEN 34 AND 42), sum(ltm) FILTER (nt BETWEEN 43 AND 51), sum(ltm) FILTER (nt BETWEEN 52 AND 60),
 sum(chx) FILTER (nt BETWEEN 13 AND 18), sum(chx) FILTER (nt BETWEEN 19 AND 21), sum(chx) FILTER (nt BETWEEN 22 AND 24), sum(chx) FILTER (nt BETWEEN 25 AND 27),
 sum(chx) FILTER (nt BETWEEN 28 AND 33), sum(chx) FILTER (nt BETWEEN 34 AND 42), sum(chx) FILTER (nt BETWEEN 43 AND 51), sum(chx) FILTER (nt BETWEEN 52 AND 60)]::DOUBLE[] AS v
 FROM pr GROUP BY trx),
k AS (SELECT trx, v, list_sum(v) AS total, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM f)
SELECT trx, i.range AS i, round(CASE WHEN total >= 10 THEN CASE WHEN norm > 0 THEN v[i.range + 1] / norm ELSE 0 END END, 9) AS feature FROM k CROSS JOIN range(0, 16) i""")
def start_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a start at base 20: eight groups of codons in each of two samples."""
    f = starts.start_features(_arrays(spark, sf_dir, 90), F.lit(20), ["ltm", "chx"], 10)
    each = f.select("trx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("i"), "features")
    return each.select("trx", "i", F.round(F.get("features", F.col("i")), 9).alias("feature"))


LTM = f"""{PROFILES}, tot AS (SELECT trx, sum(ltm) AS lt, sum(chx) AS ct FROM pr GROUP BY 1),
en AS (SELECT p.trx, p.nt AS st, t.lt, t.ct, sum(ltm) OVER w AS c, sum(chx) OVER w AS x FROM pr p JOIN tot t ON t.trx = p.trx WINDOW w AS (PARTITION BY p.trx ORDER BY nt ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING)),
ez AS (SELECT trx, st, CAST(c AS BIGINT) AS ltm_sum, (x * lt)::DOUBLE / nullif(ct, 0) AS expected FROM en WHERE st <= 55),
enriched AS (SELECT trx, st, ltm_sum, expected, coalesce(expected IS NOT NULL AND ltm_sum >= 4 AND ltm_sum - expected >= 0 AND ltm_sum >= expected * 2, FALSE) AS is_start FROM ez)"""


@query(f"WITH {LTM} SELECT trx, st, ltm_sum, round(expected, 9) AS expected, is_start FROM enriched")
def ltm_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts.enrichment(_arrays(spark, sf_dir)).withColumn("expected", F.round("expected", 9))


@query(f"""WITH {PROFILES}, r AS (SELECT trx, nt, nt - row_number() OVER (PARTITION BY trx ORDER BY nt) AS run FROM pr WHERE ltm > 0)
SELECT trx, min(nt) AS "first", max(nt) AS "last" FROM r GROUP BY trx, run""")
def bool_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(_profiles(spark, sf_dir).filter("ltm > 0"), ["trx"])


@query(f"""WITH {PROFILES}, r AS (SELECT trx, nt, ltm > 1 AS a, chx > 0 AS b, nt - row_number() OVER (PARTITION BY trx ORDER BY nt) AS run FROM pr WHERE ltm > 1 OR chx > 0),
h AS (SELECT trx, min(nt) AS "first", max(nt) AS "last", min(nt) FILTER (a) AS a_first, max(nt) FILTER (a) AS a_last, min(nt) FILTER (b) AS b_first, max(nt) FILTER (b) AS b_last,
 min(nt) FILTER (a AND b) AS both_first, max(nt) FILTER (a AND b) AS both_last FROM r GROUP BY trx, run)
SELECT *, CASE WHEN both_first IS NOT NULL THEN 'B' WHEN a_first IS NOT NULL AND b_first IS NULL THEN 'H' WHEN b_first IS NOT NULL AND a_first IS NULL THEN 'L' ELSE '?' END AS kind FROM h""")
def peak_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = _profiles(spark, sf_dir).select("trx", "nt", (F.col("ltm") > 1).alias("a"), (F.col("chx") > 0).alias("b"))
    return windows.peak_hulls(track, ["trx"]).withColumn("kind", windows.peak_type())


@query(None)
def start_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model has no SQL; tested on planted starts."""
    rows = _arrays(spark, sf_dir, 90).withColumn("cds_start", F.lit(20))
    examples = starts.start_features(starts.training_positions(rows), F.col("at"), ["ltm", "chx"], 10)
    called = starts.call_starts(svm.train(examples), examples)
    return called.select("trx", "at", "label", F.round("score", 3).alias("score"), "called")


def _caller(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Profiles, and the training positions called by a model that was written and read again."""
    rows = _arrays(spark, sf_dir, 90).withColumn("cds_start", F.lit(20))
    examples = starts.start_features(starts.training_positions(rows), F.col("at"), ["ltm", "chx"], 10)
    folder = folders.fresh(spark, "caller")
    starts.write_caller(svm.train(examples), ["ltm", "chx"], 10, folder)
    model, config = starts.read_caller(spark, folder)
    return starts.called_positions(model, rows, **config), starts.call_starts(model, examples)


@query(None)
def start_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at positions 0 .. length of each transcript, null near its ends; a trained model has no SQL."""
    every, _ = _caller(spark, sf_dir)
    return every.select("trx", "at", F.round("score", 3).alias("score"), "called")


@query(None)
def start_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the training positions by bucket, from the files of the buckets; a trained model has no SQL."""
    _, examples = _caller(spark, sf_dir)
    folder = folders.fresh(spark, "scores")
    starts.write_scores(starts.score_buckets(examples), folder)
    return starts.read_scores(spark, folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.round(F.avg("score"), 3).alias("mean_score"))


@query(None)
def start_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the trained caller and of enrichment, with what they share; a trained model has no SQL."""
    every, _ = _caller(spark, sf_dir)
    a = every.filter(F.col("at") < 60).select("trx", F.col("at").cast("bigint").alias("nt"), "called")  # enrichment's profiles end there
    b = starts.enrichment(_arrays(spark, sf_dir)).select("trx", F.col("st").alias("nt"), F.col("is_start").alias("called"))
    return windows.peak_hulls(starts.called_by_either(a, b), ["trx"]).withColumn("kind", windows.peak_type())


@query(f"""WITH {LTM}, r AS (SELECT trx, st, st - row_number() OVER (PARTITION BY trx ORDER BY st) AS run FROM enriched WHERE is_start)
SELECT trx, min(st) AS "first", max(st) AS "last", min(st) AS b_first, max(st) AS b_last, 'L' AS kind FROM r GROUP BY trx, run""")
def start_sites_untrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks where the trained caller is missing."""
    b = starts.enrichment(_arrays(spark, sf_dir)).filter("is_start").select("trx", F.col("st").alias("nt"), F.col("is_start").alias("called"))
    track = starts.predicted(_profiles(spark, sf_dir).select("trx", "nt"), None, b)
    return windows.peak_hulls(track, ["trx"]).withColumn("kind", windows.peak_type()).select("trx", "first", "last", "b_first", "b_last", "kind")


_CODON = "CASE {0} " + " ".join(
    f"WHEN '{a}{b}{c}' THEN '{sequences.CODE[16 * i + 4 * j + k]}'"
    for i, a in enumerate(sequences.CODE_BASES) for j, b in enumerate(sequences.CODE_BASES) for k, c in enumerate(sequences.CODE_BASES)
) + " ELSE 'X' END"


def _peptide(seq: str) -> str:
    return f"coalesce(array_to_string(list_transform(range(0, CAST(ceil(length({seq}) / 3.0) AS BIGINT)), lambda i: {_CODON.format(f'substr({seq}, i * 3 + 1, 3)')}), ''), '')"


def _stop(seq: str) -> str:
    stops = f"list_filter(range(0, CAST(ceil(length({seq}) / 3.0) AS BIGINT)), lambda i: substr({seq}, i * 3 + 1, 3) IN ('TAA', 'TAG', 'TGA'))"
    return f"list_min({stops})"


@query(f"WITH {DNA} SELECT item_id, {_peptide('seq')} AS peptide, {_stop('seq')} AS first_stop FROM dna")
def translate_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dna(spark, sf_dir).select("item_id", sequences.translated(F.col("seq")).alias("peptide"), sequences.first_stop_codon(F.col("seq")).alias("first_stop"))


ORFS = f"""{DNA}, st AS (SELECT item_id, seq, unnest(list_filter(range(0, greatest(length(seq) - 2, 0)), lambda i: substr(seq, i + 1, 3) = 'ATG')) AS "start" FROM dna),
rs AS (SELECT item_id, "start", substr(seq, "start" + 1) AS rest FROM st), so AS (SELECT *, {_stop('rest')} AS stop_codons FROM rs),
orfs AS (SELECT item_id, "start", rest, stop_codons, stop_codons * 3 + 3 AS orf_len FROM so)"""


@query(f"""WITH {ORFS}, p AS (SELECT *, CASE WHEN stop_codons IS NULL THEN rest ELSE substr(rest, 1, orf_len) END AS body FROM orfs)
SELECT item_id, "start", stop_codons, orf_len, {_peptide('body')} AS peptide FROM p""")
def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts.orfs(views.dna(spark, sf_dir))


@query(f"""WITH {ORFS}, c AS (SELECT *, CASE WHEN item_id % 5 = 0 THEN NULL ELSE 30 END AS cs, 60 AS cl, "start" - 30 AS so, "start" - 1 + orf_len - 89 AS eo FROM orfs)
SELECT item_id, "start", CASE WHEN cs IS NULL THEN 'sprc' WHEN so = 0 THEN 'canonical' WHEN so > 0 AND coalesce(eo = 0, FALSE) THEN 'truncation' WHEN so > 0 THEN 'internal-out-of-frame'
 WHEN coalesce(orf_len + so < 0, FALSE) THEN 'uorf' WHEN coalesce(eo = 0, FALSE) THEN 'extension' ELSE 'uorf-overlapping' END AS class FROM c""")
def orf_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = starts.orfs(views.dna(spark, sf_dir)).withColumn("cs", F.when(F.col("item_id") % 5 == 0, None).otherwise(30))
    return o.select("item_id", "start", starts.orf_class(F.col("start"), F.col("cs"), F.lit(60), F.col("orf_len")).alias("class"))


@query(f"""WITH {DNA}, c AS (SELECT item_id, unnest(list_transform(range(0, greatest(length(seq) - 2, 0)), lambda i: substr(seq, i + 1, 3))) AS codon FROM dna)
SELECT codon, count(*) AS n FROM c WHERE codon IN ('ATG', 'CTG', 'GTG', 'TTG', 'AAG', 'ACG', 'AGG', 'ATA', 'ATC', 'ATT') GROUP BY 1""")
def codon_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.dna(spark, sf_dir)
    at = d.withColumn("i", F.explode(sequences.codon_starts(F.col("seq"), F.lit(0), F.length("seq") - 3, sequences.CANDIDATE_STARTS)))
    return at.groupBy(F.substr(F.col("seq"), F.col("i") + 1, F.lit(3)).alias("codon")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DNA}, c AS (SELECT item_id, seq, unnest(list_filter(range(0, 61), lambda i: substr(seq, i + 1, 3) IN ('ATG', 'CTG', 'GTG', 'TTG', 'AAG', 'ACG', 'AGG', 'ATA', 'ATC', 'ATT'))) AS nt FROM dna),
r AS (SELECT item_id, seq, nt, substr(seq, nt + 1) AS rest FROM c), s AS (SELECT *, {_stop('rest')} AS codons FROM r)
SELECT item_id, nt, substr(rest, 1, 3) AS codon, codons, CASE WHEN codons IS NULL THEN 58 ELSE least(58, nt + 3 * codons + 1) END AS quant_end,
 CASE WHEN nt >= 3 THEN substr(seq, nt - 2, 7) END AS context FROM s""")
def uorf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.dna(spark, sf_dir).withColumn("cds_start", F.lit(60).cast("bigint")).withColumn("cds_len", F.lit(30).cast("bigint"))
    return starts.uorf_candidates(d).drop("cds_start", "cds_len")


@query(f"""WITH {PROFILES}, c AS (SELECT trx, nt, ltm, lag(ltm) OVER w AS m1, lead(ltm) OVER w AS p1, lead(ltm, 2) OVER w AS p2, lead(ltm, 3) OVER w AS p3, lead(ltm, 4) OVER w AS p4
 FROM pr WINDOW w AS (PARTITION BY trx ORDER BY nt)), s AS (SELECT trx, nt, m1 + ltm + p1 AS "before", p2 + p3 + p4 AS "after", p3 FROM c WHERE nt BETWEEN 1 AND 55)
SELECT trx, nt, "before", "after", round(p3::DOUBLE / nullif("after", 0), 9) AS frame, round(CASE WHEN "before" > 0 AND "after" > 0 THEN least(10.0, log2("after"::DOUBLE / "before"))
 WHEN "before" = 0 AND "after" > 0 THEN 10.0 END, 9) + 0.0 AS log_ratio, coalesce("before" + "after" >= 3 AND CASE WHEN "before" > 0 THEN "after"::DOUBLE / "before" >= 1.5 ELSE "after" > 0 END
 AND p3::DOUBLE / nullif("after", 0) >= 0.4, FALSE) AS is_start FROM s""")
def uorf_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _arrays(spark, sf_dir).withColumn("nt", F.explode(F.sequence(F.lit(1), F.lit(55))))
    t = starts.start_test(F.col("ltm"), F.col("nt"), 3, 1.5, 0.4)
    rows = at.select("trx", F.col("nt").cast("bigint").alias("nt"), t.alias("t")).select("trx", "nt", "t.*")
    return rows.withColumn("frame", F.round("frame", 9)).withColumn("log_ratio", F.round("log_ratio", 9) + 0.0)


_PEAK = "coalesce(list_filter(range({0}, {1}), lambda i: substr(seq, i + 1, 3) IN ({2})), [])"
_NEAR = "'CTG', 'GTG', 'TTG', 'ACG'"


@query(f"""WITH {DNA}, t AS (SELECT item_id, {_PEAK.format(12, 21, "'ATG'")} AS a, {_PEAK.format(5, 41, "'ATG'")} AS b, {_PEAK.format(12, 21, _NEAR)} AS c, {_PEAK.format(5, 41, _NEAR)} AS d FROM dna),
u AS (SELECT item_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c ELSE d END AS found FROM t)
SELECT item_id, len(found) AS n_codons, coalesce(array_to_string(found, ','), '') AS codons FROM u""")
def peak_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = starts.peak_codons(F.col("seq"), F.lit(5), F.lit(40), F.lit(12), F.lit(20))
    rows = views.dna(spark, sf_dir).select("item_id", found.alias("found"))
    return rows.select("item_id", F.size("found").cast("bigint").alias("n_codons"), F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("codons"))


CODES = """codes AS (SELECT item_id AS name, substr(seq, 1, 8) AS seq FROM dna WHERE length(seq) >= 8)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.dna(spark, sf_dir).filter("length(seq) >= 8").select(F.col("item_id").alias("name"), F.substr(F.col("seq"), F.lit(1), F.lit(8)).alias("seq"))


_HAMMING = "list_sum(list_transform(range(1, 9), lambda i: (substr(a.seq, i, 1) <> substr(b.seq, i, 1))::BIGINT))"


@query(f"WITH {DNA}, {CODES} SELECT a.name AS name_a, b.name AS name_b, CAST({_HAMMING} AS BIGINT) AS distance FROM codes a CROSS JOIN codes b")
def hamming_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    return barcodes.distances(codes, codes).select("name_a", "name_b", "distance")


@query(f"""WITH {DNA}, {CODES}, d AS (SELECT a.name, b.name AS nearest, CAST({_HAMMING} AS BIGINT) AS distance FROM codes a JOIN codes b ON a.name <> b.name),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, nearest) AS k FROM d) SELECT name, nearest, distance FROM r WHERE k = 1""")
def nearest_barcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.nearest(_codes(spark, sf_dir))


@query(f"""WITH {DNA}, {CODES}, d AS (SELECT a.name, b.name AS nearest, CAST({_HAMMING} AS BIGINT) AS distance FROM codes a JOIN codes b ON a.name <> b.name),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, nearest DESC) AS k FROM d) SELECT name, nearest, distance FROM r WHERE k = 1""")
def nearest_barcode_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On ties the one that comes first in an order of the input's own: here, the highest name."""
    return barcodes.nearest(_codes(spark, sf_dir).withColumn("place", -F.col("name")), "place")


@query(f"""WITH RECURSIVE {DNA}, {CODES}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base), g AS (SELECT DISTINCT seq, 0 AS n FROM codes
 UNION ALL SELECT g.seq || b.base, g.n + 1 FROM g CROSS JOIN b WHERE g.n < 3 AND NOT contains(right(g.seq, 2), b.base)) SELECT seq FROM g WHERE n = 3""")
def barcode_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct barcode lengthened by three bases, in all ways."""
    return barcodes.grown(_codes(spark, sf_dir), 3)


@query(f"""WITH {DNA}, {CODES}, n AS (SELECT c.name, c.seq, i.range AS i, b.base FROM codes c CROSS JOIN range(1, 9) i CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS base) b)
SELECT name, substr(seq, 1, i - 1) || base || substr(seq, i + 1) AS neighbour FROM n WHERE substr(seq, i, 1) <> base""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("name", F.explode(sequences.neighbours(F.col("seq"))).alias("neighbour"))


@query(f"WITH {DNA}, {CODES} SELECT name, seq, CAST(list_sum(list_transform(range(1, 9), lambda i: (strpos('ACGTN', substr(seq, i, 1)) - 1) * CAST(pow(5, 8 - i) AS BIGINT))) AS BIGINT) AS number, seq AS back FROM codes")
def base5_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _codes(spark, sf_dir).withColumn("number", sequences.base5(F.col("seq")))
    return c.withColumn("back", sequences.from_base5(F.col("number"), F.lit(8)))


@query(None)
def barcode_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection is sequential; tested against a brute-force version."""
    codes = _codes(spark, sf_dir)
    return barcodes.selected(codes.filter("NOT startswith(seq, 'AC')"), codes.filter("startswith(seq, 'AC')").dropDuplicates(["seq"]), 4)


@query(f"""WITH {DNA}, {CODES}, x AS (SELECT seq, TRUE AS extant FROM codes WHERE starts_with(seq, 'A') UNION ALL SELECT seq, FALSE FROM codes) SELECT seq, bool_or(extant) AS extant FROM x GROUP BY 1""")
def barcode_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All barcodes as candidates beside those that start with A as extant ones."""
    codes = _codes(spark, sf_dir)
    return barcodes.pool(codes, codes.filter("startswith(seq, 'A')"))


SAMPLES = (("one", "ACG"), ("two", "TTA"), ("three", "GAT"))
#: Prefix NNI, suffix II: the index is the third base and the last two.
FASTQ = f"""{DNA}, fq AS (SELECT item_id AS name, seq, substr(seq, 1, 2) AS barcode, substr(seq, 3, 1) || substr(seq, length(seq) - 1, 2) AS idx, length(seq) < 80 AS short FROM dna),
sm AS (SELECT unnest(['one', 'two', 'three']) AS sample, unnest(['ACG', 'TTA', 'GAT']) AS sidx),
mm AS (SELECT f.name, m.sample, CAST((substr(f.idx, 1, 1) <> substr(m.sidx, 1, 1))::INT + (substr(f.idx, 2, 1) <> substr(m.sidx, 2, 1))::INT + (substr(f.idx, 3, 1) <> substr(m.sidx, 3, 1))::INT AS BIGINT) AS mismatches
 FROM fq f CROSS JOIN sm m), hit AS (SELECT name, sample, mismatches FROM mm WHERE mismatches <= 1),
assigned AS (SELECT f.name, CASE WHEN f.short THEN NULL ELSE f.barcode END AS barcode, CASE WHEN f.short THEN 'TooShort' ELSE coalesce(h.sample, 'UnknownIndex') END AS fate,
 CASE WHEN f.short THEN NULL ELSE h.mismatches END AS mismatches, CASE WHEN f.short THEN NULL ELSE substr(f.seq, 4, length(f.seq) - 5) END AS insert_seq, CASE WHEN f.short THEN NULL ELSE f.idx END AS idx
 FROM fq f LEFT JOIN hit h ON h.name = f.name)"""


def _demuxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fastq = views.dna(spark, sf_dir).select(F.col("item_id").alias("name"), "seq", F.col("seq").alias("qual"))
    return barcodes.demultiplexed(fastq, spark.createDataFrame(SAMPLES, "name string, idx string"), "NNI", "II", 75)


@query(f"WITH {FASTQ} SELECT name, barcode, fate, mismatches, insert_seq FROM assigned")
def demux_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demuxed(spark, sf_dir).select("name", "barcode", "fate", "mismatches", F.col("insert").alias("insert_seq"))


@query(f"WITH {FASTQ} SELECT fate, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM assigned), 9) AS percent FROM assigned GROUP BY 1")
def demux_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.fates(_demuxed(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


@query(f"""WITH {FASTQ}, al AS (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS x), gr AS (SELECT s.fate AS sample, a.x || b.x AS barcode FROM (SELECT DISTINCT fate FROM assigned WHERE fate NOT IN ('TooShort', 'UnknownIndex')) s CROSS JOIN al a CROSS JOIN al b)
SELECT g.sample, g.barcode, count(q.name) AS n FROM gr g LEFT JOIN assigned q ON q.fate = g.sample AND q.barcode = g.barcode GROUP BY 1, 2""")
def demux_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.barcode_counts(_demuxed(spark, sf_dir), 2)


@query(f"""WITH {FASTQ}, full_rows AS (SELECT q.*, f.seq, m.sidx, CAST(list_sum(list_transform(range(1, 4), lambda i: (substr(q.idx, i, 1) <> 'N')::BIGINT)) AS BIGINT) AS from_none
 FROM assigned q JOIN fq f ON f.name = q.name LEFT JOIN sm m ON m.sample = q.fate)
SELECT CASE WHEN fate = 'TooShort' THEN name::VARCHAR ELSE name::VARCHAR || '#' || barcode || ' ' || idx || ':' || coalesce(mismatches, from_none)::VARCHAR || ':' || coalesce(sidx, 'NNN') END AS name,
 CASE WHEN fate = 'TooShort' THEN seq ELSE insert_seq END AS seq, fate FROM full_rows WHERE seq <> ''""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demultiplexed reads by sample, those too short and the settings, written and read again."""
    folder = folders.fresh(spark, "split")
    rows = barcodes.renamed(_demuxed(spark, sf_dir).withColumn("name", F.col("name").cast("string"))).filter("seq <> ''")
    reads.write_split_fastq(rows, folder, {"prefix": "NNI", "suffix": "II", "least_insert": 75})
    return reads.read_split_fastq(spark, folder)[0].select("name", "seq", "fate")


@query(f"""WITH {FASTQ} SELECT name, name::VARCHAR || '#' || barcode || ' ' || idx || ':' || mismatches::VARCHAR || ':' || m.sidx AS new_name FROM assigned q JOIN sm m ON m.sample = q.fate""")
def demux_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _demuxed(spark, sf_dir).filter("sample is not null").withColumn("name", F.col("name").cast("string"))
    return barcodes.renamed(rows).select(F.col("name").cast("bigint").alias("name"), "new_name")


PAIRS = """pe AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN '.' ELSE (l_orderkey % 3)::VARCHAR END AS ref1, CASE WHEN l_suppkey % 7 = 0 THEN '.' ELSE ((l_orderkey + (l_partkey % 5) // 4) % 3)::VARCHAR END AS ref2,
 CAST(l_partkey * 1000 AS BIGINT) AS left1, CAST(l_partkey * 1000 + 30 AS BIGINT) AS right1, CAST(l_suppkey * 20000 AS BIGINT) AS left2, CAST(l_suppkey * 20000 + 30 AS BIGINT) AS right2,
 CASE WHEN l_returnflag = 'R' THEN '+' ELSE '-' END AS strand1, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand2 FROM lineitem),
pf AS (SELECT *, CASE WHEN strand1 = '+' THEN left1 ELSE left2 END AS low, CASE WHEN strand1 = '+' THEN right2 ELSE right1 END AS high FROM pe),
fated AS (SELECT *, CASE WHEN ref1 = '.' AND ref2 = '.' THEN 'nomatch' WHEN ref1 = '.' OR ref2 = '.' THEN 'onematch' WHEN ref1 <> ref2 THEN 'diffchr' WHEN strand1 = strand2 THEN 'samestrand'
 WHEN low + 1000000 <= high THEN 'toolong' WHEN low <= high THEN 'good' ELSE 'inverted' END AS fate FROM pf)"""


def _fated(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pe = li.select(
        F.when(F.col("l_partkey") % 11 == 0, ".").otherwise((F.col("l_orderkey") % 3).cast("string")).alias("ref1"),
        F.when(F.col("l_suppkey") % 7 == 0, ".").otherwise(((F.col("l_orderkey") + F.floor((F.col("l_partkey") % 5) / 4)) % 3).cast("string")).alias("ref2"),
        (F.col("l_partkey") * 1000).alias("left1"), (F.col("l_partkey") * 1000 + 30).alias("right1"),
        (F.col("l_suppkey") * 20000).alias("left2"), (F.col("l_suppkey") * 20000 + 30).alias("right2"),
        F.when(F.col("l_returnflag") == "R", "+").otherwise("-").alias("strand1"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand2"),
    )
    return pe.withColumn("fate", starts.bedpe_fate({c: F.col(c) for c in pe.columns}))


@query(f"WITH {PAIRS} SELECT fate, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM fated), 9) AS percent FROM fated GROUP BY 1")
def bedpe_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes.fates(_fated(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


@query(f"""WITH {PAIRS} SELECT ref1 AS ref, low AS "start", high AS "end", strand1 AS strand, count(*) AS n FROM fated WHERE fate = 'good' GROUP BY 1, 2, 3, 4""")
def bedpe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _fated(spark, sf_dir).filter("fate = 'good'")
    forward = F.col("strand1") == "+"
    return good.groupBy(
        F.col("ref1").alias("ref"), F.when(forward, F.col("left1")).otherwise(F.col("left2")).alias("start"),
        F.when(forward, F.col("right2")).otherwise(F.col("right1")).alias("end"), F.col("strand1").alias("strand"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _sum(low: str, count: str) -> str:
    return f"coalesce(list_sum(sc[({low}) + 1:({low}) + ({count})]), 0)"


_PLUS = ", ".join(f"round(CASE WHEN st + {c} >= 14 AND len(sc) > st + {c} + 15 THEN {_sum(f'st + {c} - 14', '30')} END, 6) AS plus{c}" for c in (15, 30, 45, 60, 75))


@query(f"""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS gene, CAST(vec_id % 40 AS BIGINT) AS st, [(round(x * 1000))::DOUBLE FOR x IN embedding] AS sc FROM embeddings),
w AS (SELECT *, list_transform(range(18, st + 1), lambda i: {{'s': {_sum('st - i', '30')}, 'i': i}}) AS spans FROM e WHERE st > 0), b AS (SELECT *, list_max(spans) AS best FROM w)
SELECT gene, st + 1 AS size, round({_sum('0', 'st')}, 6) AS total, round({_sum('0', 'st')} / (st + 1), 6) AS average, round(CASE WHEN len(sc) >= 30 THEN {_sum('0', '30')} END, 6) AS first30,
 round(CASE WHEN st >= 15 AND len(sc) > st + 15 THEN {_sum('st - 15', '30')} END, 6) AS start30, -best.i AS max30_pos, round(best.s, 6) AS max30, {_PLUS} FROM b""")
def pars_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("gene"), (F.col("vec_id") % 40).cast("bigint").alias("start"),
        F.transform("embedding", lambda x: views.thousandths(x)).alias("scores"),
    )
    w = starts.pars_windows(e)
    return w.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in w.dtypes])
