"""Counts of bases as arrays of each transcript: dealt out last, and the same as base by base."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import connect, same
from tests.test_shapes import _alike
from translatome.functions.statistics import l2_normalized
from translatome.operators import asites, reports, starts, svm, windows
from translatome.plans import table_queries

SF = "/root/testdata/sf0.001"


def _wanted(reads, trx, sites):
    """(trx_id, nt, len): n, read by read."""
    pairs = asites.placed(reads.join(sites, F.col("len") == F.col("read_len")), trx).withColumn("nt", F.col("lo") + F.col("delta"))
    return Counter((r.trx_id, r.nt, r.len) for r in pairs.filter("nt >= 0 AND nt < trx_len").collect())


def _inputs(spark):
    trx, reads = _alike(spark, 40)
    return trx, reads, spark.createDataFrame([(28, 14), (29, 14), (30, 35)], "read_len bigint, delta bigint")  # 35: off its own read


def test_base_counts(spark):
    trx, reads, sites = _inputs(spark)
    twice = trx.union(trx.filter("trx_id = 3"))  # a name given twice counts twice
    for t in (trx, twice):
        want = Counter()
        for (i, nt, n_len), n in _wanted(reads, t, sites).items():
            want[i, nt, n_len] += n
            want[i, nt, None] += n
        rows = asites.by_shape(t, lambda s: asites.base_counts(reads, s, sites, "len", (30, 28))).select("trx_id", F.inline("at")).collect()
        assert {(r.trx_id, r.nt): (r.n, r.n0, r.n1) for r in rows} == {k[:2]: (n, want[*k[:2], 30], want[*k[:2], 28]) for k, n in want.items() if k[2] is None}
        assert len(rows) == len({k[:2] for k in want})


def test_dense_counts(spark):
    rows = [(1, [(0, 5), (3, 2)], 5), (2, [(4, 1)], 5), (3, [], 2), (4, None, 3), (5, [(0, 7)], 1)]
    df = spark.createDataFrame(rows, "k int, at array<struct<nt:bigint,n:bigint>>, length bigint")
    found = {r.k: r.n for r in df.select("k", asites.dense_counts(F.col("at"), F.col("length")).alias("n")).collect()}
    assert found == {1: [5, 0, 0, 2, 0], 2: [0, 0, 0, 0, 1], 3: [0, 0], 4: [0, 0, 0], 5: [7]}


def test_report_of_bases(spark):
    trx, reads, sites = _inputs(spark)
    counted = lambda t: asites.dense_arrays(asites.base_counts(reads, t, sites), t)
    seq = F.when(F.col("trx_id") == 1, None).otherwise("ATGac")
    rows = reports.by_base(asites.by_shape(trx, counted, own=("blocks", "cds_start")).withColumn("seq", seq)).collect()
    want = Counter()
    for (i, nt, _), n in _wanted(reads, trx, sites).items():
        want[i, nt] += n
    assert {(r.trx_id, r.nt): r.n for r in rows} == {(i, nt): want[i, nt] for i in range(40) for nt in range(500)}
    assert [(r.base, r.amino) for r in sorted((r for r in rows if r.trx_id == 2), key=lambda r: r.nt)[:6]] == [("A", "M"), ("T", "*"), ("G", "D"), ("a", "X"), ("c", "X"), ("", "X")]
    assert {(r.base, r.amino) for r in rows if r.trx_id == 1} == {(None, "X")}


@pytest.mark.parametrize("name", ["asite_dense", "asite_profile", "asite_len_profile", "trx_report", "trx_report_lengths"])
def test_bases_are_dealt_out_last(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Generate" in above and "Repartition" not in above and "Aggregate" not in above


@pytest.mark.parametrize("name", ["profile_stats", "trx_report_heads", "codon_profile", "trx_report_codons"])
def test_bases_are_not_grouped_for_sums(spark, name):
    """Sums over a CDS are made of the A-sites at once."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [trx_id" in line and ", off#" in line.split("]")[0]]


def test_annotated_shuffles_no_pairs(spark):
    """Every kind of read: one block, spliced, on the edges of exons, off all transcripts, many at one place."""
    trx, reads = _alike(spark, 40)
    more = spark.createDataFrame([(100 + k, "a", "+-"[k % 2], [b], 28, 1) for k, b in enumerate([(100, 300), (99, 5), (396, 5), (449, 10), (450, 200), (649, 1), (5000, 28), (600, 60)] * 2)], reads.schema)
    reads = reads.union(more).union(more.withColumn("read_ord", F.col("read_ord") + (1 << 24)))
    for strands in ("same", "opposite", "any"):
        want = {}
        for p in asites.placed(reads, trx, 0, strands=strands).collect():
            want.setdefault(p.read_ord, []).append((p.trx_id, p.lo, "+" if p.strand == p.trx_strand else "-"))
        found = {r.read_ord: (r.names, r.starts, r.strands) for r in reports.annotated(reads, trx, strands).collect()}
        text = lambda rows: tuple(",".join(map(str, c)) for c in zip(*sorted(rows), strict=True))
        assert found == {r.read_ord: text(want[r.read_ord]) if r.read_ord in want else (None, None, None) for r in reads.collect()}
    plan = reports.annotated(reads.filter("size(blocks) = 1"), trx)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[: plan.index("RepartitionByExpression")]
    assert "Aggregate" not in first and "Generate explode(ords" in first  # texts are made above the join and dealt out to reads at once


def test_annotated_writes_a_text_once(spark, tmp_path):
    """Reads of one place are written side by side, in files whose texts fit in a dictionary: 480 texts of 66 KB on average are 24 that differ."""
    ids = F.lit(1_000_000_000) + F.col("id") * 330_089_441 % 999_999_937
    trx = spark.range(12_000).select(ids.alias("trx_id"), F.lit("a").alias("ref"), F.lit("+").alias("strand"), F.expr("array(struct(100 + id div 500 as start, 100L as len))").alias("blocks"))
    reads = spark.range(480).select(F.col("id").alias("read_ord"), F.lit("a").alias("ref"), F.lit("+").alias("strand"), F.expr("array(struct(100 + id % 24 as start, 28L as len))").alias("blocks"))
    reports.annotated(reads, trx).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".parquet"]
    assert rows.count() == 480 and rows.selectExpr("sum(length(names))").first()[0] == 20 * sum(500 * k * 11 - 1 for k in range(1, 25))
    assert sum(f.stat().st_size for f in files) < 4_000_000
    assert {r.starts for r in rows.filter("read_ord % 24 = 0").select("starts").collect()} == {",".join(["0"] * 500)}


def test_annotated_splits_crowds_and_keeps_reads_without_a_number(spark, monkeypatch):
    trx, reads = _alike(spark, 40)
    reads = reads.union(spark.createDataFrame([(None, "a", "+", [(110, 28)], 28, 1), (None, None, None, None, None, None)], reads.schema))
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(map(tuple, reports.annotated(reads, trx, "any").collect()), key=key)
    assert len(want) == 46 and [r for r in want if r[0] is None] == [(None, None, None, None)] * 2
    whole = reports._dealt_places(reads.filter("size(blocks) = 1 AND read_ord IS NOT NULL"), asites.exons_in_bins(trx.selectExpr("*", "array(trx_id) as ids", "3L as chars"), "any"))
    monkeypatch.setattr(reports, "CROWD", 2)
    monkeypatch.setattr(reports, "TEXT", 100)
    split = reports._dealt_places(reads.filter("size(blocks) = 1 AND read_ord IS NOT NULL"), asites.exons_in_bins(trx.selectExpr("*", "array(trx_id) as ids", "3L as chars"), "any"))
    ords = lambda p: sorted(o for r in p.select("ords").collect() for o in r.ords)
    assert ords(split[0]) == ords(whole[0]) == list(range(40)) and split[0].count() > whole[0].count() and split[1] > whole[1]
    assert sorted(map(tuple, reports.annotated(reads, trx, "any").collect()), key=key) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_norm_is_worked_out_once_for_an_array(spark):
    rows = spark.createDataFrame([([3.0, 0.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    scaled = rows.select(l2_normalized(F.col("v")).alias("u"))
    assert [r.u for r in scaled.collect()] == [[0.6, 0.0, 0.8], [0.0, 0.0], None]
    assert "array_repeat(sqrt(" in _plan(scaled).lower()  # not inside the function of each value


@pytest.mark.parametrize("name", ["start_features", "bool_islands", "peak_overlap", "start_sites_untrained"])
def test_profiles_of_users(spark, tmp_path, name):
    """Profiles are made of the covered bases, without a grid to join; users and events without a number are in them as in SQL."""
    rows = [(k, k % 5 if k % 11 else None) for k in range(3000)] + [(None, 3), (None, 77)] + [(7 * k, 6) for k in range(20, 26)] * 9
    spark.createDataFrame(rows, "event_id bigint, user_id bigint").withColumn("event_type", F.lit("view")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])
    assert "Join" not in _plan(table_queries._profiles(spark, str(tmp_path)))


def test_features_are_worked_out_once(spark):
    rows = spark.createDataFrame([(k, [k % 7] * 67, 20 + k) for k in range(9)], "trx bigint, ltm array<bigint>, at int")
    known = starts.start_features(rows, F.col("at"), ["ltm"], 50).filter("features IS NOT NULL").select("trx", "features", F.xxhash64("features"))
    assert _plan(known).lower().count("zip_with(") == 1
    assert [r.trx for r in known.collect()] == [2, 3, 4, 5, 6]  # trx 0, 1, 7 and 8 have few counts, or offsets off the profile


@pytest.mark.parametrize("groups", [starts.GROUPS, ((0,), (2, 5), (3,)), ((-9, 4), (-3, -2)), ((-4, -1),)])
def test_scores_of_whole_profiles(spark, groups):
    """The same as position by position: short, empty and missing profiles, samples of unequal length, counts that are missing, parts that end within a profile."""
    draw = random.Random(5)
    count = lambda n: [draw.choice([0, 0, 1, 5, 40]) for _ in range(n)]
    rows = [(k, count(n), count(n)) for k, n in enumerate([0, 1, 40, 47, 48, 49, 50, 90, 200, 300])]
    rows += [(20, count(90), count(60)), (21, count(60), count(90)), (22, None, count(90)), (23, count(90), None), (24, [0] * 90, [0] * 90), (None, count(90), count(90))]
    rows += [(25, count(50) + [None] + count(60), count(111)), (26, count(90), []), (27, [], count(90)), (28, None, None)]
    profiles = spark.createDataFrame(rows, "trx bigint, ltm array<bigint>, chx array<bigint>").coalesce(1)
    vectors = np.random.default_rng(1).random((30, 2 * len(groups)))
    for model in (svm.Model(vectors / np.linalg.norm(vectors, axis=1)[:, None], np.random.default_rng(2).normal(size=30), 0.05, 2.4), svm.Model(vectors[:0], np.zeros(0), -1.0, 2.4)):
        each = starts.start_features(starts.every_position(profiles, F.size("ltm")), F.col("at"), ["ltm", "chx"], 10, groups)
        want = {(r.trx, r.at): (r.score, r.called) for r in starts.call_starts(model, each).filter("ltm IS NOT NULL").collect()}
        for least, part in ((10, 4096), (10, 7)):
            found = {(r.trx, r.at): (r.score, r.called) for r in starts.called_positions(model, profiles, ["ltm", "chx"], least, groups, part).collect()}
            assert found.keys() == want.keys()
            for k, (score, called) in want.items():
                assert found[k][1] == called and found[k][0] == (None if score is None else pytest.approx(score, abs=1e-9)), k
        assert any(s is not None for s, _ in want.values()) and any(s is None for s, _ in want.values())


def test_scores_are_of_any_size(spark):
    """Against the kernel as it is written, with vectors that are no unit vectors, in parts of one row and of all rows."""
    draw = np.random.default_rng(3)
    for n, many in ((1, 1), (5, 70_000), (700, 12), (0, 3)):
        model = svm.Model(draw.normal(size=(many, 4)), draw.normal(size=many), -0.5, 0.7)
        x = draw.normal(size=(n, 4))
        assert np.allclose(model.scores(x), svm.kernel(x, model.vectors, 0.7) @ model.weights - 0.5, atol=1e-9)


def test_start_sites_meet_where_they_are_called(spark, tmp_path):
    """No position is made that no predictor calls, and peaks are those of all positions; users and events without a number are in the table."""
    draw = random.Random(8)
    rows = [(7 * (90 * draw.randrange(50) + draw.choice([19, 20, 21, 22, 23, 50, 58, 59, 60, 61, *range(90)])) + draw.randrange(7), draw.randrange(60)) for _ in range(9000)]
    rows += [(k, None) for k in range(500)] + [(None, 3), (None, 77)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = table_queries.start_sites(spark, str(tmp_path))
    every, _ = table_queries._caller(spark, str(tmp_path))
    a = every.select("trx", F.col("at").cast("bigint").alias("nt"), "called")
    b = starts.enrichment(table_queries._arrays(spark, str(tmp_path))).select("trx", F.col("st").alias("nt"), F.col("is_start").alias("called"))
    track = starts.predicted(table_queries._profiles(spark, str(tmp_path)).select("trx", "nt"), a, b)
    want = windows.peak_hulls(track, ["trx"]).withColumn("kind", windows.peak_type())
    assert found.columns == want.columns and Counter(found.collect()) == Counter(want.collect())
    assert {r.kind for r in found.collect()} >= {"B", "H", "L"}
    assert "Join" not in _plan(found)
