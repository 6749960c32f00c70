"""Transcripts and reads that are alike meet once; results are those of each."""

from pyspark.sql import functions as F

from translatome.functions import sequences
from translatome.operators import asites, framing, intervals, lengths, reports

TRX = "trx_id bigint, gene_id bigint, ref string, strand string, blocks array<struct<start:bigint,len:bigint>>, cds_start bigint, cds_len bigint"
READS = "read_ord bigint, ref string, strand string, blocks array<struct<start:bigint,len:bigint>>, len bigint, nh bigint"


def _alike(spark, copies):
    trx = [(k, k, "a", "+-"[k % 2], [(100, 300), (450, 200)], 30, 90) for k in range(copies)]
    reads = [(k, "a", "+-"[k % 2], [(110 + k % 4 * 60, 28 + k % 3)], 28 + k % 3, 1 + k % 2) for k in range(copies)] + [
        (copies + k, "a", "+", [(380, 20), (450, 8)], 28, 1) for k in range(4)
    ]
    return spark.createDataFrame(trx, TRX), spark.createDataFrame(reads, READS)


def test_each_of_alike_transcripts_has_the_rows(spark):
    trx, reads = _alike(spark, 40)
    sites = spark.createDataFrame([(28, 14), (29, 14), (30, 35)], "read_len bigint, delta bigint")  # 35: off its own read
    for keep in (False, True):
        report = lambda t: asites.profile(reads, t, sites, by_length=keep)  # noqa: E731, B023
        plain = asites.placed(reads.join(sites, F.col("len") == F.col("read_len")), trx).withColumn("nt", F.col("lo") + F.col("delta")).filter("nt >= 0 AND nt < trx_len")
        want = plain.groupBy("trx_id", "nt", *(["len"] if keep else [])).agg(F.count(F.lit(1)).alias("n"))
        for found in (report(trx), asites.by_shape(trx, report)):
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_report_gets_one_of_alike_transcripts(spark):
    trx, _ = _alike(spark, 40)
    seen = []
    found = asites.by_shape(trx, lambda t: (seen.append(t.count()), t.select("trx_id", "strand"))[1])
    assert seen == [2] and sorted(map(tuple, found.collect())) == [(k, "+-"[k % 2]) for k in range(40)]
    twice = trx.union(trx.filter("trx_id = 3").withColumn("ref", F.lit("b")))  # one name for two places: nothing is put together
    asites.by_shape(twice, lambda t: (seen.append(t.count()), t.select("trx_id"))[1])
    assert seen == [2, 41]


def test_pair_counts(spark):
    trx, reads = _alike(spark, 40)
    for margin in (0, 100):
        want = asites.placed(reads, trx, margin).groupBy("len").agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, asites.pair_counts(reads, trx, ("len",), margin).collect())) == sorted(map(tuple, want.collect()))
    weighted = lengths.histogram(asites.pair_counts(reads, trx, ("len",), 0), weight="n")
    assert sorted(map(tuple, weighted.collect())) == sorted(map(tuple, lengths.histogram(asites.placed(reads, trx, 0)).collect()))


def test_annotated_meets_once(spark):
    trx, reads = _alike(spark, 40)
    rows = {r.read_ord: r for r in reports.annotated(reads, trx, "any").collect()}
    assert len(rows) == 44 and rows[0].names == ",".join(map(str, range(40))) and rows[0].strands == ",".join("+-" * 20)
    assert rows[40].starts == ",".join(["280", "192"] * 20)


def test_equal_spans_meet_once(spark):
    left = spark.createDataFrame([(k, "a", 10, 20) for k in range(5)] + [(9, "a", 90, 95)], "id int, ref string, s int, e int")
    right = spark.createDataFrame([(k, "a", 15, 30) for k in (7, 4, 6)], "other int, ref string, os int, oe int")
    assert [r.id for r in intervals.without_overlap(left, right, ["ref"], ("s", "e"), ("os", "oe")).collect()] == [9]
    found = intervals.first_offenders(left, right, ["ref"], ("s", "e"), ("os", "oe"), ["other", "os"])
    assert sorted((r.id, r.offender.other) for r in found.collect()) == [(k, 4) for k in range(5)]
    # never broadcast: files tell too little of what is dealt to bins
    plan = intervals.overlap_join(left, right.withColumnRenamed("ref", "ref"), ["ref"], ("s", "e"), ("os", "oe"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_framing_meets_once(spark, monkeypatch):
    """Genes that are alike are looked at once; a gene of which a read meets noncoding transcripts only makes it NoncodingOverlap."""
    block = lambda a, n: [(a, n)]
    trx = [(k, k, "a", "+", block(1000, 300), 30, 90) for k in range(5)]  # five coding genes at one place
    trx += [(10, 10, "a", "+", block(3000, 300), 30, 90), (11, 10, "a", "+", block(3000, 600), None, None), (12, 12, "a", "+", block(3200, 600), 30, 90)]
    trx += [(20, None, "a", "+", block(5000, 300), 30, 90), (21, 21, "a", "+", block(7000, 300), None, None), (22, 22, "a", "+", block(9000, 300), 30, 90)]
    at = [1100, 3050, 3250, 3400, 5100, 7100, 9080, 20]
    reads = [(i * 3 + k, "a", "+", block(p, 28), 28, 1) for i, p in enumerate(at) for k in range(3)]
    seen, real = [], framing.overlapping
    monkeypatch.setattr(framing, "overlapping", lambda r, t: (seen.append((r.count(), t.count())), real(r, t))[1])
    rows = framing.classified(spark.createDataFrame(reads, READS), spark.createDataFrame(trx, TRX)).collect()
    want = ["MultiCoding", "Good", "MultiCoding", "NoncodingOverlap", "Good", "NoncodingOnly", "Good", "NoGene"]
    assert {r.read_ord: r.status for r in rows} == {i * 3 + k: s for i, s in enumerate(want) for k in range(3)}
    assert seen == [(8, 7)]
    assert {r.gene_id for r in rows if r.read_ord // 3 == 6} == {22} and {r.vs_start for r in rows if r.read_ord // 3 == 6} == {50}


def test_first_stop_is_found_in_a_long_sequence(spark):
    seqs = [("TA" * 60_000 + "TAA", 40_000), ("TA" * 60_000, None), ("ACG" * 50_000 + "tga" + "TAA", 50_000), ("", None), ("TA", None), ("ATAATAG", None), ("CTAATGA", None), ("TAG", 0), ("AC\nTAA", 1)]
    df = spark.createDataFrame(seqs, "seq string, want bigint").select("want", sequences.first_stop_codon(F.col("seq")).alias("found"))
    assert [(r.want, r.found) for r in df.collect() if r.want != r.found] == []
