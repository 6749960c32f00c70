"""Expressions against hand-computed values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from translatome.functions import coords, sequences, statistics
from translatome.operators import asites, barcodes, duplicates, intervals, lengths, reports, starts, svm, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_codon_and_frame(spark):
    rows = spark.createDataFrame([(-2,), (-1,), (0,), (1,), (2,)], "x bigint").select(coords.codon_of(F.col("x")), coords.frame_of(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(-1, 1), (0, -1), (0, 0), (0, 1), (1, -1)]


def test_codon_length(spark):
    assert [one(spark, coords.codon_length(F.lit(n))) for n in (100, 101)] == [33, 34]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-10_000, 10_000), min_size=1, max_size=50))
def test_codon_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert df.filter(coords.codon_of(F.col("x")) * 3 + coords.frame_of(F.col("x")) != F.col("x")).count() == 0


def blocks(*pairs):
    return F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(n).cast("bigint").alias("len")) for a, n in pairs])


def three():
    return blocks((0, 10), (20, 10), (50, 5))


def test_introns(spark):
    assert [tuple(r) for r in one(spark, coords.introns(three()))] == [(10, 10), (30, 20)]
    assert one(spark, coords.introns(blocks((0, 10)))) == []


@pytest.mark.parametrize(
    ("inner", "fits"),
    [([(2, 5)], True), ([(2, 8), (20, 3)], True), ([(2, 7), (20, 3)], False), ([(2, 8), (21, 3)], False), ([(8, 5)], False), ([(5, 5), (20, 10), (50, 2)], True), ([(12, 3)], False)],
)
def test_compatible(spark, inner, fits):
    assert one(spark, coords.compatible(blocks(*inner), three())) is fits


def test_positions(spark):
    for strand in "+-":
        at = [one(spark, coords.genome_position(F.lit(i), three(), F.lit(strand))) for i in range(25)]
        bases = [*range(10), *range(20, 30), *range(50, 55)]
        assert at == (bases if strand == "+" else bases[::-1])
    assert one(spark, coords.genome_position(F.lit(25), three(), F.lit("+"))) is None
    cut = one(spark, coords.sub_blocks(three(), F.lit("-"), F.lit(3), F.lit(14)))
    assert [tuple(b) for b in cut] == [(8, 2), (20, 10), (50, 2)]


def test_sequences(spark):
    assert one(spark, sequences.translated(F.lit("ATGAAATAG"))) == "MK*"
    assert one(spark, sequences.translated(F.lit("ATGNNN"))) == "MX"
    assert one(spark, sequences.translated(F.lit("ATGA"))) == "MX"
    assert one(spark, sequences.first_stop_codon(F.lit("ATGAAATAG"))) == 2
    assert one(spark, sequences.first_stop_codon(F.lit("ATGAAA"))) is None
    assert one(spark, sequences.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, sequences.base5(F.lit("ACGTN"))) == 194
    assert one(spark, sequences.from_base5(F.lit(194), F.lit(5))) == "ACGTN"
    assert one(spark, sequences.neighbours(F.lit("AC"))) == ["CC", "GC", "TC", "NC", "AA", "AG", "AT", "AN"]
    with pytest.raises(Exception, match="not a base"):
        one(spark, sequences.base5(F.lit("AX")))
    with pytest.raises(Exception, match="out of range"):
        one(spark, sequences.from_base5(F.lit(5), F.lit(1)))


@settings(max_examples=10, deadline=None)
@given(st.text("ACGTN", min_size=1, max_size=12))
def test_base5_round_trip(spark, seq):
    assert one(spark, sequences.from_base5(sequences.base5(F.lit(seq)), F.lit(len(seq)))) == seq


def test_quantile(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 5)], "k string, v double")
    row = statistics.quantiles_type8(df, ["k"], "v", {"a": 0.5, "b": 0.75, "c": 0.25}).collect()[0]
    assert row.a == 3 and row.b == pytest.approx(13 / 3) and row.b - row.c == pytest.approx(8 / 3)


def test_entropy_and_norm(spark):
    assert one(spark, statistics.entropy_bits([F.lit(1), F.lit(1), F.lit(0)])) == pytest.approx(1.0)
    assert one(spark, statistics.l2_normalized(F.array(F.lit(3), F.lit(4)))) == pytest.approx([0.6, 0.8])
    assert one(spark, statistics.l2_normalized(F.array(F.lit(0), F.lit(0)))) == [0.0, 0.0]


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, 4.0])
def test_normal_tail(spark, z):
    assert one(spark, statistics.normal_tail(F.lit(z))) == pytest.approx(math.erfc(z / 2**0.5) / 2, abs=1e-7)


def test_overlap_join_is_nested_loop(spark):
    draw = random.Random(4)
    a = [(i, draw.choice("xy"), s := draw.randint(-500, 500), s + draw.randint(1, 300)) for i in range(80)]
    b = [(i, draw.choice("xy"), s := draw.randint(-500, 500), s + draw.randint(1, 300)) for i in range(80)]
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    left, right = spark.createDataFrame(a, "i int, k string, s bigint, e bigint"), spark.createDataFrame(b, "j int, k string, t bigint, f bigint")
    for size in (7, 100, 10_000):
        assert sorted(tuple(r) for r in intervals.overlap_join(left, right, ["k"], ("s", "e"), ("t", "f"), size).select("i", "j").collect()) == want
    clear = {p[0] for p in a} - {i for i, _ in want}
    assert {r.i for r in intervals.without_overlap(left, right, ["k"], ("s", "e"), ("t", "f")).collect()} == clear


def test_tags(spark):
    assert [one(spark, duplicates.umi_tag(F.lit(n))) for n in ("r1#ACG", "r1", "#ACG")] == ["#ACG", "", ""]
    rows = [(i, 1, 5, "+", t) for i, t in enumerate(("#A", "#A", "#B", "#A"))]
    df = spark.createDataFrame(rows, "read_ord bigint, ref bigint, pos bigint, strand string, tag string")
    together = duplicates.totals(duplicates.site_counts(duplicates.tag_groups(df))).collect()[0]
    apart = duplicates.totals(duplicates.site_counts(duplicates.tag_groups(df, consecutive=True))).collect()[0]
    assert (together.n_reads, together.n_dups) == (4, 2) and (apart.n_reads, apart.n_dups) == (4, 1)
    plain = df.withColumn("tag", F.lit(None).cast("string"))
    assert duplicates.totals(duplicates.site_counts(duplicates.tag_groups(plain))).collect()[0].n_dups == 0


def test_islands_and_distances(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "k int, nt bigint")
    assert sorted(tuple(r)[1:] for r in windows.islands(df, ["k"]).collect()) == [(1, 2), (4, 4)]
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "k int, bin bigint, n bigint")
    b = spark.createDataFrame([(0, 1), (1, 3)], "bin bigint, n bigint")
    row = lengths.distances(a, b, ["k"]).collect()[0]
    assert row.l1 == pytest.approx(0.25) and row.l2 == pytest.approx(0.353553, abs=1e-6)


def test_greedy_peaks(spark):
    draw = random.Random(2)
    cover = [(r, p, draw.randint(0, 60)) for r in range(3) for p in range(400)]
    got = sorted(tuple(x) for x in windows.greedy_peaks(spark.createDataFrame(cover, "ref bigint, pos bigint, cover bigint"), 20.0).collect())
    want = []
    for r in range(3):
        depth = [c for q, _, c in cover if q == r]
        while max(depth) > 20:
            i = depth.index(max(depth))
            want.append((r, i, depth[i]))
            depth[max(0, i - 25) : i + 26] = [0] * len(depth[max(0, i - 25) : i + 26])
    assert got == sorted(want)


@pytest.mark.parametrize("size", [1, 2, 5, 1 << 16])
def test_runs_across_stretches(spark, size):
    """Islands and hulls position by position, over groups (one of them null) whose runs cross several stretches."""
    import random

    draw = random.Random(size)
    rows = [(k, at, draw.random() < 0.5, draw.random() < 0.7) for k in (1, 2, None) for at in range(-7, 60) if draw.random() < 0.9]
    rows += [(3, at, True, None) for at in range(40)] + [(4, None, True, True)]
    df = spark.createDataFrame(rows, "k int, nt bigint, a boolean, b boolean")
    want = []
    for k in {r[0] for r in rows}:
        run = []
        for at, a, b in [*sorted(r[1:] for r in rows if r[0] == k and r[1] is not None and (r[2] or r[3])), (10**6, False, False)]:
            if run and at != run[-1][0] + 1:
                hulls = [[p for p, x, y in run if ok(x, y)] for ok in (lambda x, y: x, lambda x, y: y, lambda x, y: x and y)]
                want.append((k, run[0][0], run[-1][0], *(v for h in hulls for v in ((min(h), max(h)) if h else (None, None)))))
                run = []
            run.append((at, a, b))
    got = windows.peak_hulls(df, ["k"], size=size)
    assert got.columns == ["k", "first", "last", "a_first", "a_last", "b_first", "b_last", "both_first", "both_last"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plain = windows.islands(df.filter("a or b").union(df.filter("a or b")), ["k"], size=size).collect()
    assert sorted(map(tuple, plain), key=str) == sorted((w[:3] for w in want), key=str)


def test_long_sample_sheets_are_not_broadcast(spark, monkeypatch):
    fastq = spark.createDataFrame([("r1", "ACGTTTTA", "12345678"), ("r2", "AC", "12")], "name string, seq string, qual string")
    samples = spark.createDataFrame([("x", "CGA"), ("y", "TTT")], "name string, idx string")
    found = []
    for few in (2, 1):
        monkeypatch.setattr(barcodes, "FEW", few)
        df = barcodes.demultiplexed(fastq, samples, "NII", "I")
        assert ("rightHint=(strategy=broadcast)" in df._jdf.queryExecution().optimizedPlan().toString()) == (few == 2)
        found.append(sorted((r.name, r.fate, r.mismatches) for r in df.collect()))
    assert found[0] == found[1] == [("r1", "x", 0), ("r2", "TooShort", None)]


def test_barcodes(spark):
    assert [barcodes.generated(spark, n).count() for n in (1, 2, 3, 4)] == [4, 12, 24, 48]
    picked = barcodes.selected(barcodes.generated(spark, 4), spark.createDataFrame([("x", "ACGT")], "name string, seq string"), 3).orderBy("ord").collect()
    seqs = [r.seq for r in picked]
    assert seqs[0] == "ACGT" and picked[0].extant
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert all(far(a, b) >= 3 for i, a in enumerate(seqs) for b in seqs[:i])
    every = [r.seq for r in barcodes.generated(spark, 4).collect()]
    assert all(any(far(a, b) < 3 for b in seqs) for a in every)
    row = one(spark, barcodes.split_linker(F.lit("ACGTTTTA"), F.lit("12345678"), "NNI", "I"))
    assert tuple(row) == (False, "AC", "GA", "TTTT", "4567")
    assert one(spark, barcodes.split_linker(F.lit("ACG"), F.lit("123"), "NNI", "I")).short
    with pytest.raises(ValueError, match="linker"):
        barcodes.parse_layout("NX")
    clash = spark.createDataFrame([("a", "AAA"), ("b", "AAC")], "name string, idx string")
    with pytest.raises(Exception, match="clash"):
        barcodes.sample_lookup(clash).collect()


def test_nearest_barcode_as_all_pairs(spark):
    import random

    draw = random.Random(3)
    lists = [
        [(i, "".join(draw.choice("ACGT") for _ in range(6))) for i in range(60)] + [(100, None), (101, "acgtac"), (102, "ACGTAC"), (103, "ACGTAC")],
        [(1, "AAAA"), (2, "CCCC"), (3, "GGGG")],  # no letter in common
        [(1, "AAAACC"), (2, "AAAT"), (3, "CAATGGG"), (4, "GGG")],  # of different lengths
        [(1, "A")],
        [],
    ]
    for rows in lists:
        want = {}
        known = [(n, s.upper()) for n, s in rows if s is not None]
        for n, s in known:
            others = [(sum(x != y for x, y in zip(s, t, strict=False)), m) for m, t in known if m != n]
            if others:
                want[n] = min(others)
        got = {r.name: (r.distance, r.nearest) for r in barcodes.nearest(spark.createDataFrame(rows, "name bigint, seq string")).collect()}
        assert got == want


def test_nearest_by_place(spark):
    rows = [("z", "ACGT", 0), ("y", "ACGA", 1), ("a", "ACGC", 2), ("q", "TTTT", 3), ("p", "TTTT", 4), ("b", "TTTT", 5)]
    got = {r.name: (r.nearest, r.distance) for r in barcodes.nearest(spark.createDataFrame(rows, "name string, seq string, place int"), "place").collect()}
    assert got == {"z": ("y", 1), "y": ("z", 1), "a": ("z", 1), "q": ("p", 0), "p": ("q", 0), "b": ("q", 0)}


def test_gate_of_ribosomal_reads(spark):
    rows = [(1, 5, 30, "+"), (1, 5, 30, "-"), (1, None, 30, "+"), (1, 5, None, "+"), (1, 5, 30, None), (None, 1, 9, "+")]
    df = spark.createDataFrame(rows, "ref int, pos int, len int, strand string")
    assert {r.ref: tuple(r)[1:] for r in reports.gate_counts(df).collect()} == {1: (5, 1, 4), None: (1, 1, 0)}
    assert sorted(map(tuple, reports.forward_counts(df).collect()), key=str) == [(1, 5, 30, 1), (None, 1, 9, 1)]


def test_samples_side_by_side(spark):
    """Two samples with A-sites of their own, as dense arrays that features are made of."""
    block = [(100, 90)]
    trx = spark.createDataFrame([(1, 1, "c", "+", block, 30, 30), (2, 2, "d", "+", [(0, 5)], None, None)], "trx_id int, gene_id int, ref string, strand string, blocks array<struct<start:bigint,len:bigint>>, cds_start bigint, cds_len bigint")
    rows = [("c", 110, 28, "+", [(110, 28)], "x")] * 3 + [("c", 110, 28, "+", [(110, 28)], "y"), ("c", 110, 28, "+", [(110, 28)], "other"), ("c", 110, 29, "+", [(110, 29)], "y")]
    reads = spark.createDataFrame(rows, "ref string, pos bigint, len bigint, strand string, blocks array<struct<start:bigint,len:bigint>>, sample string")
    sites = spark.createDataFrame([("x", 28, 15), ("y", 28, 12), ("other", 28, 1)], "sample string, read_len bigint, delta bigint")
    p = asites.sample_profiles(reads, trx, sites, ["y", "x"])
    assert sorted(map(tuple, p.collect())) == [(1, 22, [1, 0], 1), (1, 25, [0, 3], 3)]
    v = {r.trx_id: r for r in asites.sample_vectors(p, trx, ["y", "x"]).collect()}
    assert v[1].x == [3 if i == 25 else 0 for i in range(90)] and v[1].y == [int(i == 22) for i in range(90)] and v[2].x == [0] * 5
    f = starts.start_features(asites.sample_vectors(p, trx, ["y", "x"]).filter("trx_id = 1"), F.lit(24), ["x", "y"], 1).first().features
    assert f == pytest.approx([0, 3 / 10**0.5] + [0] * 6 + [1 / 10**0.5] + [0] * 7)


def test_enrichment(spark):
    ltm, chx = [0] * 20, [0] * 20
    ltm[7], ltm[15], chx[8], chx[18] = 10, 90, 2, 48
    df = spark.createDataFrame([(1, ltm, chx)], "trx bigint, ltm array<bigint>, chx array<bigint>")
    row = starts.enrichment(df).filter("st = 3").collect()[0]
    assert (row.ltm_sum, row.expected, row.is_start) == (10, 0.0, True)
    row = starts.enrichment(df).filter("st = 5").collect()[0]
    assert (row.ltm_sum, row.expected, row.is_start) == (10, 4.0, True)


def test_spans_of_all_sizes(spark):
    """Pairs across levels, each once; few rows for each span, however long it is."""
    draw = random.Random(8)
    spans = lambda n: [(i, draw.choice("xy"), a, a + draw.choice([0, 1, 30, 5000, 70_000, 2_000_000, 300_000_000])) for i in range(n) for a in [draw.randrange(3_000_000)]]
    rows, others = spans(60), spans(50) + [(99, None, 0, 10), (98, "x", None, 5)]
    left, right = spark.createDataFrame(rows, "i int, k string, s bigint, e bigint"), spark.createDataFrame(others, "j int, k string, t bigint, f bigint")
    want = sorted((i, j) for i, k, s, e in rows for j, m, t, f in others if k == m and t is not None and s < f and t < e)
    for long_left in (False, True):
        got = intervals.overlap_join(left, right.filter("j < 20 or j > 90 or f - t < 100") if not long_left else right, ["k"], ("s", "e"), ("t", "f"), 100, long_left=long_left)
        few = {j for j, _, t, f in others if j < 20 or j > 90 or f - t < 100}
        assert sorted((r.i, r.j) for r in got.collect()) == [p for p in want if long_left or p[1] in few]
    dealt = intervals._dealt(right.filter("t IS NOT NULL"), "t", "f", 1000, [0, 1, 2, 3], "b").groupBy("j").count()
    assert max(r["count"] for r in dealt.collect()) <= (intervals.STEP + 1) * 2
    clear = {i for i, *_ in rows} - {i for i, _ in want}
    assert {r.i for r in intervals.without_overlap(left, right, ["k"], ("s", "e"), ("t", "f")).collect()} == clear
    first = intervals.first_offenders(left, right, ["k"], ("s", "e"), ("t", "f"), ["t", "j"]).collect()
    start = {j: t for j, _, t, _ in others}
    assert {r.i: r.offender.j for r in first} == {i: min((start[j], j) for k, j in want if k == i)[1] for i in {i for i, _ in want}}


def test_start_caller_finds_planted_starts(spark):
    draw = random.Random(1)
    rows = []
    for i in range(60):
        a = [draw.randint(0, 3) for _ in range(240)]
        a[40], a[41], a[42] = 60 + draw.randint(0, 20), 40, 20
        rows.append((i, a, 40))
    items = spark.createDataFrame(rows, "trx bigint, ltm array<bigint>, cds_start int")
    examples = starts.start_features(starts.training_positions(items), F.col("at"), ["ltm"], 5)
    called = starts.call_starts(svm.train(examples), examples)
    hit = called.filter("label = 1 and called").count()
    false = called.filter("label = 0 and called").count()
    assert hit >= 55 and false <= 5


def test_groups_of_codons():
    """Eight groups, from the base before codon -2 to the one behind codon 13, without a gap."""
    assert starts.GROUPS[0] == (-7, -6, -5, -4, -3, -2) and starts.GROUPS[1] == (-1, 0, 1) and starts.GROUPS[7] == (32, 33, 34, 35, 36, 37, 38, 39, 40)
    assert [o for g in starts.GROUPS for o in g] == list(range(-7, 41))


def plain_dual(k, y, bounds):
    """The dual by projected gradients with a penalty-free projection on the plane, for comparison: slow and simple."""
    a = np.zeros(len(y))
    step = 1 / np.linalg.eigvalsh(k).max()
    for _ in range(20_000):
        want = a + step * (1 - y * (k @ (a * y)))
        low, high = -1e3, 1e3
        for _ in range(60):  # the shift that makes the multipliers of both classes equal
            shift = (low + high) / 2
            total = (y * np.clip(want - shift * y, 0, bounds)).sum()
            low, high = (shift, high) if total > 0 else (low, shift)
        a = np.clip(want - shift * y, 0, bounds)
    free = (a > 1e-6) & (a < bounds - 1e-6)
    margin = y - k @ (a * y)
    return a, margin[free].mean() if free.any() else margin.mean()


def blobs(n, seed, wrong=0):
    draw = np.random.default_rng(seed)
    y = np.where(np.arange(n) % 3 == 0, 1.0, -1.0)
    x = draw.normal(0, 0.45, (n, 3)) + (y > 0)[:, None] * 0.9
    flipped = draw.choice(n, wrong, replace=False)
    y[flipped] *= -1
    return x, y, flipped


def test_kernel_dual():
    x, y, _ = blobs(90, 1)
    k, bounds = svm.kernel(x, x, 2.4), np.where(y > 0, 8.0, 2.0)
    a, bias = svm.solved(k, y, bounds, 1e-6)
    theirs, shift = plain_dual(k, y, bounds)
    assert abs((a * y).sum()) < 1e-6 and (a >= 0).all() and (a <= bounds).all()
    value = lambda a: a.sum() - (a * y) @ k @ (a * y) / 2
    assert value(a) >= value(theirs) - 1e-3
    mine, other = k @ (a * y) + bias, k @ (theirs * y) + shift
    assert ((mine > 0) == (other > 0)).mean() >= 0.99 and np.abs(mine - other).max() < 0.05


def test_removal_of_mislabelled_examples(spark):
    x, y, flipped = blobs(240, 2, 12)
    kept, removed = svm.fitted(x, y, 2.4, 2.0, 4.0, True)
    whole, none = svm.fitted(x, y, 2.4, 2.0, 4.0, False)
    assert not none.any() and removed[flipped].mean() > 0.8
    test, truth, _ = blobs(600, 3)
    right = lambda m: ((m.scores(test) > 0) == (truth > 0)).mean()
    assert np.abs(kept.scores(test) - whole.scores(test)).max() > 0.1 and right(kept) > 0.9
    again, bounds = svm.kernel(x[~removed], x[~removed], 2.4), np.where(y[~removed] > 0, 8.0, 2.0)
    assert (svm.solved(again, y[~removed], bounds)[0] < bounds).all()  # what is left has no example at its bound
    rows = spark.createDataFrame([(v.tolist(), float(l)) for v, l in zip(x, y, strict=True)] + [(None, 1.0)], "features array<double>, label double")
    model = svm.train(rows.repartition(3))
    assert ((model.scores(test) > 0) == (kept.scores(test) > 0)).mean() >= 0.99
    got = svm.scored(model, rows).collect()
    assert all((r.score is None) == (r.features is None) for r in got)
    assert [r.score for r in got if r.features] == pytest.approx(model.scores(np.array([r.features for r in got if r.features])).tolist())


def test_one_class_only(spark):
    rows = spark.createDataFrame([([0.5, 0.5], 0.0), ([1.0, 0.0], 0.0)], "features array<double>, label double")
    assert [r.score for r in svm.scored(svm.train(rows), rows).collect()] == [-1.0, -1.0]


def test_caller_kept_and_scored_everywhere(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, [60 if j == 40 else draw.randint(0, 3) for j in range(90)], 40) for i in range(30)]
    items = spark.createDataFrame(rows, "trx bigint, ltm array<bigint>, cds_start int")
    examples = starts.start_features(starts.training_positions(items), F.col("at"), ["ltm"], 5)
    model = svm.train(examples)
    starts.write_caller(model, ["ltm"], 5, str(tmp_path / "m"))
    again, config = starts.read_caller(spark, str(tmp_path / "m"))
    assert config == {"samples": ["ltm"], "least_total": 5, "groups": [list(g) for g in starts.GROUPS]}
    every = starts.start_features(starts.every_position(items, F.size("ltm")), F.col("at"), ["ltm"], 5)
    mine = starts.call_starts(again, every).select("trx", "at", "score", "called").collect()
    assert sorted((r.trx, r.at) for r in mine) == [(i, at) for i in range(30) for at in range(91)]
    assert all((r.score is None) == (r.at < 7 or r.at > 49) for r in mine if r.at < 7 or r.at > 49 or r.at == 40)
    theirs = {(r.trx, r.at): r.score for r in starts.call_starts(model, every).collect()}
    assert all(theirs[r.trx, r.at] == r.score for r in mine)
    bucketed = starts.score_buckets(starts.call_starts(again, examples))
    starts.write_scores(bucketed, str(tmp_path / "s"))
    key = lambda r: (r.bucket, r.score is None, r.score or 0)
    assert sorted(starts.read_scores(spark, str(tmp_path / "s")).collect(), key=key) == sorted(bucketed.select("bucket", "score").collect(), key=key)
    want = {(True, True): "tp", (False, True): "fp", (True, False): "fn", (False, False): "tn"}
    assert all(want[r.label > 0, r.called] == r.bucket for r in bucketed.collect())


def test_missing_predictors(spark):
    positions = spark.createDataFrame([(1, i) for i in range(4)], "trx bigint, nt bigint")
    a = spark.createDataFrame([(1, 0, True), (1, 1, False)], "trx bigint, nt bigint, called boolean")
    rows = lambda *p: [tuple(r)[1:] for r in starts.predicted(positions, *p).orderBy("nt").collect()]
    assert rows(a, None) == [(0, True, None), (1, False, None), (2, False, None), (3, False, None)]
    assert rows(None, a) == [(0, None, True), (1, None, False), (2, None, False), (3, None, False)]
    assert rows(None, None) == [(i, None, None) for i in range(4)]


def test_bedpe(spark):
    row = lambda **k: {n: F.lit(v) for n, v in k.items()}
    good = dict(ref1="c", left1=10, right1=20, strand1="+", ref2="c", left2=50, right2=60, strand2="-")
    fate = lambda **k: one(spark, starts.bedpe_fate(row(**(good | k))))
    assert fate() == "good" and fate(right2=1_000_010) == "toolong" and fate(ref2=".") == "onematch" and fate(ref1=".", ref2=".") == "nomatch"
    assert fate(ref2="d") == "diffchr" and fate(strand2="+") == "samestrand" and fate(left2=1, right2=5) == "inverted"
