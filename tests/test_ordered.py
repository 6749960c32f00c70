"""Running values, ranks, medians, coverage and peaks over many blocks, and rank sums, against brute force."""

import itertools
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from translatome.functions import ordered, statistics
from translatome.operators import quantities, windows


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as small as they are dealt."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_running(spark, many_ranges, keys):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1, 2]), v, draw.choice([None, 1, 5])) for v in draw.sample(range(1000), 200)]
    df = ordered.ranged(spark.createDataFrame(rows, "g int, v int, n int"), keys, ["v"])
    got = ordered.running(
        df, keys, ["v"], {"s": ("sum", F.col("n")), "m": ("max", F.col("n"))}, {"t": F.col("n")}, {"next": ("v", False), "last": ("v", True)}
    )
    assert df.select("_block").distinct().count() > 3
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0] if keys else 0, []).append(r)
    want = []
    for own in groups.values():
        for i, r in enumerate(own):
            some = [x[2] for x in own[: i + 1] if x[2] is not None]
            beside = [own[k][1] if 0 <= k < len(own) else None for k in (i + 1, i - 1)]
            want.append((*r, sum(some) if some else None, max(some, default=None), *beside, sum(x[2] or 0 for x in own)))
    assert sorted(map(tuple, got.select("g", "v", "n", "s", "m", "next", "last", "t").collect()), key=str) == sorted(want, key=str)


def test_quantiles_of_one_hot_group(spark, many_ranges):
    draw = random.Random(3)
    rows = [("a", draw.choice([1.5, 2.0, 9.0, draw.random()])) for _ in range(3000)] + [("b", 4.0), (None, 1.0), (None, 3.0), ("c", None)]
    q = statistics.quantiles_type8(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "low": 0.0, "top": 1.0}, "n")
    own = sorted(v for g, v in rows if g == "a")
    got = {r.g: r for r in q.collect()}
    assert set(got) == {"a", "b", None} and got["a"].n == 3000 and got[None].m == 2.0
    assert got["a"].m == pytest.approx(plain.median(own)) and (got["a"].low, got["a"].top) == (own[0], own[-1])


def test_values_at_ranks(spark, many_ranges):
    values = [1.0] * 9000 + [2.0] + [float(k) for k in range(3, 400)] + [500.0] * 5000
    ranked = statistics.mid_ranks(spark.createDataFrame([(v,) for v in values], "value double"), [], "value")
    targets = spark.createDataFrame([(k,) for k in (1, 4096, 4097, 9000, 9001, 9002, 9399, 14_398)], "rank bigint")
    got = {r["rank"]: r.value for r in statistics.values_at_ranks(ranked, targets, "value").collect()}
    assert got == {k: sorted(values)[k - 1] for k in got} and len(got) == 8


@pytest.mark.parametrize("seed", range(3))
def test_subset_medians(spark, many_ranges, seed):
    draw = random.Random(seed)
    data = [(f"k{i}", float(draw.choice([draw.randrange(6), draw.randrange(1000)]))) for i in range(150)] + [("none", None)]
    sets = [(f"s{s}", k) for s in range(12) for k, _ in draw.sample(data, draw.choice([1, 2, 40, 149]))]
    sets += [("all", k) for k, v in data if v is not None] + [("gone", "unknown"), ("s1", "unknown"), sets[0]]
    d, s = spark.createDataFrame(data, "key string, value double"), spark.createDataFrame(sets, "set_name string, key string")
    got = quantities.subset_medians(d, s)
    want = []
    for name in {n for n, _ in sets}:
        keys = {k for n, k in sets if n == name}
        inside, outside = ([v for k, v in data if v is not None and (k in keys) == side] for side in (True, False))
        if inside and outside:
            want.append((name, plain.median(inside), plain.median(outside), plain.median(inside) - plain.median(outside)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def enumerated(values, members):
    """Exact two-tailed probability over all choices of as many members."""
    def u(chosen):
        rest = [values[i] for i in range(len(values)) if i not in chosen]
        return sum((values[i] > r) + 0.5 * (values[i] == r) for i in chosen for r in rest)

    mean = len(members) * (len(values) - len(members)) / 2
    every = [abs(u(set(c)) - mean) for c in itertools.combinations(range(len(values)), len(members))]
    return sum(x >= abs(u(set(members)) - mean) - 1e-9 for x in every) / len(every)


@pytest.mark.parametrize("values", [[3, 1, 4, 15, 9, 2, 6, 5, 35], [1, 1, 2, 2, 2, 3, 9, 9], [7, 7, 7, 7, 7], [1, 2]], ids=str)
def test_exact_significance(spark, values):
    data = spark.createDataFrame([(f"k{i}", float(v)) for i, v in enumerate(values)] + [("none", None)], "key string, value double")
    names = {f"s{n}-{j}": members for n in range(1, len(values)) for j, members in enumerate(itertools.islice(itertools.combinations(range(len(values)), n), 0, None, 7))}
    sets = spark.createDataFrame([(s, f"k{i}") for s, m in names.items() for i in m], "set_name string, key string")
    got = {r.set_name: r.pval for r in quantities.significance(quantities.rank_sums(data, sets), data).collect()}
    assert got == {s: pytest.approx(enumerated(values, m), abs=1e-12) for s, m in names.items()}


def test_distribution_without_ties():
    """The classic counts of U for 3 of 6: 1 1 2 3 3 3 3 2 1 1."""
    ways = quantities.rank_sum_distribution([1] * 6, 3)
    assert [ways[2 * u] for u in range(10)] == [1, 1, 2, 3, 3, 3, 3, 2, 1, 1]
    assert sum(quantities.rank_sum_distribution([1] * 40, 20).values()) == 137846528820


def test_approximation_meets_the_exact_values(spark, monkeypatch):
    """With ties, the corrected variance is what the exact distribution has."""
    draw = random.Random(4)
    values = [float(draw.randrange(5)) for _ in range(40)]
    data = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "key string, value double")
    sets = spark.createDataFrame([(f"s{s}", f"k{i}") for s in range(9) for i in draw.sample(range(40), 18)], "set_name string, key string")
    stats = quantities.rank_sums(data, sets)
    exact = {r.set_name: r.pval for r in quantities.significance(stats, data).collect()}
    monkeypatch.setattr(quantities, "EXACT", 39)
    near = {r.set_name: r.pval for r in quantities.significance(stats, data).collect()}
    assert all(abs(exact[s] - near[s]) < 0.03 for s in exact) and exact != near


def test_coverage_over_blocks(spark, monkeypatch):
    """One hot reference over many blocks, with reads that reach over several of them and blocks without any."""
    monkeypatch.setattr(ordered, "blocked", lambda df, at, size=10: df.withColumn("_block", F.floor(F.col(at) / 10)))
    draw = random.Random(6)
    reads = [(1, draw.randrange(300) if i % 9 else 950, draw.choice([1, 5, 70])) for i in range(150)] + [(2, 5, 3)]
    df = spark.createDataFrame(reads, "ref bigint, pos bigint, len bigint")
    depth = {}
    for ref, pos, n in reads:
        for at in range(pos, pos + n):
            depth[ref, at] = depth.get((ref, at), 0) + 1
    got = {}
    for r in windows.coverage(df).collect():
        got |= {(r.ref, at): r.depth for at in range(r.start, r.end)}
    assert got == depth
    cover = {(r.ref, r.pos): (r.n_start, r.n_end, r.cover) for r in windows.start_end_cover(df, 2000).collect()}
    assert all(c[2] == depth.get(k, 0) for k, c in cover.items())
    assert sum(c[0] for c in cover.values()) == sum(c[1] for c in cover.values()) == len(reads)


@pytest.mark.parametrize("half_width", [0, 3, 25])
def test_greedy_peaks(spark, monkeypatch, half_width):
    monkeypatch.setattr(ordered, "blocked", lambda df, at: df.withColumn("_block", F.floor(F.col(at) / 10)))
    draw = random.Random(half_width)
    rows = [(ref, pos, draw.randrange(9)) for ref in (1, 2) for pos in draw.sample(range(2000), 600)]
    want = []
    for ref in (1, 2):
        taken = []
        for height, pos in sorted((-c, p) for r, p, c in rows if r == ref and c > 2):
            if all(abs(pos - t) > half_width for t in taken):
                taken.append(pos)
                want.append((ref, pos, -height))
    df = spark.createDataFrame(rows, "ref bigint, pos bigint, cover bigint")
    assert sorted(map(tuple, windows.greedy_peaks(df, 2.0, half_width).collect())) == sorted(want)


def test_running_depletion(spark, many_ranges):
    rows = [(r, p, (r * p) % 7) for r in range(4) for p in range(50)]
    got = windows.running_depletion(spark.createDataFrame(rows, "ref bigint, peak bigint, height bigint")).select("ref", "peak", "height", "depleted").collect()
    total, want = 0, []
    for ref, peak, height in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        total += height
        want.append((ref, peak, height, total))
    assert sorted(map(tuple, got)) == sorted(want)
