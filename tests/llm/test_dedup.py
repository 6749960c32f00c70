"""Substring, exact and near deduplication."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from translatome.llm import exact_dedup, near_dedup, substring_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, fixtures.SCHEMA)


def clashing(df):
    for name in ("id", "hash", "row", "digest", "_size", "text_sha256", "component", "s"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("rows", [fixtures.corpus(), fixtures.corpus(60, 8), fixtures.awkward(), []], ids=["corpus", "other", "awkward", "empty"])
def test_substring_like_brute_force(spark, rows):
    got = substring_dedup.repeated_passages_removed(clashing(frame(spark, rows))).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(fixtures.without_repeats(rows), key=str)


def test_substring_ids_that_name_several_texts(spark):
    """Rows without an id, and rows that share one, are documents each."""
    draw = random.Random(9)
    text = lambda n: " ".join(f"q{draw.randrange(10**6)}" for _ in range(n))
    shared, one = text(50), text(60)
    texts = [text(40), text(41), f"{text(5)} {shared} {text(6)}", f"{text(9)} {shared}", one, one, text(20), None]
    rows = [(k, t, "en", "a", 1) for k, t in zip([None, None, 5, 5, 6, 6, 7, 7], texts, strict=True)]
    got = substring_dedup.repeated_passages_removed(frame(spark, rows)).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(fixtures.without_repeats(rows), key=str)
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 0, 50, 50, 60, 60]


def test_substring_text(spark):
    rows = fixtures.corpus(40)
    for r in substring_dedup.repeated_passages_removed(frame(spark, rows), with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_every_remainder_is_a_difference():
    pairs = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert pairs == set(range(substring_dedup.PERIOD))


def test_rolled_is_a_hash_of_the_words():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 5, 400).astype(np.uint64)
    for width in (1, 3, 5, 15, 35):
        h = substring_dedup.rolled(substring_dedup.mixed(x), width, np.uint64(0x9E3779B97F4A7C15))
        same = {}
        for i in range(len(x) - width + 1):
            assert same.setdefault(tuple(x[i : i + width]), h[i]) == h[i]
        assert len(set(same.values())) == len(same)


def keepers(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for text, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0]))[0]
        out += [(r[0], keep, len(own), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()) for r in own]
    return out


@pytest.mark.parametrize("rows", [fixtures.corpus(), fixtures.awkward(), []], ids=["corpus", "awkward", "empty"])
def test_exact_like_brute_force(spark, rows):
    got = exact_dedup.decided(clashing(frame(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(keepers(rows), key=str)
    kept = exact_dedup.deduplicated(clashing(frame(spark, rows)))
    assert "digest" in kept.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({k[0] for k in keepers(rows) if k[3]}, key=str)


def test_index_persists(spark, tmp_path):
    rows = fixtures.corpus(60)
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    first = exact_dedup.decided(frame(spark, rows[:30]), index)
    n = first.filter("kept").count()
    assert index.rows().count() == n
    again = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    later = exact_dedup.decided(frame(spark, [(1000 + r[0], *r[1:]) for r in rows]), again).collect()
    texts = {r[0]: fixtures.re.sub(r"\s", "", r[1]) for r in rows}
    old = {texts[r[0]] for r in rows[:30]}
    for r in later:
        assert r.kept == (texts[r.doc_id - 1000] not in old and r.doc_id == r.keep_id)
        assert (r.keep_id < 1000) == (texts[r.doc_id - 1000] in old)
    plan = spark.table(again.table).groupBy("text_sha256").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the buckets are the partitioning


def test_index_is_compacted_and_leaves_the_catalog(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 2)
    monkeypatch.setattr(exact_dedup, "ROWS_A_BUCKET", 7)
    rows = fixtures.corpus(60)
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 2)
    for k in range(0, 60, 20):
        exact_dedup.decided(frame(spark, rows[k : k + 20]), index)
    files = lambda where: [f for f in os.listdir(where) if f.endswith(".parquet")]
    assert len(files(tmp_path / "index")) > 2
    new = index.compacted(f"file://{tmp_path}/new")
    n = index.rows().count()
    assert new.buckets == -(-n // 7) and len(files(tmp_path / "new")) <= new.buckets
    assert sorted(map(tuple, new.rows().collect())) == sorted(map(tuple, index.rows().collect()))
    assert not any(r.kept for r in exact_dedup.decided(frame(spark, rows), new).collect()) and new.rows().count() == n
    for one in (index, new):
        one.unregistered()
    assert index.rows().count() == n
    before = spark.catalog.listTables()
    assert exact_dedup.decided(frame(spark, rows)).count() == len(rows) and exact_dedup.deduplicated(frame(spark, rows)).count() == n
    assert spark.catalog.listTables() == before


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("rows", [fixtures.corpus(), fixtures.corpus(150, 5), fixtures.awkward(), []], ids=["corpus", "other", "awkward", "empty"])
def test_near_like_brute_force(spark, rows, percent):
    want = fixtures.components(rows, percent)
    got = near_dedup.near_duplicates(clashing(frame(spark, rows)), percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dedup.deduplicated(clashing(frame(spark, rows)), percent).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == sorted({i for i, (_, c) in want.items() if c == i})


def test_near_default_is_four_fifths(spark):
    """Two edits apart in a text of 110 words: 96 of 116 shingles, which are linked at 0.8 and not at 0.85."""
    w = [f"w{i}" for i in range(110)]
    x = [*w[:30], "one", *w[31:70], "two", *w[71:]]
    rows = [(1, " ".join(w), "en", "a", 1), (2, " ".join(x), "en", "a", 1)]
    docs = frame(spark, rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 85).collect()} == {1: 1, 2: 2}
    assert near_dedup.deduplicated(docs).count() == 1


def test_near_chains_and_blocks(spark, monkeypatch):
    """Copies of copies, more than one block of them: every link counts, also between blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    draw, rows = random.Random(1), []
    w = [f"v{i}" for i in range(150)]
    for i in range(40):
        rows.append((i, " ".join(w), "en", "a", 1))
        w[draw.randrange(150)] = f"n{i}"
    want = fixtures.components(rows)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_pairs_between_dissimilar_ends(spark):
    """In every bucket that a pair shares, the smallest and the largest id are of texts unlike it."""
    draw = random.Random(4)
    one = [f"p{i}" for i in range(300)]
    two = [*one[:150], "other", *one[151:]]
    sets = [near_dedup.shingle_sets([" ".join(w).encode()])[0][0] for w in (one, two)]
    marks = np.array([near_dedup.signature(s) for s in sets])
    bands = near_dedup.band_hashes(marks)
    assert (marks[0] == marks[1]).mean() > 0.85

    def like(band):
        """A text of other words but for the shingles that decide this band of the pair."""
        starts = {}
        for at in range(296):
            own = near_dedup.shingle_sets([" ".join(one[at : at + 5]).encode()])[0][0]
            for c in near_dedup._SUBSETS[band]:
                if near_dedup.signature(own)[c] == marks[0][c]:
                    starts[at] = None
        pieces = [one[at : at + 5] for at in starts]
        while True:
            draw.shuffle(pieces)
            text = " ".join(w for piece in pieces for w in [*piece, f"n{draw.randrange(10**6)}"])
            mark = near_dedup.signature(near_dedup.shingle_sets([text.encode()])[0][0])
            if near_dedup.band_hashes(mark[None])[0, band] == bands[0, band]:
                return text

    rows = [(1000, " ".join(one), "en", "a", 1), (1001, " ".join(two), "en", "a", 1)]
    for band in np.nonzero(bands[0] == bands[1])[0]:
        rows += [(int(band), like(band), "en", "a", 1), (2000 + int(band), like(band), "en", "a", 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == fixtures.components(rows) and got[1001][1] == 1000


def test_near_ids_that_name_several_texts(spark):
    """Each text of an id, and of no id, is compared; one row of each component stays."""
    draw = random.Random(3)
    a, b, c = ([f"t{draw.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    text = " ".join
    rows = [(5, text(a)), (5, text(b)), (3, text([*b, "more"])), (4, text([*a, "more"])), (None, text(c)), (None, text([*c, "end"])), (9, text([*b, "x"])), (9, text([*b, "y"])), (None, text([*a, "z"]))]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], fixtures.SCHEMA)
    got = near_dedup.near_duplicates(docs).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=lambda r: (key(r[0]), key(r[1]))) == [
        (3, 3, True), (4, 4, True), (5, 3, False), (5, 4, False), (9, 3, False), (9, 3, False), (None, 4, False), (None, None, True), (None, None, True),
    ]
    stay = near_dedup.deduplicated(docs).collect()
    assert len(stay) == 3 and {r.doc_id for r in stay} == {3, 4, None} and {r.n_chars for r in stay} - {4, 5} == {2, 3}


def test_components_take_few_rounds(spark, monkeypatch):
    """A path through shuffled ids, a star and a pair."""
    ids, written, seen = list(range(400)), near_dedup.written, []
    random.Random(5).shuffle(ids)
    ties = [*zip(ids, ids[1:]), *((1000, k) for k in range(1001, 1040)), (2001, 2000), (2000, 2000)]
    monkeypatch.setattr(near_dedup, "written", lambda df, what: seen.append(what) or written(df, what))
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(ties, "a bigint, b bigint")).collect()}
    assert got == {i: 0 if i < 400 else 1000 if i < 2000 else 2000 for i in {x for t in ties for x in t}}
    assert seen.count("small-stars") <= 12


def test_boilerplate_falls_apart(spark, monkeypatch):
    """Documents that share most of their shingles, none linked but for a few pairs, aren't all compared with one another."""
    monkeypatch.setattr(near_dedup, "LARGE", 50)
    tables, written = {}, near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, what: tables.setdefault(what, written(df, what)) if what == "cluster-members" else written(df, what))
    draw = random.Random(8)
    shared = [f"s{i}" for i in range(80)]
    own = [shared + [f"u{k}x{i}" for i in range(20)] for k in range(300)]
    own += [[*w[:-1], "last"] for w in own[:10]] + [[*w[2:]] for w in own[20:25]]
    rows = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(own)]
    draw.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == fixtures.components(rows) and sum(i != c for i, (_, c) in got.items()) == 15
    assert tables["cluster-members"].count() <= 60


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("n", [40, 400])
def test_agreeing_pairs_join_clusters(n, blocks):
    draw = np.random.default_rng(n)
    lanes = draw.integers(0, 2, (n, near_dedup.COORDINATES)).astype(np.uint8)
    clusters = draw.integers(0, n // 2, n) * 10
    block = np.arange(n) % blocks
    least = 60 if n == 40 else 65
    links = (lanes[:, None] == lanes[None]).sum(axis=2) >= least
    if blocks == 2:
        links &= block[:, None] != block[None]
    links |= clusters[:, None] == clusters[None]
    want = dict(zip(clusters, near_dedup.local_components(links, clusters), strict=True))
    got = dict(zip(*near_dedup.agreeing_clusters(lanes, clusters, block, least), strict=True))
    assert {c: got.get(c, c) for c in want} == want and 0 < len(got) < len(want) - 1


def test_links_are_exact():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([draw.choice(base, 250, replace=False), draw.integers(0, 2**63, int(draw.integers(0, 40))).astype(np.uint64)])) for _ in range(30)]
    got = near_dedup.linked(sets, 75)
    for i in range(30):
        for j in range(30):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (i == j or 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both))


def test_signature_estimates_similarity():
    draw = np.random.default_rng(5)
    errors = []
    for share in (0.3, 0.6, 0.9):
        for _ in range(20):
            a = draw.integers(0, 2**63, 400).astype(np.uint64)
            b = np.concatenate([a[: int(400 * share)], draw.integers(0, 2**63, 400 - int(400 * share)).astype(np.uint64)])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((near_dedup.signature(np.unique(a)) == near_dedup.signature(np.unique(b))).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
