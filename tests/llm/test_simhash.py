"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import fixtures
from translatome.llm import simhash


def plain_fingerprint(text, width=4):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in fixtures.words(text)]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=4):
    """Smallest id that each row reaches, by all pairs."""
    names = list(range(len(prints)))

    def find(x):
        while names[x] != x:
            x = names[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                names[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("rows", [fixtures.corpus(), fixtures.awkward(), []], ids=["corpus", "awkward", "empty"])
def test_like_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    for name in ("id", "print", "first", "cluster", "component_id", "fingerprint"):
        docs = docs.withColumn(name, F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components(prints, [r[0] for r in rows]), strict=True)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pieces_of_a_long_text(monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(f"W{draw.randrange(50)}" for _ in range(n)) for n in (0, 1, 3, 4, 5, 200)] + ["  a \n b  ", "é " * 30, "\x0b"]
    want = [plain_fingerprint(t) for t in texts]
    for piece in (1, 2, 7, 50, 10_000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t.encode()) for t in texts] == want


def neighbours(n, seed, spread):
    """Fingerprints near a few centres, so that many links are at just the radius."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        p = draw.choice(centres)
        for b in draw.sample(range(64), draw.randint(0, spread)):
            p ^= 1 << b
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("radius", range(8))
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_bit_sliced_distances(radius, n):
    prints = np.array(neighbours(n, n, 6), np.uint64)
    planes = simhash.bit_planes(prints)
    rows, found = simhash.near(prints, planes, n, radius, list(range(64)))
    got = {(int(rows[i]), int(j)) for i, j in zip(*np.nonzero(found), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(n) if int(prints[i] ^ prints[j]).bit_count() <= radius}


def test_far_blocks_are_abandoned():
    prints = np.array([0, 1, 3], np.uint64)
    rows, found = simhash.near(np.array([2**64 - 1], np.uint64), simhash.bit_planes(prints), 3, 4, list(range(64)))
    assert not len(rows) and not found.any()


@pytest.mark.parametrize("n", [0, 10**3, 10**7, 10**10, 10**13])
def test_linked_fingerprints_share_a_bucket(n):
    draw, masks = random.Random(1), simhash.choices(n, 4)
    assert n >> min(m.bit_count() for m in masks) <= simhash.BUCKET
    for _ in range(300):
        p = draw.getrandbits(64)
        q = p
        for b in draw.sample(range(64), 4):
            q ^= 1 << b
        assert any(p & m == q & m for m in masks)


@pytest.mark.parametrize("block", [4096, 16])
def test_components_of_crowded_buckets(spark, monkeypatch, block):
    """Many fingerprints in few buckets, in one block each or in many."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = neighbours(300, 2, 5) + neighbours(40, 3, 40)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    nodes = spark.createDataFrame(signed, "print bigint")
    got = {r[0]: r[1] for r in simhash._components(nodes, len(prints), 4).collect()}
    names = [got.get(s[0], s[0]) for s in signed]
    want = plain_components(prints, range(len(prints)))
    assert len(set(zip(names, want, strict=True))) == len(set(names)) == len(set(want))


def test_all_rows_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], plain_components(prints, [r.doc_id for r in rows]), strict=True)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == sorted(want)
