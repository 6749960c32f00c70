"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of 5 words (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+). Two
permutations of 32-bit numbers give all signature coordinates: the first one scatters the shingles, the second
one, shifted circularly by k, gives coordinate k. Bands are fixed subsets of the coordinates.

1. Documents with the same words are reduced to one node, whatever their ids are.
2. In each band bucket, members are tied to the bucket's smallest and largest id; ties whose signatures agree too
   little for the threshold are dropped. Connected ties make clusters.
3. In buckets with members of several clusters, all pairs across clusters are compared on their signatures, block by
   block; those that agree enough join their clusters. So any two members of a bucket that agree enough share a cluster.
4. Clusters of more than LARGE members are split: with its shingles ordered from those that few members of the cluster have to those that
   many have, a document shares one of its first n - ceil(threshold * n) + 1 with every document it is linked with. Only members
   connected by such shingles stay together, so what merely shares the same boilerplate falls apart.
5. All pairs of a cluster's members are compared on their full sets, block by block, as products of incidence
   matrices; a block returns no more rows than it has members.
6. Linked documents are joined up to components, named by their smallest id.

Rows are known by a 64-bit hash of doc_id and text together with a digest of the words, so doc_id needs to be neither unique nor there.

Defined cases: a null or blank text has an empty set and is linked with nothing; with fewer than 5 words the whole
sequence is the one shingle; very long texts are read whole, 1 MB of texts at a time; rows that repeat (same doc_id and text) are one
document, each row is returned; rows with one doc_id and several texts are documents each; a null doc_id is never a component's name
unless all its rows have none, it is linked as any other and kept only then; an empty table gives an empty result;
further columns are carried by `deduplicated`, which keeps one row of each component, and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from translatome.llm.common import slices, written
from translatome.llm.substring_dedup import hashed_words, mixed, rolled

SHINGLE = 5
#: Least similarity of linked documents, in percent, unless a caller states another.
PERCENT = 80
COORDINATES, BANDS, ROWS = 96, 40, 6
#: Independent coordinates would agree on the threshold less this, or more, but for 1 pair in 20,000 at a similarity of 0.85, in 7000 at 0.8.
MARGIN = 0.16
#: Members of one block of a cluster, and of one block of a bucket.
BLOCK, BUCKET_BLOCK = 512, 1024
#: Members above which a cluster is split by the shingles that few of them have.
LARGE = 4096
#: Bytes of text whose words a task holds at a time.
PART_BYTES = 1_000_000

_SUBSETS = np.array([np.random.default_rng([11, b]).choice(COORDINATES, ROWS, replace=False) for b in range(BANDS)])
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)


def shingle_sets(texts: list[bytes | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted distinct shingle hashes of each text, and a digest of its words (empty without words)."""
    words = [t.lower().split() if t else [] for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    hashes = hashed_words([w for ws in words for w in ws])
    shingles = rolled(hashes, SHINGLE, np.uint64(0x9E3779B97F4A7C15))
    starts = np.cumsum(n) - n
    sets, digests = [], []
    for ws, at, count in zip(words, starts, n, strict=True):
        if count >= SHINGLE:
            sets.append(np.unique(shingles[at : at + count - SHINGLE + 1]))
        elif count:
            sets.append(rolled(hashes[at : at + count], int(count), np.uint64(0xC2B2AE3D27D4EB4F)))
        else:
            sets.append(np.zeros(0, np.uint64))
        digests.append(hashlib.md5(b" ".join(ws), usedforsecurity=False).digest() if count else b"")
    return sets, digests


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: minima of the second permutation, shifted, over the first one's images."""
    first = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 512):
        x = first[at : at + 512, None] - _SHIFTS
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x7FEB352D)
        np.right_shift(x, np.uint32(15), out=t)
        x ^= t
        x *= np.uint32(0x846CA68B)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """documents x BANDS hashes of each band's coordinates and the band's number."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for row in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, _SUBSETS[:, row]].astype(np.uint64))
    return out


_SKETCH = "id bigint, key bigint, n_shingles bigint, digest binary, lanes binary, bands array<bigint>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=PART_BYTES):
        sets, digests = shingle_sets(batch.column("text").to_pylist())
        signatures = np.array([signature(s) for s in sets], dtype=np.uint32).reshape(-1, COORDINATES)
        bands = band_hashes(signatures).view(np.int64)
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([s.tobytes() for s in signatures.astype(np.uint8)], pa.binary()),  # the lowest bytes tell which pairs may agree
                pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())),
            ],
            ["id", "key", "n_shingles", "digest", "lanes", "bands"],
        )


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of coordinates on which the lanes of two signatures agree."""
    one = np.frombuffer(b"".join(a), np.uint8).reshape(-1, COORDINATES)
    two = np.frombuffer(b"".join(b), np.uint8).reshape(-1, COORDINATES)
    return pd.Series((one == two).mean(axis=1) if len(one) else np.zeros(0))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of pairs with 100 * intersection >= percent * union, by products of incidence matrices."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    everything = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    _, inverse, counts = np.unique(everything, return_inverse=True, return_counts=True)
    common = counts[inverse] > 1
    # a linked document shares at least percent % of its own shingles
    hopeful = 100 * np.bincount(owner[common], minlength=m) >= percent * sizes
    use = common & hopeful[owner]
    row, column = owner[use], np.unique(inverse[use], return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    shared = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, width, 4096):
        low, high = np.searchsorted(column, [at, at + 4096])
        incidence = np.zeros((m, min(4096, width - at)), np.float32)
        incidence[row[low:high], column[low:high] - at] = 1
        shared += incidence @ incidence.T
    shared = shared.astype(np.int64)
    out = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (shared > 0)
    np.fill_diagonal(out, True)
    return out


def local_components(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each member reaches."""
    names, last = ids.copy(), None
    while last is None or (names != last).any():
        last = names
        names = np.where(links, names[None, :], np.iinfo(np.int64).max).min(axis=1)
    return names


def _verify(percent: int):
    """Rows sorted by (cluster, one, two) in; ties between a member and its local component out."""

    def ties(ids: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        members = np.array(ids, dtype=np.int64)
        names = local_components(linked(sets, percent), members)
        return members[names != members], names[names != members]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            both = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b"])

        for batch in slices(batches, most=PART_BYTES):
            own, digests = shingle_sets(batch.column("text").to_pylist())
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "one", "two")), strict=True)
            same = [a == b for a, b in zip(digests, batch.column("digest").to_pylist(), strict=True)]
            for k, i, s, right in zip(keys, batch.column("node").to_pylist(), own, same, strict=True):
                if not right:  # another text with the same key
                    continue
                if k != key:
                    if len(ids) > 1:
                        out.append(ties(ids, sets))
                    key, ids, sets = k, [], []
                if not ids or ids[-1] != i:  # rows that repeat come one after another
                    ids.append(i)
                    sets.append(s)
            yield batch_of()
        if len(ids) > 1:
            out.append(ties(ids, sets))
        yield batch_of()

    return verify


def agreeing_clusters(signatures: np.ndarray, clusters: np.ndarray, blocks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ties (cluster, smallest cluster reached) by pairs across clusters, and across blocks if there are two, with `least` equal bytes or more."""
    low, high = blocks == blocks.min(), blocks == blocks.max()
    one, two = signatures[low], signatures[high]
    if one.size * len(two) <= 1_000_000:
        equal = (one[:, None] == two[None]).sum(axis=2)
    else:
        equal = np.zeros((len(one), len(two)), np.uint8)
        for a, b in zip(np.ascontiguousarray(one.T), np.ascontiguousarray(two.T), strict=True):
            equal += a[:, None] == b[None]
    known, at = np.unique(clusters, return_inverse=True)
    a, b = np.nonzero((equal >= least) & (clusters[low][:, None] != clusters[high][None]))
    a, b = np.unique(np.stack([at[low][a], at[high][b]]), axis=1)
    names, last = np.arange(len(known)), None
    while last is None or (names != last).any():
        last = names.copy()
        np.minimum.at(names, a, last[b])
        np.minimum.at(names, b, last[a])
    moved = names != np.arange(len(known))
    return known[moved], known[names[moved]]


def _compare(percent: int):
    """Rows sorted by (band, one, two) in; ties between clusters out."""
    least = int(np.ceil((percent / 100 - MARGIN) * COORDINATES))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ties(final: bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in ("band", "one", "two", "mine", "cluster")])
            cuts = np.nonzero((np.diff(keys[:3]) != 0).any(axis=0))[0] + 1
            ends = [*cuts.tolist(), *([rows.num_rows] if final else [])]
            raw = b"".join(rows.column("lanes").to_pylist())
            lanes = np.frombuffer(raw, np.uint8).reshape(-1, COORDINATES)
            out, start = [], 0
            for end in ends:
                if end - start > 1:
                    out.append(agreeing_clusters(lanes[start:end], keys[4, start:end], keys[3, start:end], least))
                start = end
            held[:] = rows.slice(start).to_batches()
            both = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b"])

        for batch in batches:
            held.append(batch)
            yield ties(False)
        if held:
            yield ties(True)

    return compare


def ties_across(members: DataFrame, clusters: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Ties between clusters whose members meet in a bucket and agree enough.

    members: band, node; clusters: node, cluster, for some nodes (others are clusters of one); marks: node, lanes. Members of a bucket's
    largest cluster are compared with all others, never with one another.
    """
    named = written(members.join(clusters, "node", "left").select("band", "node", F.coalesce("cluster", "node").alias("cluster")), "named-members")
    counts = named.groupBy("band", "cluster").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("band").agg(F.max(F.struct("n", "cluster")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    size = lambda n: F.ceil(n / BUCKET_BLOCK).cast("bigint")
    most = most.select("band", F.col("most.cluster").alias("largest"), size(F.col("n") - F.col("most.n")).alias("others"), size(F.col("most.n")).alias("own"))
    hashed, of_largest = F.xxhash64("node"), F.col("cluster") == F.col("largest")
    dealt = (
        named.join(most, "band")
        .withColumn("mine", F.when(of_largest, F.col("others") + F.pmod(hashed, F.col("own"))).otherwise(F.pmod(hashed, F.col("others"))))
        .withColumn("with", F.when(of_largest, F.col("others")).otherwise(F.col("others") + F.col("own")))
        .join(marks.select("node", "lanes"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("with") - 1)))
        .select("band", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "cluster", "lanes")
    )
    return dealt.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two").mapInArrow(_compare(percent), "a bigint, b bigint")


def components(ties: DataFrame) -> DataFrame:
    """id, component (the smallest id reached) for the ends of ties (a, b).

    Large and small stars in turn: each node ties its larger neighbours, then its smaller ones, to the smallest it knows. That
    halves the depth of what is left at least, so that the rounds grow as the logarithm of the longest path.
    """
    edge = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    edges, mark = written(ties.filter("a != b").select(*edge).distinct(), "edges"), None
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = written(both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", "m")).distinct(), "small-stars")
        before, mark = mark, edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each text."""
    for batch in slices(batches, most=PART_BYTES):
        sets, digests = shingle_sets(batch.column("text").to_pylist())
        sets = [s if a == b else s[:0] for s, a, b in zip(sets, digests, batch.column("digest").to_pylist(), strict=True)]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        each = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)) for c in ("cluster", "node")]
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([*each, pa.array(np.repeat(n, n)), pa.array(every.view(np.int64))], ["cluster", "node", "n", "shingle"])


def split_clusters(members: DataFrame, percent: int) -> DataFrame:
    """node, cluster: members (cluster, node, digest, text) that a shingle among the rarest of both connects; others are left out.

    Linked sets of n and k shingles share percent % of the larger one at least, so that each has one of the shared shingles, and both
    have the same first one, among its rarest n - ceil(percent % of n) + 1. Shingles of one member only come first of all.
    """
    shingles = written(members.mapInArrow(_shingles, "cluster bigint, node bigint, n bigint, shingle bigint").distinct(), "shingles")
    shared = shingles.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("node")
    ranked = (
        shingles.join(shared, ["cluster", "shingle"])
        .withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
        .withColumn("rank", F.row_number().over(own.orderBy("df", "shingle")) + F.col("alone"))
    )
    first = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("cluster", "shingle", "node")
    first = written(first, "rare-shingles")
    low = first.groupBy("cluster", "shingle").agg(F.min("node").alias("low"))
    ties = first.join(low, ["cluster", "shingle"]).filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(ties).select(F.col("id").alias("node"), F.col("component").alias("cluster"))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("id"), F.xxhash64(doc_id, "text").alias("key"), F.col("text").cast("binary").alias("text"), *more)


def _named(docs: DataFrame, percent: int) -> DataFrame:
    """id, key, n_shingles, component_id and stays (one document of each component) for each row of docs."""
    texts = _keyed(docs).select("id", "key", "text")
    sketches = written(texts.mapInArrow(_sketches, _SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = sketches.filter("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("id").alias("first"))
    nodes = written(nodes, "nodes")
    marks = written(sketches.join(nodes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "key", "digest", "lanes", "bands"), "marks")

    bands = marks.select("node", F.explode("bands").alias("band"))
    ends = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    ends = written(ends, "buckets")
    members = written(bands.join(ends, "band"), "members")
    pairs = (
        members.select("node", F.explode(F.array("low", "high")).alias("end"))
        .filter("node != end")
        .select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
        .distinct()
    )
    lanes = marks.select("node", "lanes")
    agree = F.pandas_udf(agreement, "double")
    ties = written(
        pairs.join(lanes.select(F.col("node").alias("a"), F.col("lanes").alias("one")), "a")
        .join(lanes.select(F.col("node").alias("b"), F.col("lanes").alias("two")), "b")
        .filter(agree("one", "two") >= percent / 100 - MARGIN)
        .select("a", "b"),
        "ties",
    )
    clusters = components(ties).select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    across = written(ties_across(members.filter("n > 2"), clusters, lanes, percent), "ties-across")
    if not across.isEmpty():
        joined = components(across).withColumnRenamed("id", "cluster")
        alone = joined.select(F.col("cluster").alias("node"), "cluster").join(clusters, "node", "left_anti")
        clusters = clusters.unionByName(alone).join(joined, "cluster", "left").select("node", F.coalesce("component", "cluster").alias("cluster"))
    clusters = written(clusters, "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    marked = marks.select("node", "key", "digest")
    large = sizes.filter(F.col("members") > LARGE).select("cluster")
    if not large.isEmpty():
        whole = texts.join(clusters.join(large, "cluster", "left_semi").join(marked, "node"), "key")
        smaller = split_clusters(whole.select("cluster", "node", "digest", "text"), percent)
        clusters = written(clusters.join(large, "cluster", "left_anti").select("node", "cluster").unionByName(smaller), "split-clusters")
        sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    sizes = sizes.select("cluster", F.ceil(F.col("members") / BLOCK).cast("bigint").alias("blocks"))
    clusters = written(clusters.join(sizes, "cluster").join(marked, "node"), "cluster-members")
    blocks = (
        texts.select("key", "text").join(clusters.hint("merge"), "key")  # at every size: clusters grow with the input
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .select("cluster", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "node", "digest", "text")
    )
    links = written(
        blocks.repartition("cluster", "one", "two")
        .sortWithinPartitions("cluster", "one", "two", "node")
        .mapInArrow(_verify(percent), "a bigint, b bigint"),
        "links",
    )
    if clusters.filter("blocks > 1").isEmpty():
        reached = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        reached = components(links).select(F.col("id").alias("node"), "component")
    named = written(
        nodes.join(reached, "node", "left").select("digest", "node", "first", F.coalesce("component", "node").alias("component")), "named"
    )
    best = named.groupBy("component").agg(
        F.min("first").alias("name"),
        F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best"),
    )
    named = named.join(best.select("component", "name", F.col("best.node").alias("best")), "component").select("digest", "node", "first", "name", "best")
    rows = sketches.select("id", "key", "n_shingles", "digest").join(named, "digest", "left")
    return rows.select(
        "id", "key", "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"),
        (F.col("node").isNull() | ((F.col("node") == F.col("best")) & F.col("id").eqNullSafe(F.col("first")))).alias("stays"),
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return _named(docs, percent).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one of each component, with the columns of docs."""
    staying = written(_named(docs, percent).filter("stays").select("key").distinct(), "staying")
    return _keyed(docs, F.struct("*").alias("row")).select("key", "row").join(staying, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
