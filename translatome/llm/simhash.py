"""Near-duplicate documents by SimHash fingerprints, compared bit-sliced.

A text's words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) give shingles of 4 words, repeats included; a bit of its 64-bit
fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints link at `radius` or fewer differing bits.

1. Documents with the same fingerprint are one node.
2. The 64 bits are cut into b bands. Two linked fingerprints agree on all bits of b - radius bands at least, so each node is put
   into one bucket for each choice of b - radius bands, by its bits there: linked nodes share a bucket, for certain. b grows with the
   number of nodes, so that a bucket of evenly spread fingerprints holds BUCKET of them at most.
3. A bucket is compared bit-sliced: its fingerprints are stored as 64 bit planes, 64 of them to a machine word; a fingerprint's
   differing bits from all others are counted at once, plane after plane, by carry-save adders whose counters lie in vertical words too;
   a fingerprint abandons the block as soon as all its counters exceed the radius. The planes that make up the bucket are equal and not read.
4. Buckets above BLOCK are cut into blocks. Links within the blocks are joined up first; then only members of different clusters are compared
   across blocks, those of the bucket's largest cluster with all others but never with one another.
5. Linked nodes are joined up to components, named by their smallest doc_id.

A task returns at most one tie for each member of a block, whatever the number of links is.

Defined cases: a null, empty or blank text has fingerprint zero and is linked as any other; with fewer than 4 words the whole sequence
is the one shingle; very long texts are read whole, some PIECE bytes at a time; rows that repeat, tie or share a doc_id
are rows each, in the component of their fingerprint; a null doc_id never names a component unless all its rows have none; an empty table
gives an empty result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import slices, written
from translatome.llm.near_dedup import components

WIDTH, RADIUS, SEED = 4, 4, 42
#: Most fingerprints that a bucket of evenly spread ones should hold, and those of a block of a larger bucket.
BUCKET, BLOCK = 1024, 4096
#: Words of counters that are updated at a time, and bytes of text whose words are held at a time.
WORDS, PIECE = 16_384, 1_000_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of about PIECE bytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    counts, n, held = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(text or b""):
        held += words
        if len(held) < width:
            continue
        joined = b" ".join(held)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(held) - width + 1].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        for k in range(0, len(hashes), 65_536):
            some = hashes[k : k + 65_536]
            counts += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
        held = held[len(held) - width + 1 :]
    if not n:
        return digest(b" ".join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE):
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "print"])

    return each


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 x ceil(n / 64) words: bit j of word i of plane b is bit b of fingerprint 64 * i + j."""
    bits = np.zeros((-(-len(prints) // 64) * 64, 64), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _added(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum and the carry of three bits in each place."""
    either = one ^ two
    return either ^ three, (one & two) | (either & three)


def near(queries: np.ndarray, planes: np.ndarray, n: int, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which queries come near any of the n fingerprints of the planes, and for these a matrix of whom; other planes than `order` are equal."""
    alive = np.arange(len(queries))
    masks = -np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    masks = masks.view(np.uint64)
    ones = np.zeros((len(queries), planes.shape[1]), np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    if n % 64:  # places without a fingerprint are beyond from the start
        over[:, -1] = FULL << np.uint64(n % 64)
    limit = [FULL if radius >> k & 1 else np.uint64(0) for k in range(3)]
    beyond = over
    for at in range(0, len(order), 4):
        some = order[at : at + 4]
        differ = [planes[b] ^ masks[:, b, None] for b in some] + [np.uint64(0)] * (4 - len(some))
        ones, low = _added(ones, differ[0], differ[1])
        ones, high = _added(ones, differ[2], differ[3])
        twos, carry = _added(twos, low, high)
        over = over | (fours & carry)
        fours = fours ^ carry
        if at + 4 <= radius:
            continue
        beyond, equal = over, FULL
        for count, bound in zip((fours, twos, ones), reversed(limit), strict=True):
            beyond = beyond | (equal & count & ~bound)
            equal = equal & ~(count ^ bound)
        going = (beyond != FULL).any(axis=1)
        if not going.all():
            alive, masks, ones, twos, fours, over, beyond = (x[going] for x in (alive, masks, ones, twos, fours, over, beyond))
            if not len(alive):
                break
    found = np.unpackbits(np.ascontiguousarray(~beyond).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    return alive, found


def ties(queries: np.ndarray, of: np.ndarray, prints: np.ndarray, clusters: np.ndarray, radius: int, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ties (cluster, smallest cluster reached) by links of queries in clusters `of` with prints in `clusters`."""
    known, at = np.unique(np.concatenate([of, clusters]), return_inverse=True)
    mine, theirs = at[: len(of)], at[len(of) :]
    names, planes = np.arange(len(known)), bit_planes(prints)
    step = max(1, WORDS // planes.shape[1])
    for k in range(0, len(queries), step):
        rows, found = near(queries[k : k + step], planes, len(prints), radius, order)
        one = names[mine[k + rows]]
        r, c = np.nonzero(found & (one[:, None] != names[theirs][None]))
        a, b = one[r], names[theirs][c]
        while len(a):
            np.minimum.at(names, np.maximum(a, b), np.minimum(a, b))
            while (names != names[names]).any():
                names = names[names]
            a, b = names[a], names[b]
            a, b = a[a != b], b[a != b]
    moved = names != np.arange(len(known))
    return known[moved], known[names[moved]]


def choices(n: int, radius: int) -> list[int]:
    """Masks of the bits by which n fingerprints are put into buckets."""
    for bands in range(radius + 1, 33):
        cuts = [64 * k // bands for k in range(bands + 1)]
        each = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        masks = [sum(chosen) for chosen in combinations(each, bands - radius)]
        if n >> min(m.bit_count() for m in masks) <= BUCKET:
            break
    return masks


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of equal keys."""
    held: list[pa.RecordBatch] = []

    def cut(final: bool) -> Iterator[dict[str, np.ndarray]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
        turns = np.zeros(max(rows.num_rows - 1, 0), bool)
        for key in keys:
            turns |= columns[key][1:] != columns[key][:-1]
        ends = [*(np.nonzero(turns)[0] + 1).tolist(), *([rows.num_rows] if final else [])]
        start = 0
        for end in ends:
            yield {c: x[start:end] for c, x in columns.items()}
            start = end
        held[:] = rows.slice(start).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from cut(False)
    if held:
        yield from cut(True)


_TIES = "a bigint, b bigint"


def _batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["a", "b"])


def _orders(masks: list[int]) -> list[list[int]]:
    return [[b for b in range(64) if not mask >> b & 1] for mask in masks]


def _within(masks: list[int], radius: int):
    """Rows sorted by (choice, bits, block) in; ties between fingerprints of a block out."""
    orders = _orders(masks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for rows in _groups(batches, ["choice", "bits", "block"]):
            if len(rows["print"]) > 1:
                prints = rows["print"].view(np.uint64)
                found.append(ties(prints, rows["print"], prints, rows["print"], radius, orders[rows["choice"][0]]))
            if len(found) >= 1000:
                yield _batch(found)
                found = []
        yield _batch(found)

    return compare


def _across(masks: list[int], radius: int):
    """Rows sorted by (choice, bits, one, two) in; ties between clusters of blocks one and two out."""
    orders = _orders(masks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["choice", "bits", "one", "two"]):
            low, high = rows["mine"] == rows["one"], rows["mine"] == rows["two"]
            if low.any() and high.any():
                prints = rows["print"].view(np.uint64)
                yield _batch([ties(prints[low], rows["cluster"][low], prints[high], rows["cluster"][high], radius, orders[rows["choice"][0]])])
        yield _batch([])

    return compare


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ties_across(members: DataFrame, clusters: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Ties between clusters whose members meet in a bucket of several blocks."""
    bucket = ["choice", "bits"]
    named = written(members.join(clusters, "print", "left").select(*bucket, "print", F.coalesce("cluster", "print").alias("cluster")), "print-members")
    counts = named.groupBy(*bucket, "cluster").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(*bucket).agg(F.max(F.struct("n", "cluster")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("bigint")
    most = most.select(*bucket, F.col("most.cluster").alias("largest"), blocks(F.col("n") - F.col("most.n")).alias("others"), blocks(F.col("most.n")).alias("own"))
    hashed, of_largest = F.xxhash64("print"), F.col("cluster") == F.col("largest")
    dealt = (
        named.join(most, bucket)
        .withColumn("mine", F.when(of_largest, F.col("others") + F.pmod(hashed, F.col("own"))).otherwise(F.pmod(hashed, F.col("others"))))
        .withColumn("with", F.when(of_largest, F.col("others")).otherwise(F.col("others") + F.col("own")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("with") - 1)))
        .select(*bucket, F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "mine", "cluster", "print")
    )
    keys = [*bucket, "one", "two"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_across(masks, radius), _TIES)


def _components(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """print, cluster for the linked ones among n different fingerprints."""
    masks = choices(n, radius)
    put = [F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)]
    members = nodes.select("print", F.explode(F.array(*put)).alias("at")).select("at.choice", "at.bits", "print")
    bucket = ["choice", "bits"]
    large = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large = written(large.select(*bucket, F.ceil(F.col("n") / BLOCK).cast("bigint").alias("blocks")), "large-buckets")
    whole = large.isEmpty()
    dealt = members.withColumn("block", F.lit(0).cast("bigint"))
    if not whole:
        block = F.pmod(F.xxhash64("print"), F.coalesce("blocks", F.lit(1)))
        dealt = members.join(large, bucket, "left").select(*bucket, "print", block.alias("block"))
    keys = [*bucket, "block"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_within(masks, radius), _TIES)
    clusters = components(found).select(F.col("id").alias("print"), F.col("component").alias("cluster"))
    if whole:
        return clusters
    across = written(_ties_across(members.join(large, bucket, "left_semi"), clusters, masks, radius), "print-ties-across")
    if across.isEmpty():
        return clusters
    joined = components(across).select(F.col("id").alias("cluster"), F.col("component").alias("joined"))
    alone = joined.select(F.col("cluster").alias("print"), "cluster").join(clusters, "print", "left_anti")
    return clusters.unionByName(alone).join(joined, "cluster", "left").select("print", F.coalesce("joined", "cluster").alias("cluster"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of docs. `radius` is 0 to 7 bits, `width` the words of a shingle."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold distances up to 7")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text"))
    prints = written(texts.mapInArrow(_fingerprints(width), "id bigint, print bigint"), "fingerprints")
    nodes = written(prints.groupBy("print").agg(F.min("id").alias("first")), "fingerprint-nodes")
    clusters = _components(nodes.select("print"), nodes.count(), radius)
    named = written(nodes.join(clusters, "print", "left").select("print", "first", F.coalesce("cluster", "print").alias("cluster")), "named-fingerprints")
    names = named.groupBy("cluster").agg(F.min("first").alias("component_id"))
    named = named.join(names, "cluster").select("print", "component_id")
    return prints.join(named, "print").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )
