"""Removal of repeated passages, by difference-cover anchors.

A position is a cover position if its remainder modulo PERIOD lies in COVER. As every remainder is a difference
of two elements of COVER, any two equal passages of WINDOW words, wherever they start, have cover positions at
some common distance below PERIOD from their starts. There both hold the same anchor of WINDOW - PERIOD + 1 words.
So it is enough to hash anchors at cover positions (5 of 21): an anchor that is found elsewhere extends to the
windows around it, and only those are hashed whole (96 bits) and counted.

Copies never meet as pairs. Equal texts are reduced to one beforehand; within a batch of a map task equal hashes
are reduced to one row with a key of its own, the others are marked as known, so a hash has one row for each batch at most.

Rows are known by a 64-bit hash of doc_id and text, so neither needs to be unique or there (of n rows, about n * n / 2**65 pairs
share a hash by chance). Anchors and windows carry a number of their text instead, which takes less room.

A word is [^\\x20\\x09-\\x0D]+. Defined cases: a null text has no words; texts below the window keep all their words; very long
texts are read whole, 4 MB at a time; overlapping copies inside one document count; rows that repeat (same doc_id and text) count as
copies of each other; rows with one doc_id, or none, and several texts are documents each; an empty table gives an empty result;
further columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from translatome.llm.common import slices, written

#: {0, 1, 4, 14, 16} is a perfect difference set modulo 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
WINDOW = 35
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False) if len(words) else np.zeros(0, np.uint64)


def rolled(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of the `width` words from each position on, by doubling; the last width - 1 positions are left out."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    power, part, span = np.full(1, base), words, 1  # arrays wrap without a warning
    out, done = None, 0
    n = len(words) - width + 1
    while True:
        if width & span:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += span
        if done == width:
            return mixed(out)
        part = part[:-span] * power + part[span:]
        span, power = span * 2, power * power


def _texts(batch: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray]:
    words = [t.split() if t else [] for t in batch.column("text").to_pylist()]
    return words, np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def _once(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and known: hashes that are here more than once keep one row with their key; all those are known."""
    if not len(hashes):
        return hashes, np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    as_before = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    known = as_before | np.concatenate([as_before[1:], [False]])
    keys = ranked.copy()
    keys[as_before] = mixed(ranked[as_before] + np.nonzero(as_before)[0].astype(np.uint64) * _BASE2)
    out_keys, out_known = np.empty_like(keys), np.empty_like(known)
    out_keys[order], out_known[order] = keys, known
    return out_keys, out_known


def _anchors(width: int, period: int, cover: tuple[int, ...]):
    at_cover = np.zeros(period, bool)
    at_cover[list(cover)] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, n = _texts(batch)
            hashes = rolled(hashed_words([w for ws in words for w in ws]), width, _BASE)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            doc = np.repeat(np.arange(len(n)), n)
            ok = np.nonzero(((place + width <= np.repeat(n, n)) & at_cover[place % period])[: len(hashes)])[0]
            keys, known = _once(hashes[ok])
            ids = batch.column("id").to_numpy(zero_copy_only=False)[doc[ok]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(ids), pa.array(place[ok].astype(np.int32)), pa.array(known)], ["hash", "id", "pos", "known"]
            )

    return anchors


def _windows(window: int, reach: int):
    """Candidate windows: those that hold a repeated anchor not more than `reach` words from their start."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, n = _texts(batch)
            hashes = hashed_words([w for ws in words for w in ws])
            one, two = rolled(hashes, window, _BASE), rolled(hashes, window, _BASE2)
            starts = np.cumsum(n) - n
            found = batch.column("anchors")
            counts = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
            edge = np.zeros(int(n.sum()) + 1, np.int64)
            at = np.asarray(found.flatten()).astype(np.int64)
            first = np.repeat(starts, counts)
            np.add.at(edge, first + np.maximum(at - reach, 0), 1)
            np.add.at(edge, first + at + 1, -1)
            place = np.arange(int(n.sum())) - np.repeat(starts, n)
            ok = (np.cumsum(edge)[:-1] > 0) & (place + window <= np.repeat(n, n))
            ok = np.nonzero(ok[: len(one)])[0]
            keys, known = _once(one[ok])
            doc = np.repeat(np.arange(len(n)), n)[ok]
            rest = (two[ok] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[doc]
            place = place[ok].astype(np.int32)
            twin = batch.column("twins").to_numpy(zero_copy_only=False)[doc] > 1
            send = ~(twin & known & (keys != one[ok]))  # of texts with twins only the hash is of use to others
            place = np.where(twin, -1, place).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[send]) for x in (keys.view(np.int64), rest, ids, place, known)], ["hash", "rest", "id", "pos", "known"]
            )

    return windows


def _cleaned(window: int, ids_back: bool):
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
            twins = batch.column("twins").to_pylist()
            for text, twin, starts in zip(batch.column("text").to_pylist(), twins, batch.column("starts"), strict=True):
                words = text.split() if text else []
                n = len(words)
                if n >= window and (twin is None or twin > 1):
                    kept = []
                elif starts.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.asarray(starts.values).astype(np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    kept = [words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0]]
                else:
                    kept = words
                joined = b" ".join(kept)
                columns["n_words"].append(n)
                columns["n_removed"].append(n - len(kept))
                columns["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                columns["kept_text"].append(joined.decode() if ids_back else None)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(columns.values(), types, strict=True))], ["doc_id", *columns]
            )

    return cleaned


def repeated_passages_removed(docs: DataFrame, with_text: bool = False, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless with_text), one row per row of docs."""
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"a window has {PERIOD} words at least")
    doc_id = F.col("doc_id").cast("bigint")
    texts = docs.select(F.xxhash64(doc_id, "text").alias("key"), doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"))
    twins = texts.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("twins"))
    twins = twins.filter("sha is not null").select("key", "twins", F.monotonically_increasing_id().alias("id"))
    twins = written(twins, "distinct-texts")
    keys = twins.select("key", "id")

    # each join keeps all rows of texts and each map all their columns, so that the three of them share one exchange of the texts
    first = texts.join(twins.hint("shuffle_hash"), "key", "left")
    anchors = first.filter("twins is not null").select("id", "doc_id", "text").mapInArrow(
        _anchors(width, PERIOD, COVER), "hash bigint, id bigint, pos int, known boolean"
    )
    elsewhere = F.count(F.lit(1)).over(Window.partitionBy("hash")) > 1
    found = anchors.withColumn("again", elsewhere).filter("again or known")
    found = found.groupBy("id").agg(F.collect_list("pos").alias("anchors")).join(keys, "id").select("key", "anchors")

    second = first.join(found.hint("shuffle_hash"), "key", "left").filter("anchors is not null and twins is not null")
    windows = second.select("id", "doc_id", "text", "twins", "anchors").mapInArrow(
        _windows(window, PERIOD - 1), "hash bigint, rest int, id bigint, pos int, known boolean"
    )
    elsewhere = F.count(F.lit(1)).over(Window.partitionBy("hash", "rest")) > 1
    sure = windows.withColumn("again", elsewhere).filter("(again or known) and pos >= 0")
    sure = sure.groupBy("id").agg(F.collect_list("pos").alias("starts")).join(keys, "id").select("key", "starts")

    last = first.join(sure.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "twins", "starts")
    return last.mapInArrow(
        _cleaned(window, with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    )
