"""Best-fit packing of tokenized documents into sequences.

Documents are tokenized in map tasks; only those above the sequence length are cut, from the end, into full
pieces and a first one that may be shorter. Full pieces are sequences of their own. The others are dealt out at
random into local parts; each part packs its items best-fit with the longest first. No two bins of a part fit together
then, so a part has one bin at most that is half full or less, and only such bins can still go into others. They
become items of the next round with as many others, the emptiest of those that are more than half full (if a bin fits
into any others, then into these); all else is emitted. The number of parts follows from the items that are left.
Items carry their pieces (a sequence has room for 1024 of them at most), so that no round needs a join.

Defined cases: a null text is empty (its only id is the end mark); very long texts are encoded whole and cut into as many pieces as
they take; items of one length that tie are packed in any order; rows that repeat are packed each; an empty
table gives an empty result; a null doc_id is carried; further columns are never read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import slices, written

CAPACITY, END = 1024, 2
#: Items of a part, on average.
PART_ITEMS = 30_000
#: Bytes of text whose ids a task holds at a time.
PART_BYTES = 1_000_000

# The pattern of byte-level pre-tokenizers, and what it comes to in texts without two blank characters in a row.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SINGLE_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

_encoders: dict[str, _Encoder] = {}
_blank_pair = re.compile(r"\s\s")
_beyond_latin = re.compile("[^\x00-\u024f]")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Encoder:
    """A tokenizer file and, if it is a plain byte-level BPE, the same merges as ranks of byte strings, which take a third of the time.

    Ranks give the same ids where ids count the merges in order and every token, encoded alone, is itself: what stands between the
    ends of a token is then merged as it is alone, so that no other split of it than the merge's own can arise.
    Texts beyond Latin letters, or with a special token's name, are left to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.ranked = self._ranked(spec)

    @property
    def tokenizer(self):
        """Loaded with the first text that needs it: it takes as much memory as the ranks."""
        if self._tokenizer is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _ranked(self, spec: dict) -> tuple | None:
        model, before, letters = spec["model"], spec.get("pre_tokenizer") or {}, _byte_letters()
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or not plain or odd:
            return None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if made != sorted(set(made)) or len(made) + 256 != len(vocab):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        return tuple(tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_PATTERN, _SINGLE_BLANKS))

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if self.ranked is None or _beyond_latin.search(text) or any(x in text for x in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked[not _blank_pair.search(text)].encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids, as little-endian unsigned 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return list(map(_encoders[path].ids, texts))


def pieces_of(path: str, capacity: int = CAPACITY, end: int = END):
    mark = np.asarray([end], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PART_BYTES):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), token_bytes(texts, path), strict=True):
                ids += mark
                n = len(ids) // 4
                ends = [n] if n <= capacity else list(range(n % capacity or capacity, n + 1, capacity))
                start = 0
                for k, stop in enumerate(ends):
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return pieces


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item: the longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i] = b
        open_bins[room - size].append(b)
        if room > size:
            rooms |= 1 << (room - size)
    return bins


_ITEM = "part bigint, size bigint, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def _round(capacity: int):
    """Packs one part: items in, bins out."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        bins = best_fit(part["size"].to_numpy(np.int64), capacity)
        order = np.argsort(bins, kind="stable")
        cuts = np.nonzero(np.diff(bins[order], prepend=-1))[0]
        members, sizes = part["members"].to_numpy(), part["size"].to_numpy(np.int64)
        merged = [[m for i in own for m in members[i]] for own in np.split(order, cuts[1:])] if len(part) else []
        total = np.add.reduceat(sizes[order], cuts) if len(part) else sizes
        return pd.DataFrame({"part": part["part"].iloc[0], "size": total, "members": merged})

    return pack


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences (members, sequence_id) in; a row for each piece with its offset out."""
    for batch in batches:
        members, ids = batch.column("members"), batch.column("sequence_id").to_numpy(zero_copy_only=False)
        pieces, counts = members.flatten(), members.value_lengths().to_numpy(zero_copy_only=False)
        length = pieces.field("length").to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        offset = before - np.repeat(before[np.cumsum(counts) - counts], counts)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        own = [pieces.field(n) for n in names]
        yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(ids, counts), pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, part_items: int = PART_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(
        docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
            pieces_of(tokenizer_path, capacity, end), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
        ),
        "pieces",
    )
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    full = pieces.filter(F.col("length") == capacity).select(F.array(member).alias("members"))
    short = pieces.filter(F.col("length") < capacity)
    left = short.count()
    items = short.select(F.col("length").alias("size"), F.array(member).alias("members"))
    finished = [full]
    while left:
        parts = -(-left // part_items)
        # rows that repeat are dealt out too
        dealt = items.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
        bins = written(dealt.select("part", "size", "members").groupBy("part").applyInPandas(_round(capacity), _ITEM).withColumn("at", F.monotonically_increasing_id()), "bins")
        small = F.col("size") <= capacity // 2
        n, least = bins.filter(small).agg(F.count(F.lit(1)), F.min("size")).first()
        if parts == 1 or n == 0:
            finished.append(bins.select("members"))
            break
        fits = F.col("size") <= capacity - least
        keyed = bins.withColumn("key", F.struct("size", "at"))
        last = keyed.filter(~small & fits).select("key").orderBy("key").limit(n).agg(F.max("key").alias("key")).first().key
        again = small if last is None else small | (F.col("key") <= F.struct(F.lit(last.size).alias("size"), F.lit(last["at"]).alias("at")))
        finished.append(keyed.filter(~again).select("members"))
        items = written(keyed.filter(again).select("size", "members"), "left")
        before, left = left, items.count()
        if left >= before:
            finished.append(items.select("members"))
            break
    sequences = finished[0]
    for more in finished[1:]:
        sequences = sequences.unionByName(more)
    sequences = sequences.select("members", F.monotonically_increasing_id().alias("sequence_id"))
    return sequences.mapInArrow(
        _placed, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
