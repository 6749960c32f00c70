"""BAM files as a Spark data source: read in splits, through their indexes on request, and written with indexes.

A split is a range of bytes of a file. Its task looks for the first block that starts there, then for the first record that starts in it:
a place from which a chain of plausible records goes on. It reads the records that start in blocks of its range. So the
union of all splits is the file, wherever they are cut. Files without block sizes (plain gzip) are one split.

Filters on ref and pos, and regions, are taken to the index beside a file (.bai or .csi), if there is one: only the index's chunks are
read, split in the same way. Records are decoded column by column in numpy, those that filters leave out not at all.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

#: Fixed values of the format: CIGAR operations and bases in code order, the largest place of the older index.
CIGAR_OPS, BAM_BASES, BAI_REACH = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", 1 << 29
FIELDS = "qname string, flag int, ref string, pos bigint, cigar string, query_len int, tags map<string,string>"
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 32 << 20, 1 << 18, 4 << 20
#: Records that must follow one another where a split's first record is looked for.
CHAIN = 16
MOST_REGIONS = 10_000
#: Tasks that a file is read in, at most: of more splits, neighbours are looked up one after the other in one task.
MOST_TASKS = 1024
END = 1 << 62

_HEAD = np.dtype([
    ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"),
    ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4"),
])
_PAIRS = np.frombuffer("".join(a + b for a in BAM_BASES for b in BAM_BASES).encode(), np.uint8).reshape(256, 2)
_KINDS = pa.schema([
    ("qname", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int64()), ("cigar", pa.string()), ("query_len", pa.int32()),
    ("tags", pa.map_(pa.string(), pa.string())), ("seq", pa.string()), ("qual", pa.string()),
])


def _opened(uri: str):
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


# Blocks


def _block_size(data: bytes, at: int) -> tuple[int, int] | None:
    """Bytes of the block that starts there and of its header; None if no block with a size does."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 12:
        return None
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    k = at + 12
    while k + 6 <= min(end, len(data)):
        name, n = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", data, k + 4)[0] + 1, end - at
        k += 4 + n
    return None


def _blocks(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of each block from the one that starts at `at` on."""
    stream.seek(at)
    data, base, k = b"", at, 0
    while True:
        while (size := _block_size(data, k)) is None or k + size[0] > len(data):
            more = stream.read(READ_BYTES)
            if not more and k == len(data):
                return
            if not more or size is None and len(data) - k > 1 << 17:
                raise ValueError("the BAM file is cut off or damaged")
            data, base, k = data[k:] + more, base + k, 0
        yield base + k, zlib.decompress(data[k + size[1] : k + size[0] - 8], -15)
        k += size[0]


def first_block(stream, at: int) -> int | None:
    """Place of the first block at or after `at`: two blocks, or the file's end, must follow one another from it."""
    if at == 0:
        return 0
    stream.seek(at)
    data = stream.read(5 << 16)
    ends = at + len(data) == stream.size()
    k = -1
    while (k := data.find(b"\x1f\x8b\x08\x04", k + 1)) >= 0:
        place, steps = k, 0
        while steps < 3 and place < len(data) and (size := _block_size(data, place)):
            place, steps = place + size[0], steps + 1
        if steps == 3 or steps and place == len(data) and ends:
            return at + k
    return None


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """The content of a gzip file without block sizes, as if it were one block."""
    stream.seek(0)
    inflate, data = zlib.decompressobj(31), b""
    while data := data or stream.read(1 << 20):
        piece = inflate.decompress(data)
        if piece:
            yield 0, piece
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            inflate = zlib.decompressobj(31)


class _Header:
    """Names and lengths of the references, and where the records start."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]) -> None:
        data, places = bytearray(), []  # places: where each block's content starts, and the block

        def need(n: int) -> None:
            while len(data) < n:
                if (block := next(blocks, None)) is None:
                    raise ValueError("the BAM file is cut off")
                places.append((len(data), block[0]))
                data.extend(block[1])

        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        need(at + 4)
        n, at = struct.unpack_from("<i", data, at)[0], at + 4
        self.names, self.lengths = [], []
        for _ in range(n):
            need(at + 4)
            size = struct.unpack_from("<i", data, at)[0]
            need(at + 8 + size)
            self.names.append(data[at + 4 : at + 3 + size].decode())
            self.lengths.append(struct.unpack_from("<i", data, at + 4 + size)[0])
            at += 8 + size
        self.rest = bytes(data[at:])  # the first records' bytes so far
        starts = [start for start, _ in places]
        k = bisect_right(starts, min(at, len(data) - 1)) - 1
        self.block, self.within = places[k][1], at - places[k][0]


# Records


def _plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Bytes of a record that may start there, 0 if none can, None if that can't be told yet."""
    if at + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    n = len(lengths)
    if not (-1 <= ref < n and -1 <= next_ref < n and pos >= -1 and next_pos >= -1 and l_name and l_seq >= 0) or (ref >= 0 and pos >= lengths[ref]):
        return 0
    if not 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size < 1 << 28:
        return 0
    if at + 36 + l_name > len(data):
        return None
    name = data[at + 36 : at + 36 + l_name]
    return 4 + size if name[-1] == 0 and all(32 < c < 127 for c in name[:-1]) else 0


def first_record(data: bytes, lengths: list[int], ended: bool) -> int | None:
    """Where the first chain of records starts; None if more data are needed (all data's end stands for no record)."""
    if len(data) < 36:
        return len(data) if ended else None
    raw, at = np.frombuffer(data, np.uint8), np.arange(len(data) - 35)
    for field in ("size", "ref", "pos", "next_ref", "next_pos", "l_seq"):  # all places at once, then one by one what is left
        low, high = {"size": (33, 1 << 28), "ref": (-1, len(lengths)), "next_ref": (-1, len(lengths)), "pos": (-1, 1 << 31), "next_pos": (-1, 1 << 31), "l_seq": (0, 1 << 28)}[field]
        k = at + (_HEAD.fields[field][1] + 4 if field != "size" else 0)
        value = (raw[k] | raw[k + 1].astype(np.int32) << 8 | raw[k + 2].astype(np.int32) << 16 | raw[k + 3].astype(np.int32) << 24).astype(np.int64)
        at = at[(value >= low) & (value < high)]
    for at in at.tolist():
        place, steps, n = at, 0, 1
        while steps < CHAIN and place < len(data) and (n := _plausible(data, place, lengths)):
            place, steps = place + n, steps + 1
        if steps == CHAIN or place == len(data) and ended:
            return at
        if not ended and (place >= len(data) or n is None):
            return None
    return len(data) if ended else None


def _records(stream, header: _Header, low: int, high: int, begin: int, end: int) -> Iterator[tuple[bytes, list[int]]]:
    """Data and the places in them of the records that start in blocks of [low, high), between the virtual places begin and end."""
    if begin >> 16 >= low:
        block, within = begin >> 16, begin & 0xFFFF
    else:
        block, within = first_block(stream, low), None
    if block is None or block >= high:
        return
    data, at, limit, source = bytearray(), within, None, _blocks(stream, block)

    def more() -> bool:
        """Takes one block; the limit is where what isn't asked for starts."""
        nonlocal limit
        if (got := next(source, None)) is None:
            return False
        if limit is None and (got[0] >= high or got[0] >= end >> 16):
            limit = len(data) + (end & 0xFFFF if got[0] == end >> 16 and got[0] < high else 0)
        data.extend(got[1])
        return True

    enough = 1 << 15  # a block, mostly
    while at is None:
        ended = not more()
        if ended or len(data) >= enough:
            at, enough = first_record(bytes(data), header.lengths, ended), 2 * enough
    while limit is None or at < limit:
        while len(data) < BATCH_BYTES and limit is None and more():
            pass
        places, whole = [], bytes(data)
        while at + 4 <= len(whole) and (limit is None or at < limit) and at + (size := struct.unpack_from("<i", whole, at)[0] + 4) <= len(whole):
            places.append(at)
            at += size
        if places:
            yield whole, places
        else:  # a record goes on beyond the data
            twice = 2 * len(data)
            if not more():
                if at < min(len(whole), limit or END):
                    raise ValueError("the BAM file is cut off")
                return
            while len(data) < twice and more():
                pass
        del data[:at]
        limit, at = None if limit is None else limit - at, 0


def _gathered(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all slices one after another, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return raw[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def _strings(values: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    valid = None if known is None else pa.array(known).buffers()[1]
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values)), valid)


def bam_tags(data: bytes) -> list[tuple[str, str]]:
    sizes, at, out = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}, 0, {}
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            form, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{sizes[form]}", data, at + 5)
            out[name] = ",".join(map(str, (form, *values)))
            at += 5 + struct.calcsize(f"<{n}{sizes[form]}")
        else:
            value = struct.unpack_from(f"<{sizes[kind]}", data, at)[0]
            out[name] = value.decode() if isinstance(value, bytes) else str(value)
            at += struct.calcsize(f"<{sizes[kind]}")
    return list(out.items())


def _each(data: bytes, starts: np.ndarray, ends: np.ndarray, read) -> list:
    """read() of each slice of data; equal slices are read once."""
    known: dict[bytes, object] = {}
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        piece = data[a:b]
        if piece not in known:
            known[piece] = read(piece)
        out.append(known[piece])
    return out


def _cigar(ops: bytes) -> str | None:
    return "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x, in struct.iter_unpack("<I", ops)) or None


def _span(ops: bytes) -> int:
    """Bases of the reference that an alignment covers, 1 at least."""
    return sum(x >> 4 for x, in struct.iter_unpack("<I", ops) if CIGAR_OPS[x & 15] in "MDN=X") or 1


class Wanted:
    """What filters ask for: names of references, a range of positions [low, high), regions that reads overlap; None is anything."""

    def __init__(self) -> None:
        self.refs: set[str] | None = None
        self.low, self.high = -END, END
        self.regions: dict[str, list[tuple[int, int]]] | None = None

    def add(self, f: Filter) -> None:
        if isinstance(f, EqualTo | In) and f.attribute == ("ref",):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.refs = names if self.refs is None else self.refs & names
        elif isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("pos",):
            if not isinstance(f, LessThan | LessThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))

    def narrow(self) -> bool:
        return self.refs is not None or self.regions is not None

    def spans(self, header: _Header) -> Iterator[tuple[int, int, int]]:
        """Reference, start and end of all that reads may be wanted of."""
        for k, name in enumerate(header.names):
            if self.refs is None or name in self.refs:
                for a, b in self.regions.get(name, []) if self.regions is not None else [(0, header.lengths[k])]:
                    if self.regions is None:
                        a, b = max(a, self.low), min(b, self.high)
                    if a < b:
                        yield k, max(a, 0), b

    def accepts(self, head: np.ndarray, data: bytes, at: np.ndarray, names: list[str]) -> np.ndarray:
        ok = np.ones(len(head), bool)
        if self.low > -END or self.high < END:
            ok &= (head["pos"] >= max(self.low, 0)) & (head["pos"] < self.high)
        if self.refs is not None:
            ok &= np.isin(head["ref"], [k for k, n in enumerate(names) if n in self.refs])
        if self.regions is not None:
            ops = at + 32 + head["l_name"]
            rows = np.nonzero(ok & (head["ref"] >= 0))[0]
            ends = head["pos"][rows] + np.array(_each(data, ops[rows], (ops + 4 * head["n_cigar"].astype(np.int64))[rows], _span), np.int64)
            ok[:] = False
            for ref in np.unique(head["ref"][rows]).tolist():
                own = head["ref"][rows] == ref
                spans = self.regions.get(names[ref], [])
                if spans:  # in order and apart: the last one that starts before a read's end is the one to look at
                    starts, stops = np.array(spans).T
                    k = np.searchsorted(starts, ends[own], "left") - 1
                    ok[rows[own]] = (k >= 0) & (stops[np.maximum(k, 0)] > head["pos"][rows][own])
        return ok


def batch(data: bytes, places: list[int], header: _Header, wanted: Wanted) -> pa.RecordBatch | None:
    """The wanted ones of the records at these places."""
    raw = np.frombuffer(data, np.uint8)
    at = np.array(places, np.int64) + 4
    ends = at + raw[at[:, None] + np.arange(-4, 0)].copy().view("<i4")[:, 0]
    head = raw[at[:, None] + np.arange(32)].copy().view(_HEAD)[:, 0]
    ok = wanted.accepts(head, data, at, header.names)
    if not ok.all():
        at, ends, head = at[ok], ends[ok], head[ok]
    if not len(at):
        return None
    l_name, l_seq, n_ops = (head[c].astype(np.int64) for c in ("l_name", "l_seq", "n_cigar"))
    ops = at + 32 + l_name
    bases = ops + 4 * n_ops
    quals = bases + (l_seq + 1) // 2
    packed, starts = _gathered(raw, bases, (l_seq + 1) // 2)
    letters, seq_at = _gathered(_PAIRS[packed].ravel(), 2 * starts[:-1], l_seq)
    scores, _ = _gathered(raw, quals, l_seq)
    scored = l_seq > 0
    scored[scored] = raw[quals[scored]] != 255
    shown, qual_at = _gathered(scores, seq_at[:-1], np.where(scored, l_seq, 0))
    names = pa.array([*header.names, None], pa.string())
    refs = names.take(pa.array(np.where(head["ref"] >= 0, head["ref"], len(header.names))))
    return pa.RecordBatch.from_arrays(
        [
            _strings(*_gathered(raw, at + 32, l_name - 1)),
            pa.array(head["flag"].astype(np.int32)),
            refs,
            pa.array(head["pos"].astype(np.int64), mask=head["pos"] < 0),
            pa.array(_each(data, ops, bases, _cigar), pa.string()),
            pa.array(l_seq.astype(np.int32), mask=l_seq == 0),
            pa.array(_each(data, quals + l_seq, ends, bam_tags), _KINDS.field("tags").type),
            _strings(letters, seq_at, l_seq > 0),
            _strings(shown + np.uint8(33), qual_at, scored),
        ],
        schema=_KINDS,
    )


# Indexes


def _depth(length: int) -> int:
    """Levels below the root that bins of 2^14 bases need to reach a length."""
    return max(5, -(-max(0, (length - 1).bit_length() - 14) // 3))


def bin_of(start: int, end: int, depth: int = 5) -> int:
    """The smallest bin of the levels (8 to one, the smallest of 2^14 bases) that holds start .. end - 1."""
    for level in range(depth, -1, -1):
        shift = 14 + 3 * (depth - level)
        if start >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int, depth: int, smallest: int = 14) -> Iterator[range]:
    """Of each level, the bins that start .. end - 1 touches."""
    for level in range(depth + 1):
        shift = smallest + 3 * (depth - level)
        first = ((1 << 3 * level) - 1) // 7
        yield range(first + (start >> shift), first + (end - 1 >> shift) + 1)


class Index:
    """Chunks of virtual places by reference and bin, and the least place of what reaches a stretch of a reference."""

    def __init__(self, smallest: int = 14, depth: int = 5) -> None:
        self.smallest, self.depth = smallest, depth
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.least: list[dict[int, int]] = []

    @classmethod
    def read(cls, data: bytes) -> Index:
        """From the bytes of a .bai or .csi file."""
        if data[:2] == b"\x1f\x8b":
            data = b"".join(piece for _, piece in _members(pa.BufferReader(data)))
        csi = data[:4] == b"CSI\1"
        if not csi and data[:4] != b"BAI\1":
            raise ValueError("not an index of BAM files")
        index, at = cls(*struct.unpack_from("<ii", data, 4)) if csi else cls(), 4
        if csi:
            at = 16 + struct.unpack_from("<i", data, 12)[0]
        most = ((1 << 3 * (index.depth + 1)) - 1) // 7
        n_refs, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(n_refs):
            bins, least = {}, {}
            n_bins, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n_bins):
                number, at = struct.unpack_from("<I", data, at)[0], at + 4
                if csi:
                    least[number], at = struct.unpack_from("<Q", data, at)[0], at + 8
                n, at = struct.unpack_from("<i", data, at)[0], at + 4
                pairs = struct.unpack_from(f"<{2 * n}Q", data, at)
                at += 16 * n
                if number < most:  # one beyond holds statistics
                    bins[number] = list(zip(pairs[::2], pairs[1::2], strict=True))
            if not csi:
                n, at = struct.unpack_from("<i", data, at)[0], at + 4
                first = ((1 << 3 * index.depth) - 1) // 7
                least = {first + k: v for k, v in enumerate(struct.unpack_from(f"<{n}Q", data, at))}
                at += 8 * n
            index.bins.append(bins)
            index.least.append(least)
        return index

    def chunks(self, spans: Iterator[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Ranges of virtual places, apart and in order, that hold all records over any of the spans."""
        found = []
        for ref, start, end in spans:
            if ref >= len(self.bins):
                continue
            end = min(end, 1 << self.smallest + 3 * self.depth)
            if start >= end:
                continue
            bins, least = self.bins[ref], 0
            at = ((1 << 3 * self.depth) - 1) // 7 + (start >> self.smallest)
            while at and at not in self.least[ref]:
                at = (at - 1) >> 3
            least = self.least[ref].get(at, 0)
            fine = sorted(k for k in bins if k >= ((1 << 3 * self.depth) - 1) // 7)
            after = bisect_right(fine, ((1 << 3 * self.depth) - 1) // 7 + (end - 1 >> self.smallest))
            most = bins[fine[after]][0][0] if after < len(fine) else END  # where the first bin begins that lies behind
            for over in bins_over(start, end, self.depth, self.smallest):
                numbers = over if len(over) < len(bins) else [b for b in bins if b in over]
                found += [(a, min(b, most)) for k in numbers for a, b in bins.get(k, ()) if b > least and a < most]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out


class _IndexWriter:
    """Takes records in order; places are bytes of the uncompressed file until the blocks are known."""

    def __init__(self, refs: list[tuple[str, int]]) -> None:
        self.csi = any(size > BAI_REACH for _, size in refs)
        self.depth = _depth(max((size for _, size in refs), default=0))
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in refs]
        self.least: list[dict[int, int]] = [{} for _ in refs]
        self.last, self.sorted = (-1, -1), True

    def add(self, ref: int, pos: int, end: int, start: int, stop: int) -> None:
        place = (ref if ref >= 0 else END, pos)
        self.sorted &= place >= self.last
        self.last = place
        if not self.sorted or ref < 0 or pos < 0:
            return
        chunks = self.bins[ref].setdefault(bin_of(pos, end, self.depth), [])
        if chunks and chunks[-1][1] == start:
            chunks[-1][1] = stop
        else:
            chunks.append([start, stop])
        for k in range(pos >> 14, (end - 1 >> 14) + 1):
            self.least[ref].setdefault(k, start)

    def written(self, virtual) -> bytes:
        """The file's bytes; virtual() gives the virtual place of a place in the uncompressed file."""
        out = b"CSI\1" + struct.pack("<iii", 14, self.depth, 0) if self.csi else b"BAI\1"
        out += struct.pack("<i", len(self.bins))
        for bins, least in zip(self.bins, self.least, strict=True):
            stretches, held = [], 0
            for k in range(max(least, default=-1) + 1):
                held = virtual(least[k]) if k in least else held
                stretches.append(held)
            out += struct.pack("<i", len(bins))
            for number, chunks in sorted(bins.items()):
                out += struct.pack("<I", number)
                if self.csi:
                    level, at = self.depth, number
                    while at < ((1 << 3 * level) - 1) // 7:
                        level -= 1
                    start = (at - ((1 << 3 * level) - 1) // 7) << 3 * (self.depth - level)
                    out += struct.pack("<Q", stretches[start] if start < len(stretches) else 0)
                out += struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", virtual(a), virtual(b)) for a, b in chunks)
            if not self.csi:
                out += struct.pack("<i", len(stretches)) + struct.pack(f"<{len(stretches)}Q", *stretches)
        return b"".join(_bgzf(out[k : k + 65280]) for k in range(0, len(out), 65280)) + _bgzf(b"") if self.csi else out


# Writing


def _bgzf(data: bytes) -> bytes:
    """One block: a gzip member whose extra field has its size."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Codes(dict):
    """Bases to hexadecimal digits, for str.translate."""

    def __missing__(self, base: int):
        raise ValueError(f"not a base of BAM: {chr(base)}")


_CODES = _Codes({ord(c): f"{k:x}" for k, c in enumerate(BAM_BASES)})
_WHOLE = re.compile("-?[0-9]{1,9}")


@lru_cache(10_000)
def _cigar_of(text: str) -> tuple[int, bytes, int]:
    """Operations of a CIGAR, their binary form, and the bases of the reference that they use."""
    ops = [(int(n), CIGAR_OPS.index(k)) for n, k in re.findall("([0-9]+)([A-Z=])", text)]
    return len(ops), b"".join(struct.pack("<I", n << 4 | k) for n, k in ops if len(ops) <= 65535), sum(n for n, k in ops if CIGAR_OPS[k] in "MDN=X")


def bam_record(row, numbers: dict[str, int]) -> tuple[bytes, int, int, int]:
    """One alignment (a row of FIELDS with seq and qual) in the binary form, its reference's number, start and end."""
    name = row["qname"].encode() + b"\0"
    seq, quals = ("" if row[c] in (None, "*") else row[c] for c in ("seq", "qual"))  # a star is SAM's for none
    n_cigar, cigar, span = _cigar_of(row["cigar"] or "")
    if len(name) > 255 or n_cigar > 65535:
        raise ValueError(f"too long for BAM: {row['qname']}")
    if quals and len(quals) != len(seq):
        raise ValueError(f"{len(quals)} qualities of {len(seq)} bases: {row['qname']}")
    ref = -1 if row["ref"] is None else numbers[row["ref"]]
    pos = -1 if row["pos"] is None else row["pos"]
    span = span or 1
    codes = bytes.fromhex(seq.upper().translate(_CODES) + "0" * (len(seq) % 2))
    qual = bytes(ord(c) - 33 for c in quals) if quals else b"\xff" * len(seq)
    number = bin_of(pos, pos + span) & 0xFFFF if pos >= 0 else 4680
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), 255, number, n_cigar, row["flag"], len(seq), -1, -1, 0)
    body += name + cigar + codes + qual
    for tag, value in sorted((row["tags"] or {}).items()):
        whole = _WHOLE.fullmatch(value)
        body += tag.encode() + (b"i" + struct.pack("<i", int(value)) if whole else b"Z" + value.encode() + b"\0")
    return struct.pack("<i", len(body)) + body, ref, pos, pos + span


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _BamWriter(DataSourceWriter):
    """One file for each task, under a name that readers pass over until all tasks have ended; an index beside it if its rows are in order."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.refs = options["path"], json.loads(options["refs"])

    def write(self, iterator) -> WriterCommitMessage:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        files.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bam"
        numbers = {n: i for i, (n, _) in enumerate(self.refs)}
        text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in self.refs).encode()
        data = bytearray(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.refs)))
        for n, size in self.refs:
            data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
        index, blocks, at, held = _IndexWriter(self.refs), [], 0, len(data)
        with files.open_output_stream(f"{base}/{name}.unfinished", compression=None) as out:

            def put(block: bytes) -> None:
                nonlocal at
                blocks.append(at)
                at += len(block)
                out.write(block)

            for row in iterator:
                record, ref, pos, end = bam_record(row, numbers)
                index.add(ref, pos, end, held, held + len(record))
                held += len(record)
                data += record
                while len(data) >= 65280:
                    put(_bgzf(bytes(data[:65280])))
                    del data[:65280]
            while data:
                put(_bgzf(bytes(data[:65280])))
                del data[:65280]
            put(_bgzf(b""))  # the mark of the end
        names = [name]
        if index.sorted:
            names.append(f"{name}.{'csi' if index.csi else 'bai'}")
            with files.open_output_stream(f"{base}/{names[1]}.unfinished", compression=None) as out:
                out.write(index.written(lambda place: blocks[place // 65280] << 16 | place % 65280))
        return _Written(names)

    def commit(self, messages) -> None:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        for name in reversed([n for m in messages if m for n in m.names]):  # an index before its file
            files.move(f"{base}/{name}.unfinished", f"{base}/{name}")

    def abort(self, messages) -> None:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        for name in [n for m in messages if m for n in m.names]:
            files.delete_file(f"{base}/{name}.unfinished")


# The source


class Split(InputPartition):
    """Pieces of a file: blocks [low, high) between the virtual places begin and end."""

    def __init__(self, path: str, pieces: list[tuple[int, int, int, int]]) -> None:
        self.path, self.pieces = path, pieces


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.wanted = Wanted()
        if "regions" in options:
            self.wanted.regions = {}
            for ref, a, b in sorted(map(tuple, json.loads(options["regions"]))):
                spans = self.wanted.regions.setdefault(ref, [])
                if spans and a <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(b, spans[-1][1])
                elif a < b:
                    spans.append((a, b))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        """Filters narrow what is read; Spark still applies them all."""
        for f in filters:
            self.wanted.add(f)
            yield f

    def partitions(self) -> list[InputPartition]:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(base)
        if info.type == pyarrow.fs.FileType.File:
            found = [(self.path, info.size)]
            beside = {f.base_name for f in files.get_file_info([f"{base}.{e}" for e in ("bai", "csi")]) if f.type == pyarrow.fs.FileType.File}
        else:
            listed = files.get_file_info(pyarrow.fs.FileSelector(base))
            found = [(f"{self.path.rstrip('/')}/{f.base_name}", f.size) for f in listed if f.base_name.endswith(".bam")]
            beside = {f.base_name for f in listed}
        with ThreadPoolExecutor(16) as pool:
            return [s for own in pool.map(lambda f: self._splits(*f, beside), found) for s in own]

    def _splits(self, path: str, size: int, beside: set[str]) -> list[InputPartition]:
        """A file's splits; those that its index can rule out are left out."""
        whole = lambda low, high: ((a, min(a + self.split, high)) for a in range(low, high, self.split))
        kind = next((e for e in ("bai", "csi") if f"{path.rpartition('/')[2]}.{e}" in beside), None)
        if not self.wanted.narrow() or kind is None:
            cuts = [(a, b, 0, END) for a, b in whole(0, size)]
            each = -(-len(cuts) // MOST_TASKS) or 1
            return [Split(path, cuts[k : k + each]) for k in range(0, len(cuts), each)]
        with _opened(f"{path}.{kind}") as stream:
            index = Index.read(stream.read())
        with _opened(path) as stream:
            header = _Header(_blocks(stream, 0))
        chunks = index.chunks(self.wanted.spans(header))
        out, held = [], 0
        for begin, end in chunks:
            for a, b in whole(begin >> 16, min(size, (end >> 16) + 1)):
                if not out or held + b - a > self.split:
                    out.append(Split(path, []))
                    held = 0
                out[-1].pieces.append((a, b, begin, end))
                held += b - a
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as stream:
            if _block_size(stream.read(64), 0) is None:
                if any(low == 0 for low, *_ in partition.pieces):
                    yield from self._unsplit(stream)
                return
            header = _Header(_blocks(stream, 0))
            for low, high, begin, end in partition.pieces:
                if high > header.block:
                    first = max(begin, header.block << 16 | header.within)
                    for data, places in _records(stream, header, max(low, header.block), high, first, end):
                        if (found := batch(data, places, header, self.wanted)) is not None:
                            yield found

    def _unsplit(self, stream) -> Iterator[pa.RecordBatch]:
        source = _members(stream)
        header = _Header(source)
        data = header.rest
        while True:
            at, places = 0, []
            while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
                places.append(at)
                at += 4 + size
            if places and (found := batch(data, places, header, self.wanted)) is not None:
                yield found
            more = next(source, None)
            if more is None:
                if at < len(data):
                    raise ValueError("the BAM file is cut off")
                return
            data = data[at:] + more[1]


class BamSource(DataSource):
    """format("bam") on any file system that pyarrow knows; options: splitBytes, regions (JSON of ref, start, end), refs (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return f"{FIELDS}, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return BamReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BamWriter(self.options)
