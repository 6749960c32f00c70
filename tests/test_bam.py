"""BAM files in splits and through indexes."""

import gzip
import io
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from translatome.sources import alignments, bam

REFS = [("c1", 200_000), ("c2", 1_000_000), ("c3", 50)]


def records(n, seed=1, longest=300):
    """Rows in order of their place, some without one, some longer than a block."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        ref, length = draw.choice(REFS[:2])
        size = 0 if k % 11 == 0 else draw.choice([1, 7, 30, longest])
        cigar = draw.choice([f"{size}M", f"{size}M100N5M", f"2S{size}M3I9D"]) if size else None
        qual = None if k % 3 else "".join(chr(43 + draw.randrange(30)) for _ in range(size)) or None
        seq = "".join(draw.choice("ACGTN") for _ in range(size)) or None
        row = {"qname": f"q{k}", "flag": 16 * (k % 2), "ref": ref, "pos": draw.randrange(length - 1), "cigar": cigar, "seq": seq, "qual": qual}
        if k % 17 == 0:
            row |= {"ref": None, "pos": None, "flag": 4}
        rows.append(row | {"query_len": size or None, "tags": {"NH": str(1 + k % 3), "ZT": "x" * (k % 5)}})
    names = [r for r, _ in REFS]
    return sorted(rows, key=lambda r: (r["ref"] is None, names.index(r["ref"]) if r["ref"] else 0, r["pos"] or 0))


def write(rows, path, refs=REFS, block=65280):
    """A BAM file with its index; blocks of `block` bytes."""
    writer = bam._BamWriter({"path": f"file://{path}", "refs": json.dumps(refs)})
    old = bam._bgzf
    try:
        if block != 65280:  # cut smaller blocks than the writer does
            bam._bgzf = lambda data: b"".join(old(data[k : k + block]) for k in range(0, len(data), block)) or old(b"")
        writer.commit([writer.write(iter(rows))])
    finally:
        bam._bgzf = old
    return next(path.glob("*.bam"))


def read(path, split, filters=(), **options):
    reader = bam.BamReader({"path": f"file://{path}", "splitbytes": str(split), **options})
    list(reader.pushFilters(list(filters)))
    parts = reader.partitions()
    return parts, [r for p in parts for b in reader.read(p) for r in b.to_pylist()]


def plain(rows):
    return [r | {"tags": sorted(r["tags"].items())} for r in rows]


@pytest.mark.parametrize(("n", "longest", "block"), [(3000, 300, 65280), (400, 300, 500), (60, 90_000, 65280), (12, 200_000, 9000), (1, 5, 65280), (0, 5, 65280)])
def test_union_of_splits(tmp_path, n, longest, block):
    rows = records(n, n, longest)
    path = write(rows, tmp_path, block=block)
    size = path.stat().st_size
    want = plain(rows)
    for split in sorted({size, size // 2 + 1, size // 7 + 1, 70_001, 20_000, 5000, max(200, size // 50)}):
        parts, got = read(path, split)
        assert len(parts) == -(-size // split)
        assert plain([r | {"tags": dict(r["tags"])} for r in got]) == want, split


def test_long_header(tmp_path):
    refs = REFS + [(f"contig{k}", 1000 + k) for k in range(20_000)]
    rows = records(500)
    path = write(rows, tmp_path, refs)
    for split in (3000, 50_000, 10**7):
        assert [r["qname"] for r in read(path, split)[1]] == [r["qname"] for r in rows]


def test_cut_off(tmp_path):
    path = write(records(500), tmp_path)
    data = path.read_bytes()
    path.write_bytes(data[: len(data) * 2 // 3])
    with pytest.raises(ValueError, match="cut off"):
        read(path, 10**9)


@pytest.mark.parametrize("refs", [REFS, [("c1", 200_000), ("c2", (1 << 29) + 5), ("c3", 50)]], ids=["bai", "csi"])
def test_filters_by_index(tmp_path, monkeypatch, refs):
    rows = records(80_000, 3, 100)
    path = write(rows, tmp_path, refs)
    assert {p.suffix for p in tmp_path.iterdir()} == {".bam", ".csi" if refs is not REFS else ".bai"}
    taken = []

    class Counted(io.BytesIO):
        def __init__(self, data):
            super().__init__(data)
            self.total = len(data)

        def size(self):
            return self.total

        def read(self, n=-1):
            out = super().read(n)
            taken.append(len(out))
            return out

    monkeypatch.setattr(bam, "READ_BYTES", 1 << 15)
    monkeypatch.setattr(bam, "_opened", lambda uri: Counted(open(uri.removeprefix("file://"), "rb").read()))
    whole = path.stat().st_size
    for low, high in ((0, 200_000), (5000, 5600), (100_000, 130_000), (199_990, 10**7)):
        taken.clear()
        got = read(path, 10**6, [In(("ref",), ("c2", "none")), GreaterThanOrEqual(("pos",), low), LessThan(("pos",), high)])[1]
        assert [r["qname"] for r in got] == [r["qname"] for r in rows if r["ref"] == "c2" and low <= r["pos"] < high]
        if high - low < 50_000:
            assert sum(taken) < whole / 4
    assert not read(path, 10**6, [EqualTo(("ref",), "c3")])[1] and not read(path, 10**6, [EqualTo(("ref",), "none")])[0]


def overlaps(row, regions):
    """A read covers its bases and what its alignment skips, 1 base at least."""
    import re

    span = sum(int(n) for n, k in re.findall("([0-9]+)([MDN=X])", row["cigar"] or "")) or 1
    return row["ref"] is not None and any(row["ref"] == r and row["pos"] < b and row["pos"] + span > a for r, a, b in regions)


@pytest.mark.parametrize("split", [3000, 10**7])
def test_regions(tmp_path, split):
    rows = records(8000, 5)
    path = write(rows, tmp_path)
    regions = [("c1", 100, 900), ("c1", 850, 2000), ("c1", 150_000, 150_001), ("c2", 999_000, 10**6), ("c3", 0, 50), ("gone", 0, 9)]
    want = [r["qname"] for r in rows if overlaps(r, regions)]
    got = [r["qname"] for r in read(path, split, regions=json.dumps(regions))[1]]
    assert sorted(got) == sorted(want) and want
    path.with_name(path.name + ".bai").unlink()  # without an index everything is read, and the same is found
    assert [r["qname"] for r in read(path, split, regions=json.dumps(regions))[1]] == want


def test_bins():
    """The six levels of the older index, and those of longer references."""
    assert [bam.bin_of(0, 1), bam.bin_of(16383, 16385), bam.bin_of(0, 1 << 29), bam.bin_of((1 << 29) - 1, 1 << 29)] == [4681, 585, 0, 37448]
    draw = random.Random(2)
    for depth in (5, 6, 7):
        assert bam._depth(1 << 14 + 3 * depth) == depth
        for _ in range(500):
            a = draw.randrange(1 << 14 + 3 * depth)
            b = min(1 << 14 + 3 * depth, a + draw.choice([1, 50, 20_000, 10**7]))
            at, size = sorted((draw.randrange(a, b), draw.randrange(a, b)))
            assert any(bam.bin_of(at, size + 1, depth) in r for r in bam.bins_over(a, b, depth))


def test_unsorted_has_no_index(tmp_path):
    path = write(records(50)[::-1], tmp_path)
    assert list(tmp_path.iterdir()) == [path]
    assert len(read(path, 10**6, [EqualTo(("ref",), "c1")])[1]) == sum(r["ref"] == "c1" for r in records(50))


def test_plain_gzip(tmp_path):
    rows = records(200)
    path = write(rows, tmp_path)
    data = gzip.decompress(path.read_bytes())
    path.with_name(path.name + ".bai").unlink()
    path.write_bytes(gzip.compress(data[:700]) + gzip.compress(data[700:]))
    assert [r["qname"] for r in read(path, 100)[1]] == [r["qname"] for r in rows]


def test_in_spark(spark, tmp_path):
    """Filters of a DataFrame reach the index of every file; what they leave is the same as without one."""
    schema = "qname string, flag int, ref string, pos bigint, cigar string, query_len int, tags map<string,string>, seq string, qual string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in records(3000)], schema)
    out = f"file://{tmp_path}/bam"
    alignments.write_bam(df.repartition(3), REFS, out, ordered=True)
    assert len(list((tmp_path / "bam").glob("*.bai"))) == len(list((tmp_path / "bam").glob("*.bam")))
    near = (F.col("ref") == "c2") & F.col("pos").between(1000, 90_000)
    columns = ["qname", "flag", "ref", "pos", "cigar", "query_len", "tags", "seq", "qual"]
    found = alignments.read_bam(spark, out, 4000).filter(near)
    assert found.select(*columns).orderBy("qname").collect() == df.filter(near).select(*columns).orderBy("qname").collect()
    assert alignments.read_bam(spark, out, 4000).rdd.getNumPartitions() > found.rdd.getNumPartitions()
    regions = [("c1", 500, 600), ("c2", 7000, 9000)]
    want = {r["qname"] for r in records(3000) if overlaps(r, [(r, a - 100, b + 100) for r, a, b in regions])}
    assert {r.qname for r in alignments.read_bam_regions(spark, out, regions, 100).collect()} == want
    with pytest.raises(ValueError, match="join"):
        alignments.read_bam_regions(spark, out, [("c1", 0, 1)] * (bam.MOST_REGIONS + 1))


def test_tags_of_every_kind():
    data = b"AAAx" + b"CCc\xff" + b"SSS\x01\x00" + b"FFf" + struct.pack("<f", 0.5) + b"HHH0A\0" + b"BBBs" + struct.pack("<ihh", 2, -1, 5)
    assert dict(bam.bam_tags(data)) == {"AA": "x", "CC": "-1", "SS": "1", "FF": "0.5", "HH": "0A", "BB": "s,-1,5"}


def test_many_splits_share_tasks(monkeypatch):
    """However small the splits are, a file is read in MOST_TASKS tasks at most, and each split is in one of them."""
    monkeypatch.setattr(bam, "MOST_TASKS", 8)
    for size in (0, 1, 799, 800, 801, 12_345):
        tasks = bam.BamReader({"path": "file:/x.bam", "splitbytes": "100"})._splits("file:/x.bam", size, set())
        assert len(tasks) <= 8 and [p for t in tasks for p in t.pieces] == [(a, min(a + 100, size), 0, bam.END) for a in range(0, size, 100)]


def test_bases_outside_the_code_are_an_error():
    row = dict(qname="r", flag=0, ref="a", pos=1, cigar="3M", tags=None, seq="AcN", qual=None)
    assert bytes([0x12, 0xF0, 255, 255, 255]) == bam.bam_record(row, {"a": 0})[0][-5:]
    with pytest.raises(ValueError):
        bam.bam_record(row | {"seq": "A1E"}, {"a": 0})
