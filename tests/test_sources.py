"""Readers and writers on tiny files."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from translatome.sources import alignments, annotations, reads, tables
from translatome.sources.bam import bin_of


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


SAM = "@SQ\tSN:c1\tLN:100\n@SQ\tSN:c2\tLN:50\nr1\t0\tc1\t11\t255\t2S5M10N3M1I2D4M\t*\t0\t0\tACGTACGTACGTACG\t*\tNH:i:1\tNM:i:0\nr2\t16\tc2\t1\t255\t4M\t*\t0\t0\tACGT\tIIII\tNH:i:2\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", SAM)
    df = alignments.read_sam(spark, path).orderBy("qname")
    a, b, c = df.collect()
    assert (a.ref, a.pos, a.strand, a.nh, a.nm, a.len) == ("c1", 10, "+", 1, 0, 15)
    assert [tuple(x) for x in a.blocks] == [(10, 5), (25, 9)]
    assert (b.pos, b.strand, b.nh, b.nm) == (0, "-", 2, None) and [tuple(x) for x in b.blocks] == [(0, 4)]
    assert (c.ref, c.pos, c.blocks) == (None, None, None)
    assert [tuple(r) for r in alignments.read_sam_header(spark, path).orderBy("tid").collect()] == [(0, "c1", 100), (1, "c2", 50)]
    out = str(tmp_path / "out")
    alignments.write_sam(df, out)
    again = alignments.read_sam(spark, out).select("qname", "ref", "pos", "cigar", "tags").orderBy("qname").collect()
    assert again == df.select("qname", "ref", "pos", "cigar", "tags").collect()


def bam(records):
    data = b"BAM\1" + struct.pack("<i", 3) + b"@x\n" + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)
    for name, flag, pos, ops, seq, nh in records:
        packed = bytes(("=ACMGRSVTWYHKDBN".index(seq[i]) << 4) | ("=ACMGRSVTWYHKDBN".index(seq[i + 1]) if i + 1 < len(seq) else 0) for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 255, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(k)) for n, k in ops) + packed + bytes([30] * len(seq)) + b"NHC" + bytes([nh])
        data += struct.pack("<i", len(body)) + body
    return data


def test_bam(spark, tmp_path):
    data = bam([("q1", 0, 10, [(5, "M"), (10, "N"), (3, "M")], "ACGTACGT", 1), ("q2", 16, 40, [(3, "M")], "ACG", 2)])
    half = len(data) // 2
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:half]) + gzip.compress(data[half:]) + gzip.compress(b""))
    for uri in (f"file://{tmp_path}/x.bam", f"file://{tmp_path}"):
        a, b = alignments.read_bam(spark, uri).orderBy("qname").collect()
        assert (a.qname, a.ref, a.pos, a.cigar, a.seq, a.qual, a.nh) == ("q1", "c1", 10, "5M10N3M", "ACGTACGT", "????????", 1)
        assert [tuple(x) for x in a.blocks] == [(10, 5), (25, 3)] and (b.strand, b.seq, b.nh) == ("-", "ACG", 2)


BED = "c1\t0\t30\tt1\t0\t+\t5\t25\t0\t2\t10,10,\t0,20,\nc1\t100\t200\tt2\t0\t-\t120\t150\t0\t1\t100\t0\nc2\t0\t9\tt3\t0\t+\t0\t0\t0\t1\t9\t0\n"


def test_bed(spark, tmp_path):
    df = annotations.read_transcripts(spark, put(tmp_path, "a.bed", BED)).orderBy("trx_id")
    a, b, c = df.collect()
    assert [tuple(x) for x in a.blocks] == [(0, 10), (20, 10)] and (a.cds_start, a.cds_len) == (5, 10)
    assert (b.cds_start, b.cds_len) == (50, 30) and (c.cds_start, c.cds_len) == (None, None)
    annotations.write_bed12(df, str(tmp_path / "o"))
    assert annotations.read_transcripts(spark, str(tmp_path / "o")).orderBy("trx_id").collect() == df.collect()
    assert annotations.find_transcript(df, "t2").count() == 1
    with pytest.raises(ValueError, match="0 transcripts"):
        annotations.find_transcript(df, "t9")


def test_bedpe(spark, tmp_path):
    text = "c\t1\t5\tc\t9\t12\tn\t0\t+\t-\nc\t9\t5\tc\t9\t12\tn\t0\t+\t-\nbad line\n"
    good, bad = annotations.read_bedpe(spark, put(tmp_path, "p", text))
    assert good.count() == 1 and bad.count() == 2


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i} x\n{'ACGT' * 5}\n+\n{'@III' * 5}\n" for i in range(300))
    path = put(tmp_path, "a.fastq", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = reads.read_fastq(spark, path)
        assert df.select("file", "ord").distinct().count() == df.count() == 300
        assert [r.name for r in df.orderBy("ord").collect()] == [f"r{i} x" for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    reads.write_fastq_by_sample(df.withColumn("fate", F.when(F.col("ord") % 2 == 0, "a").otherwise("b")), str(tmp_path / "out"))
    assert reads.read_fastq(spark, str(tmp_path / "out" / "fate=a")).count() == 150
    with pytest.raises(Exception, match="not a FASTQ record"):
        reads.read_fastq(spark, put(tmp_path, "b.fastq", "@r\nACGT\n+\n")).collect()


def test_fasta(spark, tmp_path):
    df = reads.read_fasta(spark, put(tmp_path, "a.fa", ">c1 some\nACGT\nacgt\n>c2\nTT\n"))
    assert {r.ref: r.seq for r in df.collect()} == {"c1": "ACGTACGT", "c2": "TT"}
    blocks = F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(n).cast("bigint").alias("len")) for a, n in ((0, 2), (4, 3))])
    row = df.filter("ref = 'c1'").select(reads.spliced(F.col("seq"), blocks, F.lit("+")), reads.spliced(F.col("seq"), blocks, F.lit("-")), *[reads.padded(F.col("seq"), F.lit(a), F.lit(b)) for a, b in ((-2, 1), (6, 9), (-5, -3), (9, 11), (2, 4))]).collect()[0]
    assert tuple(row) == ("ACACG", "CGTGT", "NNAC", "GTNN", "NNN", "NNN", "GTA")


def test_tables(spark, tmp_path):
    assert [tuple(r) for r in tables.read_asites(spark, put(tmp_path, "s", "28 14\n29\t-3\n")).orderBy("read_len").collect()] == [(28, 14), (29, -3)]
    with pytest.raises(ValueError, match="no A-site"):
        tables.read_asites(spark, put(tmp_path, "e", "\n"))
    gene_map = tables.read_gene_map(spark, put(tmp_path, "m", "#c\n\nt1\tg1\nt2\nt1\tg9\n"))
    assert {r.trx_id: r.gene_id for r in gene_map.collect()} == {"t1": "g9", "t2": None}
    trx = spark.createDataFrame([("t1", "x"), ("t2", "y"), ("t3", "z")], "trx_id string, gene_id string")
    assert {r.trx_id: r.gene_id for r in tables.remapped(trx, gene_map).collect()} == {"t1": "g9", "t3": "z"}
    q = tables.read_quants(spark, {"a": put(tmp_path, "q", "g\t-5\t3\n")}).collect()[0]
    assert (q.gene, q.size, q["count"], q.sample) == ("g", -5, 3, "a")
    m = tables.read_quant_matrix(spark, put(tmp_path, "w", "# gene\tsize\tA\tB\ng\t9\t1\t2\n"))
    assert sorted((r.gene, r.sample, r["count"]) for r in m.collect()) == [("g", "A", 1), ("g", "B", 2)]
    assert tables.read_sets(spark, put(tmp_path, "k", "s\ta,b,a\tx\ty\n")).count() == 2
    assert tables.read_data(spark, put(tmp_path, "d", "a\t1.5\n")).collect()[0].value == 1.5
    with pytest.raises(Exception, match="bad data line"):
        tables.read_data(spark, put(tmp_path, "d2", "a\tx\n")).collect()
    assert tables.read_length_counts(spark, put(tmp_path, "l", "0\t5\n1\t7\n")).count() == 2
    with pytest.raises(Exception, match="bad count line"):
        tables.read_length_counts(spark, put(tmp_path, "l2", "0\t5\n2\t7\n")).collect()
    with pytest.raises(Exception, match="index length"):
        tables.read_samples(spark, put(tmp_path, "i", "a,ACG\nb,AC\n"), 3).collect()
    assert tables.read_barcodes(spark, put(tmp_path, "b", "#x\nn\tACG\n")).count() == 1
    assert tables.read_ids(spark, put(tmp_path, "ids", "a\n\na\nb\n")).count() == 2
    f = tables.read_pars_features(spark, put(tmp_path, "pf", "g\tCDS\t3\t9\ng\tTranscript\t0\t20\n")).collect()[0]
    assert (f["CDS_start"], f["Transcript_end"], f["3UTR_start"]) == (3, 20, None)
    assert tables.read_pars_scores(spark, put(tmp_path, "ps", "g\t3\t1;2.5;3\n")).collect()[0].scores == [1.0, 2.5, 3.0]
    tables.write_tsv(m.withColumn("x", F.lit(1.25)), str(tmp_path / "tsv"), 1)
    assert spark.read.text(str(tmp_path / "tsv")).count() >= 3


def test_wig(spark, tmp_path):
    track = spark.createDataFrame([("c1", 4, 2), ("c1", 1, 1)], "ref string, at bigint, n bigint")
    annotations.write_wig(track, str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["variableStep chrom=c1 span=1", "2 1.00", "5 2.00"]


def test_written_bam_as_read(spark, tmp_path):
    df = alignments.read_sam(spark, put(tmp_path, "a.sam", SAM))
    out = f"file://{tmp_path}/bam"
    alignments.write_bam(df.repartition(3), [("c1", 100), ("c2", 50)], out)
    columns = ["qname", "flag", "ref", "pos", "cigar", "tags", "seq"]
    assert alignments.read_bam(spark, out).select(*columns).orderBy("qname").collect() == df.select(*columns).orderBy("qname").collect()
    data = gzip.decompress(next(p for p in (tmp_path / "bam").iterdir() if p.suffix == ".bam").read_bytes())
    assert data[:4] == b"BAM\1" and not list((tmp_path / "bam").glob("*.unfinished"))
    with pytest.raises(Exception, match="too long for BAM"):
        alignments.write_bam(df.limit(1).withColumn("qname", F.repeat(F.lit("x"), F.lit(300))), [("c1", 100)], f"file://{tmp_path}/bad")
    assert [bin_of(a, b) for a, b in ((0, 1), (16384, 16385), (16383, 16385), (0, 1 << 29))] == [4681, 4682, 585, 0]


def test_fasta_chunks_across_splits(spark, tmp_path):
    seqs = {f"c{i}": "".join("ACGT"[(i * 7 + j * j) % 4] for j in range(n)) for i, n in enumerate((1, 10, 64, 333, 1000, 0, 77))}
    text = "".join(f">{name} x\n" + "".join(seq[k : k + 13].lower() + "\n" for k in range(0, len(seq), 13)) for name, seq in seqs.items())
    path = put(tmp_path, "a.fa", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        chunks = reads.read_fasta_chunks(spark, path, 32).cache()
        got = {}
        for r in chunks.orderBy("ref", "chunk").collect():
            assert len(r.text) == 32 or (r.chunk + 1) * 32 > len(seqs[r.ref])
            got[r.ref] = got.get(r.ref, "") + r.text
        assert got == {k: v for k, v in seqs.items() if v}
        regions = spark.createDataFrame([(1, "c4", "+", [(0, 40), (100, 5)]), (2, "c4", "-", [(990, 30)]), (3, "c9", "+", [(0, 5)])], "id int, ref string, strand string, blocks array<struct<start:bigint,len:bigint>>")
        back = seqs["c4"][990:].translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert {r.id: r.seq for r in reads.fetched(regions, chunks, "id", 32).collect()} == {1: seqs["c4"][:40] + seqs["c4"][100:105], 2: back}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_map_lines_of_several_files(spark, tmp_path):
    paths = [put(tmp_path, "z", "t1\ta\nt2\tb\nx\ty\tz\n"), put(tmp_path, "a", "t1\nt3\tc\n")]
    assert {r.trx_id: r.gene_id for r in tables.read_gene_map(spark, paths).collect()} == {"t1": None, "t2": "b", "t3": "c"}
    assert [r.value for r in tables.bad_map_lines(spark, paths).collect()] == ["x\ty\tz"]


def test_wig_pair(spark, tmp_path):
    track = spark.createDataFrame([("c1", "+", 4, 2), ("c2", "+", 0, 3), ("c1", "-", 1, 1)], "ref string, strand string, at bigint, n bigint")
    annotations.write_wig_pair(track, str(tmp_path / "w"), 2.0)
    both = [sorted(map(tuple, annotations.read_wig(spark, str(tmp_path / f"w_{s}.wig")).collect())) for s in ("fwd", "rev")]
    assert both == [[("c1", 4, 4.0), ("c2", 0, 6.0)], [("c1", 1, 2.0)]]


def test_split_fastq_is_finished_by_its_settings(spark, tmp_path):
    columns = "name string, seq string, qual string, fate string, new_name string, insert string, insert_qual string"
    rows = [
        ("a", "ACGT", "IIII", "s/1", "a#A x", "CG", "II"), ("b", "AC", "II", "TooShort", None, None, None), ("c", "GGTT", "!!!!", "UnknownIndex", "c#G", "GT", "!!"),
        ("d", "TTTT", "@@@@", "s/1", "d#T", "TT", "@@"),
    ]
    out, settings = f"file://{tmp_path}/split", {"prefix": "NI", "least_insert": 3, "sheet": "x\ty"}
    reads.write_split_fastq(spark.createDataFrame(rows, columns), out, settings)
    got, kept = reads.read_split_fastq(spark, out)
    assert kept == settings
    want = [("a#A x", "CG", "II", "s/1"), ("b", "AC", "II", "TooShort"), ("c#G", "GT", "!!", "UnknownIndex"), ("d#T", "TT", "@@", "s/1")]
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(Exception, match="exist"):
        reads.write_split_fastq(spark.createDataFrame(rows, columns), out, settings)
    import shutil

    shutil.move(tmp_path / "split" / "config.txt", tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="not finished"):
        reads.read_split_fastq(spark, out)


def test_site_histogram_in_order(spark, tmp_path):
    rows = [(t, u, 1 + (t * u) % 5) for t in range(1, 40) for u in range(1, t + 1)]
    sites = spark.createDataFrame(rows[::-1], "total bigint, unique bigint, n_sites bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_site_histogram(sites, f"file://{tmp_path}/h")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "h").glob("part-*"))
    assert len(parts) > 1 and [tuple(map(int, x.split("\t"))) for p in parts for x in p.read_text().splitlines()] == rows


def test_unknown_pars_feature(spark, tmp_path):
    with pytest.raises(Exception, match="unknown feature type: exon"):
        tables.read_pars_features(spark, put(tmp_path, "pf", "g\tCDS\t3\t9\ng\texon\t0\t20\n")).collect()


def test_wig_in_many_files(spark, tmp_path):
    """A reference that goes on in another file is named there again."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    track = spark.createDataFrame([(f"c{i % 3}", i * 997 % 5000, float(i)) for i in range(3000)] + [("far", k * 4_194_304, 1.0) for k in range(6)], "ref string, at bigint, n double")
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "9")
        annotations.write_wig(track, str(tmp_path / "w"))
        found = sorted(map(tuple, annotations.read_wig(spark, str(tmp_path / "w")).collect()))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert found == sorted(map(tuple, track.collect()))
