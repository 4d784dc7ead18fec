import gzip
import math

import pytest
from pyspark.sql import functions as F

from locusmill import api
from locusmill.operators import profile, reads, vectors
from locusmill.plans import registry
from locusmill.sources import binary, sinks, text


def _one(spark, column, seq="", qual=""):
    return spark.createDataFrame([(seq, qual)], "seq string, qual string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("qual", "window", "keep"), [("I" * 30 + "#" * 20, 4, 29), ("#" * 50, 4, 0), ("I" * 50, 4, 50), ("III", 4, 3), ("I#I#", 0, 4), ("", 4, 0)])
def test_window_trim(spark, qual, window, keep):
    assert _one(spark, reads.cut_window(F.col("qual"), window, 20), qual=qual) == keep


def test_end_trim(spark):
    q = "##" + "I" * 20 + "###"
    assert _one(spark, reads.cut_front(F.col("qual"), 20), qual=q) == 2
    assert _one(spark, reads.cut_tail(F.col("qual"), 20), qual=q) == 22
    assert _one(spark, reads.count_other(F.col("seq")), seq="ACGTNNAC") == 2


INSERT, ADAPTER = "TTGCACAGTTGCACAGTTGCACAGTTGCACAG", "AGATCGGAAGAGC"


@pytest.mark.parametrize(("tail", "overlap", "keep"), [(ADAPTER + "TTTTTT", 4, 32), ("AGATCGG", 4, 32), ("AGAT", 6, 36), ("AGATCGGATGAGC", 4, 32)])
def test_adapter(spark, tail, overlap, keep):
    assert _one(spark, reads.cut_adapter(F.col("seq"), (ADAPTER,), overlap), seq=INSERT + tail) == keep


def test_reverse_complement(spark):
    assert _one(spark, reads.reverse_complement(F.col("seq")), seq="ACGTN") == "NACGT"


def test_csr_goldens(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (2, 3, 4.0)], "row bigint, col int, value float")
    assert {r["row"]: r["norm"] for r in vectors.row_norms(d).collect()}[0] == pytest.approx(math.sqrt(5))
    assert vectors.cosine_pairs(d).count() == 0
    assert vectors.invalid_rows(d.union(d)).count() == 3


def test_knn_and_index(spark, tmp_path):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id bigint, vec array<float>")
    got = {(r["src"], r["rank"]): r["dst"] for r in vectors.knn(v, v, 2).collect()}
    assert got[0, 1] == 1 and got[1, 1] == 0 and got[3, 1] == 0
    full = vectors.padded(vectors.knn(v, v, 5), v.select("id"), 5)
    assert full.count() == 20 and full.filter("dst = -1").count() == 8
    vectors.VectorIndex(v).save(str(tmp_path / "index"))
    index = vectors.VectorIndex.load(spark, str(tmp_path / "index"))
    assert index.add(v).vectors.count() == 8
    assert index.query(v.filter("id = 0"), 1).first()["dst"] == 0


def test_windows(spark):
    r = spark.createDataFrame([("chr1", 5000, 8000, "a", "+"), ("chr1", 5000, 8000, "b", "-"), ("zz", 1, 2, "c", "+")], "contig string, start bigint, stop bigint, name string, strand string")
    contigs = spark.createDataFrame([("chr1", 100000)], "contig string, contig_length bigint")
    o = lambda anchor: profile.ProfileOptions(upstream=1000, downstream=500, bins=10, anchor=anchor)
    w = lambda anchor: {x["name"]: (x["w_start"], x["w_stop"]) for x in profile.windows(r, contigs, o(anchor)).collect()}
    assert w("TSS")["a"] == (4000, 5500) and w("TES")["a"] == (7000, 8500) and w("center")["a"] == (5500, 7000)
    assert w("TSS")["b"] == (7500, 9000)


def test_text_sources(spark, tmp_path):
    p = tmp_path / "f.bed"
    p.write_text("track x\n#c\nchr1\t5\t9\nchr1\t+5\t9\nchr1\t 5\t9\nchr1\t9\t5\r\n")
    d = text.fragment_bed(spark, str(p))
    assert (d.count(), d.filter("not malformed").count()) == (4, 1)
    with pytest.raises(Exception, match="malformed"):
        text.peaks_bed(spark, str(p)).collect()
    g = tmp_path / "a.gtf"
    g.write_text('chr1\tx\tgene\t11\t20\t.\t-\t.\tgene_id "i"; gene_name "N1"\nshort\n')
    assert [tuple(r) for r in text.regions(spark, str(g)).collect()] == [("chr1", 10, 20, "N1", "-")]
    b = tmp_path / "p.bedpe"
    b.write_text("chr1\t10\t20\tchr1\t50\t60\tn\t.\t+\t-\nchr1\t1\t2\tchr2\t1\t2\tn\t3\t+\t-\n")
    assert [r["drop_reason"] for r in text.bedpe(spark, str(b)).collect()] == ["kept", "other_contig"]
    s = tmp_path / "c.sizes"
    s.write_text("chr1\t10\nchr1\t20\n")
    with pytest.raises(text.InvalidInput):
        text.chrom_sizes(spark, str(s))


def test_fastq_round_trip(spark, tmp_path):
    p = tmp_path / "r.fastq.gz"
    p.write_bytes(gzip.compress(b"@a\nACGT\n+\n@III\r\n@b\nAC\n+\nII"))
    d = binary.read_fastq(spark, str(p))
    assert [(r["id"], r["seq"], r["qual"]) for r in d.orderBy("rec_idx").collect()] == [("@a", "ACGT", "@III"), ("@b", "AC", "II")]
    q = api.run_qc(spark, d)
    assert (q.metrics["reads"], q.metrics["bases"], q.metrics["gc_bases"]) == (2, 6, 3)
    with pytest.raises(ValueError):
        sinks.refuse_alias(str(p), str(p))


def _bam() -> bytes:
    import struct
    import zlib

    def block(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))

    def record(name: bytes, flag: int, pos: int, mate: int, tlen: int) -> bytes:
        seq = bytes([0x12, 0x48])
        b = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 30, 0, 1, flag, 4, 0, mate, tlen) + name + b"\0" + struct.pack("<I", 4 << 4) + seq + bytes([30] * 4)
        return struct.pack("<i", len(b)) + b

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    return block(head) + block(record(b"q", 0x63, 100, 200, 104) + record(b"q", 0x93, 200, 100, -104)) + binary.BGZF_END


def test_bam(spark, tmp_path):
    p = tmp_path / "a.bam"
    p.write_bytes(_bam())
    d = binary.read_bam(spark, str(p))
    r = d.orderBy("rec_idx").first()
    assert (r["contig"], r["start"], r["stop"], r["seq"], r["qual"]) == ("chr1", 100, 104, "ACGT", "????")
    assert [(x["start"], x["stop"]) for x in binary.bam_fragments(d).collect()] == [(100, 204)]
    assert {x["seq"] for x in binary.bam_reads(d).collect()} == {"ACGT"}
    assert binary.mates(binary.bam_reads(d)).count() == 1
    p.write_bytes(_bam()[:-28])
    with pytest.raises(Exception, match="end marker"):
        binary.read_bam(spark, str(p)).collect()


def test_api_refuses_mismatched_names(spark):
    f = spark.createDataFrame([("1", 5, 50, None, False)], "contig string, start bigint, stop bigint, mapq int, reverse boolean")
    peaks = spark.createDataFrame([("chr1", 0, 100)], "contig string, start bigint, stop bigint")
    with pytest.raises(text.InvalidInput):
        api.frip(spark, f, peaks, 1000)
    assert api.fragment_sizes(spark, f).metrics["median"] == 45


def test_rows_that_wait_for_a_python_function_hold_no_document(spark):
    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    d = registry.queries()["trim_adapter"](spark, "/root/testdata/sf0.001")
    found = [p for p in nodes(d._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "ArrowEvalPython"]
    assert len(found) == 1 and "t" not in {c.split("#")[0] for c in found[0].children().apply(0).output().mkString(",").split(",")}


def test_products_of_a_range_of_columns_leave_a_row_a_pair(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(5)
    m = (r.random((30, 400)) < 0.4) * r.integers(-3, 4, (30, 400))
    coo = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)] + [(0, 400, 1.0), (7, 400, -1.0)]
    have = {(i, j): v for i, j, v in coo}
    want = {}
    for a in range(30):
        for b in range(a + 1, 30):
            if both := [j for j in range(401) if (a, j) in have and (b, j) in have]:
                want[a, b] = sum(have[a, j] * have[b, j] for j in both)
    df = spark.createDataFrame(coo, "row bigint, col bigint, value double")
    for hot, products in ((2048, 4_000_000), (2048, 50), (10, 4_000_000)):
        monkeypatch.setattr(vectors, "HOT_COLUMN", hot)
        monkeypatch.setattr(vectors, "PRODUCTS", products)
        parts = vectors._dots(df)
        assert {(x["a"], x["b"]): x["s"] for x in parts.groupBy("a", "b").agg(F.sum("dot").alias("s")).collect()} == want
        if (hot, products) == (2048, 4_000_000):
            assert parts.count() <= len(want) * spark.sparkContext.defaultParallelism  # not one a product: 400 columns


def test_slices_meet_once_and_none_is_broadcast(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(9).normal(size=(90, 4))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = (u @ u.T).astype(np.float32)
    for block in (200, 45, 30, 23):  # 1 to 4 slices
        monkeypatch.setattr(vectors, "BLOCK", block)
        for queries, same in ((df, True), (df.filter("id % 9 = 0"), False)):
            d = vectors.knn(queries, df, 3, same)
            assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
            got = {}
            for r in d.collect():
                got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
            for i in got:
                s = sim[i].copy()
                if same:
                    s[i] = -np.inf
                assert [got[i][r] for r in (1, 2, 3)] == np.argsort(-s, kind="stable")[:3].tolist()
            assert len(got) == queries.count()


def _parsed_once(d):
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", \t, -1)") == 1 and plan.count("try_cast") <= 5, plan


def test_sam_lines_are_split_once(spark, tmp_path):
    """A filter or an aggregate over parsed lines repeats neither the split nor a number's parsing."""
    cigars = {"*": 0, "10M": 10, "3S10M2I4D": 14, "3S10M2I4D5N6=7X8P9H": 32, "1M2N3M4N5M": 15}
    (tmp_path / "s").write_text("".join(f"q\t{i}\tchr1\t{5 + i}\t60\t{c}\t=\t7\t{-i}\t*\t*\n" for i, c in enumerate(cigars)))
    s = text.sam(spark, str(tmp_path / "s"))
    rows = s.orderBy("flag").collect()
    assert [r["stop"] - r["start"] for r in rows] == list(cigars.values())
    assert ["".join(f"{o.len}{o.op}" for o in r["cigar"]) or "*" for r in rows] == list(cigars)
    _parsed_once(s.filter("stop > start and flag < 9").groupBy("contig", "start", "stop", "flag").count())


def test_bedpe_and_bed_lines_are_split_once(spark, tmp_path):
    (tmp_path / "b").write_text("c\t1\t5\tc\t3\t9\tr\t.\t-\t+\nc\t1\t5\tc\t3\t9\tr\t+1\t-\t+\n")
    b = text.bedpe(spark, str(tmp_path / "b"))
    assert sorted(r["drop_reason"] for r in b.collect()) == ["kept", "malformed"]
    _parsed_once(b.filter("drop_reason = 'kept'").groupBy("contig", "start", "stop").count())
    _parsed_once(text.fragment_bed(spark, str(tmp_path / "b")).filter("not malformed").groupBy("start", "stop").count())
