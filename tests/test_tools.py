"""Files, tools and small helpers around the operators."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill import api, cli
from locusmill.operators import intervals, metrics, peaks, reads, vectors
from locusmill.sources import binary, sinks, text
from locusmill.sources.text import InvalidInput
from locusmill.streaming import events

SAM = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:1000\nr1\t99\tchr1\t11\t60\t2S5M3D4M\t=\t60\t70\tACGTACGTACG\tIIIIIIIIIII\nr1\t147\tchr1\t60\t60\t*\t=\t11\t-70\t*\t*\n"


def _bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = c.compress(data) + c.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data)) + binary.BGZF_END


def _bam(qualities: bytes) -> bytes:
    head = b"@HD\tVN:1.6\tSO:queryname\n"
    name, n = b"r1\0", len(qualities)
    record = struct.pack("<iiBBHHHiiii", 0, 10, len(name), 60, 0, 1, 99, n, 0, 50, 70) + name + struct.pack("<I", n << 4) + bytes([0x11] * ((n + 1) // 2)) + qualities
    return _bgzf(b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(record)) + record)


def test_files_are_told_by_their_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_text(SAM)
    (tmp_path / "b.bed").write_bytes(_bam(b"\x1e" * 6))
    (tmp_path / "c.bam").write_bytes(gzip.compress(b"chr1\t1\t2\n"))
    (tmp_path / "d.bam").write_bytes(b"CRAM\3\0")
    (tmp_path / "e").write_text("chr1\t1\t5\n")
    assert [binary.sniff(spark, str(tmp_path / n)) for n in ("a.txt", "b.bed", "c.bam", "d.bam", "e")] == ["sam", "bam", "gzip", "cram", "text"]
    r = binary.alignments(spark, str(tmp_path / "a.txt")).first()
    assert (r["start"], r["stop"], r["mate_start"], r["tlen"], r["contig"], r["mate_contig"]) == (10, 22, 59, 70, "chr1", "chr1")
    assert binary.coordinate_sorted(spark, str(tmp_path / "a.txt")) and not binary.coordinate_sorted(spark, str(tmp_path / "b.bed"))
    f = api._fragments(spark, str(tmp_path / "b.bed")).first()
    assert (f["start"], f["stop"]) == (10, 80)
    with pytest.raises(ValueError):
        binary.alignments(spark, str(tmp_path / "d.bam"))
    assert binary.bam_reads(binary.alignments(spark, str(tmp_path / "b.bed"))).first()["qual"] == "?" * 6


def test_bam_and_fastq_of_other_stores(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(_bam(b"\x1e" * 6))
    (tmp_path / "x.fq").write_text("@r 1\nACGT\n+\nIIII\n")
    there = binary._from_store(spark, f"file://{tmp_path}/x.bam", binary.BamSource, binary.bam_rows)
    assert there.collect() == binary.read_bam(spark, str(tmp_path / "x.bam")).collect()
    there = binary._from_store(spark, f"file://{tmp_path}/x.fq", binary.FastqSource, binary.fastq_rows)
    assert there.collect() == binary.read_fastq(spark, str(tmp_path / "x.fq")).collect()


def test_qualities_that_fastq_cannot_hold_are_refused(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(_bam(b"\x5e" * 6))
    with pytest.raises(Exception, match="cannot be written"):
        binary.read_bam(spark, str(tmp_path / "x.bam")).collect()
    (tmp_path / "x.fq").write_bytes(b"@r\x07\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="malformed record"):
        binary.read_fastq(spark, str(tmp_path / "x.fq")).collect()
    with pytest.raises(Exception, match="Phred"):
        spark.createDataFrame([("AB>",)], "q string").select(reads.to_phred33(F.col("q"))).collect()


def test_copy_counts_reach_the_figures(spark, tmp_path):
    (tmp_path / "f.bed").write_text("chr1\t10\t60\t.\t3\nchr1\t100\t200\t.\t2\nchr1\t5\t4\t.\t1\n")
    plain, counted = (api.fragment_sizes(spark, str(tmp_path / "f.bed"), with_counts=c).metrics["fragments"] for c in (False, True))
    assert (plain, counted) == (2, 5)
    m = api.mark_duplicates(spark, str(tmp_path / "f.bed"), with_counts=True).metrics
    assert (m["examined"], m["duplicates"]) == (5, 3)
    inside = api.fragment_sizes(spark, str(tmp_path / "f.bed"), with_counts=True, regions=[("chr1", 0, 50)])
    assert inside.metrics["fragments"] == 3


@pytest.mark.parametrize("lines", ["chr1\t5\tx\n", "chr1\t50\t90\nchr1\t10\t60\n", "zz\t1\t5\n", "chr1\t-1\t5\n", "chr1\t5\t5\n", "chr1\t900\t1001\n", "chr1\t1\t5\nchr2\t1\t5\nchr1\t7\t9\n"])
def test_peaks_read_strictly(spark, tmp_path, lines):
    (tmp_path / "c").write_text("chr1\t1000\nchr2\t1000\n")
    (tmp_path / "f.bed").write_text(lines)
    with pytest.raises(InvalidInput, match="refused"):
        api.call_peaks(spark, str(tmp_path / "f.bed"), str(tmp_path / "c"))


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["man"]) == 0 and "island" in capsys.readouterr().out
    (tmp_path / "x.fq").write_text("@r1\nACGTACGT\n+\nIIIII###\n@r2\nACGTAGATCGGAAGAGC\n+\nIIIIIIIIIIIIIIIII\n")
    assert cli.main(["trim", str(tmp_path / "x.fq"), "--tail", "20", "--default-adapters", "--out", str(tmp_path / "out")]) == 0
    m = json.loads(capsys.readouterr().out)
    assert (m["kept"], m["adapter_trimmed"], m["quality_trimmed"], m["bases_out"]) == (2, 1, 1, 9)
    assert cli.main(["qc", str(tmp_path / "x.fq"), "--text"]) == 0
    assert "reads        : 2 in -> 2 out (100.00% kept)" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["sizes", "x", "--region", "chr1"])
    assert cli._region("chr1:1,001-2000") == ("chr1", 1000, 2000)


def test_trimming_agrees_with_the_single_steps(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        n = int(r.integers(0, 40))
        s = "".join(r.choice(list("ACGTN"), n)) + ("AGATCGGAAGAGC"[: int(r.integers(0, 14))] if i % 3 == 0 else "")
        rows.append((i, s, "".join(chr(33 + int(x)) for x in r.integers(2, 41, len(s)))))
    o = reads.TrimOptions(front=10, tail=12, window=4, window_mean=14.0, adapters=("AGATCGGAAGAGC",), min_length=5, max_n_rate=0.3, min_mean_quality=15)
    d = spark.createDataFrame(rows, "i int, seq string, qual string")
    got = {x["i"]: x for x in reads.trim(d, o).collect()}
    for i, s, q in rows:
        v = [ord(c) - 33 for c in q]
        start = next((k for k, x in enumerate(v) if x >= 10), len(v))
        stop = max([k + 1 for k, x in enumerate(v) if k >= start and x >= 12], default=start)
        stop = next((k for k in range(start, stop - 3) if sum(v[k : k + 4]) < 56), stop)
        t = s[start:stop]
        cut = len(t)
        for k in range(len(t) - 3):
            w = t[k : k + 13]
            if w[:4] == "AGAT" and sum(x != y for x, y in zip(w, "AGATCGGAAGAGC", strict=False)) <= int(len(w) * 0.1):
                cut = k
                break
        t, u = t[:cut], v[start : start + cut]
        why = "short" if len(t) < 5 else "n_rate" if t.count("N") > 0.3 * len(t) else "short" if sum(u) / len(u) < 15 else "kept"
        assert (got[i]["keep_from"], got[i]["seq"], got[i]["drop_reason"]) == (start, t, why)


def test_large_covers_meet_the_ends_in_order(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(f"c{int(i % 3)}", int(s), int(s + n)) for i, s, n in zip(range(300), r.integers(0, 3_000_000, 300), r.integers(0, 9000, 300), strict=True)], "contig string, start bigint, stop bigint")
    cover = intervals.merge(spark.createDataFrame([(f"c{int(i % 2)}", int(s), int(s + n)) for i, s, n in zip(range(200), r.integers(0, 3_000_000, 200), r.integers(1, 9000, 200), strict=True)], "contig string, start bigint, stop bigint"))
    small, large = (sorted(map(tuple, intervals.overlap_bases(df, cover, limit=n).collect())) for n in (1000, 0))
    assert small == large and sum(x[3] for x in small) > 0


def test_regions_by_start(spark):
    d = spark.createDataFrame([("c", x, x + 5) for x in range(10)], "contig string, start bigint, stop bigint")
    assert intervals.starting_in(d, [("c", 0, 5), ("c", 5, 7)]).count() == 7
    assert intervals.starting_in(d, [("c", 0, 5), ("c", 3, 7)]).count() == 9
    assert intervals.starting_in(d, []).count() == 0


def test_vector_helpers(spark):
    d = vectors.from_csr(spark, [1.0, 2.0, 3.0, 4.0], [0, 2, 1, 3], [0, 2, 3, 4], 4)
    assert d.count() == 4 and vectors.sum_duplicates(d.union(d)).filter("row = 0 and col = 2").first()["value"] == 4
    for bad in (([1.0], [4], [0, 1]), ([1.0, 2.0], [1, 1], [0, 2]), ([1.0], [0], [0, 2]), ([float("inf")], [0], [0, 1])):
        with pytest.raises(ValueError):
            vectors.from_csr(spark, *bad, 4)
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(40)], "id bigint, vec array<float>")
    exact = vectors.knn(v, v, 3)
    idx, sim, k = vectors.as_arrays(exact, v.select("id"), 3)
    assert idx.shape == sim.shape == (40, 3) and k == 3 and (idx >= 0).all()
    g = vectors.neighbour_graph(exact, 3)
    assert g["params"]["n_neighbors"] == 3 and g["connectivities"].count() >= exact.count() and g["distances"].count() == exact.count()
    assert vectors.index_bytes(2**62, 2**62) == 2**64 - 1 and vectors.index_bytes(1000, 64) == 1000 * (256 + 132 + 52)
    found = vectors.knn_cells(v, v, 3, vectors.CellOptions(cells=4, probes=4))
    key = lambda d: sorted((r["src"], r["rank"], r["dst"], round(r["sim"], 5)) for r in d.collect())
    assert key(found) == key(exact)  # all cells looked into: exact
    assert vectors.knn_cells(v.limit(0), v.limit(0), 3).count() == 0


def test_index_labels_and_capacity(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id bigint, vec array<float>")
    index = vectors.VectorIndex(v, vectors.CellOptions(capacity=3)).set_labels(spark.createDataFrame([(0, 70), (1, 71)], "id bigint, label bigint"))
    assert index.labelled(index.query(v.filter("id = 1"), 1)).first()["label"] == 71
    assert index.labelled(index.query(v.filter("id = 1"), 1, exact=False)).first()["label"] == 71
    more = index.add(v.limit(1))
    assert sorted(r["label"] for r in more.vectors.collect()) == [2, 70, 71]
    with pytest.raises(ValueError, match="at most"):
        more.add(v)
    with pytest.raises(ValueError, match="label"):
        index.set_labels(spark.createDataFrame([(0, 70)], "id bigint, label bigint"))


def test_peak_matching_serves_the_first_left_peak(spark):
    rows = lambda *x: spark.createDataFrame([("c", a, b, n) for a, b, n in x], "contig string, start bigint, stop bigint, name string")
    got = metrics.match_peaks(rows((0, 10, "a1"), (4, 14, "a2")), rows((3, 13, "b1"))).collect()
    assert [(r["a_name"], r["b_name"]) for r in got] == [("a1", "b1")]


def test_pmf_bound_is_a_bound():
    from locusmill.functions import poisson

    k, lam = np.repeat(np.arange(1, 60), 40), np.tile(np.linspace(0.01, 80, 40), 59)
    assert (poisson.bounds(k, lam) >= poisson.scores(k, lam) - 1e-9).all()


def test_fragments_of_alignments(spark):
    a = spark.createDataFrame([("chr1", 10, 60, 99, 70, 60), ("chr1", 30, 80, 147, -70, 60), ("chr1", 10, 60, 99 + 1024, 70, 60), ("chr1", 10, 60, 99, 5000, 60), ("chr1", 960, 1010, 99, 70, 60)], "contig string, start bigint, stop bigint, flag int, tlen bigint, mapq int")
    c = spark.createDataFrame([("chr1", 1000)], "contig string, contig_length bigint")
    assert [(r["start"], r["stop"]) for r in peaks.from_alignments(a, c).collect()] == [(10, 80)]


def test_deduplication_that_forgets(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:05"), (2, "a", "2024-01-01 00:00:07")]
    spark.createDataFrame(rows, "user_id int, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet")).schema
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "events.parquet")).withWatermark("ts", "1 minute").dropDuplicatesWithinWatermark(["user_id"]).select("user_id")
    assert events.drain(s, "forget").count() == 2


def test_profile_file(spark, tmp_path):
    p = spark.createDataFrame([(0, -50, 1.5), (1, 50, 2.0)], "bin bigint, bin_offset bigint, mean double")
    sinks.write_profile(p, str(tmp_path / "p"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["offset\tmean_signal", "-50\t1.500000", "50\t2.000000"]


def test_copy_counts_out_of_bounds_are_malformed(spark, tmp_path):
    (tmp_path / "f").write_text("c\t1\t2\t.\t0\nc\t1\t2\t.\t1000001\nc\t1\t2\t.\t1000000\n")
    assert [r["malformed"] for r in text.fragment_bed(spark, str(tmp_path / "f"), True).collect()] == [True, True, False]
