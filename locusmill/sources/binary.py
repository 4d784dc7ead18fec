"""FASTQ and BAM as Python data sources.

A file is one partition: gzip cannot be split, and a record's frame depends on all before it.  Local
files are streamed by the data sources; files in any other store come through Spark's binaryFile reader,
one file a row, which bounds such a file at 2 GB.  SAM text is read and split by Spark (text.sam)."""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_RECORD = 65_536
MAX_QUALITY = 93


def _paths(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path))
    found = [p for p in found if not os.path.basename(p).startswith("_")]  # markers of finished jobs
    if not found:
        raise FileNotFoundError(path)
    return found


def is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_File]:
        return [_File(p, i) for i, p in enumerate(_paths(self.options["path"]))]


_HEADER = re.compile(rb"[\x20-\x7e\t]*")
_SIGNS = re.compile(rb"[!-~]*")


def fastq_records(f: BinaryIO, name: str) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """Four lines a record, counted by line ends and never by '@'; CRLF and a missing last line end
    are fine, plain, gzip and BGZF (multi-member gzip) alike.  Headers, bases and qualities must be
    printable."""
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    with gzip.open(f, "rb") if packed else f as f:
        while True:
            lines = [f.readline(MAX_RECORD + 1) for _ in range(4)]
            if not lines[0]:
                return
            if sum(map(len, lines)) > MAX_RECORD:
                raise ValueError(f"{name}: a record is longer than {MAX_RECORD} bytes")
            record = [x.rstrip(b"\r\n") for x in lines]
            if not lines[1] or not lines[2] or (not lines[3] and record[1]):
                raise ValueError(f"{name}: the last record is cut short")
            sound = record[0].startswith(b"@") and record[2].startswith(b"+") and len(record[1]) == len(record[3])
            if not sound or not all(_HEADER.fullmatch(x) for x in record[::2]) or not all(_SIGNS.fullmatch(x) for x in record[1::2]):
                raise ValueError(f"{name}: malformed record {record[0][:60]!r}")
            yield tuple(record)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file int, rec_idx bigint, id string, seq string, plus string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader(self.options)


class _FastqReader(_FileReader):
    def read(self, partition: _File):
        yield from fastq_rows(open(partition.path, "rb"), partition.path, partition.number)


def fastq_rows(f: BinaryIO, name: str, number: int) -> Iterator[tuple]:
    for i, record in enumerate(fastq_records(f, name)):
        yield number, i, *(x.decode("latin-1") for x in record)


# fixed values of the BAM format
CIGAR = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf_blocks(f: BinaryIO, path: str) -> Iterator[bytes]:
    """Decompressed blocks; each one's checksum and length are verified, the end marker is required."""
    with f:
        last = b""
        while head := f.read(18):
            if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"{path}: not a BGZF block")
            size = struct.unpack("<H", head[16:18])[0] + 1
            rest = f.read(size - 18)
            if len(rest) != size - 18:
                raise ValueError(f"{path}: a block is cut short")
            last = head + rest
            data = zlib.decompress(rest[:-8], -15)
            crc, length = struct.unpack("<II", rest[-8:])
            if zlib.crc32(data) != crc or len(data) != length:
                raise ValueError(f"{path}: a block fails its checksum")
            yield data
        if last != BGZF_END:
            raise ValueError(f"{path}: the end marker is missing")


class _Bytes:
    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def take(self, n: int, optional: bool = False) -> bytes:
        while len(self.held) < n:
            more = next(self.blocks, None)
            if more is None:
                if optional and not self.held:
                    return b""
                raise ValueError("a BAM record is cut short")
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def bam_header(data: _Bytes) -> tuple[str, list[tuple[str, int]]]:
    """The header's text and the contigs with their lengths."""
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = data.take(data.number()).rstrip(b"\0").decode("latin-1")
    out = []
    for _ in range(data.number()):
        name = data.take(data.number())[:-1].decode()
        out.append((name, data.number()))
    return text, out


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "file int, rec_idx bigint, qname string, flag int, contig string, start bigint, stop bigint, mapq int, mate_contig string, mate_start bigint, tlen bigint, cigar array<struct<op:string,len:int>>, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _BamReader(self.options)


class _BamReader(_FileReader):
    def read(self, partition: _File):
        yield from bam_rows(open(partition.path, "rb"), partition.path, partition.number)


def bam_rows(f: BinaryIO, path: str, number: int) -> Iterator[tuple]:
    data = _Bytes(bgzf_blocks(f, path))
    contigs = [n for n, _ in bam_header(data)[1]]
    name_of = lambda i: contigs[i] if i >= 0 else None
    i = 0
    while size := data.take(4, optional=True):
        b = data.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
        at = 32 + l_name
        ops = [(CIGAR[c & 15], c >> 4) for c in struct.unpack_from(f"<{n_cigar}I", b, at)]
        at += 4 * n_cigar
        packed = b[at : at + (l_seq + 1) // 2]
        seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:l_seq]
        at += (l_seq + 1) // 2
        quality = b[at : at + l_seq]
        if l_seq and quality[0] != 255 and max(quality) > MAX_QUALITY:
            raise ValueError(f"{path}: a quality above {MAX_QUALITY} cannot be written as FASTQ")
        qual = None if not l_seq or quality[0] == 255 else bytes(q + 33 for q in quality).decode("latin-1")
        span = sum(n for op, n in ops if op in "MDN=X")
        yield number, i, b[32 : 32 + l_name - 1].decode(), flag, name_of(ref), pos, pos + span, mapq, name_of(mate), mate_pos, tlen, ops, seq or None, qual
        i += 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(BamSource)


def _from_store(spark: SparkSession, path: str, source: type[DataSource], rows: Callable) -> DataFrame:
    """The records of files that only Spark's readers reach."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = spark.createDataFrame([], source.schema(None)).schema
    names, number = [f.name for f in schema], {p: i for i, p in enumerate(sorted(r["path"] for r in files.select("path").collect()))}
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                held: list[tuple] = []
                for row in rows(io.BytesIO(content), path, number[path]):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _batch(held, names, arrow)
                        held = []
                if held:
                    yield _batch(held, names, arrow)

    return files.mapInArrow(parse, schema)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    as_dicts = lambda v: [{"op": o, "len": n} for o, n in v] if isinstance(v, list) else v
    columns = [pa.array([as_dicts(r[i]) for r in rows], schema.field(n).type) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    if not is_local(path):
        return _from_store(spark, path, FastqSource, fastq_rows)
    register(spark)
    return spark.read.format("fastq").load(path)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    if not is_local(path):
        return _from_store(spark, path, BamSource, bam_rows)
    register(spark)
    return spark.read.format("bam").load(path)


def _head(spark: SparkSession, path: str, n: int = 65_536) -> bytes:
    """The first bytes of a file in any store; of a folder, those of its first file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        found = sorted((x.getPath() for x in fs.listStatus(at) if not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getName())
        if not found:
            return b""
        at = found[0]
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str) -> str:
    """bam, cram, sam, gzip or text, by the first bytes and never by the name."""
    head = _head(spark, path)
    if head[:4] == b"CRAM":
        return "cram"
    if head[:2] == b"\x1f\x8b":
        inside = zlib.decompressobj(31).decompress(head, 16)
        return "bam" if inside[:4] == b"BAM\1" else "gzip"
    return "sam" if re.match(rb"@(HD|SQ|RG|PG|CO)\t", head) else "text"


def alignments(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The alignments of a BAM or SAM file."""
    kind = kind or sniff(spark, path)
    if kind == "cram":
        raise ValueError(f"{path} is CRAM, which needs its reference sequence; convert it to BAM")
    if kind == "sam":
        from .text import sam

        return sam(spark, path)
    if kind != "bam":
        raise ValueError(f"{path} holds no alignments")
    return read_bam(spark, path)


def coordinate_sorted(spark: SparkSession, path: str) -> bool:
    """Does the header of a BAM or SAM file say that records are sorted by coordinate?"""
    head = _head(spark, path)
    text = zlib.decompressobj(31).decompress(head)[8:].decode("latin-1") if head[:2] == b"\x1f\x8b" else head.decode("latin-1")
    return re.match(r"@HD\t[^\n]*\bSO:coordinate\b", text) is not None


def bam_fragments(alignments: DataFrame, require: int = 0x2, exclude: int = 0xB04) -> DataFrame:
    """Fragments from proper pairs: the mate with a positive template length speaks for both."""
    from ..operators.fragments import flags_pass

    d = alignments.filter(flags_pass(F.col("flag"), require, exclude) & (F.col("tlen") > 0) & (F.col("contig") == F.col("mate_contig")))
    return d.select("contig", "start", (F.col("start") + F.col("tlen")).alias("stop"), F.when(F.col("mapq") == 255, None).otherwise(F.col("mapq")).alias("mapq"), (F.col("flag").bitwiseAND(F.lit(16)) > 0).alias("reverse"), "rec_idx")


def bam_reads(alignments: DataFrame, missing: str = "I") -> DataFrame:
    """Reads as sequenced: primary records with a sequence, reverse ones turned back."""
    from ..operators.reads import reverse_complement

    back = F.col("flag").bitwiseAND(F.lit(16)) > 0
    qual = F.coalesce("qual", F.rpad(F.lit(""), F.char_length("seq"), F.lit(missing)))
    d = alignments.filter((F.col("flag").bitwiseAND(F.lit(0x900)) == 0) & F.col("seq").isNotNull())
    return d.select("rec_idx", F.concat(F.lit("@"), "qname").alias("id"), "flag", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse(qual)).otherwise(qual).alias("qual"))


def mates(reads: DataFrame) -> DataFrame:
    """Pairs of first and second reads by name."""
    part = lambda bit, name: reads.filter(F.col("flag").bitwiseAND(F.lit(bit)) > 0).select("id", F.col("seq").alias(f"seq_{name}"), F.col("qual").alias(f"qual_{name}"))
    return part(64, "1").join(part(128, "2"), "id")


def singletons(reads: DataFrame) -> DataFrame:
    """Reads whose mate is not there; single-end reads among them."""
    first, second = F.col("flag").bitwiseAND(F.lit(64)) > 0, F.col("flag").bitwiseAND(F.lit(128)) > 0
    has = reads.groupBy("id").agg(F.max(first).alias("_1"), F.max(second).alias("_2"))
    return reads.join(has, "id").filter(~((first & F.col("_2")) | (second & F.col("_1")))).drop("_1", "_2")
