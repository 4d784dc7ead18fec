"""Read quality control, trimming and filtering.

Reads are ASCII, so a batch of them is one byte string with places where each begins.  Everything
per base is numpy over such byte strings, one Arrow pass a table: counts per byte, moving sums as
differences of prefix sums, first hits by binary search.  What is left for shuffles are small counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CYCLES = 1024
REPORT_TOP = 63
# fixed values: the adapters looked for where none are named
DEFAULT_ADAPTERS = ("AGATCGGAAGAGC", "CTGTCTCTTATACACATCT")


@dataclass(frozen=True)
class TrimOptions:
    front: int = 0  # cut leading bases below this quality; 0: off
    tail: int = 0
    window: int = 4
    window_mean: float = 20.0
    adapters: tuple[str, ...] = ()
    min_overlap: int = 4
    seed: int = 8
    mismatch_rate: float = 0.1
    min_length: int = 1
    max_n_rate: float = 1.0
    min_mean_quality: float = 0.0
    phred64: bool = False  # qualities are Phred+64 and are rebased first

    def __post_init__(self) -> None:
        if min(self.front, self.tail, self.window, self.min_length) < 0 or self.min_overlap < 1 or not 0 <= self.mismatch_rate < 1:
            raise ValueError("trim options out of range")
        if any(not a or set(a) - set("ACGTN") for a in self.adapters):
            raise ValueError("adapters are non-empty strings of ACGTN")

    def with_adapters(self, *more: str) -> TrimOptions:
        """The same with the named adapters, or with the default ones if none are named."""
        return replace(self, adapters=more or DEFAULT_ADAPTERS)


def well_formed(r: DataFrame) -> Column:
    """Printable header (tabs are fine), bases and qualities of equal length, all of them printable."""
    plain = r["id"].startswith("@") & r["id"].rlike("^[\\x20-\\x7e\\t]*$")
    return plain & (F.char_length(r["seq"]) == F.char_length(r["qual"])) & r["seq"].rlike("^[!-~]*$") & r["qual"].rlike("^[!-~]*$")


# ----------------------------------------------------------------------------- bytes of a batch


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value begins, one place more than values; null
    values are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _prefix(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _first(places: np.ndarray, start: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The first of the ascending places at or after each start."""
    at = np.searchsorted(places, start)
    return np.where(at < len(places), np.append(places, 0)[at], none)


def _front(data: np.ndarray, start: np.ndarray, stop: np.ndarray, q: int) -> np.ndarray:
    return np.minimum(_first(np.flatnonzero(data >= 33 + q), start, stop), stop) if q > 0 else start


def _tail(data: np.ndarray, start: np.ndarray, stop: np.ndarray, q: int) -> np.ndarray:
    if q <= 0:
        return stop
    good = np.flatnonzero(data >= 33 + q)
    at = np.searchsorted(good, stop) - 1
    return np.maximum(np.where(at >= 0, np.append(good, 0)[at] + 1, 0), start)


def _window(data: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int, mean: float) -> np.ndarray:
    """Where the first window whose sum is too small starts; reads shorter than a window stay whole."""
    if window == 0 or len(data) < window:
        return stop
    below = _prefix(data.astype(np.int64) - 33)
    bad = np.flatnonzero(below[window:] - below[:-window] < int(mean * window))
    found = _first(bad, start, stop)
    return np.where(found + window <= stop, np.minimum(found, stop), stop)


def _adapter(data: np.ndarray, start: np.ndarray, stop: np.ndarray, o: TrimOptions) -> np.ndarray:
    """Where the 5'-most adapter starts: an exact seed, then at most floor(rate * overlap) mismatches
    over the overlap of read and adapter, at least min_overlap long."""
    out = stop.copy()
    for name in o.adapters:
        a = np.frombuffer(name.encode(), np.uint8)
        seed = min(o.seed, o.min_overlap, len(a))
        if len(data) < seed:
            continue
        hit = np.ones(len(data) - seed + 1, bool)
        for i in range(seed):
            hit &= data[i : len(data) - seed + 1 + i] == a[i]
        at = np.flatnonzero(hit)
        read = np.searchsorted(start, at, side="right") - 1
        ok = read >= 0
        at, read = at[ok], read[ok]
        overlap = np.minimum(len(a), stop[read] - at)
        ok = overlap >= o.min_overlap
        at, read, overlap = at[ok], read[ok], overlap[ok]
        differ = np.zeros(len(at), np.int64)
        for i in range(len(a)):
            inside = i < overlap
            differ += inside & (data[np.where(inside, at + i, 0)] != a[i])
        ok = differ <= np.floor(overlap * o.mismatch_rate)
        read, first = np.unique(read[ok], return_index=True)
        out[read] = np.minimum(out[read], at[ok][first])
    return out


_OTHER = np.ones(256, bool)
_OTHER[list(b"ACGTacgt")] = False


# ----------------------------------------------------------------------------- counts


def byte_counts(reads: DataFrame) -> DataFrame:
    """(which, byte, n): how often each byte occurs among bases (which = 0) and qualities (1); which = 2
    holds the number of reads.  At most 513 rows a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 256), np.int64)
        for batch in batches:
            for i in range(2):
                held[i] += np.bincount(_flat(batch.column(i))[0], minlength=256)
            held[2, 0] += batch.num_rows
        which, byte = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(byte.astype(np.int32)), pa.array(held[which, byte])], names=["which", "byte", "n"])

    return reads.select("seq", "qual").mapInArrow(count, "which int, byte int, n bigint").groupBy("which", "byte").agg(F.sum("n").alias("n"))


def totals(reads: DataFrame) -> DataFrame:
    base, letter, n = F.col("which") == 0, F.chr("byte"), F.col("n")
    quality, q = F.col("which") == 1, F.col("byte") - 33
    part = lambda cond, value, name: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint").alias(name)
    return byte_counts(reads).agg(
        part(F.col("which") == 2, n, "reads"),
        part(base, n, "bases"),
        part(quality, q * n, "quality_sum"),
        part(quality & (q >= 20), n, "q20_bases"),
        part(quality & (q >= 30), n, "q30_bases"),
        part(base & letter.isin(*"GCgc"), n, "gc_bases"),
        part(base & ~letter.isin(*"ACGTacgt"), n, "n_bases"),
    )


def quality_histogram(reads: DataFrame, fold: bool = False, top: int = REPORT_TOP) -> DataFrame:
    """(q, n); the report's form folds all above `top` into it."""
    h = byte_counts(reads).filter("which = 1").select((F.col("byte") - 33).alias("q"), "n")
    return h.groupBy(F.least("q", F.lit(top)).alias("q")).agg(F.sum("n").alias("n")) if fold else h


def per_cycle(reads: DataFrame) -> DataFrame:
    """Mean quality and base counts of each cycle up to CYCLES."""
    names = ["cycle", "q", "n", "n_a", "n_c", "n_g", "n_t"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(names) - 1, CYCLES), np.int64)
        for batch in batches:
            (bases, at), (quals, places) = (_flat(batch.column(i)) for i in range(2))
            if len(bases) != len(quals) or (at != places).any():
                raise ValueError("bases and qualities of a read differ in length")
            cycle = np.arange(len(bases)) - np.repeat(at[:-1], np.diff(at))
            near = np.flatnonzero(cycle < CYCLES)
            cycle, bases, quals = cycle[near], bases[near] & 0xDF, quals[near]  # upper case
            held[0] += np.bincount(cycle, weights=quals - 33.0, minlength=CYCLES).astype(np.int64)
            held[1] += np.bincount(cycle, minlength=CYCLES)
            for i, b in enumerate(b"ACGT"):
                held[2 + i] += np.bincount(cycle[bases == b], minlength=CYCLES)
        seen = np.flatnonzero(held[1])
        yield pa.RecordBatch.from_arrays([pa.array((seen + 1).astype(np.int32)), *(pa.array(h[seen]) for h in held)], names=names)

    d = reads.select("seq", "qual").mapInArrow(count, "cycle int, q bigint, n bigint, n_a bigint, n_c bigint, n_g bigint, n_t bigint")
    d = d.groupBy("cycle").agg(*(F.sum(c).alias(c) for c in names[1:]))
    other = F.col("n") - F.col("n_a") - F.col("n_c") - F.col("n_g") - F.col("n_t")
    return d.select("cycle", F.round(F.col("q") / F.col("n"), 6).alias("mean_quality"), *names[3:], other.alias("n_other"))


def over_cycle_limit(reads: DataFrame) -> DataFrame:
    """One row: how many reads are longer than the cycles reported."""
    return reads.agg(F.count_if(F.char_length("seq") > CYCLES).alias("reads_over_cycle_limit"))


def phred64(histogram: DataFrame) -> DataFrame:
    """One row: does the quality histogram look like Phred+64?"""
    n = F.sum("n")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    q = F.col("q")
    s = histogram.agg(part(q < 31).alias("low"), part(q > 72).alias("high"), part(q.between(61, 72)).alias("top"), F.coalesce(n, F.lit(0)).alias("total"))
    return s.select("low", "high", "top", ((F.col("low") == 0) & (F.col("high") == 0) & (F.col("top") > 0) & (F.col("top") * 100 >= F.col("total"))).alias("phred64"))


def is_phred64(qual: Column) -> Column:
    return qual.rlike("^[@-~]*$")


def to_phred33(qual: Column) -> Column:
    """Rebased qualities; what a Phred+64 file cannot hold is an error."""
    signs = [chr(c) for c in range(64, 127)]
    moved = F.translate(qual, "".join(signs), "".join(chr(ord(c) - 31) for c in signs))
    return F.when(is_phred64(qual), moved).otherwise(F.raise_error(F.concat(F.lit("not Phred+64: "), qual)))


def count_other(seq: Column) -> Column:
    """Bases that are not A, C, G, T in either case."""
    return F.char_length(F.regexp_replace(seq, "[ACGTacgt]", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


# ----------------------------------------------------------------------------- trimming


def _below(threshold: int) -> str:
    """Character class of qualities below the threshold."""
    top = chr(33 + threshold - 1)
    return f"[!-{chr(92) + top if top in chr(92) + ']^-' else top}]"


def cut_front(qual: Column, q: int) -> Column:
    """Leading bases to drop."""
    return F.char_length(F.regexp_extract(qual, f"^{_below(q)}*", 0)) if q > 0 else F.lit(0)


def cut_tail(qual: Column, q: int) -> Column:
    """Length left after dropping trailing bases."""
    return F.char_length(F.regexp_replace(qual, f"{_below(q)}+$", "")) if q > 0 else F.char_length(qual)


def _lengths(cut) -> Column:
    """A function of (bytes, starts, stops) as one of a string column that gives lengths kept."""

    @F.arrow_udf("int")
    def kept(column: pa.Array) -> pa.Array:
        data, at = _flat(column)
        return pa.array((cut(data, at[:-1], at[1:]) - at[:-1]).astype(np.int32))

    return kept


def cut_window(qual: Column, window: int, mean: float) -> Column:
    return _lengths(lambda d, a, b: _window(d, a, b, window, mean))(qual)


def cut_adapter(seq: Column, adapters: tuple[str, ...], min_overlap: int = 4, seed: int = 8, rate: float = 0.1) -> Column:
    o = TrimOptions(adapters=adapters, min_overlap=min_overlap, seed=seed, mismatch_rate=rate)
    return _lengths(lambda d, a, b: _adapter(d, a, b, o))(seq)


_VERDICT = "keep_from int, keep_to int, quality_trimmed boolean, adapter_trimmed boolean, drop_reason string"


def _judge(seq: pa.Array, qual: pa.Array, o: TrimOptions) -> pa.StructArray:
    """What trim() adds, for a batch of reads."""
    (bases, at), (quals, places) = _flat(seq), _flat(qual)
    if len(bases) != len(quals) or (at != places).any():
        raise ValueError("bases and qualities of a read differ in length")
    begin, end = at[:-1], at[1:]
    start = _front(quals, begin, end, o.front)
    stop = _window(quals, start, _tail(quals, start, end, o.tail), o.window, o.window_mean)
    cut = _adapter(bases, start, stop, o)
    n = cut - start
    other, quality = _prefix(_OTHER[bases]), _prefix(quals.astype(np.int64) - 33)
    mean = np.maximum(0, (quality[cut] - quality[start]) / np.maximum(n, 1))
    reason = np.where(n < o.min_length, "short", np.where(other[cut] - other[start] > o.max_n_rate * n, "n_rate", np.where(mean < o.min_mean_quality, "short", "kept")))
    made = [(start - begin).astype(np.int32), (cut - begin).astype(np.int32), stop - start < end - begin, cut < stop, reason]
    return pa.StructArray.from_arrays([pa.array(x) for x in made], names=[c.split()[0] for c in _VERDICT.split(", ")])


def trim(reads: DataFrame, o: TrimOptions) -> DataFrame:
    """Adds keep_from, keep_to, trimmed seq and qual, and drop_reason; order: front, tail, window,
    adapter, then the filters short, N share, mean quality."""

    @F.arrow_udf(_VERDICT)
    def judge(seq: pa.Array, qual: pa.Array) -> pa.Array:
        return _judge(seq, qual, o)

    d = reads.withColumn("qual", to_phred33(F.col("qual"))) if o.phred64 else reads
    d = d.withColumn("_t", judge("seq", "qual"))
    n = F.col("_t.keep_to") - F.col("_t.keep_from")
    cut = lambda c: F.substring(F.col(c), F.col("_t.keep_from") + 1, n)
    d = d.withColumn("seq", cut("seq")).withColumn("qual", cut("qual"))
    return d.select(*(c for c in d.columns if c != "_t"), "_t.*")
