"""The seven public functions.  Each takes frames or paths and returns a Result."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fragments as frag
from .operators import intervals
from .operators import peaks as pk
from .operators import profile as pf
from .operators import reads as rd
from .sources import binary, text
from .sources.text import InvalidInput


class ToolError(RuntimeError):
    """A system or usage error."""


@dataclass
class Result:
    tool: str
    metrics: dict[str, Any]
    frames: dict[str, DataFrame] = field(default_factory=dict)
    wall_seconds: float = 0.0


def _timed(f: Callable[..., Result]) -> Callable[..., Result]:
    def run(*args, **options) -> Result:
        began = time.monotonic()
        result = f(*args, **options)
        result.wall_seconds = time.monotonic() - began
        return result

    run.__doc__, run.__name__ = f.__doc__, f.__name__
    return run


def _fragments(spark: SparkSession, source: DataFrame | str, with_counts: bool = False, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Fragments of a frame or file; what a file is, its first bytes say, and for text the name.  With
    regions, those that start in one of them."""
    d = _read_fragments(spark, source, with_counts)
    return intervals.starting_in(d, regions) if regions else d


def _read_fragments(spark: SparkSession, source: DataFrame | str, with_counts: bool) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    kind = binary.sniff(spark, source)
    if kind in ("bam", "sam", "cram"):
        return binary.bam_fragments(binary.alignments(spark, source, kind))
    if source.removesuffix(".gz").lower().endswith(".bedpe"):
        d = text.bedpe(spark, source)
        if not d.isEmpty() and d.filter("drop_reason <> 'malformed'").isEmpty():
            raise InvalidInput(f"every record of {source} is malformed")
        return d.filter("drop_reason = 'kept'").drop("drop_reason")
    d = text.fragment_bed(spark, source, with_counts)
    if not d.isEmpty() and d.filter("not malformed").isEmpty():
        raise InvalidInput(f"every record of {source} is malformed")
    return d.filter("not malformed").select("contig", "start", "stop", "n", F.lit(None).cast("int").alias("mapq"), F.lit(False).alias("reverse"))


def _row(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


@_timed
def fragment_sizes(spark: SparkSession, source: DataFrame | str, options: frag.FragmentFilter = frag.FragmentFilter(), with_counts: bool = False, regions: list[tuple[str, int, int]] | None = None) -> Result:
    """Length statistics, the histogram and why fragments were dropped."""
    f = _fragments(spark, source, with_counts, regions)
    drops = {r["reason"]: r["n"] for r in frag.drop_reasons(f, options).collect()}
    kept = frag.kept(f, options)
    return Result("sizes", _row(frag.size_report(kept)) | {"drops": drops}, {"histogram": frag.size_histogram(kept)})


@_timed
def mark_duplicates(spark: SparkSession, source: DataFrame | str, order: list[str] | None = None, with_counts: bool = False) -> Result:
    """Duplicate counts and the library size; marked rows if an order is given."""
    f = _fragments(spark, source, with_counts)
    m = _row(frag.duplicate_stats(f))
    m["library_size"] = frag.library_size(m["examined"], m["unique_fragments"])
    if order and len(order) == 1:
        m |= _row(frag.out_of_order(f, order[0]))
        if m["out_of_order"]:
            raise InvalidInput("records are not sorted by contig and start", m)
    return Result("markdup", m, {"marked": frag.mark_duplicates(f, order)} if order else {})


@_timed
def frip(spark: SparkSession, source: DataFrame | str, peaks: DataFrame | str, genome: int, keep_duplicates: bool = False, with_counts: bool = False, regions: list[tuple[str, int, int]] | None = None) -> Result:
    """Fraction of fragments in peaks.  No overlap together with unmatched contig names is an error."""
    f = _fragments(spark, source, with_counts, regions)
    p = text.peaks_bed(spark, peaks) if isinstance(peaks, str) else peaks
    m = _row(frag.frip(f, p, genome, keep_duplicates))
    strange = f.select("contig").distinct().join(p.select("contig").distinct(), "contig", "left_anti")
    if m["fragments"] and not m["in_peaks"] and not strange.isEmpty():
        raise InvalidInput("no fragment overlaps a peak, and contig names differ", m)
    return Result("frip", m, {"unmatched_contigs": strange})


@_timed
def call_peaks(spark: SparkSession, source: DataFrame | str, contigs: DataFrame | str, options: pk.PeakOptions = pk.PeakOptions(), min_mapq: int = 0) -> Result:
    """Peaks that pass the false discovery gate.  Input is read strictly: a malformed record, an unknown
    contig, an interval that is empty, too long or beyond its contig, and files that are not grouped by
    contig and sorted by start are errors."""
    c = text.chrom_sizes(spark, contigs) if isinstance(contigs, str) else contigs
    f, order = source, None
    if isinstance(source, str):
        kind = binary.sniff(spark, source)
        if kind in ("bam", "sam", "cram"):
            f, order = pk.from_alignments(binary.alignments(spark, source, kind), c, min_mapq), "rec_idx"
        else:
            f, order = text.ordered_bed(spark, source), "rec_idx"
    elif "rec_idx" in source.columns:
        order = "rec_idx"
    seen = _row(pk.refused(f, c, order))
    records = seen.pop("records")
    if any(seen.values()):
        raise InvalidInput("records are refused: " + ", ".join(f"{n} {k}" for k, n in seen.items() if n), {"records": records} | seen)
    found = pk.call(f, c, options)
    kept = pk.gate(found, options.alpha)
    kept = pk.extended(kept, c, options.extend) if options.extend else kept
    return Result("peaks", {"records": records, "candidates": found.count(), "peaks": kept.count()}, {"peaks": pk.narrow_peak(kept)})


@_timed
def profile(spark: SparkSession, regions: DataFrame | str, alignments: DataFrame | str, contigs: DataFrame, options: pf.ProfileOptions = pf.ProfileOptions(), norm: pf.Norm = "raw") -> Result:
    """Signal matrix and meta-profile.  An input whose every region is skipped is an error."""
    r = text.regions(spark, regions) if isinstance(regions, str) else regions
    a = binary.alignments(spark, alignments) if isinstance(alignments, str) else alignments
    w = _row(pf.windows(r, contigs, options).agg(F.count("*").alias("regions"), F.count_if("skipped").alias("skipped")))
    if w["regions"] and w["skipped"] == w["regions"]:
        raise InvalidInput("every region is on an unknown contig", w)
    m = pf.normalised(pf.matrix(r, pf.signal(a, options), contigs, options), a.agg(F.count("*").alias("n")), options, norm)
    return Result("profile", w, {"matrix": m, "profile": pf.meta_profile(m)})


def _reads(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    kind = binary.sniff(spark, source)
    if kind in ("bam", "sam", "cram"):
        return binary.bam_reads(binary.alignments(spark, source, kind))
    return binary.read_fastq(spark, source)


@_timed
def run_qc(spark: SparkSession, source: DataFrame | str) -> Result:
    """Totals, quality histogram and per-cycle figures; Phred+64 input is an error."""
    r = _reads(spark, source)
    h = rd.quality_histogram(r)
    m = _row(rd.totals(r)) | _row(rd.over_cycle_limit(r)) | _row(rd.phred64(h))
    if m["phred64"]:
        raise InvalidInput("qualities look like Phred+64", m)
    return Result("qc", m, {"quality_histogram": h, "report_histogram": rd.quality_histogram(r, fold=True), "per_cycle": rd.per_cycle(r)})


@_timed
def trim(spark: SparkSession, source: DataFrame | str, options: rd.TrimOptions = rd.TrimOptions()) -> Result:
    """Trimmed reads and counts of what was trimmed and dropped.  options.with_adapters() looks for the
    default adapters, options.with_adapters("ACGT...") for others."""
    d = rd.trim(_reads(spark, source), options)
    n = lambda reason: F.count_if(F.col("drop_reason") == reason)
    bases = F.coalesce(F.sum(F.when(F.col("drop_reason") == "kept", F.char_length("seq"))), F.lit(0))
    m = _row(
        d.agg(
            F.count("*").alias("reads"), F.count_if("quality_trimmed").alias("quality_trimmed"), F.count_if("adapter_trimmed").alias("adapter_trimmed"),
            n("kept").alias("kept"), n("short").alias("dropped_short"), n("n_rate").alias("dropped_n"), bases.alias("bases_out"),
        )
    )
    return Result("trim", m, {"reads": d.filter("drop_reason = 'kept'"), "dropped": d.filter("drop_reason <> 'kept'")})


def register_functions(spark: SparkSession) -> None:
    """SQL names for the functions Spark lacks."""
    from .functions import poisson

    spark.udf.register("poisson_score", poisson._score)
