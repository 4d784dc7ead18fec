"""Text sinks.  Each writes a folder of part files; `single` coalesces small results into one."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refuse_alias(source: str, target: str) -> None:
    """A result must not overwrite its own input."""
    plain = lambda p: os.path.realpath(p.removeprefix("file://"))
    if plain(source) == plain(target) or plain(source).startswith(plain(target) + os.sep):
        raise ValueError(f"{target} would overwrite the input {source}")


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("errorifexists").csv(path, sep="\t", header=True)


def write_histogram(histogram: DataFrame, path: str) -> None:
    write_tsv(histogram.filter("n > 0").select("length", F.col("n").alias("count")).orderBy("length"), path, single=True)


def write_narrow_peak(peaks: DataFrame, path: str) -> None:
    five = lambda c: F.format_string("%.5f", F.col(c))
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), "name", F.col("score").cast("string"), "strand", five("fold"), five("neg_log10_p"), five("neg_log10_q"), F.col("summit_offset").cast("string"))
    peaks.orderBy("chrom", "start").select(line.alias("value")).write.text(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """One line a region: its name and its bins' values, six places each."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("bin", "value"))), lambda c: F.format_string("%.6f", c["value"]))
    matrix.groupBy("name").agg(cells.alias("v")).orderBy("name").select(F.concat_ws("\t", "name", F.array_join("v", "\t")).alias("value")).write.text(path)


def write_profile(profile: DataFrame, path: str) -> None:
    """The mean signal at each bin's offset, six places."""
    d = profile.select(F.col("bin_offset").cast("bigint").alias("at"), F.concat_ws("\t", F.col("bin_offset").cast("string"), F.format_string("%.6f", F.col("mean"))).alias("value"))
    head = profile.sparkSession.createDataFrame([(None, "offset\tmean_signal")], "at bigint, value string")
    head.unionByName(d).repartition(1).sortWithinPartitions(F.col("at").asc_nulls_first()).select("value").write.text(path)  # a row a bin


def write_bed(fragments: DataFrame, path: str) -> None:
    """contig, start, stop, a dot for the name, and the copy count."""
    n = F.col("n") if "n" in fragments.columns else F.lit(1)
    fragments.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), n.cast("string")).alias("value")).write.text(path)


def write_fastq(reads: DataFrame, path: str, order: str = "rec_idx") -> None:
    reads.orderBy(order).select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value")).write.text(path)


def report_json(metrics: dict) -> str:
    return json.dumps(metrics, sort_keys=True, default=str)


def report_text(tool: str, source: str, m: dict, wall_seconds: float = 0.0) -> str:
    """The quality report as lines for people; `m` holds totals and, after trimming, what was kept."""
    percent = lambda part, whole: 100.0 * part / whole if whole else 0.0
    reads, bases = m.get("reads", 0), m.get("bases", 0)
    kept, left = m.get("kept", reads), m.get("bases_out", bases)
    lines = [
        f"{tool}",
        f"  input        : {source}",
        f"  reads        : {reads} in -> {kept} out ({percent(kept, reads):.2f}% kept)",
        f"  bases        : {bases} in -> {left} out ({percent(left, bases):.2f}% kept)",
        f"  quality      : mean Q{m.get('quality_sum', 0) / bases if bases else 0.0:.2f}  Q20 {percent(m.get('q20_bases', 0), bases):.2f}%  "
        f"Q30 {percent(m.get('q30_bases', 0), bases):.2f}%  GC {percent(m.get('gc_bases', 0), bases):.2f}%",
        f"  trimmed      : {m.get('adapter_trimmed', 0)} adapter, {m.get('quality_trimmed', 0)} quality",
        f"  dropped      : {m.get('dropped_short', 0)} too short / low quality, {m.get('dropped_n', 0)} excess N",
    ]
    if m.get("reads_over_cycle_limit"):
        lines.append(f"  per-cycle    : first cycles only; {m['reads_over_cycle_limit']} reads are longer")
    return "\n".join([*lines, f"  performance  : {wall_seconds:.2f}s wall"]) + "\n"
