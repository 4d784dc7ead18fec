"""Fragment statistics: sizes, drop reasons, duplicates, library size, fraction in peaks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals

MAX_HISTOGRAM = 2000  # longer fragments count in totals and overflow only
MAX_COORDINATE = 2**31 - 1


@dataclass(frozen=True)
class FragmentFilter:
    min_mapq: int = 0
    min_length: int = 1
    max_length: int = 1000  # 0: no limit

    def __post_init__(self) -> None:
        if self.min_mapq < 0 or self.min_length < 0 or self.max_length < 0:
            raise ValueError("filter bounds must not be negative")


def flags_pass(flag: Column, require: int = 0x2, exclude: int = 0xB04) -> Column:
    return (flag.bitwiseAND(F.lit(exclude)) == 0) & (flag.bitwiseAND(F.lit(require)) == require)


def drop_reason(f: FragmentFilter = FragmentFilter()) -> Column:
    """First reason that applies, or 'kept'."""
    n = F.col("stop") - F.col("start")
    return (
        F.when(F.col("contig").isNull() | (F.col("start") < 0) | (F.col("stop") > MAX_COORDINATE), "malformed")
        .when(F.coalesce(F.col("mapq"), F.lit(255)) < f.min_mapq, "low_mapq")
        .when((n <= 0) | (n < f.min_length), "too_short")
        .when((F.lit(f.max_length) > 0) & (n > f.max_length), "too_long")
        .otherwise("kept")
    )


def kept(fragments: DataFrame, f: FragmentFilter = FragmentFilter()) -> DataFrame:
    return fragments.filter(drop_reason(f) == "kept")


def copies(fragments: DataFrame) -> Column:
    """What a record stands for: its copy count where the source carries one (column n), else 1."""
    return F.col("n").cast("bigint") if "n" in fragments.columns else F.lit(1).cast("bigint")


def drop_reasons(fragments: DataFrame, f: FragmentFilter = FragmentFilter()) -> DataFrame:
    return fragments.groupBy(drop_reason(f).alias("reason")).agg(F.sum(copies(fragments)).alias("n"))


def size_histogram(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy((F.col("stop") - F.col("start")).alias("length")).agg(F.sum(copies(fragments)).alias("n"))


def nearest_rank(histogram: DataFrame, value: str, fractions: dict[str, float], cap: int | None = None) -> DataFrame:
    """One row: for each fraction q the first value whose cumulative count exceeds floor(q * (n - 1)).
    The histogram has one row per distinct value, so one ordered pass over it is small."""
    v = F.least(F.col(value), F.lit(cap)) if cap else F.col(value)
    h = histogram.select(v.alias("v"), F.sum("n").over(Window.orderBy(value)).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return h.agg(*(F.min(F.when(F.col("cum") > F.floor((F.col("total") - 1) * q), F.col("v"))).alias(k) for k, q in fractions.items()))


def size_report(fragments: DataFrame) -> DataFrame:
    """Count, mean, nearest-rank percentiles, sub- and mononucleosomal shares, overflow: one row."""
    h = size_histogram(fragments)
    n = F.sum("n")
    share = lambda a, b: F.coalesce(F.sum(F.when(F.col("length").between(a, b), F.col("n"))), F.lit(0)) / n
    basic = h.agg(
        n.alias("fragments"),
        F.round(F.sum(F.col("length") * F.col("n")) / n, 6).alias("mean_length"),
        F.round(share(1, 99), 6).alias("sub_nucleosomal"),
        F.round(share(180, 247), 6).alias("mono_nucleosomal"),
        F.coalesce(F.sum(F.when(F.col("length") > MAX_HISTOGRAM, F.col("n"))), F.lit(0)).alias("overflow"),
    )
    return basic.crossJoin(nearest_rank(h, "length", {"p10": 0.1, "median": 0.5, "p90": 0.9}, MAX_HISTOGRAM))  # one row each


KEY = ("contig", "start", "stop", "reverse")


def duplicate_keys(fragments: DataFrame) -> DataFrame:
    """Key, copies: the first of a key's copies is kept, the others are duplicates."""
    return fragments.groupBy(*KEY).agg(F.sum(copies(fragments)).alias("copies"))


def mark_duplicates(fragments: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `duplicate`: not the first of its key in the given order.  A key with very many
    copies is ordered in slices: only each slice's first rows meet."""
    slices = F.pmod(F.xxhash64(*order), F.lit(32))
    d = fragments.withColumn("_slice", slices)
    first = d.groupBy(*KEY).agg(F.min(F.struct(*order)).alias("_first"))
    d = d.join(first, list(KEY))
    w = Window.partitionBy(*KEY, "_slice").orderBy(*order)
    own = (F.struct(*order) == F.col("_first")) & (F.row_number().over(w) == 1)
    return d.withColumn("duplicate", ~own).drop("_slice", "_first")


def duplicate_stats(fragments: DataFrame) -> DataFrame:
    """examined, unique, duplicates, duplicate_rate, peak_live_keys: one row."""
    k = duplicate_keys(fragments)
    live = k.groupBy("contig", "start").agg(F.count("*").alias("live"), F.sum("copies").alias("copies"))
    s = live.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("examined"), F.coalesce(F.sum("live"), F.lit(0)).alias("unique_fragments"), F.coalesce(F.max("live"), F.lit(0)).alias("peak_live_keys"))
    dup = F.col("examined") - F.col("unique_fragments")
    rate = F.when(F.col("examined") > 0, dup / F.col("examined")).otherwise(0.0)
    return s.select("examined", "unique_fragments", dup.alias("duplicates"), F.round(rate, 6).alias("duplicate_rate"), "peak_live_keys")


def library_size(examined: int, unique: int) -> float:
    """Lander-Waterman estimate by bisection; 0 without duplicates or with nothing but."""
    if unique <= 0 or unique >= examined:
        return 0.0
    f = lambda x: unique / x - 1 + math.exp(-examined / x)
    low, high = float(unique), float(unique)
    while f(high) > 0:
        high *= 10
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def out_of_order(fragments: DataFrame, order: str = "rec_idx", slices: int = 64) -> DataFrame:
    """One row: how many records start before an earlier one of their contig, or return to a contig
    after another one.  Records are numbered by `order`; neighbours meet inside slices of it, and
    slice ends meet in one small pass."""
    top = fragments.agg(F.max(order).alias("_top"))
    d = fragments.crossJoin(F.broadcast(top)).withColumn("_slice", F.floor(F.col(order) * slices / (F.col("_top") + 1)).cast("int"))
    here = F.struct(F.col(order).alias("o"), "contig", "start")
    ends = d.groupBy("_slice").agg(F.max(here).alias("end"))
    prior = ends.select("_slice", F.lag("end").over(Window.orderBy("_slice")).alias("_end"))
    w = Window.partitionBy("_slice").orderBy(order)
    d = d.withColumn("_before", F.lag(here).over(w)).join(F.broadcast(prior), "_slice").withColumn("_before", F.coalesce("_before", "_end"))
    firsts = fragments.groupBy("contig").agg(F.min(order).alias("_first"))
    d = d.join(firsts, "contig")
    same = F.col("_before.contig") == F.col("contig")
    late = F.when(F.col("_before").isNull(), False).when(same, F.col("start") < F.col("_before.start")).otherwise(F.col("_first") < F.col(order))
    return d.agg(F.count_if(late).alias("out_of_order"), F.count("*").alias("records"))


def frip(fragments: DataFrame, peaks: DataFrame, genome: int, keep_duplicates: bool = True) -> DataFrame:
    """Fraction of fragments, and of their bases, in peaks, and the enrichment: one row."""
    cover = intervals.merge(peaks)
    d = duplicate_keys(fragments)
    d = d.withColumn("n", F.col("copies") if keep_duplicates else F.lit(1))
    d = intervals.overlap_bases(d, cover)
    size = F.col("stop") - F.col("start")
    covered = cover.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("peak_bases"), F.count("*").alias("peaks"))
    s = d.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fragments"),
        F.coalesce(F.sum(F.when(F.col("overlap") > 0, F.col("n"))), F.lit(0)).alias("in_peaks"),
        F.coalesce(F.sum(size * F.col("n")), F.lit(0)).alias("bases"),
        F.coalesce(F.sum(F.col("overlap") * F.col("n")), F.lit(0)).alias("bases_in_peaks"),
        F.coalesce(F.sum(F.col("copies") - F.col("n")), F.lit(0)).alias("excluded"),
    ).crossJoin(covered)  # one row each
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    frac, expected = over(F.col("in_peaks"), F.col("fragments")), F.col("peak_bases") / F.lit(genome)
    return s.select("fragments", "in_peaks", "bases", "bases_in_peaks", "excluded", "peaks", "peak_bases", F.round(frac, 6).alias("frip"), F.round(over(F.col("bases_in_peaks"), F.col("bases")), 6).alias("base_frip"), F.round(over(frac, expected), 6).alias("enrichment"))
