"""Peak calling: pileup, local background, Poisson scores, islands, summits, false discovery control.

Per-base work is done in stretches of STRETCH bases, one task each: the runs of a stretch and of its
surroundings become a depth array, the background around a base is a difference of two of its prefix
sums, and what leaves the task are the bases asked for.  Only runs are ever shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import poisson
from ..storage import stored
from . import intervals
from .fragments import flags_pass, out_of_order

SCALES = (1000, 5000, 10000)
STRETCH = 1 << 17
REACH = max(SCALES) // 2
MAX_FRAGMENT = 4096


@dataclass(frozen=True)
class PeakOptions:
    cutoff: float = 2.0  # -log10 p
    max_gap: int = 30
    min_length: int = 50
    alpha: float = 0.05
    extend: int = 0

    def __post_init__(self) -> None:
        if self.cutoff <= 0:
            raise ValueError("a cutoff of 0 would call uncovered bases")
        if self.max_gap < 0 or self.min_length < 1 or not 0 < self.alpha <= 1 or self.extend < 0:
            raise ValueError("peak options out of range")


def runs(fragments: DataFrame) -> DataFrame:
    """(contig, start, stop, depth): maximal stretches between events, covered ones only."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("d"))))
    e = fragments.select("contig", ends.alias("e")).groupBy("contig", F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d"))
    e = stored(e, "pileup-events")
    e = stored(intervals.running(e, ["start"], F.col("d"), "sum", "depth"), "pileup-depths")
    e = intervals.following(e, "start", "stop")
    return e.filter("depth > 0").select("contig", "start", "stop", F.col("depth").cast("bigint").alias("depth"))


def pileup_runs(fragments: DataFrame) -> DataFrame:
    """Runs with neighbours of equal depth joined."""
    r = runs(fragments)
    r = stored(r, "runs")
    w = intervals.running(r, ["start"], F.struct("stop", "depth"), "max", "_last", inclusive=False)
    w = stored(w, "runs")
    fresh = F.when((F.col("_last.stop") == F.col("start")) & (F.col("_last.depth") == F.col("depth")), 0).otherwise(1)
    d = intervals.running(w, ["start"], fresh, "sum", "island")
    return d.groupBy("contig", "island", "depth").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("contig", "start", "stop", "depth")


def genome_rate(pileup: DataFrame, contigs: DataFrame) -> DataFrame:
    total = pileup.agg(F.coalesce(F.sum((F.col("stop") - F.col("start")) * F.col("depth")), F.lit(0)).alias("total"))
    return total.crossJoin(contigs.agg(F.sum("contig_length").alias("size"))).select((F.col("total") / F.col("size")).alias("lambda_bg"))  # one row each


_BASE = ", ".join(["contig string", "pos bigint", "k bigint", *(f"{x}_{s} bigint" for s in SCALES for x in "sw"), "lam double", "score double"])


def _base_scan(rate: float, cutoff: float | None) -> Callable[[pa.Table], pa.Table]:
    names = [c.split()[0] for c in _BASE.split(", ")]

    def scan(table: pa.Table) -> pa.Table:
        contig, stretch, length = (table.column(c)[0].as_py() for c in ("contig", "stretch", "contig_length"))
        low = stretch * STRETCH - REACH
        size = STRETCH + 2 * REACH
        start, stop, depth = (table.column(c).to_numpy() for c in ("start", "stop", "depth"))
        step = np.zeros(size + 1, np.int64)
        np.add.at(step, np.clip(start - low, 0, size), depth)
        np.add.at(step, np.clip(stop - low, 0, size), -depth)
        depth = np.cumsum(step[:-1])
        below = np.concatenate([[0], np.cumsum(depth)])
        last = min(STRETCH, length - stretch * STRETCH)
        at = np.flatnonzero(depth[REACH : REACH + max(0, last)]) + REACH
        pos, k = at + low, depth[at]
        made, lam = [], np.full(len(at), rate)
        for s in SCALES:
            a, b = np.maximum(0, pos - s // 2), np.minimum(length, pos + s // 2)
            made += [below[b - low] - below[a - low], b - a]
            lam = np.maximum(lam, made[-2] / made[-1])
        keep = np.arange(len(at))
        score = np.full(len(at), np.nan)
        if cutoff is not None:
            if cutoff > 0.30103:  # the median of a Poisson variable is above lam - ln 2
                keep = keep[k > lam - 0.6931471805599453]
            # nor can a base pass that the bound keeps below the cutoff as a float
            keep = keep[poisson.bounds(k[keep], lam[keep]) >= cutoff - 1e-3]
            score[keep] = poisson.scores(k[keep], lam[keep])
        columns = [np.full(len(keep), contig, object), *(x[keep] for x in (pos, k, *made, lam, score))]
        return pa.table([pa.array(x) if i else pa.array(x, pa.string()) for i, x in enumerate(columns)], names=names)

    return scan


def base_table(pileup: DataFrame, contigs: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(contig, pos, k, s_<scale>, w_<scale>, lam, score) of covered bases: depth, coverage sum and width
    of the windows [pos - scale / 2, pos + scale / 2) cut at the contig's ends, and the largest of the
    genome rate and the three local rates.  With a cutoff, bases that could reach it are scored and the
    others left out; a cutoff of 0 scores all.  Without one score is NaN."""
    rate = genome_rate(pileup, contigs).first()["lambda_bg"] or 0.0  # one number
    first = F.greatest(F.lit(0), F.floor((F.col("start") - REACH) / STRETCH)).cast("bigint")
    last = F.floor((F.col("stop") - 1 + REACH) / STRETCH).cast("bigint")
    d = pileup.join(contigs, "contig").withColumn("stretch", F.explode(F.sequence(first, last)))
    return d.groupBy("contig", "stretch").applyInArrow(_base_scan(rate, cutoff), _BASE)


def candidates(d: DataFrame, o: PeakOptions) -> DataFrame:
    """Islands of bases at or above the cutoff.  Two such bases belong together if they are at most
    max(2, max_gap + 1) apart; scores are compared as floats; the summit is the middle of the first
    stretch of adjacent bases that hold the maximum."""
    d = d.withColumn("score", F.col("score").cast("float")).filter(F.col("score") >= F.lit(o.cutoff).cast("float"))
    d = stored(d, "passing")
    d = intervals.running(d, ["pos"], F.col("pos"), "max", "_before", position="pos", inclusive=False)
    d = stored(d, "above-cutoff")
    fresh = F.when(F.col("pos") - F.col("_before") <= max(2, o.max_gap + 1), 0).otherwise(1)
    d = stored(intervals.running(d, ["pos"], fresh, "sum", "island", position="pos"), "islands")
    peak = d.groupBy("contig", "island").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.max("score").alias("summit_score"), F.sum("k").alias("total_signal")
    ).filter(F.col("stop") - F.col("start") >= o.min_length)
    top = d.join(peak.select("contig", "island", "summit_score"), ["contig", "island"]).filter("score = summit_score")
    w = Window.partitionBy("contig", "island").orderBy("pos")
    top = top.withColumn("_run", F.col("pos") - F.row_number().over(w))
    first = top.groupBy("contig", "island", "_run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min_by("lam", "pos").alias("summit_lambda"))
    first = first.groupBy("contig", "island").agg(F.min(F.struct("lo", "hi", "summit_lambda")).alias("f"))
    summit = F.col("f.lo") + F.floor((F.col("f.hi") - F.col("f.lo")) / 2)
    return peak.join(first, ["contig", "island"]).select("contig", "start", "stop", summit.cast("bigint").alias("summit"), "summit_score", "total_signal")


def benjamini_hochberg(peaks: DataFrame, order: tuple[str, ...] = ("contig", "start")) -> DataFrame:
    """Adds `q`: -log10 q values by step-up over all candidates.  The statistic is global; it is taken
    over distinct scores (counts before each), so what one task orders is the distinct float scores
    and not the peaks.  Ties share the value of the last of them, as the step-up gives."""
    levels = peaks.groupBy("summit_score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("summit_score"))
    levels = levels.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy()))
    adjusted = F.greatest(F.lit(0.0), F.col("summit_score").cast("double") - F.log10("m") + F.log10("rank"))
    below = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = levels.withColumn("adjusted", adjusted).withColumn("q", F.max("adjusted").over(below).cast("float"))
    return peaks.join(q.select("summit_score", "q"), "summit_score")


#: Flags of fragments that peaks are called on, for alignments: bits that exclude and that are required.
EXCLUDE, REQUIRE = 0xF0C, 0x2


def from_alignments(alignments: DataFrame, contigs: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Fragments of proper, primary, unmarked pairs, told by the leftmost mate, of 1 to MAX_FRAGMENT bases
    and inside their contig."""
    ok = flags_pass(F.col("flag"), REQUIRE, EXCLUDE) & F.col("tlen").between(1, MAX_FRAGMENT) & (F.coalesce(F.col("mapq"), F.lit(255)) >= min_mapq)
    d = alignments.filter(ok).withColumn("stop", F.col("start") + F.col("tlen")).join(contigs.select("contig", "contig_length"), "contig")
    return d.filter((F.col("start") >= 0) & (F.col("stop") <= F.col("contig_length"))).drop("contig_length")


def refused(fragments: DataFrame, contigs: DataFrame, order: str | None = None) -> DataFrame:
    """One row: how many records a strict reader refuses, by reason; with an order also records that are
    not grouped by contig or not sorted by start."""
    d = fragments.join(contigs.select("contig", "contig_length"), "contig", "left")
    n = F.col("stop") - F.col("start")
    bad = F.col("contig").isNull() | F.col("start").isNull() | F.col("stop").isNull()
    reason = (
        F.when(bad, "malformed").when(F.col("contig_length").isNull(), "unknown_contig").when(F.col("start") < 0, "negative_start")
        .when(n <= 0, "empty_interval").when(F.col("stop") > F.col("contig_length"), "beyond_contig").when(n > MAX_FRAGMENT, "too_long")
    )
    kinds = ["malformed", "unknown_contig", "negative_start", "empty_interval", "beyond_contig", "too_long"]
    out = d.select(reason.alias("r")).agg(F.count("*").alias("records"), *(F.count_if(F.col("r") == k).alias(k) for k in kinds))
    return out.crossJoin(out_of_order(fragments, order).select("out_of_order")) if order else out  # one row each


def call(fragments: DataFrame, contigs: DataFrame, o: PeakOptions = PeakOptions()) -> DataFrame:
    """All candidates with q values."""
    f = fragments.filter((F.col("stop") - F.col("start")).between(1, MAX_FRAGMENT))
    pileup = stored(runs(f), "pileup")
    d = base_table(pileup, contigs, o.cutoff).select("contig", "pos", "k", "lam", "score")
    return benjamini_hochberg(stored(candidates(d, o), "candidates"))


def gate(peaks: DataFrame, alpha: float) -> DataFrame:
    return peaks.filter(F.col("q") >= F.lit(-math.log10(alpha)).cast("float"))


def extended(peaks: DataFrame, contigs: DataFrame, by: int) -> DataFrame:
    """Reported bounds widened on both sides, inside the contig."""
    d = peaks.join(contigs, "contig")
    return d.withColumn("start", F.greatest(F.lit(0), F.col("start") - by)).withColumn("stop", F.least("contig_length", F.col("stop") + by)).drop("contig_length")


def narrow_peak(peaks: DataFrame) -> DataFrame:
    """Ten columns of the narrowPeak format; peaks are numbered in genome order."""
    number = intervals.running(peaks, ["start"], F.lit(1), "sum", "number")
    per = peaks.groupBy("contig").agg(F.count("*").alias("n"))
    before = per.select("contig", F.coalesce(F.sum("n").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    d = number.join(before, "contig")
    return d.select(
        F.col("contig").alias("chrom"),
        "start",
        "stop",
        F.concat(F.lit("peak_"), (F.col("before") + F.col("number")).cast("string")).alias("name"),
        F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(F.col("q").cast("double") * 10))).cast("bigint").alias("score"),
        F.lit(".").alias("strand"),
        F.round(F.col("total_signal") / (F.col("stop") - F.col("start")), 5).alias("fold"),
        F.round(F.col("summit_score").cast("double"), 5).alias("neg_log10_p"),
        F.round(F.col("q").cast("double"), 5).alias("neg_log10_q"),
        (F.col("summit") - F.col("start")).alias("summit_offset"),
    )
