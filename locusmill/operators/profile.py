"""Region-by-bin signal matrices, normalisation, meta-profiles, heat-map bands."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import intervals
from .fragments import flags_pass

Anchor = Literal["TSS", "TES", "center"]
Norm = Literal["raw", "CPM", "RPKM", "BPM"]


@dataclass(frozen=True)
class ProfileOptions:
    upstream: int = 1000
    downstream: int = 1000
    bins: int = 20
    anchor: Anchor = "TSS"
    mode: Literal["reads", "depth"] = "reads"
    min_mapq: int = 0
    stranded: bool = True
    extend: int = 0  # bases along the strand, for alignments that tell no fragment
    fragments: bool = False  # proper pairs stand for their fragment
    max_fragment: int = 0

    def __post_init__(self) -> None:
        if self.upstream < 0 or self.downstream < 0 or self.upstream + self.downstream < self.bins or self.bins < 1:
            raise ValueError("the window must hold at least one base per bin")
        if self.anchor not in ("TSS", "TES", "center") or self.mode not in ("reads", "depth"):
            raise ValueError("unknown anchor or mode")

    @property
    def width(self) -> int:
        return self.upstream + self.downstream


def anchor_position(o: ProfileOptions) -> Column:
    minus = (F.col("strand") == "-") if o.stranded else F.lit(False)
    if o.anchor == "center":
        return F.col("start") + F.floor((F.col("stop") - F.col("start")) / 2).cast("bigint")
    first = minus if o.anchor == "TSS" else ~minus
    return F.when(first, F.col("stop")).otherwise(F.col("start"))


def windows(regions: DataFrame, contigs: DataFrame, o: ProfileOptions) -> DataFrame:
    """name, contig, strand, w_start, w_stop (mirrored on the minus strand), skipped (contig unknown)."""
    minus = (F.col("strand") == "-") if o.stranded else F.lit(False)
    a = regions.withColumn("a", anchor_position(o)).join(contigs, "contig", "left")
    return a.select(
        "name", "contig", "strand",
        F.when(minus, F.col("a") - o.downstream).otherwise(F.col("a") - o.upstream).alias("w_start"),
        F.when(minus, F.col("a") + o.upstream).otherwise(F.col("a") + o.downstream).alias("w_stop"),
        F.col("contig_length").isNull().alias("skipped"),
    )


def bin_bounds(b: Column, o: ProfileOptions) -> tuple[Column, Column]:
    """First offset of a bin inside its window, and the first one after it, by which depth is shared
    out and bins are named."""
    part = lambda x: F.floor(F.lit(o.width) * x / o.bins).cast("bigint")
    return part(b), part(b + 1)


def tally_bounds(b: Column, o: ProfileOptions) -> tuple[Column, Column]:
    """The same for counting reads: offset x falls into bin x * bins div width, so a bin begins at the
    first x with x * bins >= b * width."""
    part = lambda x: F.ceil(F.lit(o.width) * x / o.bins).cast("bigint")
    return part(b), part(b + 1)


def bin_offset(b: Column, o: ProfileOptions) -> Column:
    lo, hi = bin_bounds(b, o)
    return (F.lit(-o.upstream) + F.floor((lo + hi) / 2)).cast("bigint")


def passing(alignments: DataFrame, o: ProfileOptions) -> DataFrame:
    ok = flags_pass(F.col("flag"), 0, 0xF04)
    return alignments.filter(ok & (F.coalesce(F.col("mapq"), F.lit(255)) >= o.min_mapq))


def matrix(regions: DataFrame, alignments: DataFrame, contigs: DataFrame, o: ProfileOptions) -> DataFrame:
    """name, bin, bin_offset, value per region and bin of regions on known contigs.  Minus-strand
    rows read along the strand.  A bin's value is a difference of running sums at its two ends, so
    reads and regions are never paired.  Regions that share a name keep rows of their own."""
    w = windows(regions, contigs, o).filter("not skipped").withColumn("_region", F.monotonically_increasing_id())
    w = stored(w, "windows")  # numbered once
    reads = passing(alignments, o).groupBy("contig", "start", "stop").agg(F.count("*").alias("n"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(o.bins - 1).cast("bigint"))
    if o.mode == "reads":
        lo, hi = tally_bounds(F.col("bin"), o)
        spans = w.select("contig", "_region", "w_start", F.explode(every).alias("bin")).select("contig", (F.col("w_start") + lo).alias("start"), (F.col("w_start") + hi).alias("stop"), "_region", "bin")
        found = intervals.touching(spans, reads, "value").select("_region", "bin", F.col("value").cast("double").alias("value"))
    else:
        lo, hi = bin_bounds(F.col("bin"), o)
        ends = F.explode(F.array(F.struct((F.col("w_start") + lo).alias("pos"), F.lit(-1).alias("sign")), F.struct((F.col("w_start") + hi).alias("pos"), F.lit(1).alias("sign"))))
        edges = w.select("contig", "_region", "w_start", F.explode(every).alias("bin")).select("contig", "_region", "bin", ends.alias("e")).select("contig", "e.pos", "e.sign", "_region", "bin")
        bases = intervals.covered(edges, reads, "below").groupBy("_region", "bin").agg(F.sum(F.col("sign") * F.col("below")).alias("bases"))
        found = bases.select("_region", "bin", F.when(hi > lo, F.col("bases") / (hi - lo)).otherwise(0.0).alias("value"))
    d = found.join(w.select("_region", "name", "strand"), "_region")
    minus = (F.col("strand") == "-") if o.stranded else F.lit(False)
    d = d.withColumn("bin", F.when(minus, F.lit(o.bins - 1) - F.col("bin")).otherwise(F.col("bin")))
    return d.select("name", "bin", bin_offset(F.col("bin"), o).alias("bin_offset"), "value")


def normalised(m: DataFrame, total_reads: DataFrame, o: ProfileOptions, norm: Norm) -> DataFrame:
    """total_reads: one row, column n (mapped reads, before any filter)."""
    if norm == "raw":
        return m
    width = F.lit(o.width / o.bins)
    t = total_reads
    if norm == "BPM":
        t = m.agg(F.sum("value").alias("n")).select((F.col("n") / width).alias("n"))
    d = m.crossJoin(F.broadcast(t))  # one row
    factor = {"CPM": 1e6 / F.col("n"), "RPKM": 1e9 / (F.col("n") * width), "BPM": 1e6 / F.col("n") / width}[norm]
    return d.withColumn("value", F.col("value") * F.when(F.col("n") > 0, factor).otherwise(1.0)).drop("n")


def meta_profile(m: DataFrame) -> DataFrame:
    return m.groupBy("bin", "bin_offset").agg(F.avg("value").alias("mean"))


def row_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("name").agg(F.avg("value").alias("mean"), F.max("value").alias("top"))


def top_regions(m: DataFrame, n: int) -> DataFrame:
    return row_stats(m).orderBy(F.desc("mean"), "name").limit(n)


def placed(stats: DataFrame, buckets: int = 256) -> DataFrame:
    """stats (name, mean, ...) with `place`, counted from 0 in descending order of mean, and `rows`.
    Means are dealt into ranges cut at their quantiles; ranks run inside a range, and ranges' sizes are
    added up over one row each."""
    s = stored(stats, "row-stats")
    cuts = s.select(F.percentile_approx("mean", [i / buckets for i in range(1, buckets)]).alias("c")).first()["c"] or []
    bucket = F.aggregate(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))), F.lit(0), lambda a, c: a + (F.col("mean") >= c).cast("int")) if cuts else F.lit(0)
    d = s.withColumn("_b", bucket)
    sizes = d.groupBy("_b").agg(F.count("*").alias("_n"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), F.sum("_n").over(Window.partitionBy()).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("mean"), "name")) - 1
    return d.withColumn("_own", inside).join(F.broadcast(sizes), "_b").withColumn("place", F.col("_own") + F.col("_above")).drop("_b", "_own", "_above")


def top_share(m: DataFrame, share: float = 0.1) -> DataFrame:
    """The regions in the top share by mean, at least one."""
    r = placed(row_stats(m))
    return r.filter(F.col("place") < F.greatest(F.lit(1), F.floor(F.col("rows") * share))).drop("place", "rows")


def heatmap(m: DataFrame, bands: int) -> DataFrame:
    """Rows in descending order of mean, cut at rows * b / bands, averaged per band and bin."""
    m = stored(m, "matrix")
    r = placed(row_stats(m))
    # the band b with rows * b / bands <= place < rows * (b + 1) / bands, in whole numbers
    band = F.floor(((F.col("place") + 1) * bands - 1) / F.col("rows"))
    return m.join(r.select("name", band.cast("bigint").alias("band")), "name").groupBy("band", "bin").agg(F.avg("value").alias("mean"))


def count_reads(regions: DataFrame, alignments: DataFrame) -> DataFrame:
    """Alignments overlapping each region, regions without any included."""
    reads = alignments.groupBy("contig", "start", "stop").agg(F.count("*").alias("n"))
    r = regions.select("contig", "start", "stop", "name")
    found = intervals.touching(r.distinct(), reads, "_n")
    return r.join(found, ["contig", "start", "stop", "name"], "left").select("name", F.coalesce("_n", F.lit(0)).alias("n"))


# ----------------------------------------------------------------------------- alignments


def alignment_spans(alignments: DataFrame, extend: int = 0, fragments: bool = True, max_fragment: int = 0) -> DataFrame:
    """What each alignment covers: the fragment, told once by its leftmost mate and at most
    max_fragment long (0: any); else, with extend, that many bases along the strand; else the aligned
    part."""
    reverse = F.col("flag").bitwiseAND(F.lit(16)) > 0
    proper = (F.col("flag").bitwiseAND(F.lit(3)) == 3) & (F.col("tlen") != 0) if fragments else F.lit(False)
    told = (F.col("tlen") > 0) & (F.lit(max_fragment <= 0) | (F.col("tlen") <= max_fragment))
    start, stop = F.col("start"), F.col("stop")
    end = F.greatest(F.col("start") + F.col("tlen"), stop)
    first = F.when(proper, start).when(F.lit(extend > 0) & reverse, F.greatest(F.lit(0), stop - extend)).otherwise(start)
    last = F.when(proper, end).when(F.lit(extend > 0) & ~reverse, start + extend).otherwise(stop)
    return alignments.filter(~proper | told).withColumn("span_start", first).withColumn("span_stop", last)


def signal(alignments: DataFrame, o: ProfileOptions) -> DataFrame:
    """Alignments as the profile counts them: spans, or, for the depth of alignments as they are, the
    stretches their CIGARs align."""
    if o.fragments or o.extend:
        d = alignment_spans(alignments, o.extend, o.fragments, o.max_fragment)
        return d.withColumn("start", F.col("span_start")).withColumn("stop", F.col("span_stop")).drop("span_start", "span_stop")
    return cigar_blocks(alignments) if o.mode == "depth" and "cigar" in alignments.columns else alignments


def cigar_blocks(alignments: DataFrame) -> DataFrame:
    """The reference stretches that M, = and X operations align; D and N skip, I, S, H and P take no
    reference."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    first = F.struct(F.col("start").cast("bigint").alias("at"), empty.alias("made"))

    def step(a: Column, c: Column) -> Column:
        moves, aligned = c["op"].isin("M", "=", "X", "D", "N"), c["op"].isin("M", "=", "X")
        after = a["at"] + F.when(moves, c["len"]).otherwise(0)
        block = F.struct(a["at"].alias("start"), after.alias("stop"))
        return F.struct(after.alias("at"), F.when(aligned, F.array_append(a["made"], block)).otherwise(a["made"]).alias("made"))

    keep = [c for c in alignments.columns if c not in ("start", "stop", "cigar")]
    d = alignments.withColumn("_b", F.aggregate("cigar", first, step, lambda a: a["made"]))
    return d.select(*keep, F.explode("_b").alias("_b")).select(*keep, "_b.start", "_b.stop")
