"""Interval algebra on (contig, start, stop), half open.

A contig may hold a third of all rows, so nothing here is windowed by contig alone: ordered
operations run in two levels: inside position bins, then over one row per bin.  Lookups into a set of
intervals are running sums over both together, or binary searches where its size allows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

WIDE_BIN = 1_000_000
SLICE = 1024  # rows of one side of a bin that meet the other side in one piece
BROADCAST_ROWS = 500_000  # a cover of at most so many intervals (12 MB) goes to every task


def _bin(position: str, width: int) -> Column:
    return F.floor(F.col(position) / width).cast("bigint")


def running(df: DataFrame, order: list[str], value: Column, kind: str, out: str, position: str = "start", keys: tuple[str, ...] = ("contig",), width: int = WIDE_BIN, inclusive: bool = True) -> DataFrame:
    """df with a running 'sum' or 'max' of value by keys in the given order, which must begin with
    position.  Exclusive runs give null (max) or 0 (sum) to the first row."""
    agg = F.sum if kind == "sum" else F.max
    join2 = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if kind == "sum" else F.greatest
    d = df.withColumn("_bin", _bin(position, width)).withColumn("_v", value)
    per_bin = d.groupBy(*keys, "_bin").agg(agg("_v").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bin.select(*keys, "_bin", agg("_total").over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn("_own", agg("_v").over(inside)).join(carried, [*keys, "_bin"])
    return d.withColumn(out, join2(F.col("_own"), F.col("_carried"))).drop("_bin", "_v", "_own", "_carried")


def following(df: DataFrame, value: str, out: str, position: str = "start", keys: tuple[str, ...] = ("contig",), width: int = WIDE_BIN) -> DataFrame:
    """df with the next row's value in position order (positions are distinct within keys)."""
    d = df.withColumn("_bin", _bin(position, width))
    first = d.groupBy(*keys, "_bin").agg(F.min_by(value, position).alias("_first"))
    nxt = first.select(*keys, "_bin", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_next"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(position)
    d = d.withColumn("_own", F.lead(value).over(inside)).join(nxt, [*keys, "_bin"])
    return d.withColumn(out, F.coalesce("_own", "_next")).drop("_bin", "_own", "_next")


def merge(df: DataFrame, width: int = WIDE_BIN) -> DataFrame:
    """Union of intervals: overlapping and book-ended ones join; empty ones are dropped."""
    d = df.filter("stop > start").groupBy("contig", "start").agg(F.max("stop").alias("stop"))
    d = running(d, ["start"], F.col("stop"), "max", "before", width=width, inclusive=False)
    fresh = F.when(F.col("start") <= F.col("before"), 0).otherwise(1)
    d = running(d, ["start"], fresh, "sum", "island", width=width)
    return d.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def prefix_cover(cover: DataFrame) -> DataFrame:
    """A disjoint cover with the bases covered before each interval."""
    return running(cover, ["start"], F.col("stop") - F.col("start"), "sum", "covered_before", inclusive=False).withColumn("covered_before", F.col("covered_before").cast("bigint"))


def sums_below(points: DataFrame, events: DataFrame, values: list[str], width: int = WIDE_BIN) -> DataFrame:
    """points (contig, pos, ...) with the sum of each value over the events (contig, pos, values) at
    smaller positions of the contig.  Both meet in one ordered pass per position bin, and bins' totals
    are carried over one row per bin; neither empty stretches nor pairs are ever made.  A pass holds a
    row a place, however many points and events lie there, so a bin's width bounds it."""
    p = points.select("contig", "pos", F.lit(0).alias("_kind"), *(F.lit(0).cast("bigint").alias(f"_{v}") for v in values)).distinct()
    e = events.groupBy("contig", "pos").agg(*(F.sum(F.col(v).cast("bigint")).alias(f"_{v}") for v in values))
    e = stored(e, "events").select("contig", "pos", F.lit(1).alias("_kind"), *(f"_{v}" for v in values))
    totals = e.groupBy("contig", _bin("pos", width).alias("_bin")).agg(*(F.sum(f"_{v}").alias(f"_t_{v}") for v in values))
    d = p.unionByName(e).withColumn("_bin", _bin("pos", width))
    inside = Window.partitionBy("contig", "_bin").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("contig", "pos", "_bin", "_kind", *(F.sum(f"_{v}").over(inside).alias(v) for v in values)).filter("_kind = 0").drop("_kind")
    # bins of points may hold no event, so what is carried is looked up for the union of both
    wanted = p.select("contig", _bin("pos", width).alias("_bin")).distinct().join(totals, ["contig", "_bin"], "full_outer")
    before = Window.partitionBy("contig").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.select("contig", "_bin", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_t_{v}") for v in values))
    d = d.join(carried, ["contig", "_bin"])
    d = d.select("contig", "pos", *((F.col(v) + F.col(f"_t_{v}")).alias(v) for v in values))
    extra = [c for c in points.columns if c not in ("contig", "pos")]
    return points.join(d, ["contig", "pos"]).select("contig", "pos", *extra, *values) if extra else points.join(d, ["contig", "pos"])


def touching(spans: DataFrame, reads: DataFrame, out: str = "n") -> DataFrame:
    """spans (contig, start, stop, ...) with how many reads (contig, start, stop, weight n) share a base
    with each: the reads that start before its stop, less those that stop at or before its start.  Equal
    spans are counted once."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("n").alias("starts"), F.lit(0).cast("bigint").alias("stops")),
                             F.struct(F.col("stop").alias("pos"), F.lit(0).cast("bigint").alias("starts"), F.col("n").alias("stops"))))
    events = reads.filter("stop > start").select("contig", ends.alias("e")).select("contig", "e.*")
    s = spans.filter("stop > start")
    one = s.select("contig", "start", "stop").distinct()
    # stops at or before start are the stops below start + 1
    edges = F.explode(F.array(F.struct(F.col("stop").alias("pos"), F.lit(1).alias("sign")), F.struct((F.col("start") + 1).alias("pos"), F.lit(-1).alias("sign"))))
    d = sums_below(one.select("contig", "start", "stop", edges.alias("e")).select("contig", "e.pos", "start", "stop", "e.sign"), events, ["starts", "stops"])
    n = F.sum(F.when(F.col("sign") == 1, F.col("starts")).otherwise(-F.col("stops")))
    return s.join(d.groupBy("contig", "start", "stop").agg(n.alias(out)), ["contig", "start", "stop"]).select(*spans.columns, out)


def covered(edges: DataFrame, reads: DataFrame, out: str = "covered") -> DataFrame:
    """edges (contig, pos, ...) with the bases of reads (contig, start, stop, weight n) below pos."""
    n, z = F.col("n").cast("bigint"), F.lit(0).cast("bigint")
    event = lambda at, sign: F.struct(F.col(at).alias("pos"), (n * sign).alias("open"), (n * sign * F.col(at)).alias("weight"))
    e = reads.filter("stop > start").select("contig", F.explode(F.array(event("start", 1), event("stop", -1))).alias("e"))
    e = e.groupBy("contig", F.col("e.pos").alias("pos")).agg(F.sum("e.open").alias("open"), F.sum("e.weight").alias("weight"))
    # each start below x adds x - start bases, each stop takes x - stop away
    d = sums_below(edges, e, ["open", "weight"])
    return d.withColumn(out, F.coalesce(F.col("open") * F.col("pos") - F.col("weight"), z)).drop("open", "weight")


def overlap_bases(df: DataFrame, cover: DataFrame, out: str = "overlap", limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with the bases of each interval that a disjoint cover covers.  A cover of at most `limit`
    intervals is sent to the tasks, which look both ends up by binary search; a larger one meets the
    ends in order."""
    cover = stored(cover.select("contig", "start", "stop"), "cover")
    if cover.count() <= limit:
        return df.withColumn(out, _cover_lookup(cover)("contig", "start", "stop"))
    names = df.columns
    d = df.withColumn("_row", F.struct(*names))
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.col("stop").alias("pos"), F.lit(1).alias("sign"))))
    edges = d.withColumn("_uid", F.monotonically_increasing_id()).select("contig", "_row", "_uid", ends.alias("e")).select("contig", "e.pos", "e.sign", "_row", "_uid")
    below = covered(edges, cover.withColumn("n", F.lit(1)), "_below")
    return below.groupBy("_uid", "_row").agg(F.sum(F.col("sign") * F.col("_below")).alias(out)).select("_row.*", out)


def _cover_lookup(cover: DataFrame):
    rows = cover.toArrow()
    held: dict[str, tuple] = {}
    contig, start, stop = rows.column("contig").to_pandas().to_numpy(), rows.column("start").to_numpy(), rows.column("stop").to_numpy()
    for c in set(contig.tolist()):
        mine = np.flatnonzero(contig == c)
        mine = mine[np.argsort(start[mine], kind="stable")]
        s, e = start[mine], stop[mine]
        held[c] = s, e, np.concatenate([[0], np.cumsum(e - s)])
    shared = cover.sparkSession.sparkContext.broadcast(held)

    def below(c: tuple, x: np.ndarray) -> np.ndarray:
        s, e, total = c
        at = np.searchsorted(s, x)  # intervals that start below x
        return total[at] - np.where(at > 0, np.maximum(0, e[at - 1] - x), 0)

    @F.arrow_udf("bigint")
    def lookup(contig: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
        names = contig.dictionary_encode()
        which = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        a, b = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (start, stop))
        found = np.zeros(len(which), np.int64)
        for i, name in enumerate(names.dictionary.to_pylist()):
            if name in shared.value:
                mine = which == i
                found[mine] = np.where(b[mine] > a[mine], below(shared.value[name], b[mine]) - below(shared.value[name], a[mine]), 0)
        return pa.array(found)

    return lookup


def _width_for(left: DataFrame, right: DataFrame) -> int:
    """A bin width of four mean lengths: bins then repeat a quarter of the rows and pair few rows that
    do not overlap."""
    n = left.select("start", "stop").unionAll(right.select("start", "stop")).filter("stop > start").agg(F.avg(F.col("stop") - F.col("start")).alias("m")).first()["m"]
    return int(min(WIDE_BIN, max(64, 4 * (n or 0))))


def overlap_join(left: DataFrame, right: DataFrame, width: int = 0, most: int = SLICE) -> DataFrame:
    """All overlapping pairs, nested ones included; columns of left are l_*, of right r_*.  A pair is
    made once: in the bin where the later of the two starts lies.  A bin's rows of either side are dealt
    into slices of about `most`; each pair of slices is a key of its own, so the pairs of a deep bin are
    spread over all tasks.  width 0: by the lengths."""
    width = width or _width_for(left, right)

    def binned(df: DataFrame, side: str) -> DataFrame:
        d = df.filter("stop > start").select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
        first, last = F.floor(F.col(f"{side}_start") / width), F.floor((F.col(f"{side}_stop") - 1) / width)
        return d.withColumn("_contig", F.col(f"{side}_contig")).withColumn("_bin", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))

    lb, rb = binned(left, "l"), binned(right, "r")
    slices = lambda d, name: d.groupBy("_contig", "_bin").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = slices(lb, "_ls").join(slices(rb, "_rs"), ["_contig", "_bin"])  # bins that hold both sides
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["_contig", "_bin", "_i", "_j"]

    def dealt(d: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        d = d.withColumn("_h", F.xxhash64(*(c for c in d.columns if c[1] == "_"))).join(sizes, ["_contig", "_bin"])
        d = d.withColumn(own, F.pmod("_h", n_own).cast("int")).drop("_h")
        d = d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_ls", "_rs")
        return d.repartition(tasks, *keys)  # a given number is kept: few rows may make very many pairs

    d = dealt(lb, "_i", "_j", "_ls", "_rs").hint("merge").join(dealt(rb, "_j", "_i", "_rs", "_ls"), keys)
    d = d.filter((F.col("l_start") < F.col("r_stop")) & (F.col("r_start") < F.col("l_stop")))
    # both rows reach into the bin, so the later start lies in it unless it lies before it
    return d.filter(F.greatest("l_start", "r_start") >= F.col("_bin") * width).drop(*keys)


def tiles(df: DataFrame, width: int) -> DataFrame:
    """Rows with the tile that contains their start; tiles partition them exactly."""
    return df.withColumn("tile", _bin("start", width))


def starting_in(df: DataFrame, regions: list[tuple[str, int, int]]) -> DataFrame:
    """Rows of each region (contig, start, stop) in turn, a row belonging to the region that holds its
    start; regions that overlap repeat rows.  The filters reach the scan."""
    if not regions:
        return df.filter(F.lit(False))
    part = lambda r: df.filter((F.col("contig") == r[0]) & (F.col("start") >= r[1]) & (F.col("start") < r[2]))
    ordered = sorted(regions)
    if all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(ordered, ordered[1:], strict=False)):  # disjoint: one scan
        inside = F.lit(False)
        for c, a, b in ordered:
            inside = inside | ((F.col("contig") == c) & (F.col("start") >= a) & (F.col("start") < b))
        return df.filter(inside)
    out = part(regions[0])
    for r in regions[1:]:
        out = out.unionByName(part(r))
    return out
