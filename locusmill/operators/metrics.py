"""Agreement measures between results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import intervals


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def _levels(df: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """Distinct values with how often each occurs (_n) and how many rows lie below it (_before).  Values
    are dealt into ranges cut at quantiles, ordered inside them, and ranges' sizes added up."""
    c = stored(df.groupBy(column).agg(F.count("*").alias("_n")), "levels")
    cuts = sorted(set(c.select(F.percentile_approx(F.col(column).cast("double"), [i / buckets for i in range(1, buckets)]).alias("c")).first()["c"] or []))
    bucket = F.aggregate(F.array(*(F.lit(float(x)) for x in cuts)), F.lit(0), lambda a, x: a + (F.col(column).cast("double") >= x).cast("int")) if cuts else F.lit(0)
    c = c.withColumn("_b", bucket)
    sizes = c.groupBy("_b").agg(F.sum("_n").alias("_s"))
    sizes = sizes.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_under"))
    inside = F.sum("_n").over(Window.partitionBy("_b").orderBy(column)) - F.col("_n")
    return c.withColumn("_own", inside).join(F.broadcast(sizes), "_b").select(column, "_n", (F.col("_own") + F.col("_under")).alias("_before"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank with ties averaged, through counts per distinct value rather than an order of all rows."""
    return df.join(_levels(df, column).select(column, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out)), column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    d = average_ranks(average_ranks(df.select(F.col(x).alias("x"), F.col(y).alias("y")), "x", "rx"), "y", "ry")
    return d.agg(F.corr("rx", "ry").alias("spearman"))


def histogram_ks(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest gap of two cumulative histograms (value, n)."""
    j = a.select(F.col(value).alias("v"), F.col("n").alias("na")).join(b.select(F.col(value).alias("v"), F.col("n").alias("nb")), "v", "full_outer")
    w = Window.orderBy("v")
    run = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w) / F.sum(F.coalesce(c, F.lit(0))).over(Window.partitionBy())
    d = j.select((run("na") - run("nb")).alias("gap"))
    return d.agg(F.max(F.abs("gap")).alias("ks"))


def set_jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(both.alias("shared"), F.count("*").alias("either"), (both / F.count("*")).alias("jaccard"))


def interval_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared over covered bases of two interval sets."""
    ma, mb = stored(intervals.merge(a), "merged"), stored(intervals.merge(b), "merged")
    size = lambda d, n: d.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias(n))
    hit = intervals.overlap_join(ma, mb).agg(F.coalesce(F.sum(F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start")), F.lit(0)).alias("shared"))
    d = size(ma, "a").crossJoin(size(mb, "b")).crossJoin(hit)  # one row each
    either = F.col("a") + F.col("b") - F.col("shared")
    return d.select("shared", either.alias("either"), F.when(either > 0, F.col("shared") / either).otherwise(0.0).alias("jaccard"))


def match_peaks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best partner of each left peak by intersection over union, the earliest of equals; a right peak
    serves once, the first left peak in genome order that wants it, and the others stay alone."""
    # equal intervals want the same partner, and of equal ones only the first by name wants or is wanted first
    one = lambda d: d.groupBy("contig", "start", "stop").agg(F.min("name").alias("name"))
    p = intervals.overlap_join(one(a), one(b))
    inter = F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start")
    iou = inter / (F.greatest("l_stop", "r_stop") - F.least("l_start", "r_start"))
    # the best partner is an aggregate, so a peak with very many partners is no single task's work
    want = F.struct((-iou).alias("worse"), "r_start", "r_stop", "r_name")
    left = p.groupBy("l_contig", "l_start", "l_stop", "l_name").agg(F.min(want).alias("w"))
    first = F.struct("l_start", "l_stop", "l_name", "w.worse")
    right = left.groupBy("l_contig", "w.r_start", "w.r_stop", "w.r_name").agg(F.min(first).alias("f"))
    return right.select(F.col("f.l_name").alias("a_name"), F.col("r_name").alias("b_name"), (-F.col("f.worse")).alias("iou"))


def relative_error(observed: Column, expected: Column) -> Column:
    """|observed - expected| / |expected|; two zeros agree, anything else over zero and numbers that are
    not finite have none."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    over = F.when(expected != 0, F.abs(observed - expected) / F.abs(expected)).when(observed == 0, 0.0)
    return F.when(finite(observed) & finite(expected), over)


def row_agreement(df: DataFrame, row: str, x: str, y: str) -> DataFrame:
    """Pearson's r of x and y inside each row; of the rows that have one: how many, the median, the tenth
    percentile (by place) and the share above 0.95.  One row; ordered are rounded values of r."""
    r = df.groupBy(row).agg(F.corr(x, y).alias("r")).filter(F.col("r").isNotNull() & ~F.isnan("r"))
    h = r.groupBy(F.round("r", 6).alias("v")).agg(F.count("*").alias("n"))  # at most two million values
    h = h.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("cum"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    at = lambda part: F.min(F.when(F.col("cum") > F.floor(F.col("rows") / part), F.col("v")))
    return h.agg(F.max("rows").alias("rows"), at(2).alias("median_r"), at(10).alias("p10_r"), F.round(F.sum(F.when(F.col("v") > 0.95, F.col("n")).otherwise(0)) / F.max("rows"), 6).alias("above_95"))


def least_squares_scale(df: DataFrame, x: str, y: str) -> DataFrame:
    """Factor that fits x to y, and the largest residual in percent of the largest y."""
    s = df.agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("scale"), F.max(F.abs(F.col(y))).alias("_top"))
    d = df.crossJoin(F.broadcast(s))  # one row
    return d.agg(F.first("scale").alias("scale"), (100 * F.max(F.abs(F.col(y) - F.col("scale") * F.col(x))) / F.first("_top")).alias("max_residual_percent"))
