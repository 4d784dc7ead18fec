"""Registered queries and their SQL oracles: one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fragments as frag
from ..operators import intervals, metrics, peaks, profile, reads, vectors
from ..sources import sinks, text
from ..storage import stored
from ..streaming import events
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = a.with_views(sql, *views) if views else sql
        return f

    return keep


GENOME = a.CONTIG_LENGTH * len(a.CONTIGS)

# ----------------------------------------------------------------------------- fragments

_RANK = "min(CASE WHEN cum > floor((total - 1) * {q}) THEN length END)"


@_add(
    "fragment_sizes",
    f"""WITH h AS (SELECT stop - start AS length, count(*) AS n FROM fragments WHERE stop - start BETWEEN 1 AND 1000 GROUP BY 1),
    c AS (SELECT length, n, sum(n) OVER (ORDER BY length) AS cum, sum(n) OVER () AS total FROM h)
    SELECT CAST(sum(n) AS BIGINT) AS fragments, round(sum(length * n) / sum(n), 6) AS mean_length,
      round(coalesce(sum(CASE WHEN length BETWEEN 1 AND 99 THEN n END), 0) / sum(n), 6) AS sub_nucleosomal,
      round(coalesce(sum(CASE WHEN length BETWEEN 180 AND 247 THEN n END), 0) / sum(n), 6) AS mono_nucleosomal,
      CAST(coalesce(sum(CASE WHEN length > 2000 THEN n END), 0) AS BIGINT) AS overflow,
      {_RANK.format(q=0.1)} AS p10, {_RANK.format(q=0.5)} AS median, {_RANK.format(q=0.9)} AS p90 FROM c""",
    "fragments",
)
def _(s, d):
    return frag.size_report(frag.kept(a.fragments(s, d)))


@_add("size_histogram", "SELECT stop - start AS length, count(*) AS n FROM fragments GROUP BY 1", "fragments")
def _(s, d):
    return frag.size_histogram(a.fragments(s, d))


_FILTER = frag.FragmentFilter(min_mapq=10, min_length=80, max_length=330)


@_add(
    "drop_reasons",
    """SELECT CASE WHEN start < 0 OR stop > 2147483647 THEN 'malformed' WHEN mapq < 10 THEN 'low_mapq' WHEN stop - start < 80 THEN 'too_short'
    WHEN stop - start > 330 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n FROM fragments GROUP BY 1""",
    "fragments",
)
def _(s, d):
    return frag.drop_reasons(a.fragments(s, d), _FILTER)


@_add(
    "markdup_stats",
    """WITH k AS (SELECT contig, start, stop, reverse, count(*) AS copies FROM fragments GROUP BY ALL), l AS (SELECT contig, start, count(*) AS live, sum(copies) AS copies FROM k GROUP BY 1, 2)
    SELECT CAST(sum(copies) AS BIGINT) AS examined, CAST(sum(live) AS BIGINT) AS unique_fragments, CAST(sum(copies) - sum(live) AS BIGINT) AS duplicates,
    round((sum(copies) - sum(live)) / sum(copies), 6) AS duplicate_rate, max(live) AS peak_live_keys FROM l""",
    "fragments",
)
def _(s, d):
    return frag.duplicate_stats(a.fragments(s, d))


_ALL = ["order_key", "line", "mapq", "start", "stop", "reverse", "contig"]


@_add(
    "markdup_rows",
    """SELECT contig, start, stop, reverse, count(*) AS copies, CAST(sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates
    FROM (SELECT *, row_number() OVER (PARTITION BY contig, start, stop, reverse ORDER BY order_key, line, mapq) AS r FROM fragments) GROUP BY 1, 2, 3, 4""",
    "fragments",
)
def _(s, d):
    m = frag.mark_duplicates(a.fragments(s, d), _ALL)
    return m.groupBy("contig", "start", "stop", "reverse").agg(F.count("*").alias("copies"), F.count_if("duplicate").alias("duplicates"))


def _numbered(s, d):
    f = a.fragments(s, d).filter("line = 1")  # the numbering below needs a key without ties
    return f.groupBy("order_key").agg(F.min(F.struct("contig", "start")).alias("f")).select(F.col("order_key").alias("rec_idx"), "f.contig", "f.start")


@_add(
    "out_of_order",
    """WITH r AS (SELECT order_key AS rec_idx, min(struct_pack(contig := contig, start := start)) AS f FROM fragments WHERE line = 1 GROUP BY 1),
    p AS (SELECT rec_idx, f.contig AS contig, f.start AS start, lag(f.contig) OVER (ORDER BY rec_idx) AS pc, lag(f.start) OVER (ORDER BY rec_idx) AS ps, min(rec_idx) OVER (PARTITION BY f.contig) AS fi FROM r)
    SELECT count(*) FILTER (WHERE CASE WHEN pc IS NULL THEN FALSE WHEN pc = contig THEN start < ps ELSE fi < rec_idx END) AS out_of_order, count(*) AS records FROM p""",
    "fragments",
)
def _(s, d):
    return frag.out_of_order(_numbered(s, d))


@_add(
    "library_size",
    """WITH RECURSIVE s AS (SELECT count(*) AS n, count(DISTINCT (contig, start, stop, reverse)) AS u FROM fragments),
    b(i, lo, hi) AS (SELECT 0, CAST(u AS DOUBLE), u * 1e7 FROM s UNION ALL
      SELECT i + 1, CASE WHEN u / ((lo + hi) / 2) - 1 + exp(-n / ((lo + hi) / 2)) > 0 THEN (lo + hi) / 2 ELSE lo END,
        CASE WHEN u / ((lo + hi) / 2) - 1 + exp(-n / ((lo + hi) / 2)) > 0 THEN hi ELSE (lo + hi) / 2 END FROM b, s WHERE i < 120)
    SELECT n AS examined, u AS unique_fragments, round((lo + hi) / 2 / 100) AS library_hundreds FROM b, s WHERE i = 120""",
    "fragments",
)
def _(s, d):
    row = frag.duplicate_stats(a.fragments(s, d)).first()
    size = frag.library_size(row["examined"], row["unique_fragments"])
    return s.createDataFrame([(row["examined"], row["unique_fragments"], float(round(size / 100)))], "examined bigint, unique_fragments bigint, library_hundreds double")


_FRIP = """WITH k AS (SELECT contig, start, stop, reverse, count(*) AS copies FROM fragments GROUP BY ALL),
    o AS (SELECT k.contig, k.start, k.stop, k.reverse, k.copies, sum(least(k.stop, c.stop) - greatest(k.start, c.start)) AS overlap FROM k
      JOIN cover c ON c.contig = k.contig AND k.start < c.stop AND c.start < k.stop GROUP BY ALL),
    t AS (SELECT k.*, coalesce(overlap, 0) AS overlap, {n} AS n FROM k LEFT JOIN o USING (contig, start, stop, reverse, copies)),
    z AS (SELECT CAST(sum(n) AS BIGINT) AS fragments, CAST(sum(CASE WHEN overlap > 0 THEN n ELSE 0 END) AS BIGINT) AS in_peaks, CAST(sum((stop - start) * n) AS BIGINT) AS bases,
      CAST(sum(overlap * n) AS BIGINT) AS bases_in_peaks, CAST(sum(copies - n) AS BIGINT) AS excluded FROM t),
    c AS (SELECT CAST(sum(stop - start) AS BIGINT) AS peak_bases, count(*) AS peaks FROM cover)
    SELECT z.*, peaks, peak_bases, round(in_peaks / fragments, 6) AS frip, round(bases_in_peaks / bases, 6) AS base_frip,
      round((in_peaks / fragments) / (peak_bases / 500000), 6) AS enrichment FROM z, c"""


@_add("frip", _FRIP.format(n=1), "fragments", "cover")
def _(s, d):
    return frag.frip(a.fragments(s, d), a.peaks_bed(s, d), GENOME, keep_duplicates=False)


@_add("frip_keep_dups", _FRIP.format(n="copies"), "fragments", "cover")
def _(s, d):
    return frag.frip(a.fragments(s, d), a.peaks_bed(s, d), GENOME)


# ----------------------------------------------------------------------------- intervals


@_add("peak_merge", "SELECT contig, start, stop FROM cover", "cover")
def _(s, d):
    return intervals.merge(a.peaks_bed(s, d))


@_add("prefix_cover", "SELECT contig, start, stop, CAST(sum(stop - start) OVER (PARTITION BY contig ORDER BY start) - (stop - start) AS BIGINT) AS covered_before FROM cover", "cover")
def _(s, d):
    return intervals.prefix_cover(intervals.merge(a.peaks_bed(s, d)))


@_add(
    "overlap_semi",
    "SELECT contig, start, stop, reverse, count(*) AS n FROM fragments f WHERE EXISTS (SELECT 1 FROM cover c WHERE c.contig = f.contig AND f.start < c.stop AND c.start < f.stop) GROUP BY ALL",
    "fragments", "cover",
)
def _(s, d):
    k = intervals.overlap_bases(frag.duplicate_keys(a.fragments(s, d)), intervals.merge(a.peaks_bed(s, d)))
    return k.filter("overlap > 0").select(*frag.KEY, F.col("copies").alias("n"))


@_add(
    "overlap_bases",
    """SELECT f.contig, f.start, f.stop, coalesce(CAST(sum(CASE WHEN c.start IS NULL THEN 0 ELSE least(f.stop, c.stop) - greatest(f.start, c.start) END) AS BIGINT), 0) AS overlap
    FROM (SELECT DISTINCT contig, start, stop FROM fragments) f LEFT JOIN cover c ON c.contig = f.contig AND f.start < c.stop AND c.start < f.stop GROUP BY 1, 2, 3""",
    "fragments", "cover",
)
def _(s, d):
    k = a.fragments(s, d).select("contig", "start", "stop").distinct()
    return intervals.overlap_bases(k, intervals.merge(a.peaks_bed(s, d)))


@_add(
    "overlap_all",
    """SELECT x.name AS l_name, y.name AS r_name, least(x.stop, y.stop) - greatest(x.start, y.start) AS bases FROM peaks_bed x JOIN peaks_bed y
    ON x.contig = y.contig AND x.start < y.stop AND y.start < x.stop WHERE x.name < y.name""",
    "peaks_bed",
)
def _(s, d):
    p = a.peaks_bed(s, d)
    return intervals.overlap_join(p, p).filter("l_name < r_name").select("l_name", "r_name", (F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start")).alias("bases"))


@_add(
    "region_counts",
    "SELECT p.name, count(x.start) AS n FROM peaks_bed p LEFT JOIN alignments x ON p.contig = x.contig AND p.start < x.stop AND x.start < p.stop GROUP BY 1",
    "peaks_bed", "alignments",
)
def _(s, d):
    return profile.count_reads(a.peaks_bed(s, d), a.alignments(s, d))


@_add("unmatched_contigs", "SELECT contig, count(*) AS n FROM fragments WHERE contig NOT IN (SELECT contig FROM peaks_bed WHERE strand = '+' AND contig <> 'chr3') GROUP BY 1", "fragments", "peaks_bed")
def _(s, d):
    known = a.peaks_bed(s, d).filter("strand = '+' and contig <> 'chr3'").select("contig").distinct()
    return a.fragments(s, d).groupBy("contig").agg(F.count("*").alias("n")).join(known, "contig", "left_anti")


@_add("region_tiles", "SELECT contig, start // 10000 AS tile, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases FROM fragments GROUP BY 1, 2", "fragments")
def _(s, d):
    return intervals.tiles(a.fragments(s, d), 10_000).groupBy("contig", "tile").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


# ----------------------------------------------------------------------------- peaks

_RUNS = """ev AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, start AS pos, 1 AS d FROM fragments UNION ALL SELECT contig, stop, -1 FROM fragments) GROUP BY 1, 2),
  runs AS (SELECT * FROM (SELECT contig, pos AS start, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS stop, CAST(sum(d) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS depth FROM ev) WHERE depth > 0)"""
_DENSE = _RUNS + """,
  cb AS (SELECT contig, unnest(range(start, stop)) AS pos, depth AS k FROM runs),
  dense AS (SELECT contig, pos, coalesce(k, 0) AS k FROM (SELECT contig, unnest(range(0, 100000)) AS pos FROM contigs) LEFT JOIN cb USING (contig, pos)),
  bg AS (SELECT * FROM (SELECT contig, pos, k,
    CAST(sum(k) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING) AS BIGINT) AS s_1000, least(100000, pos + 500) - greatest(0, pos - 500) AS w_1000,
    CAST(sum(k) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 2500 PRECEDING AND 2499 FOLLOWING) AS BIGINT) AS s_5000, least(100000, pos + 2500) - greatest(0, pos - 2500) AS w_5000,
    CAST(sum(k) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 5000 PRECEDING AND 4999 FOLLOWING) AS BIGINT) AS s_10000, least(100000, pos + 5000) - greatest(0, pos - 5000) AS w_10000 FROM dense) WHERE k > 0),
  lm AS (SELECT *, greatest((SELECT sum((stop - start) * depth) FROM runs) / 500000, s_1000 / w_1000, s_5000 / w_5000, s_10000 / w_10000) AS lam FROM bg)"""
_SCORED = _DENSE + """,
  pr AS (SELECT DISTINCT k, lam FROM lm WHERE k > lam - 0.6931471805599453),
  sp AS (SELECT k, lam, CASE WHEN k > lam THEN (lam - k * ln(lam) + lgamma(k + 1) - ln(1 + list_sum(list_transform(range(1, 700), lambda i: exp(i * ln(lam) - lgamma(k + 1 + i) + lgamma(k + 1)))))) / ln(10)
     ELSE -log10(1 - list_sum(list_transform(range(0, k), lambda j: exp(-lam + j * ln(lam) - lgamma(j + 1))))) END AS score FROM pr)"""
_CANDIDATES = _SCORED + """,
  sc AS (SELECT contig, pos, k, CAST(score AS FLOAT) AS s FROM lm JOIN sp USING (k, lam) WHERE CAST(score AS FLOAT) >= CAST(2 AS FLOAT)),
  isl AS (SELECT *, sum(CASE WHEN pos - prev <= 31 THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY pos) AS island FROM (SELECT *, lag(pos) OVER (PARTITION BY contig ORDER BY pos) AS prev FROM sc)),
  pk AS (SELECT contig, island, min(pos) AS start, max(pos) + 1 AS stop, max(s) AS ss, CAST(sum(k) AS BIGINT) AS ts FROM isl GROUP BY 1, 2 HAVING max(pos) + 1 - min(pos) >= 50),
  tp AS (SELECT contig, island, pos, pos - row_number() OVER (PARTITION BY contig, island ORDER BY pos) AS r FROM isl JOIN pk USING (contig, island) WHERE s = ss),
  fr AS (SELECT contig, island, min(pos) AS lo, max(pos) AS hi FROM tp GROUP BY contig, island, r),
  sm AS (SELECT contig, island, lo + (hi - lo) // 2 AS summit FROM fr QUALIFY row_number() OVER (PARTITION BY contig, island ORDER BY lo) = 1),
  cand AS (SELECT contig, start, stop, summit, ss, ts FROM pk JOIN sm USING (contig, island)),
  rk AS (SELECT *, row_number() OVER (ORDER BY ss DESC, contig, start) AS rk, count(*) OVER () AS m FROM cand),
  bh AS (SELECT *, CAST(max(greatest(0.0, CAST(ss AS DOUBLE) - log10(m) + log10(rk))) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS FLOAT) AS q FROM rk),
  ok AS (SELECT * FROM bh WHERE q >= CAST(-log10(0.05) AS FLOAT))"""
_O = peaks.PeakOptions()


def _pileup(s, d):
    return stored(peaks.runs(a.fragments(s, d)), "pileup")


@_add(
    "pileup_runs",
    f"""WITH {_RUNS}, c AS (SELECT *, CASE WHEN lag(stop) OVER w = start AND lag(depth) OVER w = depth THEN 0 ELSE 1 END AS fresh FROM runs WINDOW w AS (PARTITION BY contig ORDER BY start)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start) AS island FROM c)
    SELECT contig, min(start) AS start, max(stop) AS stop, depth FROM i GROUP BY contig, island, depth""",
    "fragments",
)
def _(s, d):
    return peaks.pileup_runs(a.fragments(s, d))


@_add("background_sums", f"WITH {_DENSE} SELECT contig, pos, k, s_1000, w_1000, s_5000, w_5000, s_10000, w_10000 FROM bg", "fragments", "contigs")
def _(s, d):
    return peaks.base_table(_pileup(s, d), a.contigs(s, d)).drop("lam", "score")


@_add("local_lambda", f"WITH {_DENSE} SELECT contig, pos, k, round(lam, 6) AS lam FROM lm", "fragments", "contigs")
def _(s, d):
    return peaks.base_table(_pileup(s, d), a.contigs(s, d)).select("contig", "pos", "k", F.round("lam", 6).alias("lam"))


@_add("poisson_scores", f"WITH {_SCORED} SELECT k, round(lam, 6) AS lam, round(score, 4) AS score FROM sp", "fragments", "contigs")
def _(s, d):
    r = peaks.base_table(_pileup(s, d), a.contigs(s, d), 0.0)
    return r.filter(F.col("k") > F.col("lam") - 0.6931471805599453).select("k", "lam", "score").distinct().select("k", F.round("lam", 6).alias("lam"), F.round("score", 4).alias("score"))


@_add("pmf_bounds", f"WITH {_DENSE} SELECT DISTINCT k, round(lam, 6) AS lam, round((lam - k * ln(lam) + lgamma(k + 1)) / ln(10), 4) AS bound FROM lm", "fragments", "contigs")
def _(s, d):
    from ..functions import poisson

    pairs = peaks.base_table(_pileup(s, d), a.contigs(s, d)).select("k", "lam").distinct()
    return pairs.select("k", F.round("lam", 6).alias("lam"), F.round(poisson.pmf_bound(F.col("k"), F.col("lam")), 4).alias("bound")).distinct()


@_add("candidate_peaks", f"WITH {_CANDIDATES} SELECT contig, start, stop, summit, round(CAST(ss AS DOUBLE), 4) AS summit_score, ts AS total_signal FROM cand", "fragments", "contigs")
def _(s, d):
    return peaks.call(a.fragments(s, d), a.contigs(s, d), _O).select("contig", "start", "stop", "summit", F.round(F.col("summit_score").cast("double"), 4).alias("summit_score"), "total_signal")


@_add("bh_qvalues", f"WITH {_CANDIDATES} SELECT contig, start, stop, round(CAST(q AS DOUBLE), 4) AS q FROM bh", "fragments", "contigs")
def _(s, d):
    return peaks.call(a.fragments(s, d), a.contigs(s, d), _O).select("contig", "start", "stop", F.round(F.col("q").cast("double"), 4).alias("q"))


@_add(
    "narrowpeak",
    f"""WITH {_CANDIDATES} SELECT contig AS chrom, start, stop, 'peak_' || row_number() OVER (ORDER BY contig, start) AS name, CAST(greatest(0, least(1000, floor(CAST(q AS DOUBLE) * 10))) AS BIGINT) AS score, '.' AS strand,
    round(ts / (stop - start), 5) AS fold, round(CAST(ss AS DOUBLE), 5) AS neg_log10_p, round(CAST(q AS DOUBLE), 5) AS neg_log10_q, summit - start AS summit_offset FROM ok""",
    "fragments", "contigs",
)
def _(s, d):
    return peaks.narrow_peak(peaks.gate(peaks.call(a.fragments(s, d), a.contigs(s, d), _O), _O.alpha))


@_add("extended_peaks", f"WITH {_CANDIDATES} SELECT contig, greatest(0, start - 75) AS start, least(100000, stop + 75) AS stop, summit FROM ok", "fragments", "contigs")
def _(s, d):
    c = a.contigs(s, d)
    return peaks.extended(peaks.gate(peaks.call(a.fragments(s, d), c, _O), _O.alpha), c, 75).select("contig", "start", "stop", "summit")


# ----------------------------------------------------------------------------- profile

_P = profile.ProfileOptions()
_MATRIX = """w AS (SELECT name, contig, strand, CASE WHEN strand = '-' THEN stop ELSE start END - 1000 AS ws FROM peaks_bed JOIN contigs USING (contig)),
  al AS (SELECT contig, start, stop, count(*) AS n FROM alignments WHERE flag & 3844 = 0 AND stop > start GROUP BY 1, 2, 3),
  h AS (SELECT name, b, start, stop, ws, n FROM w JOIN al ON al.contig = w.contig AND al.start < ws + 2000 AND ws < al.stop JOIN range(0, 20) t(b) ON al.start < ws + b * 100 + 100 AND ws + b * 100 < al.stop),
  v AS (SELECT name, b, CAST({value} AS DOUBLE) AS value FROM h GROUP BY 1, 2),
  m AS (SELECT w.name, CASE WHEN strand = '-' THEN 19 - t.b ELSE t.b END AS bin, coalesce(value, 0) AS value FROM w CROSS JOIN range(0, 20) t(b) LEFT JOIN v ON v.name = w.name AND v.b = t.b),
  total AS (SELECT count(*) AS n FROM alignments)"""
_COUNT = _MATRIX.format(value="sum(n)")
_DEPTH = _MATRIX.format(value="sum((least(stop, ws + b * 100 + 100) - greatest(start, ws + b * 100)) * n) / 100")
_PV = ("peaks_bed", "contigs", "alignments")


def _matrix(s, d, o=_P):
    return profile.matrix(a.peaks_bed(s, d), a.alignments(s, d), a.contigs(s, d), o)


def _total(s, d):
    return a.alignments(s, d).agg(F.count("*").alias("n"))


@_add("profile_matrix", f"WITH {_COUNT} SELECT name, bin, -1000 + bin * 100 + 50 AS bin_offset, value FROM m", *_PV)
def _(s, d):
    return _matrix(s, d)


_UNEVEN = profile.ProfileOptions(bins=7)
_REFERENCE_BINS = """w AS (SELECT name, contig, strand, CASE WHEN strand = '-' THEN stop ELSE start END - 1000 AS ws FROM peaks_bed JOIN contigs USING (contig)),
  al AS (SELECT contig, greatest(start, 0) AS start, stop, count(*) AS n FROM alignments WHERE flag & 3844 = 0 AND stop > start GROUP BY 1, 2, 3),
  h AS (SELECT name, n, (greatest(start, ws) - ws) * 7 // 2000 AS b0, (least(stop, ws + 2000) - 1 - ws) * 7 // 2000 AS b1 FROM w JOIN al ON al.contig = w.contig AND al.start < ws + 2000 AND ws < al.stop),
  v AS (SELECT name, b, CAST(sum(n) AS DOUBLE) AS value FROM (SELECT name, n, unnest(range(b0, b1 + 1)) AS b FROM h) GROUP BY 1, 2)"""


@_add("profile_uneven_bins", f"WITH {_REFERENCE_BINS} SELECT w.name, CASE WHEN strand = '-' THEN 6 - t.b ELSE t.b END AS bin, coalesce(value, 0) AS value FROM w CROSS JOIN range(0, 7) t(b) LEFT JOIN v ON v.name = w.name AND v.b = t.b", *_PV)
def _(s, d):
    return _matrix(s, d, _UNEVEN).select("name", "bin", "value")


@_add("profile_depth", f"WITH {_DEPTH} SELECT name, bin, -1000 + bin * 100 + 50 AS bin_offset, round(value, 6) AS value FROM m", *_PV)
def _(s, d):
    return _matrix(s, d, profile.ProfileOptions(mode="depth")).withColumn("value", F.round("value", 6))


@_add("profile_cpm", f"WITH {_COUNT} SELECT name, bin, round(value * (1e6 / (SELECT n FROM total)), 4) AS value FROM m", *_PV)
def _(s, d):
    return profile.normalised(_matrix(s, d), _total(s, d), _P, "CPM").select("name", "bin", F.round("value", 4).alias("value"))


@_add("profile_rpkm", f"WITH {_COUNT} SELECT name, bin, round(value * (1e9 / ((SELECT n FROM total) * 100.0)), 4) AS value FROM m", *_PV)
def _(s, d):
    return profile.normalised(_matrix(s, d), _total(s, d), _P, "RPKM").select("name", "bin", F.round("value", 4).alias("value"))


@_add("profile_bpm", f"WITH {_COUNT} SELECT name, bin, round(value * (1e6 / (SELECT sum(value) FROM m)), 4) AS value FROM m", *_PV)
def _(s, d):
    return profile.normalised(_matrix(s, d), _total(s, d), _P, "BPM").select("name", "bin", F.round("value", 4).alias("value"))


@_add("meta_profile", f"WITH {_COUNT} SELECT bin, -1000 + bin * 100 + 50 AS bin_offset, round(avg(value), 6) AS mean FROM m GROUP BY bin", *_PV)
def _(s, d):
    return profile.meta_profile(_matrix(s, d)).withColumn("mean", F.round("mean", 6))


@_add("top_regions", f"WITH {_COUNT} SELECT name, round(avg(value), 6) AS mean, max(value) AS top FROM m GROUP BY name ORDER BY avg(value) DESC, name LIMIT 20", *_PV)
def _(s, d):
    return profile.top_regions(_matrix(s, d), 20).withColumn("mean", F.round("mean", 6))


@_add(
    "heatmap",
    f"""WITH {_COUNT}, r AS (SELECT name, row_number() OVER (ORDER BY avg(value) DESC, name) - 1 AS place, count(*) OVER () AS total_rows FROM m GROUP BY name),
    e AS (SELECT b, total_rows * b // 8 AS lo, total_rows * (b + 1) // 8 AS hi FROM range(0, 8) t(b), (SELECT max(total_rows) AS total_rows FROM r))
    SELECT e.b AS band, bin, round(avg(value), 6) AS mean FROM m JOIN r USING (name) JOIN e ON place >= lo AND place < hi GROUP BY 1, 2""",
    *_PV,
)
def _(s, d):
    return profile.heatmap(_matrix(s, d), 8).withColumn("mean", F.round("mean", 6))


# ----------------------------------------------------------------------------- reads

_Q = "list_transform(list_filter(string_split(qual, ''), lambda c: c <> ''), lambda c: ord(c) - 33)"


@_add(
    "read_qc",
    f"""WITH z AS (SELECT seq, {_Q} AS q FROM reads)
    SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(coalesce(list_sum(q), 0)) AS BIGINT) AS quality_sum,
    CAST(sum(len(list_filter(q, lambda x: x >= 20))) AS BIGINT) AS q20_bases, CAST(sum(len(list_filter(q, lambda x: x >= 30))) AS BIGINT) AS q30_bases,
    CAST(sum(length(seq) - length(regexp_replace(seq, '[GCgc]', '', 'g'))) AS BIGINT) AS gc_bases, CAST(sum(length(regexp_replace(seq, '[ACGTacgt]', '', 'g'))) AS BIGINT) AS n_bases FROM z""",
    "reads",
)
def _(s, d):
    return reads.totals(a.reads(s, d))


@_add("quality_histogram", f"SELECT q, count(*) AS n FROM (SELECT CAST(unnest({_Q}) AS INTEGER) AS q FROM reads) GROUP BY 1", "reads")
def _(s, d):
    return reads.quality_histogram(a.reads(s, d))


@_add(
    "per_cycle",
    """WITH c AS (SELECT unnest(range(1, length(qual) + 1)) AS cycle, qual, seq FROM reads WHERE length(qual) > 0),
    b AS (SELECT cycle, ord(substr(qual, cycle, 1)) - 33 AS q, upper(substr(seq, cycle, 1)) AS b FROM c)
    SELECT CAST(cycle AS INTEGER) AS cycle, round(avg(q), 6) AS mean_quality, count(*) FILTER (WHERE b = 'A') AS n_a, count(*) FILTER (WHERE b = 'C') AS n_c, count(*) FILTER (WHERE b = 'G') AS n_g,
    count(*) FILTER (WHERE b = 'T') AS n_t, count(*) FILTER (WHERE b NOT IN ('A', 'C', 'G', 'T')) AS n_other FROM b GROUP BY 1""",
    "reads",
)
def _(s, d):
    return reads.per_cycle(a.reads(s, d))


_TQ = reads.TrimOptions(front=22, tail=25, window=4, window_mean=29.0)
_CUT = """f AS (SELECT rec_idx, seq, qual, length(regexp_extract(qual, '^[!-6]*')) AS keep_from FROM reads),
  t AS (SELECT rec_idx, seq, keep_from, qual, regexp_replace(substr(qual, keep_from + 1), '[!-9]+$', '') AS q FROM f),
  l AS (SELECT *, list_transform(list_filter(string_split(q, ''), lambda c: c <> ''), lambda c: ord(c) - 33) AS v FROM t),
  k AS (SELECT *, CASE WHEN length(q) < 4 THEN length(q) ELSE coalesce(list_filter(range(0, length(q) - 3), lambda s: list_sum(list_slice(v, s + 1, s + 4)) < 116)[1], length(q)) END AS keep FROM l)"""


@_add("trim_quality", f"WITH {_CUT} SELECT rec_idx, CAST(keep_from AS INTEGER) AS keep_from, CAST(keep_from + keep AS INTEGER) AS keep_to FROM k", "reads")
def _(s, d):
    return reads.trim(a.reads(s, d), _TQ).select("rec_idx", "keep_from", F.col("keep_to").cast("int").alias("keep_to"))


_ADAPTER = "GCAATCGA"


@_add(
    "trim_adapter",
    f"""SELECT rec_idx, CAST(coalesce(list_filter(range(0, greatest(length(seq) - 3, 0)), lambda p: substr(seq, p + 1, 4) = '{_ADAPTER[:4]}' AND
      len(list_filter(range(1, least(8, length(seq) - p) + 1), lambda i: substr(seq, p + i, 1) <> substr('{_ADAPTER}', i, 1))) <= floor(least(8, length(seq) - p) * 0.25))[1], length(seq)) AS INTEGER) AS keep FROM reads""",
    "reads",
)
def _(s, d):
    return a.reads(s, d).select("rec_idx", reads.cut_adapter(F.col("seq"), (_ADAPTER,), 4, 8, 0.25).cast("int").alias("keep"))


_RF = reads.TrimOptions(window=0, min_length=40, max_n_rate=0.02, min_mean_quality=30.5)


@_add(
    "read_filters",
    f"""WITH z AS (SELECT seq, qual, {_Q} AS q FROM reads) SELECT CASE WHEN length(seq) < 40 THEN 'short' WHEN length(regexp_replace(seq, '[ACGTacgt]', '', 'g')) > 0.02 * length(seq) THEN 'n_rate'
    WHEN coalesce(list_sum(q) / len(q), 0) < 30.5 THEN 'short' ELSE 'kept' END AS drop_reason, count(*) AS n FROM z GROUP BY 1""",
    "reads",
)
def _(s, d):
    return reads.trim(a.reads(s, d), _RF).groupBy("drop_reason").agg(F.count("*").alias("n"))


@_add(
    "phred64_check",
    f"""WITH h AS (SELECT q, count(*) AS n FROM (SELECT unnest({_Q}) AS q FROM reads) GROUP BY 1)
    SELECT CAST(coalesce(sum(n) FILTER (WHERE q < 31), 0) AS BIGINT) AS low, CAST(coalesce(sum(n) FILTER (WHERE q > 72), 0) AS BIGINT) AS high, CAST(coalesce(sum(n) FILTER (WHERE q BETWEEN 61 AND 72), 0) AS BIGINT) AS top, FALSE AS phred64 FROM h""",
    "reads",
)
def _(s, d):
    return reads.phred64(reads.quality_histogram(a.reads(s, d)))


@_add("reverse_complement", "SELECT rec_idx, reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn')) AS seq, reverse(qual) AS qual FROM reads", "reads")
def _(s, d):
    return a.reads(s, d).select("rec_idx", reads.reverse_complement(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"))


# ----------------------------------------------------------------------------- vectors

_K = 5


@_add("row_norms", "SELECT row, round(sqrt(sum(value * value)), 6) AS norm FROM counts GROUP BY row", "counts")
def _(s, d):
    return vectors.row_norms(a.counts(s, d)).withColumn("norm", F.round("norm", 6))


_PAIRS = """nn AS (SELECT row, sqrt(sum(value * value)) AS norm FROM counts GROUP BY row),
  pp AS (SELECT x.row AS a, y.row AS b, sum(x.value * y.value) AS dot FROM counts x JOIN counts y ON x.col = y.col AND x.row < y.row GROUP BY 1, 2),
  ps AS (SELECT a, b, CAST(dot / (na.norm * nb.norm) AS FLOAT) AS sim FROM pp JOIN nn na ON na.row = a JOIN nn nb ON nb.row = b)"""


@_add("cosine_pairs", f"WITH {_PAIRS} SELECT a, b, round(CAST(sim AS DOUBLE), 5) AS sim FROM ps", "counts")
def _(s, d):
    return vectors.cosine_pairs(a.counts(s, d)).withColumn("sim", F.round(F.col("sim").cast("double"), 5))


@_add(
    "knn_exact",
    f"""WITH {_PAIRS}, two AS (SELECT a AS src, b AS dst, sim FROM ps UNION ALL SELECT b, a, sim FROM ps)
    SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS INTEGER) AS rank, dst, round(CAST(sim AS DOUBLE), 5) AS sim FROM two QUALIFY rank <= {_K}""",
    "counts",
)
def _(s, d):
    return vectors.knn_sparse(a.counts(s, d), _K).withColumn("sim", F.round(F.col("sim").cast("double"), 5))


_UNIT = "un AS (SELECT id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM cells)"


@_add(
    "knn_dense",
    f"""WITH {_UNIT}, z AS (SELECT x.id AS src, y.id AS dst, CAST(list_cosine_similarity(x.v, y.v) AS FLOAT) AS sim FROM un x JOIN un y ON x.id <> y.id)
    SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS INTEGER) AS rank, dst, round(CAST(sim AS DOUBLE), 4) AS sim FROM z QUALIFY rank <= {_K}""",
    "cells",
)
def _(s, d):
    c = a.cells(s, d)
    return vectors.knn(c, c, _K).withColumn("sim", F.round(F.col("sim").cast("double"), 4))


@_add(
    "knn_query",
    f"""WITH {_UNIT}, z AS (SELECT x.id AS src, y.id AS dst, CAST(list_cosine_similarity(x.v, y.v) AS FLOAT) AS sim FROM un x JOIN un y ON x.id % 20 = 0)
    SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS INTEGER) AS rank, dst, round(CAST(sim AS DOUBLE), 4) AS sim FROM z QUALIFY rank <= {_K}""",
    "cells",
)
def _(s, d):
    c = a.cells(s, d)
    return vectors.VectorIndex(c).query(c.filter("id % 20 = 0"), _K).withColumn("sim", F.round(F.col("sim").cast("double"), 4))


@_add(
    "graph_symmetrise",
    f"""WITH {_PAIRS}, two AS (SELECT a AS src, b AS dst, sim FROM ps UNION ALL SELECT b, a, sim FROM ps),
    e AS (SELECT src, dst, sim FROM two QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= {_K}), s AS (SELECT src, dst, sim FROM e UNION ALL SELECT dst, src, sim FROM e)
    SELECT src, dst, round(CAST(max(sim) AS DOUBLE), 5) AS sim FROM s GROUP BY 1, 2""",
    "counts",
)
def _(s, d):
    return vectors.symmetrised(vectors.knn_sparse(a.counts(s, d), _K)).withColumn("sim", F.round(F.col("sim").cast("double"), 5))


# ----------------------------------------------------------------------------- metrics


@_add("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def _(s, d):
    return metrics.pearson(a.table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("pearson", 6).alias("pearson"))


@_add(
    "spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem)
    SELECT round(corr(x, y), 6) AS spearman FROM r""",
)
def _(s, d):
    return metrics.spearman(a.table(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


@_add(
    "ks",
    """WITH a AS (SELECT stop - start AS v, count(*) AS n FROM fragments WHERE reverse GROUP BY 1), b AS (SELECT stop - start AS v, count(*) AS n FROM fragments WHERE NOT reverse GROUP BY 1),
    j AS (SELECT coalesce(a.v, b.v) AS v, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.v = b.v),
    c AS (SELECT sum(na) OVER (ORDER BY v) / sum(na) OVER () - sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS gap FROM j) SELECT round(max(abs(gap)), 6) AS ks FROM c""",
    "fragments",
)
def _(s, d):
    f = a.fragments(s, d)
    return metrics.histogram_ks(frag.size_histogram(f.filter("reverse")), frag.size_histogram(f.filter("not reverse")), "length").select(F.round("ks", 6).alias("ks"))


@_add(
    "jaccard",
    """WITH x AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'F')
    SELECT count(*) FILTER (WHERE x.k IS NOT NULL AND y.k IS NOT NULL) AS shared, count(*) AS either, round(count(*) FILTER (WHERE x.k IS NOT NULL AND y.k IS NOT NULL) / count(*), 6) AS jaccard FROM x FULL JOIN y ON x.k = y.k""",
)
def _(s, d):
    li = a.table(s, d, "lineitem").withColumnRenamed("l_partkey", "k")
    return metrics.set_jaccard(li.filter("l_returnflag = 'R'"), li.filter("l_linestatus = 'F'"), "k").withColumn("jaccard", F.round("jaccard", 6))


def _shifted(s, d):
    p = a.peaks_bed(s, d).filter("strand = '+'")
    return p.select("contig", (F.col("start") + 40).alias("start"), (F.col("stop") + 40).alias("stop"), F.concat(F.lit("q"), "name").alias("name"))


_SHIFTED = "pb AS (SELECT contig, start + 40 AS start, stop + 40 AS stop, 'q' || name AS name FROM peaks_bed WHERE strand = '+')"


@_add(
    "peak_matching",
    f"""WITH {_SHIFTED}, p AS (SELECT x.contig, x.start AS xs, x.stop AS xe, x.name AS a_name, y.start AS ys, y.stop AS ye, y.name AS b_name,
      (least(x.stop, y.stop) - greatest(x.start, y.start)) / (greatest(x.stop, y.stop) - least(x.start, y.start)) AS iou
      FROM peaks_bed x JOIN pb y ON x.contig = y.contig AND x.start < y.stop AND y.start < x.stop),
    l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY contig, xs, xe, a_name ORDER BY iou DESC, ys, ye, b_name) = 1)
    SELECT a_name, b_name, round(iou, 6) AS iou FROM l QUALIFY row_number() OVER (PARTITION BY contig, ys, ye, b_name ORDER BY xs, xe, a_name) = 1""",
    "peaks_bed",
)
def _(s, d):
    return metrics.match_peaks(a.peaks_bed(s, d), _shifted(s, d)).withColumn("iou", F.round("iou", 6))


@_add("relative_errors", """SELECT c_custkey, CASE WHEN c_acctbal <> 0 THEN round(abs(c_nationkey * 100 - c_acctbal) / abs(c_acctbal), 6) WHEN c_nationkey = 0 THEN 0 END AS error FROM customer""")
def _(s, d):
    return a.table(s, d, "customer").select("c_custkey", F.round(metrics.relative_error(F.col("c_nationkey") * 100, F.col("c_acctbal")), 6).alias("error"))


@_add(
    "row_agreement",
    """WITH r AS (SELECT l_partkey, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1), v AS (SELECT round(r, 6) AS v FROM r WHERE r IS NOT NULL AND NOT isnan(r)),
    o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS p, count(*) OVER () AS n FROM v)
    SELECT any_value(n) AS rows, max(v) FILTER (WHERE p = n // 2) AS median_r, max(v) FILTER (WHERE p = n // 10) AS p10_r, round(count(*) FILTER (WHERE v > 0.95) / any_value(n), 6) AS above_95 FROM o""",
)
def _(s, d):
    return metrics.row_agreement(a.table(s, d, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")


@_add(
    "interval_jaccard",
    f"""WITH {_SHIFTED}, mb AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT contig, start, stop, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pb)) GROUP BY contig, island),
    z AS (SELECT CAST((SELECT sum(least(x.stop, y.stop) - greatest(x.start, y.start)) FROM cover x JOIN mb y ON x.contig = y.contig AND x.start < y.stop AND y.start < x.stop) AS BIGINT) AS shared,
      CAST((SELECT sum(stop - start) FROM cover) AS BIGINT) AS ca, CAST((SELECT sum(stop - start) FROM mb) AS BIGINT) AS cb)
    SELECT shared, ca + cb - shared AS either, round(shared / (ca + cb - shared), 6) AS jaccard FROM z""",
    "cover",
)
def _(s, d):
    return metrics.interval_jaccard(a.peaks_bed(s, d), _shifted(s, d)).withColumn("jaccard", F.round("jaccard", 6))


# ----------------------------------------------------------------------------- streams


@_add(
    "sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM i GROUP BY user_id, k""",
)
def _(s, d):
    return events.sessions(a.table(s, d, "events"))


@_add("tumbling_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return events.tumbling(a.table(s, d, "events"))


@_add("dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return events.deduplicated(s, d, ["user_id", "event_type"])


# ----------------------------------------------------------------------------- further operators


@_add("alignment_flags", "SELECT flag & 2820 = 0 AND flag & 2 = 2 AS passes, count(*) AS n, count(*) FILTER (WHERE flag & 3844 = 0) AS profile_passes FROM alignments GROUP BY 1", "alignments")
def _(s, d):
    f = F.col("flag")
    return a.alignments(s, d).groupBy(frag.flags_pass(f).alias("passes")).agg(F.count("*").alias("n"), F.count_if(frag.flags_pass(f, 0, 0xF04)).alias("profile_passes"))


@_add(
    "alignment_spans",
    """WITH z AS (SELECT *, flag & 2 = 2 AND tlen <> 0 AS proper, flag & 16 = 16 AS rev FROM alignments),
    y AS (SELECT contig, CASE WHEN proper THEN start WHEN rev THEN greatest(0, stop - 150) ELSE start END AS span_start, CASE WHEN proper THEN start + tlen WHEN NOT rev THEN start + 150 ELSE stop END AS span_stop FROM z WHERE NOT proper OR tlen > 0)
    SELECT contig, span_start, span_stop, count(*) AS n FROM y GROUP BY 1, 2, 3""",
    "alignments",
)
def _(s, d):
    return profile.alignment_spans(a.alignments(s, d), extend=150).groupBy("contig", "span_start", "span_stop").agg(F.count("*").alias("n"))


@_add(
    "off_contig_windows",
    """SELECT name, ws AS w_start, ws + 2000 AS w_stop, contig_length IS NULL AS skipped, coalesce(ws < 0 OR ws + 2000 > contig_length, TRUE) AS off_contig FROM
    (SELECT name, CASE WHEN strand = '-' THEN stop ELSE start END - 1000 AS ws, contig_length FROM peaks_bed LEFT JOIN (SELECT * FROM contigs WHERE contig <> 'chr5') USING (contig))""",
    "peaks_bed", "contigs",
)
def _(s, d):
    c = a.contigs(s, d).filter("contig <> 'chr5'")
    w = profile.windows(a.peaks_bed(s, d), c, _P).join(c, "contig", "left")
    off = F.coalesce((F.col("w_start") < 0) | (F.col("w_stop") > F.col("contig_length")), F.lit(True))
    return w.select("name", "w_start", "w_stop", "skipped", off.alias("off_contig"))


@_add("top_decile", f"WITH {_COUNT} SELECT name, round(avg(value), 6) AS mean, max(value) AS top FROM m GROUP BY name QUALIFY row_number() OVER (ORDER BY avg(value) DESC, name) <= greatest(1, floor(count(*) OVER () * 0.1))", *_PV)
def _(s, d):
    return profile.top_share(_matrix(s, d), 0.1).withColumn("mean", F.round("mean", 6))


@_add("mate_pairs", """SELECT f.rec_idx AS rec_idx, f.seq AS seq_1, g.seq AS seq_2 FROM reads f JOIN reads g ON f.rec_idx % 2 = 0 AND g.rec_idx = f.rec_idx + 1""", "reads")
def _(s, d):
    from ..sources import binary

    r = a.reads(s, d)
    pair = r.select(F.col("rec_idx").bitwiseAND(F.lit(-2)).cast("string").alias("id"), F.when(F.col("rec_idx") % 2 == 0, 64).otherwise(128).alias("flag"), "seq", "qual")
    return binary.mates(pair).select(F.col("id").cast("bigint").alias("rec_idx"), "seq_1", "seq_2")


@_add("quality_report", f"SELECT least(q, 63) AS q, count(*) AS n FROM (SELECT CAST(unnest({_Q}) AS INTEGER) + 30 AS q FROM reads) GROUP BY 1", "reads")
def _(s, d):
    # qualities 30 higher than the view's, so that some lie above the fold
    high = a.reads(s, d).withColumn("qual", F.translate("qual", "".join(map(chr, range(33, 97))), "".join(map(chr, range(63, 127)))))
    return reads.quality_histogram(high, fold=True)


@_add("csr_validation", "SELECT l_suppkey AS row FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING max(n) > 1")
def _(s, d):
    li = a.table(s, d, "lineitem")
    return vectors.invalid_rows(li.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value")))


@_add(
    "knn_padded",
    f"""WITH {_PAIRS}, two AS (SELECT a AS src, b AS dst, sim FROM ps UNION ALL SELECT b, a, sim FROM ps), e AS (SELECT src, dst, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM two),
    g AS (SELECT DISTINCT row AS src FROM counts) SELECT g.src, CAST(t.r AS INTEGER) AS rank, coalesce(e.dst, -1) AS dst, round(coalesce(CAST(e.sim AS DOUBLE), 0), 5) AS sim FROM g CROSS JOIN range(1, 13) t(r) LEFT JOIN e ON e.src = g.src AND e.rank = t.r""",
    "counts",
)
def _(s, d):
    c = a.counts(s, d)
    p = vectors.padded(vectors.knn_sparse(c, 12), c.select(F.col("row").alias("id")).distinct(), 12)
    return p.withColumn("sim", F.round(F.col("sim").cast("double"), 5))


@_add(
    "cosine_distances",
    f"""WITH {_PAIRS}, two AS (SELECT a AS src, b AS dst, sim FROM ps UNION ALL SELECT b, a, sim FROM ps), e AS (SELECT src, dst, sim FROM two QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= {_K})
    SELECT src, dst, round(1 - CAST(sim AS DOUBLE), 5) AS distance FROM e""",
    "counts",
)
def _(s, d):
    return vectors.distances(vectors.knn_sparse(a.counts(s, d), _K)).withColumn("distance", F.round("distance", 5))


_KNN5 = f"""{_UNIT}, z AS (SELECT x.id AS src, y.id AS dst, CAST(list_cosine_similarity(x.v, y.v) AS FLOAT) AS sim FROM un x JOIN un y ON x.id <> y.id),
    k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM z)"""


@_add(
    "knn_recall",
    f"""WITH {_KNN5}, b AS (SELECT src, count(*) FILTER (WHERE r <= 1 + src % 5) AS hit, count(*) AS n FROM k WHERE r <= {_K} GROUP BY 1)
    SELECT round(sum(hit) / sum(n), 6) AS recall, round(avg(hit / n), 6) AS jaccard FROM b""",
    "cells",
)
def _(s, d):
    c = a.cells(s, d)
    exact = vectors.knn(c, c, _K)
    return vectors.recall(exact.filter("rank <= 1 + src % 5"), exact).select(F.round("recall", 6).alias("recall"), F.round("jaccard", 6).alias("jaccard"))


@_add("knn_index_recall", f"WITH {_KNN5} SELECT count(*) AS wanted, TRUE AS recall_reached FROM k WHERE r <= {_K}", "cells")
def _(s, d):
    """The inverted-file index against the exact product: at least 0.9 of the neighbours."""
    c = a.cells(s, d)
    exact, found = vectors.knn(c, c, _K), vectors.knn_cells(c, c, _K)
    hit = exact.join(found.select("src", "dst", F.lit(1).alias("_f")), ["src", "dst"], "left")
    return hit.agg(F.count("*").alias("wanted"), (F.count("_f") / F.count("*") >= 0.9).alias("recall_reached"))


@_add(
    "least_squares_scale",
    """WITH s AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS scale, max(abs(l_extendedprice)) AS top FROM lineitem)
    SELECT round(any_value(scale), 4) AS scale, round(100 * max(abs(l_extendedprice - scale * l_quantity)) / any_value(top), 4) AS max_residual_percent FROM lineitem, s""",
)
def _(s, d):
    r = metrics.least_squares_scale(a.table(s, d, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select(*(F.round(c, 4).alias(c) for c in r.columns))


@_add("region_union", "SELECT contig, count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases FROM fragments WHERE start >= 1000 AND start < 30000 OR start >= 60000 AND start < 90000 AND contig <> 'chr2' GROUP BY 1", "fragments")
def _(s, d):
    regions = [(c, 1000, 30_000) for c in a.CONTIGS] + [(c, 60_000, 90_000) for c in a.CONTIGS if c != "chr2"]
    found = intervals.starting_in(a.fragments(s, d), regions)
    return found.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"))


# ----------------------------------------------------------------------------- files


def _file(s, label):
    from ..storage import shared_folder

    return shared_folder(s, label)


@_add("bed_round_trip", "SELECT contig, start, stop, count(*) AS n FROM fragments GROUP BY 1, 2, 3", "fragments")
def _(s, d):
    """Fragments with copy counts, written as BED and read back with them."""
    k = a.fragments(s, d).groupBy("contig", "start", "stop").agg(F.count("*").alias("n"))
    path = _file(s, "bed")
    sinks.write_bed(k, path)
    return text.fragment_bed(s, path, with_counts=True).filter("not malformed").drop("malformed")


@_add("weighted_duplicates", "SELECT contig, start, stop, FALSE AS reverse, count(*) AS copies FROM fragments GROUP BY 1, 2, 3", "fragments")
def _(s, d):
    """The same copies through a column that carries them."""
    k = a.fragments(s, d).groupBy("contig", "start", "stop").agg(F.count("*").alias("n"))
    return frag.duplicate_keys(k.withColumn("reverse", F.lit(False)))


@_add("bedpe_round_trip", "SELECT contig, start, stop, mapq, reverse, count(*) AS n FROM fragments GROUP BY ALL", "fragments")
def _(s, d):
    f, c = a.fragments(s, d), lambda x: F.col(x).cast("string")
    half = F.floor((F.col("start") + F.col("stop")) / 2).cast("string")
    line = F.concat_ws("\t", "contig", c("start"), half, "contig", half, c("stop"), F.lit("r"), c("mapq"), F.when(F.col("reverse"), "-").otherwise("+"), F.lit("+"))
    path = _file(s, "bedpe")
    f.select(line.alias("value")).write.text(path)
    return text.bedpe(s, path).filter("drop_reason = 'kept'").groupBy("contig", "start", "stop", "mapq", "reverse").agg(F.count("*").alias("n"))


@_add("regions_round_trip", "SELECT contig, start, stop, name, strand FROM peaks_bed", "peaks_bed")
def _(s, d):
    path = _file(s, "regions")
    p = a.peaks_bed(s, d)
    p.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("stop").cast("string"), "name", F.lit("0"), "strand").alias("value")).write.text(path)
    return text.regions_bed(s, path)


@_add("gtf_round_trip", "SELECT contig, start, stop, name, strand FROM peaks_bed WHERE strand = '+'", "peaks_bed")
def _(s, d):
    path = _file(s, "genes") + ".gtf"
    p = a.peaks_bed(s, d).withColumn("f", F.when(F.col("strand") == "+", "gene").otherwise("exon"))
    note = F.concat(F.lit('gene_id "g"; gene_name "'), "name", F.lit('";'))
    p.select(F.concat_ws("\t", "contig", F.lit("src"), "f", (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), note).alias("value")).write.text(path)
    return text.regions(s, path)


@_add("chrom_sizes_round_trip", "SELECT contig, contig_length FROM contigs", "contigs")
def _(s, d):
    path = _file(s, "sizes")
    a.contigs(s, d).select(F.concat_ws("\t", "contig", F.col("contig_length").cast("string")).alias("value")).write.text(path)
    return text.chrom_sizes(s, path)


@_add("fastq_round_trip", "SELECT id, seq, qual FROM reads WHERE length(seq) > 0", "reads")
def _(s, d):
    from ..sources import binary

    path = _file(s, "fastq")
    sinks.write_fastq(a.reads(s, d).filter("seq <> ''"), path)
    return binary.read_fastq(s, path).select("id", "seq", "qual")


@_add("sam_round_trip", "SELECT contig, start, stop, flag, tlen, mapq, count(*) AS n FROM alignments GROUP BY ALL", "alignments")
def _(s, d):
    path, c = _file(s, "sam"), lambda x: F.col(x).cast("string")
    m = a.alignments(s, d)
    line = F.concat_ws("\t", F.lit("q"), c("flag"), "contig", (F.col("start") + 1).cast("string"), c("mapq"), F.concat((F.col("stop") - F.col("start") - 10).cast("string"), F.lit("M10D4S")), F.lit("="), F.lit("1"), c("tlen"), F.lit("*"), F.lit("*"))
    m.select(line.alias("value")).write.text(path)
    return text.sam(s, path).groupBy("contig", "start", "stop", "flag", "tlen", "mapq").agg(F.count("*").alias("n"))


@_add("matrix_file", f"WITH {_COUNT}, t AS (SELECT name, string_agg(printf('%.6f', value), chr(9) ORDER BY bin) AS v FROM m GROUP BY name) SELECT name || chr(9) || v AS value FROM t", *_PV)
def _(s, d):
    path = _file(s, "matrix")
    sinks.write_matrix(_matrix(s, d), path)
    return s.read.text(path)


@_add("profile_file", f"WITH {_COUNT}, t AS (SELECT bin, avg(value) AS v FROM m GROUP BY bin) SELECT (-1000 + bin * 100 + 50) || chr(9) || printf('%.6f', v) AS value FROM t UNION ALL SELECT 'offset' || chr(9) || 'mean_signal'", *_PV)
def _(s, d):
    path = _file(s, "profile")
    sinks.write_profile(profile.meta_profile(_matrix(s, d)), path)
    return s.read.text(path)


@_add("histogram_file", "SELECT stop - start AS length, count(*) AS count FROM fragments GROUP BY 1", "fragments")
def _(s, d):
    path = _file(s, "histogram")
    sinks.write_histogram(frag.size_histogram(a.fragments(s, d)), path)
    return s.read.csv(path, sep="\t", header=True, schema="length bigint, count bigint")


@_add("index_round_trip", "SELECT vec_id AS id, vec_id * 3 AS label, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def _(s, d):
    path = _file(s, "index")
    c = a.cells(s, d)
    vectors.VectorIndex(c).set_labels(c.select("id", (F.col("id") * 3).alias("label"))).save(path)
    return vectors.VectorIndex.load(s, path).vectors.select("id", "label", F.size("vec").alias("dims"))


# ----------------------------------------------------------------------------- strict input, spans


@_add(
    "strict_peak_input",
    """WITH r AS (SELECT CASE WHEN contig_length IS NULL THEN 'unknown_contig' WHEN start < 5000 THEN 'negative_start' WHEN stop > contig_length THEN 'beyond_contig' WHEN stop - start > 330 THEN 'too_long' END AS r
      FROM (SELECT contig, start, stop, CASE WHEN contig <> 'chr4' THEN 90000 END AS contig_length FROM fragments))
    SELECT count(*) AS records, CAST(0 AS BIGINT) AS malformed, count(*) FILTER (WHERE r = 'unknown_contig') AS unknown_contig, count(*) FILTER (WHERE r = 'negative_start') AS negative_start,
      CAST(0 AS BIGINT) AS empty_interval, count(*) FILTER (WHERE r = 'beyond_contig') AS beyond_contig, count(*) FILTER (WHERE r = 'too_long') AS too_long FROM r""",
    "fragments",
)
def _(s, d):
    """Moved 5,000 down so that some starts are negative, stretched so that 330 becomes the limit."""
    f = a.fragments(s, d)
    long = peaks.MAX_FRAGMENT - 330
    moved = f.select("contig", (F.col("start") - 5000).alias("start"), (F.col("stop") - 5000 + long).alias("stop"))
    c = a.contigs(s, d).filter("contig <> 'chr4'").withColumn("contig_length", F.lit(90_000 - 5000 + long).cast("bigint"))
    return peaks.refused(moved, c)


@_add("peak_fragments", "SELECT contig, start, start + tlen AS stop, count(*) AS n FROM alignments WHERE flag & 3852 = 0 AND flag & 2 = 2 AND tlen BETWEEN 1 AND 4096 AND start + tlen <= 95000 AND mapq >= 20 GROUP BY 1, 2, 3", "alignments")
def _(s, d):
    c = a.contigs(s, d).withColumn("contig_length", F.lit(95_000).cast("bigint"))
    return peaks.from_alignments(a.alignments(s, d), c, 20).groupBy("contig", "start", "stop").agg(F.count("*").alias("n"))


@_add(
    "cigar_depth",
    """SELECT contig, start, stop, count(*) AS n FROM (SELECT contig, start, start + 20 AS stop FROM fragments UNION ALL SELECT contig, start + 20 + line, start + 30 + line FROM fragments UNION ALL SELECT contig, start + 35 + line, start + 40 + line FROM fragments) GROUP BY 1, 2, 3""",
    "fragments",
)
def _(s, d):
    """20 aligned, a gap as long as the line number, 10 and 5 aligned around a deletion, clipped ends."""
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    n = F.lit
    c = F.array(op("S", n(3)), op("M", n(20)), op("N", F.col("line")), op("=", n(10)), op("I", n(2)), op("D", n(5)), op("X", n(5)), op("H", n(1)))
    return profile.cigar_blocks(a.fragments(s, d).withColumn("cigar", c)).groupBy("contig", "start", "stop").agg(F.count("*").alias("n"))


@_add("contig_lookup", "SELECT contig, CAST(CASE WHEN contig IN ('chr1', 'chr3') THEN 100000 ELSE -1 END AS BIGINT) AS contig_length, count(*) AS n FROM fragments GROUP BY 1, 2", "fragments")
def _(s, d):
    known = a.contigs(s, d).filter("contig in ('chr1', 'chr3')")
    return text.contig_lengths(a.fragments(s, d).groupBy("contig").agg(F.count("*").alias("n")), known)


@_add("size_overflow", "SELECT CAST(count(*) AS BIGINT) AS fragments, CAST(count(*) FILTER (WHERE 10 * (stop - start) > 2000) AS BIGINT) AS overflow FROM fragments", "fragments")
def _(s, d):
    longer = a.fragments(s, d).withColumn("stop", F.col("start") + 10 * (F.col("stop") - F.col("start")))
    return frag.size_report(longer).select("fragments", "overflow")


@_add("coo_sums", "SELECT l_suppkey AS row, l_partkey AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2")
def _(s, d):
    li = a.table(s, d, "lineitem")
    return vectors.sum_duplicates(li.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value")))


@_add("well_formed_reads", "SELECT length(seq) % 7 = 3 OR rec_idx % 11 = 5 AS broken, count(*) AS n FROM reads GROUP BY 1", "reads")
def _(s, d):
    """Reads damaged on purpose: a header with a control character, a quality too few."""
    r = a.reads(s, d)
    r = r.withColumn("id", F.when(F.col("rec_idx") % 11 == 5, F.concat("id", F.lit("\x07"))).otherwise(F.col("id")))
    r = r.withColumn("qual", F.when(F.char_length("seq") % 7 == 3, F.expr("substring(qual, 2)")).otherwise(F.col("qual")))
    return r.groupBy((~reads.well_formed(r)).alias("broken")).agg(F.count("*").alias("n"))


@_add("phred64_rebase", "SELECT rec_idx, qual FROM reads", "reads")
def _(s, d):
    up = F.translate("qual", "".join(map(chr, range(33, 95))), "".join(map(chr, range(64, 126))))
    return a.reads(s, d).select("rec_idx", reads.to_phred33(up).alias("qual"))


@_add("mate_singletons", "SELECT rec_idx FROM reads f WHERE NOT EXISTS (SELECT 1 FROM reads g WHERE g.rec_idx = f.rec_idx + CASE WHEN f.rec_idx % 2 = 0 THEN 1 ELSE -1 END)", "reads")
def _(s, d):
    from ..sources import binary

    r = a.reads(s, d)
    pair = r.select(F.col("rec_idx").bitwiseAND(F.lit(-2)).cast("string").alias("id"), F.when(F.col("rec_idx") % 2 == 0, 64).otherwise(128).alias("flag"), "rec_idx")
    return binary.singletons(pair).select("rec_idx")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
