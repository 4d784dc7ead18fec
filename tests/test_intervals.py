import random

from pyspark.sql import functions as F

from locusmill.operators import fragments as frag
from locusmill.operators import intervals, metrics

PEAKS = "contig string, start bigint, stop bigint"
MERGE = [("chr1", 100, 200), ("chr1", 150, 250), ("chr1", 160, 170), ("chr1", 250, 300), ("chr1", 400, 500), ("chr2", 0, 10), ("chr1", 700, 700)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_joins_book_ended_and_drops_empty(spark):
    assert rows(intervals.merge(spark.createDataFrame(MERGE, PEAKS)).select("contig", "start", "stop")) == [("chr1", 100, 300), ("chr1", 400, 500), ("chr2", 0, 10)]


def test_merge_does_not_depend_on_the_bin_width(spark):
    r = random.Random(3)
    data = [(f"c{r.randint(1, 2)}", s, s + r.randint(0, 40)) for s in (r.randint(0, 3000) for _ in range(300))]
    df = spark.createDataFrame(data, PEAKS)
    one = rows(intervals.merge(df, width=50).select("contig", "start", "stop"))
    assert one == rows(intervals.merge(df).select("contig", "start", "stop"))
    covered = {(c, p) for c, s, e in data for p in range(s, e)}
    assert {(c, p) for c, s, e in one for p in range(s, e)} == covered


def test_overlap_bases_against_a_bitmap(spark):
    r = random.Random(4)
    make = lambda n, w: [(f"c{r.randint(1, 2)}", s, s + r.randint(0, w)) for s in (r.randint(0, 5000) for _ in range(n))]
    peaks, frags = make(60, 90), sorted(set(make(200, 400)))
    bits = {(c, p) for c, s, e in peaks for p in range(s, e)}
    cover = intervals.merge(spark.createDataFrame(peaks, PEAKS))
    for limit in (0, 4096):
        got = rows(intervals.overlap_bases(spark.createDataFrame(frags, PEAKS), cover, limit=limit).select("contig", "start", "stop", "overlap"))
        assert got == [(c, s, e, sum((c, p) in bits for p in range(s, e))) for c, s, e in frags]


def test_overlap_join_makes_each_pair_once(spark):
    r = random.Random(5)
    make = lambda n: [("c", s, s + r.randint(0, 300)) for s in (r.randint(0, 2000) for _ in range(n))]
    a, b = make(60), make(60)
    got = rows(intervals.overlap_join(spark.createDataFrame(a, PEAKS), spark.createDataFrame(b, PEAKS), width=100).select("l_start", "l_stop", "r_start", "r_stop"))
    want = sorted((s, e, x, y) for _, s, e in a for _, x, y in b if s < y and x < e and e > s and y > x)
    assert got == want


def test_pairs_of_one_deep_bin_are_spread_over_tasks(spark):
    p = spark.createDataFrame([("c", i % 7, 100 + i % 5, f"p{i}") for i in range(300)], PEAKS + ", name string").coalesce(1)
    d = intervals.overlap_join(p, p, width=4096, most=50)
    assert d.count() == 300 * 300 and d.select("l_name", "r_name").distinct().count() == 300 * 300
    assert d.groupBy(F.spark_partition_id()).count().count() > 1


def test_equal_peaks_meet_once_in_matching(spark, monkeypatch):
    r = random.Random(6)
    make = lambda n, q: [("c", s, s + r.choice([30, 50]), f"{q}{i}") for i, s in enumerate(r.choice([0, 10, 25, 60]) for _ in range(n))]
    a, b = make(90, "a"), make(80, "b")
    met, join = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda x, y: met.append((x.count(), y.count())) or join(x, y))
    got = metrics.match_peaks(*(spark.createDataFrame(x, PEAKS + ", name string") for x in (a, b)))
    got = {(x["a_name"], x["b_name"], round(x["iou"], 9)) for x in got.collect()}
    first = {}
    for _, s, e, name in sorted(a, key=lambda x: x[1:]):
        near = [(-(min(e, y) - max(s, x)) / (max(e, y) - min(s, x)), x, y, q) for _, x, y, q in b if s < y and x < e]
        if near:
            first.setdefault(min(near)[3], (name, round(-min(near)[0], 9)))
    assert got == {(v[0], k, v[1]) for k, v in first.items()}
    assert max(met[0]) <= 8


def test_equal_spans_are_counted_once_and_all_kept(spark):
    r = random.Random(7)
    spans = [("c", s, s + 50, i) for i, s in enumerate(r.choice([0, 40, 80]) for _ in range(60))]
    reads = [("c", s, s + 30, 2) for s in (r.randint(0, 200) for _ in range(40))]
    s = spark.createDataFrame(spans, PEAKS + ", region int")
    d = spark.createDataFrame(reads, PEAKS + ", n bigint")
    want = sorted((c, a, b, 2 * sum(x < b and a < y for _, x, y, _ in reads)) for c, a, b, _ in spans)
    assert rows(intervals.touching(s.drop("region"), d)) == want
    assert rows(intervals.touching(s, d)) == sorted((*x, 2 * sum(p < x[2] and x[1] < q for _, p, q, _ in reads)) for x in spans)


FRIP = [
    ([(1000, 2000), (5000, 6000)], [(1100, 1300), (900, 1050), (3000, 3200), (5900, 6100), (900, 1000)], (5, 3, 850, 350)),
    ([(1000, 1500), (1200, 1700), (1600, 1800)], [(1000, 1800)], (1, 1, 800, 800)),
    ([(1000, 2000)], [(1100, 1300)] * 3 + [(3000, 3200)] * 2, (5, 3, 1000, 600)),
]


def _fragments(spark, data):
    return spark.createDataFrame([("chr1", s, e, False) for s, e in data], "contig string, start bigint, stop bigint, reverse boolean")


def test_frip_goldens(spark):
    for peaks, frags, want in FRIP:
        r = frag.frip(_fragments(spark, frags), spark.createDataFrame([("chr1", *p) for p in peaks], PEAKS), 10_000).first()
        assert (r["fragments"], r["in_peaks"], r["bases"], r["bases_in_peaks"]) == want
    r = frag.frip(_fragments(spark, FRIP[2][1]), spark.createDataFrame([("chr1", 1000, 2000)], PEAKS), 10_000, keep_duplicates=False).first()
    assert (r["excluded"], r["fragments"], r["in_peaks"]) == (3, 2, 1)


def test_frip_of_nothing(spark):
    r = frag.frip(_fragments(spark, []), spark.createDataFrame([], PEAKS), 10_000).first()
    assert (r["fragments"], r["in_peaks"], r["frip"]) == (0, 0, 0.0)


def test_duplicates_and_library_size(spark):
    d = spark.createDataFrame([("c", 100, 300, False), ("c", 100, 301, False), ("c", 100, 300, True)], "contig string, start bigint, stop bigint, reverse boolean")
    r = frag.duplicate_stats(d).first()
    assert (r["duplicates"], r["peak_live_keys"]) == (0, 3)
    assert frag.library_size(100, 100) == 0 and frag.library_size(2000, 1000) > 1000
    marked = frag.mark_duplicates(d.union(d).withColumn("rec_idx", F.monotonically_increasing_id()), ["rec_idx"])
    assert marked.filter("duplicate").count() == 3


def test_out_of_order(spark):
    make = lambda data: spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(data)], "rec_idx bigint, contig string, start bigint")
    assert frag.out_of_order(make([("a", 500), ("a", 100)])).first()["out_of_order"] == 1
    assert frag.out_of_order(make([("a", 1), ("b", 2), ("a", 3)])).first()["out_of_order"] == 1
    assert frag.out_of_order(make([("a", 1), ("a", 1), ("b", 0)])).first()["out_of_order"] == 0


def test_nearest_rank(spark):
    h = spark.createDataFrame([(v, 1) for v in range(15)], "length bigint, n bigint")
    assert frag.nearest_rank(h, "length", {"p": 0.9}).first()["p"] == 12


def test_metrics(spark):
    a = spark.createDataFrame([("c", 0, 10, "a1"), ("c", 20, 30, "a2")], "contig string, start bigint, stop bigint, name string")
    b = spark.createDataFrame([("c", 5, 15, "b1"), ("c", 21, 29, "b2")], "contig string, start bigint, stop bigint, name string")
    r = metrics.interval_jaccard(a, b).first()
    assert (r["shared"], r["either"]) == (13, 25)
    assert {(x["a_name"], x["b_name"]) for x in metrics.match_peaks(a, b).collect()} == {("a1", "b1"), ("a2", "b2")}
