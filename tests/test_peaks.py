import math
import random

import pytest

from locusmill.functions import poisson
from locusmill.operators import peaks

GOLDEN = [(1, 1e-300, -690.77552789821370521), (1, 1e-10, -23.02585092999045684), (1, 0.5, -0.93275212956718857189), (1, 1, -0.45867514538708189102), (1, 10, -0.000045400960370489209504), (1, 1000, 0.0), (2, 0.5, -2.4056813913603713434), (2, 1, -1.3308932682040545336)]


def test_poisson_goldens():
    for k, lam, want in GOLDEN:
        assert poisson.log_tail(k, lam) == pytest.approx(want, rel=1e-12, abs=1e-12)
    for lam in (0.0, -1.0, math.nan, math.inf):
        assert poisson.log_tail(5, lam) == 0.0


def test_pileup_against_counts(spark):
    r = random.Random(1)
    data = [("c", s, s + r.randint(1, 30)) for s in (r.randint(0, 300) for _ in range(60))]
    depth = [0] * 400
    for _, s, e in data:
        for p in range(s, e):
            depth[p] += 1
    got = peaks.pileup_runs(spark.createDataFrame(data, "contig string, start bigint, stop bigint")).collect()
    seen = [0] * 400
    for x in got:
        for p in range(x["start"], x["stop"]):
            seen[p] = x["depth"]
    assert seen == depth
    edges = sorted((x["start"], x["stop"], x["depth"]) for x in got)
    assert all(a[1] < b[0] or a[2] != b[2] for a, b in zip(edges, edges[1:], strict=False))


def test_background_windows_are_cut_at_the_ends(spark):
    contigs = spark.createDataFrame([("c", 20000)], "contig string, contig_length bigint")
    pile = peaks.runs(spark.createDataFrame([("c", 100, 101), ("c", 19999, 20000)], "contig string, start bigint, stop bigint"))
    got = {r["pos"]: r for r in peaks.base_table(pile, contigs).collect()}
    assert [got[100][f"w_{s}"] for s in peaks.SCALES] == [600, 2600, 5100]
    assert (got[19999]["w_1000"], got[19999]["w_10000"]) == (501, 5001)
    assert got[100]["s_1000"] == 1


def _islands(spark, spans, max_gap):
    data = [("c", p, 9, 1.0, 5.0) for a, b in spans for p in range(a, b)]
    d = spark.createDataFrame(data, "contig string, pos bigint, k bigint, lam double, score double")
    return sorted((r["start"], r["stop"], r["summit"], r["total_signal"]) for r in peaks.candidates(d, peaks.PeakOptions(max_gap=max_gap, min_length=1)).collect())


def test_islands(spark):
    assert [x[:2] for x in _islands(spark, [(100, 110), (130, 140)], 30)] == [(100, 140)]
    assert [x[:2] for x in _islands(spark, [(100, 110), (150, 160)], 30)] == [(100, 110), (150, 160)]
    assert _islands(spark, [(0, 3), (4, 5)], 0) == [(0, 5, 1, 36)]


def test_benjamini_hochberg(spark):
    r = random.Random(2)
    scores = [round(r.random() * 6, 1) for _ in range(40)]
    d = spark.createDataFrame([("c", i, s) for i, s in enumerate(scores)], "contig string, start bigint, summit_score float")
    order = sorted(range(40), key=lambda i: (-scores[i], i))
    want, best = {}, 0.0
    for rank in range(40, 0, -1):
        i = order[rank - 1]
        best = max(best, scores[i] - math.log10(40) + math.log10(rank))
        want[i] = best
    for x in peaks.benjamini_hochberg(d).collect():
        assert x["q"] == pytest.approx(max(want[x["start"]], max(want[j] for j in want if scores[j] == scores[x["start"]])), abs=1e-5)


def test_options_are_checked():
    with pytest.raises(ValueError):
        peaks.PeakOptions(cutoff=0)
