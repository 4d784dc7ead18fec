"""Packing by cutting-stock column generation.

Documents become token ids; a document longer than a sequence is cut into full sequences and one
remainder.  Remainder lengths are grouped into classes of UNIT tokens (rounded up), so the histogram
has SEQUENCE / UNIT rows whatever the corpus.  A linear program over patterns - multisets of classes
that fit one sequence - minimises the number of sequences: the restricted master problem is a
revised simplex whose columns are priced by an unbounded-knapsack dynamic program.  The solution is
rounded down; the few pieces left over, at most one sequence's worth for each pattern, are packed
first-fit decreasing.  The pattern table then turns into rank intervals of each class, and pieces,
ranked within their class, look their sequence up.

Ranks are taken in two levels (class, salt) so that a class holding most pieces is not ranked in
one task.

Edge cases: null and empty texts hold the end id only and are packed like any piece; repeated rows
are packed one by one (ties of doc_id are ordered by row); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .token_codec import encoder
from .token_count import pre_tokens

SEQUENCE = 2048
UNIT = 8
ROWS_PER_SALT = 250_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """(uid, doc_id, start, length, ids_crc32, doc_tokens) per piece."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            encode = encode or encoder(tokenizer_path, pre_tokens)
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                uid += 1
                n = len(ids) // 4
                for start in range(0, n, sequence):
                    stop = min(n, start + sequence)
                    for c, v in zip(cols, (uid, doc_id, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, ", ".join(f"{n} bigint" for n in names))


# ----------------------------------------------------------------------------- the linear program


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: value[c] for each size c (index 0 unused); the counts of the best fill."""
    f, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for j in range(1, capacity + 1):
        gain = value[1 : j + 1] + f[j - 1 :: -1][:j]
        k = int(gain.argmax())
        f[j], pick[j] = (gain[k], k + 1) if gain[k] > f[j - 1] + 1e-12 else (f[j - 1], 0)
    counts, j = np.zeros(capacity + 1, np.int64), capacity
    while j > 0:
        if pick[j]:
            counts[pick[j]] += 1
            j -= pick[j]
        else:
            j -= 1
    return float(f[capacity]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting; the basis is small and its threads need no library's."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        if abs(work[p, k]) < 1e-12:
            raise ValueError("the patterns do not form a basis")
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0
        rows = np.flatnonzero(others)
        work[rows] -= others[rows, None] * work[k]
    return work[:, n:]


def greedy_basis(need: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis and its amounts.  Each pattern holds the largest class left and fills the
    sequence exactly where the classes left allow; it is used until one class runs out, so the
    patterns are triangular in the order in which classes run out."""
    left, columns, amount = need.copy(), [], []
    for _ in range(len(sizes)):
        open_ = np.flatnonzero(left > 0)
        reach = np.zeros(capacity + 1, bool)
        reach[0] = True
        for j in range(1, capacity + 1):
            inside = sizes[open_][sizes[open_] <= j]
            reach[j] = reach[j - inside].any()
        counts, room = np.zeros(len(sizes)), capacity
        for i in open_[::-1]:
            size = int(sizes[i])
            while size <= room and counts[i] < max(1.0, left[i]) and (not counts.any() or reach[room - size] or not reach[room]):
                counts[i] += 1
                room -= size
        times, first = min((left[i] / counts[i], i) for i in np.flatnonzero(counts))
        left = np.maximum(left - times * counts, 0)
        left[first] = 0
        # a class that runs out at the same time keeps a trace, so that it gets a pattern of its own
        ties = np.flatnonzero((left == 0) & (need > 0) & (counts > 0))
        left[ties[ties != first]] = 1e-9
        columns.append(counts)
        amount.append(times)
    return np.array(columns).T, np.array(amount)


def solve_patterns(demand: np.ndarray, capacity: int, rounds: int = 3000, gap: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts per class) with whole multiplicities that together cover the demand.  Columns
    are generated until none improves, or the dual bound proves the gap."""
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    m, need = len(sizes), demand[sizes].astype(float)
    columns, amount = greedy_basis(need, sizes, capacity)
    inverse = inverted(columns)
    for _ in range(rounds):
        price = inverse.sum(0)  # every pattern costs one sequence
        value = np.zeros(capacity + 1)
        value[sizes] = np.maximum(price, 0)
        worth, counts = best_pattern(value, capacity)
        if worth <= 1 + 1e-7 or amount.sum() * (1 - gap) <= (need @ value[sizes]) / worth:
            break
        new = counts[sizes].astype(float)
        step = inverse @ new
        ratio = np.full(m, np.inf)
        np.divide(amount, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        amount = np.maximum(amount - step * ratio[out], 0)
        amount[out] = ratio[out]
        columns[:, out] = new
    whole = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    found, rest = [], demand[sizes].astype(np.int64)
    for j in np.flatnonzero(whole):
        counts = np.zeros(capacity + 1, np.int64)
        counts[sizes] = np.round(columns[:, j]).astype(np.int64)
        found.append((counts, int(whole[j])))
        rest -= counts[sizes] * whole[j]
    rest = np.maximum(rest, 0)
    while rest.any():  # the rounding's remainder: one sequence at a time, largest first
        room, counts = capacity, np.zeros(capacity + 1, np.int64)
        for i in range(m - 1, -1, -1):
            k = min(int(rest[i]), room // int(sizes[i]))
            if k:
                counts[sizes[i]], room = k, room - k * int(sizes[i])
                rest[i] -= k
        times = 1 + int(min((rest[i] // counts[sizes[i]] for i in range(m) if counts[sizes[i]]), default=0))
        rest -= counts[sizes] * (times - 1)
        found.append((counts, times))
    return found


def place_table(patterns: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per class: rows (first rank, pieces a sequence, first sequence), ascending by rank."""
    at: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for counts, times in patterns:
        for c in np.flatnonzero(counts):
            c = int(c)
            rows.setdefault(c, []).append((at.get(c, 0), int(counts[c]), sequence))
            at[c] = at.get(c, 0) + int(counts[c]) * times
        sequence += times
    return {c: np.array(r, np.int64) for c, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, unit: int = UNIT, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, sequence), "pieces")
    kind = F.ceil(F.col("length") / unit).cast("int")
    histogram = {r["kind"]: r["n"] for r in pieces.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}  # at most sequence / unit rows
    demand = np.zeros(sequence // unit + 1, np.int64)
    for c, n in histogram.items():
        demand[c] = n
    places = place_table(solve_patterns(demand, sequence // unit))
    salts = max(16, int(demand.sum()) // rows_per_salt)
    salted = pieces.withColumn("kind", kind).withColumn("salt", F.pmod(F.xxhash64("uid", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("kind", "salt").agg(F.count("*").alias("n"))
    before = counts.select("kind", "salt", (F.sum("n").over(Window.partitionBy("kind").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("doc_id", "uid", "start")))
    ranked = ranked.join(before, ["kind", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            out, place = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for c in np.unique(kinds):
                at = np.flatnonzero(kinds == c)
                t = places[int(c)]
                i = np.searchsorted(t[:, 0], ranks[at], side="right") - 1
                inside = ranks[at] - t[i, 0]
                out[at] = t[i, 2] + inside // t[i, 1]
                place[at] = int(c) * (sequence + 1) + inside % t[i, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out), pa.array(place)], names=[*cols[:5], "sequence_id", "place"])

    placed = ranked.select(*cols).mapInArrow(assign, ", ".join(f"{c} bigint" for c in [*cols[:5], "sequence_id", "place"]))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint")).drop("place")
