"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

A document is contaminated by an item if some passage of it is within BUDGET of the item's length in
edit operations (case and kind of white space do not count).  For each document:

1. Windows worth embedding: an item with at most k edits keeps one of k + 1 equal pieces intact, so
   an Aho-Corasick scan for all pieces yields, for every true passage, an item-sized window whose
   alignment the piece fixes.  This loses nothing and makes the number of windows follow the matches
   instead of the text.
2. Each window goes through WALKS Chakraborty-Goldenberg-Koucky random walks, which copy a character
   and advance by a random bit of (step, character): strings a few edits apart re-synchronise, so
   edit distance becomes Hamming distance.
3. TABLES samples of SAMPLE embedding positions are compared with the item's; one equal sample keeps
   the window.  TABLES follows from the target recall at the agreement expected at the budget.
4. Kept windows are verified by Myers' bit-parallel edit distance with free ends.

Items are processed in blocks of at most BLOCK_BYTES, one after the other, so the broadcast is bounded
for any benchmark.

Edge cases: null and empty texts are clean; items that are null or shorter than MIN_ITEM characters
are no evidence and are skipped; repeated items are reported once, under their smallest id; repeated
rows are judged row by row; empty tables give clean documents or an empty result; extra columns are
ignored, whatever their names.  Texts of any length are searched whole; of overlapping passages of an
item that tie, the first is reported; an item without id is reported without one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

BUDGET = 1 / 16
MIN_ITEM = 16
WALKS = 16  # tables of one walk fail together, so many walks matter more than many tables
SAMPLE = 6
RECALL, AGREEMENT = 0.999, 0.6  # measured at the budget: 0.67 on average, less in single passages
TABLES = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREEMENT**SAMPLE))
BLOCK_BYTES = 16_000_000
_SPACE = re.compile(r"\s")


def fold(text: str) -> str:
    """Lower case, every white-space character a space; the length does not change."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return _SPACE.sub(" ", low)


def distance_within(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of item to a part of text and where that part ends, if at most `most`."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # free start: no carry-in
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Walks:
    """CGK embeddings of equally treated strings; the random bits depend on the seed only."""

    def __init__(self, longest: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (WALKS, 3 * longest, 256), dtype=np.int8)
        self.pick = rng.random((TABLES, SAMPLE))
        self.walk = np.arange(TABLES) % WALKS

    def samples(self, texts: list[str], lengths: np.ndarray) -> np.ndarray:
        """[texts, TABLES, SAMPLE] sampled embedding symbols; the embedding has 3 * length steps."""
        longest = int(lengths.max())
        grid = np.zeros((len(texts), longest + 1), np.int64)
        for i, t in enumerate(texts):
            codes = np.frombuffer(t.encode("utf-32-le"), "<u4")[:longest].astype(np.int64)
            grid[i, : len(codes)] = codes % 251 + 1
        rows, out = np.arange(len(texts)), np.empty((len(texts), TABLES, SAMPLE), np.int64)
        for w in range(WALKS):
            at = np.zeros(len(texts), np.int64)
            steps = np.empty((len(texts), 3 * longest), np.int16)
            for j in range(3 * longest):
                c = grid[rows, at]
                steps[:, j] = c
                at = np.minimum(at + self.bits[w, j, c], longest)
            mine = np.flatnonzero(self.walk == w)
            place = (self.pick[mine][None] * (3 * lengths)[:, None, None]).astype(np.int64)
            out[:, mine] = np.take_along_axis(steps[:, None, :], place.reshape(len(texts), 1, -1), 2).reshape(len(texts), len(mine), SAMPLE)
        return out


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int | None, str]]):
        unique: dict[str, int | None] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            unique.setdefault(fold(text), item_id)
        self.items = [(i, t, int(len(t) * BUDGET)) for t, i in unique.items()]
        self.lengths = np.array([len(t) for _, t, _ in self.items], np.int64)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            edges = [len(t) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for p, places in pieces.items():
            self.automaton.add_word(p, (len(p), places))
        self.automaton.make_automaton()
        self.walks = Walks(int(self.lengths.max()))
        self.own = self.walks.samples([t for _, t, _ in self.items], self.lengths)

    def __call__(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """Per text: (item id, start, end, edits), by start."""
        folded = [fold(t) for t in texts]
        windows: dict[tuple[int, int, int], None] = {}
        for i, t in enumerate(folded):
            for end, (size, places) in self.automaton.iter(t):
                for n, offset in places:
                    windows[i, n, end + 1 - size - offset] = None
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        spots = list(windows)
        for a in range(0, len(spots), 2000):
            some = spots[a : a + 2000]
            which = np.array([n for _, n, _ in some])
            cut = [folded[i][max(0, s) : max(0, s) + int(self.lengths[n])] for i, n, s in some]
            equal = (self.walks.samples(cut, self.lengths[which]) == self.own[which]).all(2).any(1)
            for k in np.flatnonzero(equal):
                i, n, s = some[k]
                _, item, most = self.items[n]
                if cut[k] == item:
                    found[i].append((n, s, s + len(item), 0))
                    continue
                low = max(0, s - most)
                hit = distance_within(item, folded[i][low : s + len(item) + most], most)
                if hit:
                    end = low + hit[1]
                    back = distance_within(item[::-1], folded[i][low:end][::-1], most)
                    found[i].append((n, end - (back[1] if back else len(item)), end, hit[0]))
        return [[(self.items[n][0], a, b, e) for n, a, b, e in best_of(f)] for f in found]


def best_of(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping passages of one item, the one with the fewest edits, the first of equals.  Those
    kept of an item are disjoint, so a new one is compared with its two neighbours only."""
    kept: dict[int, list[tuple[int, int, int]]] = {}
    for n, a, b, edits in sorted(set(found), key=lambda x: (x[3], x[1], x[2], x[0])):
        mine = kept.setdefault(n, [])
        k = bisect.bisect_left(mine, (a, b, edits))
        if (k == 0 or mine[k - 1][1] <= a) and (k == len(mine) or mine[k][0] >= b):
            mine.insert(k, (a, b, edits))
    return sorted(((n, *x) for n, mine in kept.items() for x in mine), key=lambda x: (x[1], x[2], x[0]))


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The usable items in blocks of about block_bytes, and whether a block is the last one.  One block at
    a time is held here."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.char_length("text") >= MIN_ITEM)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for block in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in mine.collect()]
        if rows:
            yield rows, block == blocks - 1


def _in_turn(docs: DataFrame, benchmark: DataFrame, block_bytes: int, search: Callable) -> DataFrame:
    """docs through search(broadcast rows) block by block.  What a block leaves is stored before the next
    one starts, so only one block's items and automaton are alive at a time."""
    out, schema = docs, docs.schema
    for rows, last in _item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        out = out.mapInArrow(search(shared), schema)
        if not last:
            out = stored(out, "decontaminated")
            shared.unpersist()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a passage of an item; no shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def search(shared) -> Callable:
        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = None
            for batch in batches:
                match = match or Matcher(shared.value)
                found = match([t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not f for f in found]))

        return drop

    return _in_turn(docs, benchmark, block_bytes, search)


_HITS = "array<struct<item_id:bigint,start:bigint,stop:bigint,edits:bigint>>"


def find_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, n_passages, item_id, edits, passages per row of docs(doc_id, text);
    passages is item:start:end:edits, comma-joined, in code points, an item without id written null."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.array().cast(_HITS).alias("hits"))
    hit_type = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64())]))

    def search(shared) -> Callable:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = None
            for batch in batches:
                match = match or Matcher(shared.value)
                found = match([t or "" for t in batch.column(1).to_pylist()])
                hits = [(old or []) + [{"item_id": a, "start": b, "stop": c, "edits": d} for a, b, c, d in new] for old, new in zip(batch.column(2).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, hit_type)], names=["doc_id", "text", "hits"])

        return add

    out = _in_turn(docs, benchmark, block_bytes, search)
    best = F.array_min(F.transform("hits", lambda h: F.struct(h["edits"].alias("edits"), h["item_id"].isNull().alias("unnamed"), h["item_id"].alias("item_id"))))
    named = lambda h: F.concat_ws(":", F.coalesce(h["item_id"].cast("string"), F.lit("null")), h["start"], h["stop"], h["edits"])
    text = F.transform(F.array_sort(F.transform("hits", lambda h: F.struct(h["start"], h["stop"], h["item_id"], h["edits"]))), named)
    n = F.size("hits")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.cast("bigint").alias("n_passages"), best["item_id"].alias("item_id"), best["edits"].alias("edits"), F.concat_ws(",", text).alias("passages"))
