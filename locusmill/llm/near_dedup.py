"""MinHash near-duplicate detection with odd sketches.

One pass over the texts makes, per document, the set of its word shingles (64-bit hashes), MINHASHES
minimum hashes, BANDS band keys of ROWS minima each, and an odd sketch: every minimum flips one bit
of a SKETCH_BITS parity bitmap, so the population count of two sketches' XOR estimates the number of
differing minima - sharply so at the high similarities that matter.  Documents with equal sets form
one class, named by a 128-bit digest of the set, and are represented once from here on.

Candidates are found without listing the pairs of a bucket:

1. every member of a bucket is compared with one pivot, the one it shares most buckets with;
2. buckets whose members are then all in one component are done;
3. in the others, small buckets pair their members across components; large ones get up to PIVOTS
   further pivots, each met by the members outside its component, and what is open after that is cut
   into blocks: each pair of blocks counts all its intersections by matrix products and returns only
   a spanning forest of the components that its links connect.

Pairs pass the sketch test, which is lenient by six standard deviations, and every link is confirmed
on the full sets.  With 42 bands of 6 rows, a pair at similarity exactly 0.8 shares no band with
probability 3e-6; at 0.9, below 1e-13.  Components come from contraction: links are looked at as
links between the components known so far, and those inside one component are dropped, so that no
round sees again what earlier ones have settled.  Nothing whose size follows the corpus reaches the driver.

Edge cases: null and empty texts and texts without words have no shingles, are linked with nothing
and keep their own id as component; texts of fewer words than a shingle are one shingle; repeated
rows share a component; a null doc_id names a component only where no row of it has an id; empty
tables give an empty result; extra columns are ignored, and keep_one() returns them whatever their
names.  Texts of any length are taken whole; of documents that tie for the smallest id one row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_words, small_batches, stored

BANDS, ROWS = 42, 6
MINHASHES = BANDS * ROWS
SKETCH_BITS = 1024
MAX_DIFFERENCE = 184  # expected 92 at similarity 0.8, plus six standard deviations
SMALL_BUCKET = 32
BLOCK = 512
PIVOTS = 2
BITMAP = 1 << 22  # bits; up to a quarter as many members are looked up by it, more by a join
_EMPTY = np.zeros(0, np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; the word cache's bound changes the speed only."""

    def __init__(self, width: int, bound: int = 400_000):
        self.width, self.bound, self.cache = width, bound, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = lower_words(text)
        if not words:
            return _EMPTY
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > self.bound:
                self.cache = {}
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.cache[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(found, np.uint64)
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def _permutations() -> np.ndarray:
    rng = np.random.default_rng(2718)
    return (rng.integers(0, 1 << 32, (MINHASHES, 2), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """[documents, MINHASHES] minimum hashes of non-empty sets."""
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((MINHASHES, len(sets)), np.uint32)
    h, t = np.empty_like(x), np.empty_like(x)
    for i, (a, b) in enumerate(_permutations()):
        np.multiply(x, a, out=h)
        np.right_shift(h, 15, out=t)
        np.bitwise_xor(h, t, out=h)
        np.multiply(h, b, out=h)
        out[i] = np.minimum.reduceat(h, starts)
    return out.T


def band_keys(low: np.ndarray) -> np.ndarray:
    m = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.view(np.int64)


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """[documents, SKETCH_BITS / 64]: bit parities of the (position, minimum) samples."""
    at = _mix(low.astype(np.uint64) + (np.arange(MINHASHES, dtype=np.uint64) << np.uint64(32))) & np.uint64(SKETCH_BITS - 1)
    flat = (np.arange(len(low))[:, None] * SKETCH_BITS + at.astype(np.int64)).ravel()
    parity = (np.bincount(flat, minlength=len(low) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(low), SKETCH_BITS), axis=1).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, node (the class of its set), keys, sketch; node, keys and sketch are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            node, keys, sketch = ([None] * len(sets) for _ in range(3))
            if len(full):
                low = minima([sets[i] for i in full])
                for i, k, s in zip(full, band_keys(low), odd_sketches(low), strict=True):
                    node[i], keys[i], sketch[i] = _node(sets[i]), k, s
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "n", "node", "keys", "sketch"],
            )

    return docs.mapInArrow(sign, "doc_id bigint, n bigint, node binary, keys array<bigint>, sketch array<bigint>")


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


class _Finder:
    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.found: DataFrame | None = None

    def test(self, pairs: DataFrame) -> None:
        """Confirm (a, b) candidates and keep the links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side in "ab":
            end = self.classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"), F.col("member").alias(f"member_{side}"))
            pairs = pairs.join(end, side)
        different = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        close = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent).filter(different <= MAX_DIFFERENCE)
        close = stored(close.select("a", "b", "n_a", "n_b", "member_a", "member_b"), "candidates")
        sets = self._sets(close.select(F.explode(F.array("member_a", "member_b")).alias("member")))
        both = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        links = both.withColumn("shared", shared).filter(F.col("shared") * 100 >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")
        self._add(links)

    def _add(self, links: DataFrame) -> None:
        self.found = components(stored(links, "links"), self.found)

    def _sets(self, members: DataFrame) -> DataFrame:
        """(node, set) of the classes with the given members.  While members are few, a bitmap of BITMAP
        bits, whose size does not follow them, lets their texts through the scan; what passes by chance is
        dropped by the join with the classes.  More members meet the texts in a join."""
        members = stored(members.distinct(), "members")
        docs, width = self.docs.select("doc_id", "text"), self.width
        if members.count() > BITMAP // 4:
            same = F.col("doc_id").eqNullSafe(F.col("member"))
            docs, passing = docs.join(members, same, "left_semi").withColumn("p", F.lit(0).cast("bigint")), None
        else:
            place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
            places = members.select(place("member").alias("p")).distinct().toArrow().column("p").to_numpy()
            wanted = np.zeros(BITMAP, bool)
            wanted[places] = True
            docs, passing = docs.withColumn("p", place("doc_id")), self.docs.sparkSession.sparkContext.broadcast(np.packbits(wanted).tobytes())

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, shingle = np.unpackbits(np.frombuffer(passing.value, np.uint8)) if passing else None, Shingler(width)
            for batch in batches:
                hits = np.arange(batch.num_rows) if bits is None else np.flatnonzero(bits[batch.column(2).to_numpy()])
                sets = [shingle(batch.column(1)[int(i)].as_py()) for i in hits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[int(i)].as_py() for i in hits], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["member", "node", "set"],
                )

        found = docs.mapInArrow(build, "member bigint, node binary, set array<bigint>")
        own = self.classes.select(F.col("node").alias("_node"), F.col("member").alias("_member"))
        found = found.join(own, (F.col("node") == F.col("_node")) & F.col("member").eqNullSafe(F.col("_member")))  # null where no row has an id
        return stored(found.dropDuplicates(["node"]).select("node", "set"), "sets")

    def unresolved(self, buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(key, node, component, size) of buckets that hold several components."""
        if labels is None:
            b = buckets.withColumn("component", F.col("node"))
        else:
            b = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
        w = Window.partitionBy("key")
        b = b.select("key", "node", "component", F.count("*").over(w).alias("size"), F.max("component").over(w).alias("top"), F.min("component").over(w).alias("bottom"))
        return b.filter("top <> bottom").select("key", "node", "component", "size")

    def compare_blocks(self, big: DataFrame) -> None:
        """Large buckets: blocks of members are compared with one another, without listing pairs;
        each block pair returns a spanning forest of its links."""
        members = big.select("node").distinct().join(self.classes.select("node", "member"), "node")
        sets = self._sets(members.select("member"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("node"), blocks)
        rows = big.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component").join(sets, "node")
        percent = self.percent

        def compare(table: pa.Table) -> pa.Table:
            names = np.array(table.column("node").to_pylist(), object)
            order = np.array(sorted(range(len(names)), key=names.__getitem__))
            node, block = names[order], table.column("block").to_numpy()[order]
            component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()[order]
            sets = [table.column("set")[int(k)].values.to_numpy() for k in order]
            n = np.array([len(s) for s in sets], np.int64)
            found = shared_counts(sets)
            linked = found * 100 >= percent * (n[:, None] + n[None, :] - found)
            linked &= component[:, None] != component[None, :]
            if table.column("i")[0].as_py() != table.column("j")[0].as_py():
                linked &= block[:, None] != block[None, :]
            a, b = connecting(linked, component)
            return pa.table({"a": pa.array(node[a], pa.binary()), "b": pa.array(node[b], pa.binary())})

        self._add(rows.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary"))


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the elements that two sets share."""
    values, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.cumsum(times > 1) - 1
    keep = times[of] > 1
    row, col = row[keep], place[of[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        a, b = np.searchsorted(col, [c, c + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], col[a:b] - c] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def spanning_forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what a symmetric boolean matrix connects."""
    new, a, b = np.ones(len(linked), bool), [], []
    for start in range(len(linked)):
        if not new[start]:
            continue
        new[start], front = False, [start]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x] & new).tolist():
                new[y] = False
                front.append(y)
                a.append(x)
                b.append(y)
    return a, b


def connecting(linked: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, one fewer than components at most, that connect what all links and components connect."""
    i, j = np.nonzero(linked)
    k = int(component.max()) + 1
    link = np.full((k, k), -1, np.int64)
    link[component[i], component[j]] = i * len(linked) + j
    a, b = spanning_forest(link >= 0)
    return np.divmod(link[np.array(a, np.int64), np.array(b, np.int64)], len(linked))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node reachable by the edges (a, b) and inside the components of known.
    A round names each end of an edge by its least neighbour's least neighbour, renames the edges and
    drops those that have become loops."""

    def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
        for side in "ab":
            end = names.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
            edges = edges.join(end, side, "left")
        a, b = (F.coalesce(f"label_{side}", side) for side in "ab")
        return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()

    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if known is None:
        labels, live = ends.withColumn("label", F.col("node")), edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    else:
        labels, live = known.unionByName(ends.join(known, "node", "left_anti").withColumn("label", F.col("node"))), renamed(edges, known)
    live = stored(live, "adjacent")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("near")), "nearest")
        next_ = least.select(F.col("node").alias("near"), F.col("near").alias("label"))
        step = stored(least.join(next_, "near").select("node", "label"), "steps")
        live = stored(renamed(live, step), "adjacent")
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("end")), "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    return stored(labels, "labels")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(signatures(docs, width), "signatures")
    classes = stored(
        signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("member"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")),
        "classes",
    )
    find = _Finder(docs, classes, width, percent)
    w = Window.partitionBy("key")
    rows = classes.select("node", F.explode("keys").alias("key")).select("key", "node", F.min("node").over(w).alias("pivot"), F.count("*").over(w).alias("size"))
    buckets = stored(rows.filter("size > 1"), "buckets")
    shared = buckets.filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("bands"))
    best = shared.groupBy("node").agg(F.max_by("pivot", F.struct("bands", "pivot")).alias("pivot"))
    find.test(best.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    open_ = stored(find.unresolved(buckets.select("key", "node"), find.found), "open")
    small = open_.filter(F.col("size") <= small_bucket).select("key", "node", "component")
    other = small.select("key", F.col("node").alias("b"), F.col("component").alias("component_b"))
    pairs = small.join(other, "key").filter("node < b and component <> component_b").select(F.col("node").alias("a"), "b")
    find.test(pairs)
    big = open_.filter(F.col("size") > small_bucket)
    for turn in range(PIVOTS):  # dense groups mostly hang together through a few of their members
        if big.isEmpty():
            break
        # the pivot of a turn is any member, so that the same ones do not fail twice
        own = big.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("p"))
        met = big.join(own, "key").filter(F.col("component") != F.col("p.component")).groupBy("node", F.col("p.node").alias("pivot")).agg(F.count("*").alias("bands"))
        best = met.groupBy("node").agg(F.max_by("pivot", F.struct("bands", "pivot")).alias("pivot"))
        find.test(best.select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        big = stored(find.unresolved(buckets.select("key", "node"), find.found).filter(F.col("size") > small_bucket), "open")
    if not big.isEmpty():
        find.compare_blocks(big)
    labels = find.found
    if labels is None:
        named = classes.select("node", F.col("member").alias("component_id"))
    else:
        full = classes.select("node", "member").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = full.groupBy("label").agg(F.min("member").alias("component_id"))
        named = full.join(least, "label").select("node", "component_id")
    out = signed.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group of near duplicates: the one with the smallest doc_id; of equal
    rows one stays."""
    name = "kept"
    while name in docs.columns:
        name += "_"
    kept = near_duplicates(docs, width, percent).filter("kept").select(F.col("doc_id").alias(name))
    same = docs["doc_id"].eqNullSafe(kept[name])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


#: For width 4 and 80 percent.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.c + nb.c - x)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reach) AS (SELECT a, b FROM t UNION SELECT r.id, t.b FROM r JOIN t ON t.a = r.reach),
c AS (SELECT id, min(reach) AS least FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.least, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
"""
