"""Repeated passages by a common-prefix interval tree over a sparse suffix array.

A full suffix array of the corpus would move every byte position through several shuffles.  Any
string of WIDTH bytes contains an anchor - the leftmost of its ANCHOR-byte substrings with the least
hash - and equal strings have their anchor at the same place, so sorting only the suffixes that
start at anchors finds every repeat of WIDTH bytes:

1. each task lists its anchors' hashes (about one position in sixteen);
2. per hash range, anchors found in two or more documents are reported to the chunks holding them;
3. chunks ship one context per distinct (anchor, bytes around it): the windows the anchor speaks for;
4. per hash range, contexts of an anchor are put in suffix order with their common-prefix lengths.
   A stack scan walks the interval tree; each interval is a set of occurrences with a common right
   part, and the diversity of what stands to the left decides whether it is one maximal repeat or
   divides further.  Every repeat group knows all its occurrences, hence its smallest document;
5. chunks apply the groups to their documents' bytes.

A chunk is a bounded slice of documents by id hash.  A passage shared by very many documents is one
context per chunk, never one row per document, so no group grows with the copies it has.

Edge cases: null and empty texts and texts under WIDTH bytes lose nothing; matches never cross
documents and a document never removes its own repeats; rows with equal doc_id do not remove one
another's bytes; a null doc_id counts as larger than all others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, store, stored

WIDTH, ANCHOR = 50, 20
SPAN = WIDTH - ANCHOR + 1  # windows an anchor can lie in
CHUNK_BYTES = 2_000_000
CHUNKS_PER_PART = 1  # more saves disk (larger messages compress better) and takes memory
SHORT = 16  # hash bits left out where a chance match only costs a context
LAST = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)  # of a hash; of a place, as texts are under 2 GB


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length; wide numbers are stored byte plane by byte plane."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if a.ndim == 1 else a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unblob(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        dtype, width = (kind, 1) if not isinstance(kind, tuple) else kind
        size = np.dtype(dtype).itemsize * n * width
        a = np.frombuffer(raw, np.uint8, size, at)
        at += size
        out.append(a.reshape(n, width) if isinstance(kind, tuple) else np.ascontiguousarray(a.reshape(-1, n).T).view(dtype).ravel())
    return out


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor of a text's windows, by position."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    m = len(data) - ANCHOR + 1
    load = lambda at: np.ndarray((m,), "<u8", data, at, (1,))  # noqa: E731  eight bytes from each position
    h = load(0) * _M1
    h ^= h >> np.uint64(29)
    h += load(8)
    h *= _M2
    h ^= h >> np.uint64(32)
    h += load(ANCHOR - 8)
    h *= _M1
    h ^= h >> np.uint64(31)
    low = h & _HIGH
    low |= np.arange(m, dtype=np.uint64)  # of equal hashes (their upper halves here) the leftmost is the least
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[SPAN - width : SPAN - width + n])
    at = np.flatnonzero(low[1:] != low[:-1])
    first = np.concatenate([[0], at + 1])
    last = np.concatenate([at, [n - 1]])
    pos = (low[first] & _LOW).astype(np.int64)
    return h[pos], pos, first, last


# ----------------------------------------------------------------------------- the interval tree


def intervals(lcp: list[int], floor: int) -> Iterator[tuple[int, int, int, int]]:
    """Stack scan of a common-prefix array (lcp[i]: of suffixes i and i + 1): (first, last, depth,
    depth of the enclosing interval) of every interval deeper than floor, inner ones first."""
    stack: list[tuple[int, int]] = []  # (first, depth)
    for i, d in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > d:
            first, depth = stack.pop()
            outer = max(d, stack[-1][1] if stack else -1, floor)
            if depth > outer:
                yield first, i, depth, outer
        if d > floor and (not stack or stack[-1][1] < d):
            stack.append((first, d))


def repeat_groups(rows: list[tuple[bytes, bytes, int, int]]) -> Iterator[tuple[range, list[int]]]:
    """Maximal repeat groups of an anchor's contexts.

    rows: (right part from the anchor on, left part read backwards, least and greatest number of
    left bytes of the windows spoken for).  Yields (numbers of left bytes, rows): for each such
    number o, the listed rows have the same window of o left and WIDTH - o right bytes, and no
    other row has it.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    numbers = [int.from_bytes(rows[i][0], "big") for i in order]
    lcp = [WIDTH - ((a ^ b).bit_length() + 7) // 8 for a, b in zip(numbers, numbers[1:], strict=False)]
    for first, last, depth, outer in intervals(lcp, ANCHOR - 1):
        lefts = range(WIDTH - depth, WIDTH - outer)  # right parts of depth .. outer + 1 bytes
        inside = order[first : last + 1]
        base = rows[inside[0]]
        longest = lefts[-1]
        diverse = any(rows[i][1][:longest] != base[1][:longest] or rows[i][2] > lefts[0] or rows[i][3] < longest for i in inside)
        if not diverse:
            yield lefts, inside
            continue
        for o in lefts:
            parts: dict[bytes, list[int]] = {}
            for i in inside:
                if rows[i][2] <= o <= rows[i][3]:
                    parts.setdefault(rows[i][1][:o], []).append(i)
            for part in parts.values():
                if len(part) > 1:
                    yield range(o, o + 1), part


# ----------------------------------------------------------------------------- Spark side


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def _in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order of their own: shuffles deliver them in any."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _kind(spark: SparkSession, path: str, kind: int, schema: str) -> DataFrame:
    """One kind's rows of a table stored by kind; without a folder there are none."""
    folder = f"{path}/kind={kind}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def _by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return part, np.argsort(part, kind="stable")


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(3 * spark.sparkContext.defaultParallelism, total // chunk_bytes + 1)
    parts = max(3 * spark.sparkContext.defaultParallelism, n // CHUNKS_PER_PART)  # hash ranges
    # rows of one doc_id may repeat, so the chunk also looks at the text
    texts = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h = np.concatenate([a for a, _, _ in held])
            doc = np.repeat(np.array([d for _, d, _ in held], np.int64), [len(a) for a, _, _ in held])
            chunk = np.repeat(np.array([c for _, _, c in held], np.int32), [len(a) for a, _, _ in held])
            order = np.lexsort((doc, chunk, h))
            h, doc, chunk = h[order], doc[order], chunk[order]
            # one entry per (anchor, chunk) of this flush and whether several documents hold the
            # anchor; entries of different chunks or flushes come from different rows anyway
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (chunk[1:] == chunk[:-1])])
            start = np.flatnonzero(~same)
            least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
            h, chunk, several = h[start], chunk[start], (least != most).astype(np.uint8)
            part, by = _by_part(h, parts)
            h >>= np.uint64(SHORT)
            edges = np.searchsorted(part[by], np.arange(parts + 1))
            rows = [(p, e - s, _blob(h[by[s:e]], chunk[by[s:e]], several[by[s:e]])) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([int(r[1]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "n", "data"])

        for batch in batches:
            for doc, text, chunk in zip(batch.column(0).fill_null(LAST).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_py().encode()
                h = np.unique(anchors(data)[0])
                if len(h):
                    held.append((h, doc, chunk))
                    size += len(h)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def find_shared(table: pa.Table) -> pa.Table:
        found = [_unblob(d, k, np.uint64, np.int32, np.uint8) for d, k in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
        h, chunk, several = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(h, kind="stable")
        h, chunk, several = h[order], chunk[order], several[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        shared = (np.diff(np.append(start, len(h))) > 1) | (np.maximum.reduceat(several, start) > 0)
        keep = np.repeat(shared, np.diff(np.append(start, len(h))))
        h, chunk = h[keep], chunk[keep]
        order = np.argsort(chunk, kind="stable")
        h, chunk = h[order], chunk[order]
        ids, at = np.unique(chunk, return_index=True)
        edge = np.append(at, len(chunk))
        return pa.table({"chunk": pa.array(ids, pa.int32()), "n": pa.array(np.diff(edge), pa.int32()), "data": pa.array([_blob(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    def make_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per chunk: contexts by part (kind 0) and, for the last step, where they occur (kind 1)."""
        out = {"kind": [], "chunk": [], "part": [], "n": [], "data": []}
        left = _in_order(left)
        if left.num_rows and right.num_rows:
            chunk = left.column("chunk")[0].as_py()
            shared = np.unique(np.concatenate([_unblob(d, k, np.uint64)[0] for d, k in zip(right.column("data").to_pylist(), right.column("n").to_pylist(), strict=True)]))
            hs, rows, poss, los, his, mats, docs_ = [], [], [], [], [], [], []
            for i, (doc, text) in enumerate(zip(_ids(left.column("doc_id")).tolist(), left.column("text"), strict=True)):
                data = text.as_py().encode()
                h, pos, first, last = anchors(data)
                if not len(h):
                    continue
                short = h >> np.uint64(SHORT)
                hit = shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
                if not hit.any():
                    continue
                h, pos, first, last = h[hit], pos[hit], first[hit], last[hit]
                col = np.arange(WIDTH + SPAN - 1)[None, :] - (SPAN - 1) + pos[:, None]
                inside = (col >= first[:, None]) & (col < last[:, None] + WIDTH)
                raw = np.frombuffer(data, np.uint8)
                mats.append(np.where(inside, raw[np.clip(col, 0, len(raw) - 1)], 0).astype(np.uint8))
                hs.append(h), rows.append(np.full(len(h), i, np.int32)), poss.append(pos)
                los.append((pos - last).astype(np.uint8)), his.append((pos - first).astype(np.uint8)), docs_.append(np.full(len(h), doc, np.int64))
            if hs:
                h, row, pos, lo, hi, doc = (np.concatenate(x) for x in (hs, rows, poss, los, his, docs_))
                mat = np.concatenate(mats)
                pad = np.ascontiguousarray(np.concatenate([h.view(np.uint8).reshape(-1, 8), lo[:, None], hi[:, None], mat], axis=1))
                _, one, of = np.unique(pad.view(np.dtype((np.void, pad.shape[1]))).ravel(), return_index=True, return_inverse=True)
                least, most = np.full(len(one), LAST), np.full(len(one), np.iinfo(np.int64).min)
                np.minimum.at(least, of, doc)
                np.maximum.at(most, of, doc)
                out["kind"].append(1), out["chunk"].append(chunk), out["part"].append(-1), out["n"].append(len(row))
                out["data"].append(_blob(row, pos, of.astype(np.int32)))
                part, by = _by_part(h[one], parts)
                edges = np.searchsorted(part[by], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    b = by[edges[p] : edges[p + 1]]
                    o = one[b]
                    out["kind"].append(0), out["chunk"].append(chunk), out["part"].append(int(p)), out["n"].append(len(b))
                    out["data"].append(_blob(h[o], b.astype(np.int32), least[b], most[b], lo[o], hi[o], mat[o]))
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "data": pa.array(out["data"], pa.binary())})

    def scan_tree(table: pa.Table) -> pa.Table:
        """Per hash range: the smallest document of each context's windows, back to the chunks."""
        found = [_unblob(d, k, np.uint64, np.int32, np.int64, np.int64, np.uint8, np.uint8, (np.uint8, WIDTH + SPAN - 1)) for d, k in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
        h, ctx, least, most, lo, hi, mat = (np.concatenate([f[k] for f in found]) for k in range(7))
        chunk = np.repeat(np.array(table.column("chunk").to_pylist(), np.int32), table.column("n").to_numpy())
        order = np.argsort(h, kind="stable")
        h, ctx, least, most, lo, hi, mat, chunk = (x[order] for x in (h, ctx, least, most, lo, hi, mat, chunk))
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        head = np.repeat(start, size)
        equal = (mat == mat[head]).all(1) & (lo == lo[head]) & (hi == hi[head])
        uniform = np.logical_and.reduceat(equal, start)
        window = np.full((len(h), SPAN), LAST)
        group_least = np.minimum.reduceat(least, start)
        all_same = np.repeat(uniform, size)
        window[all_same] = np.repeat(group_least, size)[all_same][:, None]
        own = np.arange(SPAN)
        for g in np.flatnonzero(~uniform):
            s, e = int(start[g]), int(start[g] + size[g])
            window[s:e] = least[s:e, None]
            rows = [(m[SPAN - 1 :].tobytes(), m[: SPAN - 1][::-1].tobytes(), int(a), int(b)) for m, a, b in zip(mat[s:e], lo[s:e], hi[s:e], strict=True)]
            for lefts, inside in repeat_groups(rows):
                at = s + np.array(inside)
                window[at, lefts.start : lefts.stop] = least[at].min()
        window[(own < lo[:, None]) | (own > hi[:, None])] = LAST
        keep = np.flatnonzero(window.min(1) < most)
        keep = keep[np.argsort(chunk[keep], kind="stable")]
        ids, at = np.unique(chunk[keep], return_index=True)
        edge = np.append(at, len(keep))
        return pa.table({"chunk": pa.array(ids, pa.int32()), "n": pa.array(np.diff(edge), pa.int32()), "data": pa.array([_blob(ctx[keep[a:b]], window[keep[a:b]].view(np.uint8).reshape(b - a, -1)) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _in_order(left)
        ids = _ids(left.column("doc_id"))
        hits: dict[int, list] = {}
        kinds = right.column("kind").to_pylist()
        data, sizes = right.column("data").to_pylist(), right.column("n").to_pylist()
        places = [_unblob(d, k, np.int32, np.int64, np.int32) for d, k, kind in zip(data, sizes, kinds, strict=True) if kind == 1]
        verdicts = [_unblob(d, k, np.int32, (np.uint8, 8 * SPAN)) for d, k, kind in zip(data, sizes, kinds, strict=True) if kind == 0]
        if places and verdicts:
            row, pos, ctx = (np.concatenate([p[k] for p in places]) for k in range(3))
            known = np.concatenate([v[0] for v in verdicts])
            window = np.concatenate([v[1] for v in verdicts]).view(np.int64)
            order = np.argsort(known)
            known, window = known[order], window[order]
            k = np.minimum(np.searchsorted(known, ctx), len(known) - 1)
            r, o = np.nonzero((window[k] < ids[row][:, None]) & (known[k] == ctx)[:, None])
            start = pos[r] - o
            by = np.argsort(row[r], kind="stable")
            rr, start = row[r][by], start[by]
            seen, at = np.unique(rr, return_index=True)
            hits = {int(i): start[a:b] for i, a, b in zip(seen, at, np.append(at[1:], len(rr)), strict=True)}
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for i, text in enumerate(left.column("text")):
            raw = text.as_py().encode()
            removed = spans = 0
            kept = raw
            if i in hits:
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, hits[i], 1)
                np.add.at(step, hits[i] + WIDTH, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(raw)), out["n_removed"].append(removed), out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return pa.table({"doc_id": left.column("doc_id").combine_chunks(), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    listed = texts.select("doc_id", "text", "chunk").mapInArrow(list_anchors, "part int, n int, data binary")
    shared = listed.groupBy("part").applyInArrow(find_shared, "chunk int, n int, data binary")
    made = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(make_contexts, "kind int, chunk int, part int, n int, data binary")
    contexts, blobs = store(made, "contexts", by="kind"), "chunk int, part int, n int, data binary"
    scanned = _kind(spark, contexts, 0, blobs).groupBy("part").applyInArrow(scan_tree, "chunk int, n int, data binary")
    found = stored(scanned, "repeats")
    release(spark, f"{contexts}/kind=0")  # the bulk of what is stored; nothing reads it any more
    verdicts = found.select("chunk", F.lit(0).alias("kind"), "n", "data").unionByName(_kind(spark, contexts, 1, blobs).select("chunk", F.lit(1).alias("kind"), "n", "data"))
    return texts.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(hx, 2 * i + 1, 100) AS s FROM (SELECT doc_id, hx, unnest(range(0, n - 49)) AS i FROM d)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w),
c AS (SELECT doc_id, i FROM g WHERE least < doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c)),
x AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, island),
y AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY 1),
z AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM (SELECT doc_id, a, b FROM x UNION ALL SELECT doc_id, n, n FROM d)),
t AS (SELECT doc_id, string_agg(substr(hx, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM z JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(t.kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN y USING (doc_id)
"""
