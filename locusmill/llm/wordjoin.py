"""A word-statistics join: per-document unit frequencies against a corpus-wide unit table.

Both token counting and language-model scoring need "one number per distinct unit, joined back to
every document".  Exploding every (document, unit) pair would shuffle the corpus several times
over, so the join is split by frequency:

* the HOT units - the at most HOT_UNITS most frequent ones - are joined inside the scan;
* every other unit is rare by construction, so its (document, unit, n) rows are few and unskewed;
  they meet the unit table in an ordinary shuffle join and are summed per document.

No unit is dropped: hot and tail together are all units.  Units of more than KEY_CHARS characters
are known by a 128-bit digest, so that keys are short, the broadcast has a fixed bound, and a long
unit that every document holds becomes hot like a short one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_UNITS = 131_072
KEY_CHARS = 64
FLUSH_UNITS = 200_000  # distinct units a counter holds
FLUSH_BYTES = 32_000_000  # text a counter covers
OUT_ROWS = 50_000


def unit_key(unit: str | bytes) -> str:
    r"""The unit itself if short, else its length and digest.  A leading \x01 marks digests only."""
    text = unit.decode() if isinstance(unit, bytes) else unit
    if len(text) <= KEY_CHARS and text[:1] != "\x01":
        return text
    return f"\x01{len(text)}:{hashlib.blake2b(text.encode(), digest_size=16).hexdigest()}"


def count_units(docs: DataFrame, split: Callable[[str], list], measure: Callable[[], Callable[[list], list]] | None = None) -> DataFrame:
    """(unit, n): occurrences over all texts; counted per task before the shuffle.  With `measure`
    also (value): what it gives for units known by a digest, taken where they are seen; null for
    all others."""
    schema = "unit string, n bigint" + (", value bigint" if measure else "")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, of = Counter(), 0, None

        def out() -> pa.RecordBatch:
            nonlocal of, seen
            units = list(held)
            keys = list(map(unit_key, units))
            columns = [pa.array(keys, pa.string()), pa.array(list(held.values()), pa.int64())]
            if measure:
                digests = [i for i, k in enumerate(keys) if k[:1] == "\x01"]
                values: list = [None] * len(keys)
                if digests:
                    of = of or measure()
                    for i, v in zip(digests, of([units[i] for i in digests]), strict=True):
                        values[i] = v
                columns.append(pa.array(values, pa.int64()))
            held.clear()
            seen = 0
            return pa.RecordBatch.from_arrays(columns, names=["unit", "n", "value"][: len(columns)])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    held.update(split(text))
                    seen += len(text)
                    if len(held) > FLUSH_UNITS or seen > FLUSH_BYTES:
                        yield out()
        if held:
            yield out()

    also = [F.max("value").alias("value")] if measure else []
    return docs.select("text").mapInArrow(count, schema).groupBy("unit").agg(F.sum("n").alias("n"), *also)


def hot_units(table: DataFrame, *values: str, limit: int = HOT_UNITS) -> dict[str, tuple]:
    """The most frequent units, at most `limit`, found by a histogram of log-spaced counts (a few
    hundred rows) rather than a sort."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    steps = table.groupBy(level.alias("level")).agg(F.count("*").alias("units")).collect()
    held, least = 0, None
    for row in sorted(steps, key=lambda r: -r["level"]):
        if held + row["units"] > limit:
            break
        held, least = held + row["units"], row["level"]
    if least is None:
        return {}
    rows = table.filter(level >= F.lit(least)).select("unit", *values).toPandas()
    return dict(zip(rows["unit"], zip(*(rows[v].tolist() for v in values), strict=True), strict=True))


def split_rows(
    docs: DataFrame,
    split: Callable[[str], list],
    hot: dict[str, float],
    extra: Callable[[list, list], Iterable[tuple]],
    extra_schema: list[tuple[str, pa.DataType, str]],
) -> DataFrame:
    """One `unit = null-like sentinel` row per document with its hot sum, plus one row per document
    and tail unit.  `uid` tells rows apart even when doc_id repeats or is null;
    `extra` gives a batch of texts, which come whole and split, their further columns."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    names = ["uid", "unit", "n", "doc_id", "hot", *(n for n, _, _ in extra_schema)]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *(t for _, t, _ in extra_schema)]
    n_extra = len(extra_schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        uid = TaskContext.get().partitionId() << 40
        cols: list[list] = [[] for _ in names]
        units_, times, many = [], [], []  # of the tail rows; many: how many a document has

        def out() -> Iterator[pa.RecordBatch]:
            if units_:
                k = len(units_)
                uids = np.repeat(np.array(cols[0], np.int64), many)
                tail = [pa.array(uids), pa.array(units_, pa.string()), pa.array(times, pa.int64()), *(pa.nulls(k, t) for t in types[3:])]
                yield pa.RecordBatch.from_arrays(tail, names=names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            for c in (units_, times, many, *cols):
                c.clear()

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            split_up = [split(t) for t in texts]
            for doc_id, units, more in zip(batch.column(0).to_pylist(), split_up, extra(texts, split_up), strict=True):
                uid += 1
                total, before = 0.0, len(units_)
                for unit, n in Counter(units).items():
                    v = table.get(unit)
                    if v is None:
                        # no more bytes than KEY_CHARS are no more characters either
                        key = unit if len(unit) <= KEY_CHARS and unit[:1] not in ("\x01", b"\x01") else unit_key(unit)
                        if key is not unit and key[:1] == "\x01":
                            v = table.get(key.encode() if isinstance(unit, bytes) else key)
                        if v is None:
                            units_.append(key)
                            times.append(n)
                            continue
                    total += v * n
                many.append(len(units_) - before)
                for c, v in zip(cols, (uid, f"\0{uid}", 0, doc_id, total, *more), strict=True):
                    c.append(v)
                if len(units_) + len(many) > OUT_ROWS:
                    yield from out()
        if many:
            yield from out()

    schema = "uid bigint, unit string, n bigint, doc_id bigint, hot double" + "".join(f", {n} {s}" for n, _, s in extra_schema)
    assert n_extra == len(names) - 5
    return docs.select("doc_id", "text").mapInArrow(emit, schema)


def join_tail(rows: DataFrame, table: DataFrame, value: str, carried: list[str], absent: float, also: list | None = None) -> DataFrame:
    """Per document: hot sum plus the tail's n * value (units the table lacks count `absent`)."""
    v = F.when(F.col("n") > 0, F.col("n") * F.coalesce(F.col(value), F.lit(absent))).otherwise(F.lit(0.0))
    return (
        rows.join(table, "unit", "left")
        .groupBy("uid")
        .agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in carried), (F.max("hot") + F.sum(v)).alias("total"), *(also or []))
    )
