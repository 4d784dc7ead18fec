"""Token counts: count pieces once per distinct pre-token, join to per-document pre-token
frequencies, and sum - no id sequence is ever built.

A pre-token here is a maximal run without white space.  The tokenizers this serves drop white
space and never merge across it, so a text's count is the sum over its pre-tokens.  Texts holding
white space on which Python and the tokenizer may disagree are one pre-token of their own, which
the library splits by its own rules.

Edge cases: null and empty texts have 0 tokens; repeated rows are counted row by row; an empty
table gives an empty result; extra columns are ignored.  A null doc_id stays null.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordjoin
from .common import ODD_SPACE, WORD_BREAK, small_batches, stored

LIMIT = 2048
_BREAK = re.compile(WORD_BREAK)


def pre_tokens(text: str) -> list[str]:
    plain = text.replace("\n", "").isprintable() or not ODD_SPACE.search(text)
    return text.split() if plain else [u for u in _BREAK.split(text) if u]


class Pieces:
    """Piece counts by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def __call__(self, units: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(units, add_special_tokens=False)]


def piece_table(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(unit, n, pieces) for every distinct pre-token of the corpus; long ones, which later steps know
    by a digest, are measured where they are counted."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or Pieces(tokenizer_path)
            known = batch.column(2).to_pylist()
            found = iter(count([u for u, v in zip(batch.column(0).to_pylist(), known, strict=True) if v is None]))
            pieces = [next(found) if v is None else v for v in known]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], names=["unit", "n", "pieces"])

    return stored(wordjoin.count_units(docs, pre_tokens, lambda: Pieces(tokenizer_path)).mapInArrow(measure, "unit string, n bigint, pieces bigint"), "pieces")


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, hot_limit: int = wordjoin.HOT_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = piece_table(docs, tokenizer_path)
    hot = {u: float(v[0]) for u, v in wordjoin.hot_units(table, "pieces", limit=hot_limit).items()}
    rows = wordjoin.split_rows(docs, pre_tokens, hot, lambda texts, _: ((len(t.encode()),) for t in texts), [("n_bytes", pa.int64(), "bigint")])
    total = wordjoin.join_tail(rows, table.select("unit", "pieces"), "pieces", ["n_bytes"], 0.0)
    n = F.col("total").cast("bigint")
    return total.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
