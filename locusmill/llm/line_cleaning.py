"""Quality rules, line first, as DataFrame expressions only.

Each line with a word is judged on its own: navigation (separator bars), symbol noise, shouted
punctuation, boilerplate phrases, and missing closing punctuation on long lines.  Failing lines go;
a document that loses more than MOST_LOST percent of its characters this way is rejected.  Before
that, base rules reject texts under 50 words and texts made of repeated word triples.

Word triples are compared by a 64-bit hash with their positions, sorted within the row, so nothing
is exploded or shuffled.

Edge cases: null and empty texts have no words, fail the base rules and keep an empty text; repeated
rows are judged row by row; an empty table gives an empty result; a table's own columns named like a
result column are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_BREAK

# fixed values
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50
MOST_LOST = 40
BARS = 2
SYMBOL_PERCENT = 6
SHOUTS = 2
LONG_LINE_WORDS = 12
BOILERPLATE = (
    "(?i)(all rights reserved|licen[cs]ed under|released under the|under the gnu |privacy policy|cookie policy|use of cookies|"
    "terms of (use|service)|enable javascript|lorem ipsum|click here|sign (in|up) |subscribe to|skip to (main )?content)"
)
SENTENCE_MARK = "[.!?…。！？]"



def _removed(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    """Occurrences of single-byte characters."""
    return F.octet_length(text) - F.octet_length(_removed(text, chars))


def line_fails(line: Column) -> Column:
    """The verdict on one line that has a word."""
    n_chars = F.char_length(line)
    bars = F.octet_length(line) - F.octet_length(F.replace(line, F.lit("|"), F.lit("")))
    shouts = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    words = F.size(F.split(line, " "))
    return (
        (bars >= BARS)
        | (_count(line, SYMBOLS) * 100 > n_chars * SYMBOL_PERCENT)
        | (shouts >= SHOUTS)
        | line.rlike(BOILERPLATE)
        | ((words >= LONG_LINE_WORDS) & ~line.rlike(SENTENCE_MARK))
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """row (the whole input row), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_failed_lines, cleaned_text per row of docs(doc_id, text, ...)."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_BREAK), "")).withColumn("lines", F.split("text", "\n"))
    d = d.select(
        "row",
        "words",
        F.size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("full"),
        "lines",
    )
    triple = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    d = d.withColumn(
        "sorted",
        F.when(F.col("n_words") > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), triple))),
    )
    twice = lambda x, k: (F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"])
    d = d.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
    d = d.withColumn("failed", F.filter("full", line_fails))
    reach = F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3))))
    total = lambda a: F.aggregate(F.transform(a, lambda x: F.char_length(x)), F.lit(0), lambda s, x: s + x)
    d = d.select(
        "row",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(reach, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("full").cast("bigint").alias("n_lines"),
        F.size("failed").cast("bigint").alias("n_failed_lines"),
        total("full").alias("chars"),
        total("failed").alias("lost"),
        F.when(F.size("failed") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.filter("lines", lambda x: ~(x.rlike(WORD) & line_fails(x))), "\n")).alias("cleaned_text"),
        # the verdicts depend on this, so no later filter is pushed below and the arrays above, which
        # are read inside lambdas, are never inlined into its condition
        F.monotonically_increasing_id().alias("_id"),
    )
    base = (F.col("_id") >= 0) & ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    return d.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & (F.col("lost") * 100 <= F.col("chars") * MOST_LOST)).alias("kept"),
        "n_lines", "n_failed_lines", "cleaned_text",
    )


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: the verdicts without the texts."""
    found = clean_lines(docs.select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), *(c for c in found.columns if c not in ("row", "cleaned_text")))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their failing lines removed; n_chars follows the text."""
    found = clean_lines(docs).filter("kept")
    new = {"text": F.col("cleaned_text"), "n_chars": F.char_length("cleaned_text").cast("bigint")}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS lines FROM d),
f AS (SELECT doc_id, text, w, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) > 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT f.*, coalesce(n.n_repeat_words, 0) AS n_repeat_words,
  list_filter(ls, lambda x: (length(x) - length(replace(x, '|', '')) >= 2)
    OR (100 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) > 6 * length(x))
    OR ((length(x) - length(replace(x, '!!', ''))) / 2 >= 2)
    OR regexp_matches(x, '(?i)(all rights reserved|licen[cs]ed under|released under the|under the gnu |privacy policy|cookie policy|use of cookies|terms of (use|service)|enable javascript|lorem ipsum|click here|sign (in|up) |subscribe to|skip to (main )?content)')
    OR (len(string_split(x, ' ')) >= 12 AND NOT regexp_matches(x, '[.!?…。！？]'))) AS bad
  FROM f LEFT JOIN n USING (doc_id)),
b AS (SELECT *, (len(w) < 50 OR n_repeat_words * 100 > len(w) * 50) AS base_failed,
  coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS chars, coalesce(list_sum(list_transform(bad, lambda x: length(x))), 0) AS lost FROM l)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, (NOT base_failed AND lost * 100 <= chars * 40) AS kept, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(bad) AS BIGINT) AS n_failed_lines
FROM b
"""
