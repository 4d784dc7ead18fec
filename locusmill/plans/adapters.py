"""Domain views over the test tables, as DataFrames and as the SQL the oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIG_LENGTH = 100_000
CONTIGS = [f"chr{i}" for i in range(1, 6)]
READ_LENGTH = 50
PIECE = 100
#: Letters to bases and to quality signs (Phred+33), for the reads made from prose.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TO_BASE = "ACGTACGTACGTACGTACGTACGTAN"
TO_QUALITY = "IHGFEDCBA@?>=<;:9876543210"[: len(LETTERS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df on all cores: a scan of fewer pieces than cores is dealt out once; a larger one stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, CONTIG_LENGTH) for c in CONTIGS], "contig string, contig_length bigint")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount"))
    start = F.when(F.col("l_returnflag") == "R", 1500 + (F.col("l_partkey") % 40) * 2400 + F.col("l_orderkey") % 60).otherwise(
        (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 99000
    )
    length = 60 + 6 * F.col("l_quantity").cast("bigint")
    return li.select(
        F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 5).cast("string")).alias("contig"),
        start.cast("bigint").alias("start"),
        (start + length).cast("bigint").alias("stop"),
        (F.col("l_linestatus") == "F").alias("reverse"),
        F.round(F.col("l_discount") * 600).cast("int").alias("mapq"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("int").alias("line"),
    )


def peaks_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size % 2 = 0")
    start = 1450 + (F.col("p_partkey") % 40) * 2400 + (F.col("p_size") % 5) * 20
    return p.select(
        F.concat(F.lit("chr"), (1 + F.expr("p_partkey div 40") % 5).cast("string")).alias("contig"),
        start.cast("bigint").alias("start"),
        (start + 200 + (F.col("p_size") % 3) * 100).cast("bigint").alias("stop"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates per line item; flag bits from the line number and the order's status."""
    f = fragments(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderstatus"), "order_key")
    base = 1 + F.when(F.col("o_orderstatus") == "P", 0).otherwise(2) + F.when(F.col("line") == 7, 1024).otherwise(0) + F.when(F.col("line") == 6, 256).otherwise(0)
    back, ahead = F.when(F.col("reverse"), 16).otherwise(0), F.when(F.col("reverse"), 0).otherwise(16)
    mates = F.array(
        F.struct(F.col("start").alias("start"), (F.col("start") + READ_LENGTH).alias("stop"), (base + 64 + back).alias("flag"), (F.col("stop") - F.col("start")).alias("tlen")),
        F.struct((F.col("stop") - READ_LENGTH).alias("start"), F.col("stop").alias("stop"), (base + 128 + ahead).alias("flag"), (F.col("start") - F.col("stop")).alias("tlen")),
    )
    return f.select("contig", "mapq", F.explode(mates).alias("m")).select("contig", "m.start", "m.stop", F.col("m.flag").cast("int").alias("flag"), "m.tlen", "mapq")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 100-letter pieces of every document."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("t"))
    # the pieces are what is exploded: a row per piece that still held its document would fill a Python function's queue
    d = d.select("doc_id", F.posexplode_outer(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "p"))
    d = d.select("doc_id", F.coalesce("piece", F.lit(0)).alias("piece"), F.lower(F.coalesce("p", F.lit(""))).alias("p"))
    return d.select(
        (F.col("doc_id") * 1_000_000 + F.col("piece")).alias("rec_idx"),
        F.concat(F.lit("@r"), "doc_id", F.lit("."), "piece").alias("id"),
        F.translate("p", LETTERS, TO_BASE).alias("seq"),
        F.translate("p", LETTERS, TO_QUALITY).alias("qual"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").cast("double").alias("value"))


SQL = {
    "contigs": "SELECT 'chr' || i AS contig, CAST(100000 AS BIGINT) AS contig_length FROM range(1, 6) t(i)",
    "fragments": """SELECT contig, start, start + length AS stop, reverse, mapq, order_key, line FROM (SELECT 'chr' || (1 + l_suppkey % 5) AS contig,
        CAST(CASE WHEN l_returnflag = 'R' THEN 1500 + (l_partkey % 40) * 2400 + l_orderkey % 60
             ELSE (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 99000 END AS BIGINT) AS start,
        60 + 6 * CAST(l_quantity AS BIGINT) AS length, l_linestatus = 'F' AS reverse, CAST(round(l_discount * 600) AS INTEGER) AS mapq,
        l_orderkey AS order_key, CAST(l_linenumber AS INTEGER) AS line FROM lineitem)""",
    "peaks_bed": """SELECT contig, start, start + w AS stop, name, strand FROM (SELECT 'chr' || (1 + (p_partkey // 40) % 5) AS contig,
        CAST(1450 + (p_partkey % 40) * 2400 + (p_size % 5) * 20 AS BIGINT) AS start, CAST(200 + (p_size % 3) * 100 AS BIGINT) AS w,
        'p' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_size % 2 = 0)""",
    "alignments": """SELECT contig, CASE m WHEN 0 THEN start ELSE stop - 50 END AS start, CASE m WHEN 0 THEN start + 50 ELSE stop END AS stop,
        CAST(1 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END + CASE WHEN line = 7 THEN 1024 ELSE 0 END + CASE WHEN line = 6 THEN 256 ELSE 0 END
          + CASE m WHEN 0 THEN 64 ELSE 128 END + CASE WHEN reverse = (m = 0) THEN 16 ELSE 0 END AS INTEGER) AS flag,
        CASE m WHEN 0 THEN stop - start ELSE start - stop END AS tlen, mapq
        FROM fragments JOIN orders ON o_orderkey = order_key CROSS JOIN range(0, 2) t(m)""",
    "reads": f"""SELECT doc_id * 1000000 + piece AS rec_idx, '@r' || doc_id || '.' || piece AS id, translate(p, '{LETTERS}', '{TO_BASE}') AS seq, translate(p, '{LETTERS}', '{TO_QUALITY}') AS qual
        FROM (SELECT doc_id, piece, lower(substr(t, piece * 100 + 1, 100)) AS p FROM (SELECT doc_id, t, unnest(range(0, greatest((length(t) + 99) // 100, 1))) AS piece
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS t FROM documents)))""",
    "cells": "SELECT vec_id AS id, embedding AS vec FROM embeddings",
    "counts": "SELECT l_suppkey AS row, l_partkey AS col, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2",
    "cover": """SELECT contig, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CASE WHEN start <= before THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT contig, start, stop, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM peaks_bed WHERE stop > start)) GROUP BY contig, island""",
}
_NEEDS = {"alignments": ["fragments"], "cover": ["peaks_bed"]}


def with_views(query: str, *views: str) -> str:
    """Oracle SQL: the named views, what they need, then the query."""
    order: list[str] = []

    def add(v: str) -> None:
        for need in _NEEDS.get(v, []):
            add(need)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    body = ",\n".join(f"{v} AS ({SQL[v]})" for v in order)
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{query[15:]}"
    if query.upper().startswith("WITH "):
        return f"WITH {body},\n{query[5:]}"
    return f"WITH {body}\n{query}"
