"""Shared plumbing of the training-data operators: table access, lineage cuts, hashing helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and the five ASCII line/tab controls.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Characters that one of str.split() / a tokenizer's white-space class treats as a break and the
#: other may not; texts holding them take the slower exact path.
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")


def words(text: str | None) -> list[bytes]:
    """Words of a text as the contracts define them, in UTF-8; null has none.  bytes.split() breaks
    at exactly the six ASCII characters of WORD_BREAK."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z only, which is what bytes.lower() does."""
    return text.encode().lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; where unset, a temporary one if the
    master is this process, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        have = sc._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="locusmill-")
        sc.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; nothing depends on the removal
        pass


def stored(df: DataFrame, label: str, n_files: int | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: the result is computed once and
    no longer depends on executors that made it."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label, n_files=n_files))


def store(df: DataFrame, label: str, by: str | None = None, n_files: int | None = None) -> str:
    """The folder df is written to, one subfolder per value of `by`; removed at the interpreter's
    exit unless release() does so earlier."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    out = (df.coalesce(n_files) if n_files else df).write
    (out.partitionBy(by) if by else out).parquet(path)
    atexit.register(_remove, spark, path)
    return path


def release(spark: SparkSession, path: str) -> None:
    """Delete a stored table whose last reader is done."""
    _remove(spark, path)


def remainder(id_column: str, modulus: int):
    """crc32 of the id as text, modulo modulus (null ids give null)."""
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(modulus))


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches by rows and by bytes: whole texts can be long.  Plans are made when
    results are asked for, so the bound stays in the session; it changes no result."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
