"""Event streams: sessions, stateful deduplication, windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user; works on static and on streaming frames."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return s.select("user_id", "first_ts", "last_ts", "n_events")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and type; events later than the watermark are dropped by the stream."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def drain(frame: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet in the shared folder, and read it back."""
    spark = frame.sparkSession
    out = shared_folder(spark, label)
    query = frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def deduplicated(spark: SparkSession, folder: str, keys: list[str], within: str | None = None) -> DataFrame:
    """Distinct keys of the event stream, by stateful streaming deduplication.  The state holds every key
    ever seen, which a stream that ends can afford; with `within` it forgets keys older than that, and a
    key may come again after it."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = stream(spark, folder, "events.parquet", schema)
    if within:
        kept = events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys).select(*keys)
    else:
        kept = events.select(*keys).dropDuplicates(keys)
    return drain(kept, "dedup-stream")
