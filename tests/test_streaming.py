import datetime as dt

from locusmill.streaming import events

T0 = dt.datetime(2024, 1, 1)


def _events(spark):
    data = [(1, 7, T0, "a"), (2, 7, T0 + dt.timedelta(minutes=10), "b"), (3, 7, T0 + dt.timedelta(minutes=50), "a"), (4, 8, T0, "a")]
    return spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp, event_type string")


def test_sessions(spark):
    got = sorted((r["user_id"], r["n_events"]) for r in events.sessions(_events(spark)).collect())
    assert got == [(7, 1), (7, 2), (8, 1)]


def test_streamed_deduplication_and_windows(spark, tmp_path):
    _events(spark).union(_events(spark)).write.parquet(str(tmp_path / "events.parquet"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet")).schema
    files = events.stream(spark, str(tmp_path / "events.parquet"), "*.parquet", schema)
    assert events.drain(files.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "t").count() == 3
    static = {(r["window_start"], r["event_type"]): r["n"] for r in events.tumbling(_events(spark)).collect()}
    assert static[T0, "a"] == 3 and static[T0, "b"] == 1
