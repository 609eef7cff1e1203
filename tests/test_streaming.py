"""Sessions and sliding windows: late events, restarts, batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cityloom.streaming import sessions

START = datetime(2024, 3, 1, 8)
SCHEMA = "k string, ts timestamp, v double"


def _batch(spark, folder, name, rows):
    spark.createDataFrame([(k, START + timedelta(minutes=m), float(v)) for k, m, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def _run(spark, folder, out):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    found = sessions.run_available(stream, lambda e: sessions.dwell_sessions(e, ["k"], "10 minutes", "v"), out, lateness="15 minutes")
    minute = lambda c: (F.unix_timestamp(c) - int((START - datetime(1970, 1, 1)).total_seconds())) / 60
    return sorted((r.k, int(r.a), int(r.b), r.events, r.total) for r in found.select("k", minute("started").alias("a"), minute("ended").alias("b"), "events", "total").collect())


def test_sessions_go_on_from_a_checkpoint_and_drop_late_events(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    _batch(spark, folder, "one", [("a", 0, 1), ("a", 9, 2), ("b", 3, 1), ("a", 25, 4)])
    first = _run(spark, folder, out)
    assert first == []  # the watermark is at minute 10; no session has ended before it
    _batch(spark, folder, "two", [("a", 18, 8), ("a", 60, 16)])  # joins two sessions of before, across the restart
    second = _run(spark, folder, out)
    assert second == [("a", 0, 25, 4, 15.0), ("b", 3, 3, 1, 1.0)]
    _batch(spark, folder, "three", [("b", 5, 99), ("a", 120, 32)])  # minute 5 is later than the watermark allows
    third = _run(spark, folder, out)
    assert third == [("a", 0, 25, 4, 15.0), ("a", 60, 60, 1, 16.0), ("b", 3, 3, 1, 1.0)]
    assert _run(spark, folder, out) == third  # nothing new: nothing repeats


def test_replay_closes_every_window(spark, tmp_path):
    folder = f"file://{tmp_path}/events.parquet"
    spark.createDataFrame([("a", START + timedelta(minutes=m), 1.0) for m in (0, 4, 11, 35)] + [(None, START, 2.0)], SCHEMA).repartition(3).write.parquet(folder)
    got = {(r.k, r.started, r.load) for r in sessions.replayed(spark, folder, lambda e: sessions.sliding_loads(e, ["k"], "20 minutes", "10 minutes"), "1 hour").collect()}
    at = lambda m: START + timedelta(minutes=m)
    assert got == {("a", at(-10), 2), ("a", at(0), 3), ("a", at(10), 1), ("a", at(20), 1), ("a", at(30), 1), (None, at(-10), 1), (None, at(0), 1)}
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/none.parquet")
    assert sessions.replayed(spark, f"file://{tmp_path}/none.parquet", lambda e: sessions.dwell_sessions(e, ["k"])).count() == 0
