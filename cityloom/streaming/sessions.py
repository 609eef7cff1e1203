"""Sessions and sliding windows over streams of events, in append mode.

A window's row comes out once, when the watermark (the latest event less the lateness) has
passed its end; then its state goes.  Events that are later than that are dropped.  Sinks
are Parquet files with Spark's own log, so a stream that is stopped goes on from its
checkpoint without losing or repeating a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources.lineage import new_folder


def dwell_sessions(events: DataFrame, keys: list[str], gap: str = "6 hours", value: str | None = None) -> DataFrame:
    """keys, started, ended (the last event's time), events and total (the sum of value) of
    sessions: events of a key, each less than gap after the one before.  events has the
    watermarked time column at."""
    sums = [F.sum(value).alias("total")] if value else []
    found = events.groupBy(F.session_window("at", gap), *keys).agg(F.count("*").alias("events"), F.max("at").alias("ended"), *sums)
    return found.select(*keys, F.col("session_window.start").alias("started"), "ended", "events", *(["total"] if value else []))


def sliding_loads(events: DataFrame, keys: list[str], length: str = "30 minutes", step: str = "10 minutes") -> DataFrame:
    """started, keys, load: numbers of events in windows of length that begin every step."""
    return events.groupBy(F.window("at", length, step), *keys).agg(F.count("*").alias("load")).select(F.col("window.start").alias("started"), *keys, "load")


def run_available(events: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, time: str = "ts", lateness: str = "30 days", before=None) -> DataFrame:
    """Runs build over what a stream of events has to offer now, and returns the rows there
    are so far under out; a later call with the same out goes on from there.

    before: a time; events from it on only move the watermark.
    """
    timed = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", lateness)
    if before is not None:
        timed = timed.where(F.col("at") < F.lit(before))
    made = build(timed)
    run = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    return events.sparkSession.read.schema(made.schema).parquet(f"{out}/rows")


def replayed(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], lateness: str = "30 days", time: str = "ts") -> DataFrame:
    """build over all files of path as one available stream, with every window closed: a mark
    after the last event and the lateness lets the watermark pass them all."""
    given = spark.read.parquet(path)
    folder, _, file = path.rstrip("/").rpartition("/")
    end = given.agg(F.max(F.col(time).cast("timestamp")) + F.expr("INTERVAL 1 DAY"), F.max(F.col(time).cast("timestamp")) + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 400 DAYS")).first()
    out = new_folder(spark, "stream")
    if end[0] is None:
        return build(given.withColumn("at", F.col(time).cast("timestamp")))
    kinds = dict(given.dtypes)
    mark = spark.range(1).select(*[F.lit(end[1] if c == time else None).cast(kinds[c]).alias(c) for c in given.columns])
    mark.write.parquet(f"{out}/mark/mark.parquet")
    stream = spark.readStream.schema(given.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    one = stream.parquet(path) if not _is_file(spark, path) else spark.readStream.schema(given.schema).option("pathGlobFilter", file).parquet(folder)
    return run_available(one.unionByName(stream.parquet(f"{out}/mark")), build, out, time, lateness, end[0])


def _is_file(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
