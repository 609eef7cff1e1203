"""Ticks as tumbling event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources.lineage import new_folder


def tick_loads(events: DataFrame, key: Column, minutes: int = 6, lateness: str = "30 days") -> DataFrame:
    """tick, u (key), load of a stream of events at ts: counts in tumbling windows, kept
    until the watermark has passed."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counts = timed.groupBy(F.window("at", f"{minutes} minutes"), key.alias("u")).agg(F.count("*").alias("load"))
    return counts.select(F.floor(F.unix_timestamp("window.start") / (60 * minutes)).alias("tick"), "u", "load")


def replayed_ticks(spark: SparkSession, path: str, key: Column, lateness: str = "30 days") -> DataFrame:
    """Runs tick_loads over all files of path as one available stream and returns its result.

    Windows that changed go to Parquet in the shared folder batch by batch; the last
    batch of a window counts.  State is dropped when the watermark has passed.
    """
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    out = new_folder(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/loads/batch={number}")

    run = tick_loads(stream, key, lateness=lateness).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("tick long, u long, load long, batch long").parquet(f"{out}/loads")
    return rows.groupBy("tick", "u").agg(F.max_by("load", "batch").alias("load"))
