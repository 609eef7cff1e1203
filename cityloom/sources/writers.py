"""Sinks: raster tiles, tensors, tables and manifests."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raster_tiles(raster: DataFrame, path: str, tile: int = 256) -> None:
    """Parquet partitioned by square tiles, so that boxes prune files."""
    tiled = raster.withColumn("tile_row", F.floor(F.col("row_i") / tile)).withColumn("tile_col", F.floor(F.col("col_i") / tile))
    tiled.repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(path)


def table_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header; fractional columns rounded half to even where asked."""
    if digits is not None:
        df = df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def tensor_frames(tensor: DataFrame, height: int, width: int, channels: list[str]) -> DataFrame:
    """tick and one dense float array a channel: frames that a training job reads row by row."""
    cells = F.sequence(F.lit(0).cast("long"), F.lit(height * width - 1).cast("long"))
    maps = [F.map_from_entries(F.collect_list(F.struct("cell", F.col(c).cast("float")))).alias(f"_{c}") for c in channels]
    dense = lambda c: F.transform(cells, lambda i: F.coalesce(F.element_at(f"_{c}", i), F.lit(0.0).cast("float"))).alias(c)
    return tensor.groupBy("tick").agg(*maps).select("tick", *[dense(c) for c in channels])


def tensor_npy(tensor: DataFrame, file: str, ticks: list[int], height: int, width: int, channels: list[str], most_values: int = 200_000_000) -> None:
    """A (T, C, H, W) float32 array in one file; larger ones belong in tensor_frames()."""
    if len(ticks) * len(channels) * height * width > most_values:
        raise ValueError("too large for one file")
    out = np.zeros((len(ticks), len(channels), height * width), dtype=np.float32)
    at = {t: i for i, t in enumerate(ticks)}
    for row in tensor.where(F.col("tick").isin(ticks)).toLocalIterator():
        for c, name in enumerate(channels):
            out[at[row["tick"]], c, row["cell"]] = row[name]
    np.save(file, out.reshape(len(ticks), len(channels), height, width))


def manifest(spark: SparkSession, path: str, content: dict, merge: tuple[str, ...] = ()) -> None:
    """Writes a JSON manifest by a rename that replaces the old one; the mappings named in merge keep older entries."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    content = dict(content)
    if merge and store.exists(target):
        old = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        for key in merge:
            content[key] = {**old.get(key, {}), **content.get(key, {})}
    draft = store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"))
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(content, indent=2, sort_keys=True, default=_plain).encode()))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    whole = store.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, whole, options)


def _plain(value):
    if hasattr(value, "item"):
        return value.item()
    if hasattr(value, "tolist"):
        return value.tolist()
    return str(value)
