"""Readers of files that Spark has no source for, and of the pipeline's own files.

File contents come through Spark's ``binaryFile`` source, so any file system that
Spark reads will do; files are decoded in tasks, one file at a time.  Rasters are read by
blocks, by the data source of ``rasters``.
"""

from __future__ import annotations

import io
import sqlite3
import struct
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources import rasters


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# ---------------------------------------------------------------- manifests and bundles


def roi_record(spark: SparkSession, manifest: str, city: str) -> DataFrame:
    """The record of a city in a manifest's ``rois``; KeyError if there is none."""
    rows = spark.read.json(manifest, multiLine=True).select(F.explode("rois").alias("r")).select("r.*").where(F.col("matched_name") == city)
    if not rows.limit(1).count():
        raise KeyError(city)
    return rows


def city_table(spark: SparkSession, path: str, schema: str, city: str) -> DataFrame:
    """Rows of a CSV table with a header for one city; KeyError if there are none."""
    rows = spark.read.csv(path, schema=schema, header=True).where(F.col("matched_name") == city)
    if not rows.limit(1).count():
        raise KeyError(city)
    return rows


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, data) and edges (u, v, data) of a GraphML file; data are its keyed values."""
    pair = "array<struct<_key:string,_VALUE:string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {pair}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {pair}").load(path)
    values = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(pair)), lambda d: F.struct(d["_key"], d["_VALUE"])))
    return nodes.select(F.col("_id").alias("id"), values.alias("data")), edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), values.alias("data"))


# ---------------------------------------------------------------- arrays


def npy_tensors(spark: SparkSession, path: str, rank: int = 4) -> DataFrame:
    """path, tick, channel, row_i, col_i, value of the non-zero values of arrays (T, C, H, W)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != rank:
                    raise ValueError(f"{name} has {x.ndim} dimensions, not {rank}")
                for t in range(len(x)):
                    c, r, w = np.nonzero(x[t])
                    yield pd.DataFrame({"path": name, "tick": np.int64(t), "channel": c.astype(np.int64), "row_i": r.astype(np.int64), "col_i": w.astype(np.int64), "value": x[t][c, r, w].astype(float)})

    return _files(spark, path).mapInPandas(run, "path string, tick long, channel long, row_i long, col_i long, value double")


# ---------------------------------------------------------------- vector layers


def wkb_rings(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or multi-polygon in well-known binary."""

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0] % 1000
        at += 5
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        rings = []
        for _ in range(n):
            if kind == 3:
                m = struct.unpack_from(order + "I", data, at)[0]
                flat = struct.unpack_from(f"{order}{2 * m}d", data, at + 4)
                rings.append(list(zip(flat[::2], flat[1::2])))
                at += 4 + 16 * m
            elif kind == 6:
                more, at = read(at)
                rings += more
            else:
                raise ValueError(f"geometry type {kind} has no rings")
        return rings, at

    return read(0)[0]


def _gpkg_body(blob: bytes) -> bytes:
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def gpkg_layer(spark: SparkSession, path: str, layer: str, columns: list[str], geometry: str = "geom") -> DataFrame:
    """The named columns (as strings) and rings of a GeoPackage layer; a missing column is an error."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as file:  # sqlite needs a file; it goes with the task
                    file.write(content)
                    file.flush()
                    con = sqlite3.connect(file.name)
                    there = {r[1] for r in con.execute(f'PRAGMA table_info("{layer}")')}
                    if missing := [c for c in columns if c not in there]:
                        raise ValueError(f"{layer} lacks {', '.join(missing)}")
                    names = ", ".join(f'"{c}"' for c in [*columns, geometry])
                    for row in con.execute(f'SELECT {names} FROM "{layer}"'):
                        rings = [[{"x": x, "y": y} for x, y in ring] for ring in wkb_rings(_gpkg_body(row[-1]))]
                        yield pd.DataFrame([[*(None if v is None else str(v) for v in row[:-1]), rings]], columns=[*columns, "rings"])
                    con.close()

    kinds = ", ".join(f"`{c}` string" for c in columns)
    return _files(spark, path).mapInPandas(run, f"{kinds}, rings array<array<struct<x:double,y:double>>>")


# ---------------------------------------------------------------- GeoTIFF


def geotiff(content: bytes, band: int = 1) -> tuple[np.ndarray, dict]:
    """A band (from 1) and tags (transform, nodata) of a GeoTIFF that is in memory."""
    read = lambda at, size: content[at : at + size]
    found = rasters.layout(read)
    if not 1 <= band <= found.bands:
        raise ValueError(f"there is no band {band} of {found.bands}")
    h, w = found.block
    out, each = np.zeros((found.height, found.width), dtype=found.dtype), found.across * found.down
    for k, (offset, size) in enumerate(rasters.addresses(read, found, 0 if found.woven > 1 else (band - 1) * each, each)):
        y, x = k // found.across, k % found.across * w
        block = rasters.decoded(read(offset, size), found, rasters.block_rows(found, y))
        out[y * h : y * h + len(block), x : x + w] = block[: found.height - y * h, : found.width - x, band - 1 if found.woven > 1 else 0]
    return out, {"width": found.width, "height": found.height, "bands": found.bands, "nodata": found.nodata, "transform": found.transform}


def raster_grids(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, width, height, bands, nodata, transform (six numbers or null) of GeoTIFF files, from their headers."""
    return rasters.metadata(spark, path).select("raster_id", "width", "height", "bands", "nodata", "transform")


def raster_tables(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """raster_id, row_i, col_i, value of a band of GeoTIFF files; nodata and NaN samples are left out."""
    return rasters.scan(spark, path, band).select("raster_id", "row_i", "col_i", "value")
