"""Files that other programs read: GeoTIFF, GeoPackage, GraphML, PNG, and bundles of them.

Spark lays out the contents (one row a file); a task encodes a file and writes it under
a name of its own, which is then renamed, so a repeated task leaves one whole file.
Formats that are one file each hold what one task can hold; larger results belong in the
Parquet sinks of ``writers``.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
import tempfile
import uuid
import zlib
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources.rasters import deflated, directory, file_head, store_of
from cityloom.sources.writers import manifest, table_csv


def put(path: str, content: bytes) -> None:
    """Writes a file in whole, replacing an older one."""
    store, name = store_of(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, name)


# ---------------------------------------------------------------- GeoTIFF


def encode_geotiff(bands: np.ndarray, transform: tuple[float, ...], nodata: float | None = None, tile: int = 256, epsg: int | None = None) -> bytes:
    """A tiled GeoTIFF (deflate, bands apart) of an array (bands, rows, columns); BigTIFF from 4 GB on."""
    n, h, w = bands.shape
    big = bands.nbytes > 1 << 32
    blocks = []
    for band in bands:
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                block = np.full((tile, tile), nodata if nodata is not None else 0, dtype=bands.dtype)
                part = band[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(deflated(block))
    head, count = len(file_head(0, big)), len(blocks)
    at = head + np.concatenate([[0], np.cumsum([len(x) for x in blocks])])
    place = int(at[-1])
    return file_head(place, big) + b"".join(blocks) + directory((n, h, w), bands.dtype, transform, nodata, tile, epsg, at[:count].tolist(), [len(x) for x in blocks], place, big)


def geotiffs(cells: DataFrame, path: str, transform: tuple[float, ...], height: int, width: int, by: str, band: str | None = None, nodata: float = -9999.0, dtype: str = "float32", most_values: int = 500_000_000) -> DataFrame:
    """A GeoTIFF for each value of by under path, from row_i, col_i, value; band: a column
    whose values, in order, are its bands.  Returns file names and numbers of samples."""

    def run(key, frame):
        names = sorted(frame[band].unique()) if band else [None]
        if len(names) * height * width > most_values:
            raise ValueError(f"{key[0]} has too many samples for one file")
        out = np.full((len(names), height, width), nodata, dtype=dtype)
        at = np.searchsorted(names, frame[band]) if band else np.zeros(len(frame), dtype=int)
        out[at, frame["row_i"].to_numpy(dtype=int), frame["col_i"].to_numpy(dtype=int)] = frame["value"].to_numpy()
        file = f"{path.rstrip('/')}/{key[0]}.tif"
        put(file, encode_geotiff(out, transform, nodata))
        return pd.DataFrame({"file": [file], "bands": [len(names)], "samples": [len(frame)]})

    kept = cells.select("row_i", "col_i", "value", F.col(by).cast("string").alias(by), *([band] if band else [])).where("value IS NOT NULL")
    return kept.groupBy(by).applyInPandas(run, "file string, bands long, samples long")


# ---------------------------------------------------------------- GeoPackage


def wkb(kind: str, points: list) -> bytes:
    """Well-known binary of a point, a line or a polygon of one ring."""
    flat = lambda ps: struct.pack(f"<{2 * len(ps)}d", *[v for p in ps for v in p])
    if kind == "point":
        return struct.pack("<BI", 1, 1) + flat(points)
    if kind == "line":
        return struct.pack("<BII", 1, 2, len(points)) + flat(points)
    ring = points if points[0] == points[-1] else [*points, points[0]]
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + flat(ring)


_KINDS = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL"}


def geopackage(layers: dict[str, tuple[DataFrame, str]], path: str, srs: tuple[int, str, str] = (54009, "ESRI", "Mollweide")) -> None:
    """A GeoPackage at path with layers (rows with points: array of x, y; kind point, line or
    polygon).  Rows are read through one task's file, partition by partition."""
    with tempfile.TemporaryDirectory() as folder:  # sqlite needs a file; the driver copies it to path
        file = os.path.join(folder, "layers.gpkg")
        con = sqlite3.connect(file)
        con.executescript(
            "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"
            "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
            "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);"
            "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z INTEGER NOT NULL, m INTEGER NOT NULL);"
        )
        con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', '')", [("undefined", -1, "NONE", -1), ("geographic", 0, "NONE", 0), (srs[2], srs[0], srs[1], srs[0])])
        for name, (rows, kind) in layers.items():
            columns = [(c, _KINDS.get(t, "TEXT")) for c, t in rows.dtypes if c != "points"]
            con.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB' + "".join(f', "{c}" {t}' for c, t in columns) + ")")
            box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
            insert = f'INSERT INTO "{name}" (geom' + "".join(f', "{c}"' for c, _ in columns) + f") VALUES (?{', ?' * len(columns)})"
            for row in rows.toLocalIterator():
                points = [(p["x"], p["y"]) for p in row["points"]]
                for x, y in points:
                    box = [min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)]
                con.execute(insert, [b"GP\0\1" + struct.pack("<i", srs[0]) + wkb(kind, points), *(v if isinstance(v := row[c], int | float | str | None) else str(v) for c, _ in columns)])
            shape = {"point": "POINT", "line": "LINESTRING", "polygon": "POLYGON"}[kind]
            con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), ?, ?, ?, ?, ?)", [name, name, *(box if box[0] <= box[2] else [None] * 4), srs[0]])
            con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", [name, shape, srs[0]])
        con.commit()
        con.close()
        with open(file, "rb") as made:
            put(path, made.read())


# ---------------------------------------------------------------- GraphML


def graphml(nodes: DataFrame, edges: DataFrame, path: str, crs: str = "ESRI:54009") -> None:
    """A GraphML file of nodes (node_id, ...) and edges (u, v, ...): Spark writes the elements
    as text parts, which are joined behind a head of keys."""
    keys, head = {}, ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for domain, df, own in (("node", nodes, ["node_id"]), ("edge", edges, ["u", "v"])):
        for c, _ in df.dtypes:
            if c not in own:
                keys[domain, c] = f"d{len(keys)}"
                head.append(f'<key id="{keys[domain, c]}" for="{domain}" attr.name={quoteattr(c)} attr.type="string"/>')
    head.append(f'<key id="crs" for="graph" attr.name="crs" attr.type="string"/><graph edgedefault="directed"><data key="crs">{escape(crs)}</data>')

    def element(domain: str, df: DataFrame, start: list) -> DataFrame:
        clean = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        data = [F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(f'<data key="{k}">'), clean(c), F.lit("</data>"))) for (d, c), k in keys.items() if d == domain]
        return df.select(F.concat(*start, *data, F.lit(f"</{domain}>")).alias("value"))

    parts = [element("node", nodes, [F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">')]), element("edge", edges, [F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('">')])]
    lines = [*head, *(r.value for part in parts for r in part.toLocalIterator()), "</graph></graphml>"]
    put(path, "\n".join(lines).encode())


# ---------------------------------------------------------------- pictures


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of an array (rows, columns, 3 or 4) of bytes, or of grey values (rows, columns)."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = pixels.shape[:2]
    raw = np.zeros((h, 1 + pixels[0].size), dtype=np.uint8)
    raw[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    colour = {1: 0, 3: 2, 4: 6}[1 if pixels.ndim == 2 else pixels.shape[2]]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def encode_gif(frames: list[np.ndarray], delay: int = 20) -> bytes:
    """A looping GIF of grey frames (rows, columns); codes are written without dictionary growth."""
    h, w = frames[0].shape
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF6, 0, 0))
    out += bytes(v for i in range(128) for v in (2 * i,) * 3) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    for frame in frames:
        out += b"\x21\xf9\x04\0" + struct.pack("<H", delay) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x07"
        flat = (np.asarray(frame, dtype=np.uint8).ravel() >> 1).astype(np.uint8)
        codes = []
        for i in range(0, len(flat), 126):  # a clear code before the width would grow
            codes += [128, *flat[i : i + 126].tolist()]
        data = bytes([*codes, 129])
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8)[:, None], axis=1, bitorder="little").ravel()
        packed = np.packbits(bits, bitorder="little").tobytes()
        out += b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0"
    return bytes(out + b"\x3b")


def _greys(frame: pd.DataFrame, height: int, width: int, top: float) -> np.ndarray:
    out = np.zeros((height, width))
    out[frame["row_i"].to_numpy(dtype=int), frame["col_i"].to_numpy(dtype=int)] = frame["value"].to_numpy()
    return (255 * np.clip(out / max(top, 1e-12), 0, 1)).astype(np.uint8)


def heat_pngs(cells: DataFrame, path: str, height: int, width: int, by: str, top: float) -> DataFrame:
    """A grey PNG for each value of by (row_i, col_i, value from 0 to top): file names."""

    def run(key, frame):
        file = f"{path.rstrip('/')}/{key[0]}.png"
        put(file, encode_png(_greys(frame, height, width, top)))
        return pd.DataFrame({"file": [file]})

    return cells.select("row_i", "col_i", "value", F.col(by).cast("string").alias(by)).groupBy(by).applyInPandas(run, "file string")


def heat_gif(cells: DataFrame, path: str, height: int, width: int, frame: str, top: float, most_frames: int = 1000) -> None:
    """A GIF with a frame for each value of frame, in order; frames are drawn in tasks."""

    def run(key, part):
        return pd.DataFrame({"frame": [int(key[0])], "pixels": [zlib.compress(_greys(part, height, width, top).tobytes())]})

    drawn = cells.select("row_i", "col_i", "value", F.col(frame).cast("long").alias(frame)).groupBy(frame).applyInPandas(run, "frame long, pixels binary")
    rows = drawn.orderBy("frame").limit(most_frames + 1).collect()
    if len(rows) > most_frames:
        raise ValueError(f"more than {most_frames} frames")
    put(path, encode_gif([np.frombuffer(zlib.decompress(r.pixels), dtype=np.uint8).reshape(height, width) for r in rows]))


# ---------------------------------------------------------------- bundles


def hotspot_bundle(spark: SparkSession, folder: str, city: str, centres: DataFrame, summary: DataFrame, config: dict) -> dict:
    """Centres as a layer, the cluster summary as CSV, and a manifest that keeps older cities."""
    folder = folder.rstrip("/")
    points = centres.withColumn("points", F.array(F.struct("x", "y"))).drop("x", "y")
    geopackage({"cluster_centers": (points, "point")}, f"{folder}/{city}.gpkg")
    table_csv(summary, f"{folder}/{city}_clusters.csv")
    content = {"hotspots": {city: {"centers": f"{folder}/{city}.gpkg", "summary": f"{folder}/{city}_clusters.csv", "clusters": summary.count(), "config": config}}}
    manifest(spark, f"{folder}/manifest.json", content, merge=("hotspots",))
    return content


def network_bundle(spark: SparkSession, folder: str, city: str, grid: DataFrame, nodes: DataFrame, edges: DataFrame, snapped: DataFrame, demand: DataFrame, summary: DataFrame, facts: dict) -> dict:
    """The eight artefacts of a city's network: graph, its layers, grid, hotspots, three tables, manifest.

    grid has points (corner rings); nodes node_id, x, y; edges u, v; snapped cluster_id,
    x, y, node_id, node_x, node_y, snap_distance_m.
    """
    folder = folder.rstrip("/")
    files = {k: f"{folder}/{n}" for k, n in (("graphml", "network.graphml"), ("network_gpkg", "network.gpkg"), ("grid_gpkg", "grid.gpkg"), ("hotspots_gpkg", "hotspots.gpkg"), ("cluster_summary_csv", "hotspot_cluster_summary.csv"), ("hotspot_node_map_csv", "hotspot_node_map.csv"), ("node_hotspot_demand_csv", "node_hotspot_demand.csv"))}
    graphml(nodes, edges, files["graphml"])
    xy = lambda *names: F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in names])
    ends = edges.join(nodes.select(F.col("node_id").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu")), "u").join(nodes.select(F.col("node_id").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv")), "v")
    lines = ends.withColumn("points", xy(("xu", "yu"), ("xv", "yv"))).drop("xu", "yu", "xv", "yv")
    geopackage({"nodes": (nodes.withColumn("points", xy(("x", "y"))), "point"), "edges": (lines, "line")}, files["network_gpkg"])
    geopackage({"grid_cells": (grid, "polygon")}, files["grid_gpkg"])
    layers = {"cluster_centers": (snapped.withColumn("points", xy(("x", "y"))), "point"), "snapped_nodes": (snapped.withColumn("points", xy(("node_x", "node_y"))), "point"), "snap_lines": (snapped.withColumn("points", xy(("x", "y"), ("node_x", "node_y"))), "line")}
    geopackage(layers, files["hotspots_gpkg"])
    for name, df in (("cluster_summary_csv", summary), ("hotspot_node_map_csv", snapped), ("node_hotspot_demand_csv", demand)):
        table_csv(df, files[name])
    content = {"city": city, "graph_node_count": nodes.count(), "graph_edge_count": edges.count(), "grid_cell_count": grid.count(), **facts, "outputs": files}
    manifest(spark, f"{folder}/manifest.json", content)
    return content


def city_bundle(spark: SparkSession, folder: str, city: str | None = None) -> dict:
    """A network bundle read back: manifest, hotspot_node_map, node_hotspot_demand and
    cluster_summary; another city's bundle is an error."""
    folder = folder.rstrip("/")
    content = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first().value)
    if city is not None and content["city"] != city:
        raise KeyError(city)
    read = lambda name: spark.read.csv(content["outputs"][name], header=True, inferSchema=True)
    return {"manifest": content, "hotspot_node_map": read("hotspot_node_map_csv"), "node_hotspot_demand": read("node_hotspot_demand_csv"), "cluster_summary": read("cluster_summary_csv")}


def roi_bundle(spark: SparkSession, folder: str, cells: DataFrame, polygons: DataFrame, transform: tuple[float, ...], distance: float, nodata: float = -9999.0) -> DataFrame:
    """Clipped raster and mask of every polygon as GeoTIFF, the rings as a layer, a table and
    a manifest of statistics.  Rows and columns of a clipped raster begin at its window."""
    from cityloom.functions.text import output_name
    from cityloom.operators import regions
    from cityloom.sources.lineage import stored

    folder = folder.rstrip("/")
    a, _, c, _, e, f = transform
    named = stored(polygons.withColumn("prefix", output_name(F.col("city_id"), F.col("city_name"))), "roi")
    boxes = regions.windows(named, transform, distance).select("city_id", "prefix", "row_min", "row_max", "col_min", "col_max")
    clipped = regions.clip_polygons(cells, named, transform, distance).select("city_id", "row_i", "col_i", "value")
    masked = regions.polygon_masks(named, transform, distance).withColumn("value", F.lit(1.0))

    def run(kind: str, empty: float, dtype: str):
        def write(key, frame):
            top, bottom, left, right = (int(frame[k].iloc[0]) for k in ("row_min", "row_max", "col_min", "col_max"))
            out = np.full((1, bottom - top + 1, right - left + 1), empty, dtype=dtype)
            some = frame[frame["value"].notna()]
            out[0, some["row_i"].to_numpy(dtype=int) - top, some["col_i"].to_numpy(dtype=int) - left] = some["value"].to_numpy()
            file = f"{folder}/{frame['prefix'].iloc[0]}_{kind}.tif"
            put(file, encode_geotiff(out, (a, 0.0, c + left * a, 0.0, e, f + top * e), empty))
            return pd.DataFrame({"city_id": [int(key[0])], f"{kind}_path": [file]})

        return write

    files = None
    for kind, rows, empty, dtype in (("baseline", clipped, nodata, "float32"), ("mask", masked, 0.0, "uint8")):
        made = boxes.join(rows, "city_id", "left").groupBy("city_id").applyInPandas(run(kind, empty, dtype), f"city_id long, {kind}_path string")
        made = stored(made, "roi-files")
        files = made if files is None else files.join(made, "city_id")
    geopackage({"rois": (named.select("city_id", "city_name", F.col("ring").alias("points")), "polygon")}, f"{folder}/rois.gpkg")
    records = stored(regions.roi_statistics(cells, named, transform, distance).join(files, "city_id"), "roi-records")
    table_csv(records.withColumn("bounds", F.to_json("bounds")), f"{folder}/roi_manifest.csv")
    rows = [r.asDict(recursive=True) for r in records.orderBy("city_id").collect()]  # one a city
    manifest(spark, f"{folder}/roi_manifest.json", {"roi_count": len(rows), "buffer_meters": distance, "rois": rows})
    return records
