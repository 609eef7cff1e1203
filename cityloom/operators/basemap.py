"""Basemaps: providers, tile ranges, mosaics and warps; fetching is an interface.

There is no network code here: a fetcher (provider, zoom, x, y -> bytes of decoded RGBA
pixels) is handed in, is called in tasks and may read a cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import geo

SIDE = 256


@dataclass(frozen=True)
class Provider:
    name: str
    template: str
    max_zoom: int = 19

    def url(self, zoom: int, x: int, y: int) -> str:
        return self.template.format(z=zoom, x=x, y=y)


def resolve_provider(name: str, providers: dict) -> Provider:
    """The provider at a dotted name in nested mappings; ValueError if there is none."""
    found = providers
    for part in name.split("."):
        if not isinstance(found, dict) or part not in found:
            raise ValueError(f"no tile provider {name!r}")
        found = found[part]
    if not isinstance(found, Provider):
        raise ValueError(f"{name!r} names a group of providers")
    return found


def provider_folder(name: Column) -> Column:
    """Name of a provider's cache folder."""
    return F.lower(F.replace(name, F.lit("."), F.lit("_")))


def wrapped_tile(zoom: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """x within the world's width, and y; a y outside the world is an error."""
    n = F.pow(F.lit(2.0), zoom).cast("long")
    legal = (y >= 0) & (y < n)
    return F.pmod(x, n), F.when(legal, y).otherwise(F.raise_error(F.format_string("tile row %s isn't on zoom %s", y.cast("string"), zoom.cast("string"))).cast("long"))


def tile_range(minx: Column, miny: Column, maxx: Column, maxy: Column, zoom: Column) -> list[Column]:
    """x_min, x_max, y_min, y_max of the tiles that web-Mercator bounds touch, kept in the world."""
    n = F.pow(F.lit(2.0), zoom)
    span = 2.0 * geo.HALF_WORLD / n
    at = lambda v: F.greatest(F.lit(0), F.least((n - 1).cast("long"), F.floor(v / span))).cast("long")
    return [at(minx + geo.HALF_WORLD), at(maxx + geo.HALF_WORLD), at(geo.HALF_WORLD - maxy), at(geo.HALF_WORLD - miny)]


def mosaic_layout(tiles: DataFrame) -> DataFrame:
    """Rows (zoom, x_min, x_max, y_min, y_max) with width_px, height_px and the bounds left,
    bottom, right, top of their mosaic in web-Mercator metres."""
    z = F.col("zoom")
    left, _, _, top = geo.tile_bounds(F.col("x_min"), F.col("y_min"), z)
    _, bottom, right, _ = geo.tile_bounds(F.col("x_max"), F.col("y_max"), z)
    return tiles.select("*", ((F.col("x_max") - F.col("x_min") + 1) * SIDE).alias("width_px"), ((F.col("y_max") - F.col("y_min") + 1) * SIDE).alias("height_px"), left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"))


def warped_size(minx: Column, miny: Column, maxx: Column, maxy: Column, long_side: int) -> tuple[Column, Column]:
    """Width and height in pixels of bounds whose longer side has long_side pixels."""
    w, h = F.greatest(maxx - minx, F.lit(1.0)), F.greatest(maxy - miny, F.lit(1.0))
    short = lambda a, b: F.greatest(F.lit(1), F.bround(F.lit(long_side) * a / b)).cast("long")
    return F.when(w >= h, F.lit(long_side).cast("long")).otherwise(short(w, h)), F.when(w >= h, short(h, w)).otherwise(F.lit(long_side).cast("long"))


def back_off(minx: float, miny: float, maxx: float, maxy: float, long_side: int, most_zoom: int, most_tiles: int) -> int:
    """Zoom of choose_zoom(), lowered until the bounds touch no more than most_tiles tiles."""
    side = max(maxx - minx, maxy - miny, 1.0)
    zoom = int(max(0, min(most_zoom, np.floor(np.log2(2 * geo.HALF_WORLD / 256.0 / (side / max(long_side, 1)))))))
    while zoom > 0:
        span = 2 * geo.HALF_WORLD / 2**zoom
        tiles = (int(maxx // span) - int(minx // span) + 1) * (int(maxy // span) - int(miny // span) + 1)
        if tiles <= most_tiles:
            break
        zoom -= 1
    return zoom


Fetch = Callable[[Provider, int, int, int], bytes]


def tile_pixels(spark: SparkSession, zoom: int, x_min: int, x_max: int, y_min: int, y_max: int, provider: Provider, fetch: Fetch) -> DataFrame:
    """row_i, col_i, red, green, blue of a mosaic; tiles are fetched in tasks."""
    across = x_max - x_min + 1
    tiles = spark.range(across * (y_max - y_min + 1)).select((F.lit(x_min) + F.col("id") % across).alias("x"), (F.lit(y_min) + F.floor(F.col("id") / across)).alias("y"))
    wrapped_x, legal_y = wrapped_tile(F.lit(zoom), F.col("x"), F.col("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, wrapped, y in zip(batch["x"], batch["wrapped"], batch["legal"]):
                pixels = np.frombuffer(fetch(provider, zoom, int(wrapped), int(y)), dtype=np.uint8).reshape(SIDE, SIDE, -1)
                row, col = np.divmod(np.arange(SIDE * SIDE), SIDE)
                flat = pixels.reshape(SIDE * SIDE, -1).astype(np.int64)
                yield pd.DataFrame({"row_i": (int(y) - y_min) * SIDE + row, "col_i": (int(x) - x_min) * SIDE + col, "red": flat[:, 0], "green": flat[:, 1], "blue": flat[:, 2]})

    return tiles.select("x", "y", wrapped_x.alias("wrapped"), legal_y.alias("legal")).mapInPandas(run, "row_i long, col_i long, red long, green long, blue long")


def warped(spark: SparkSession, pixels: DataFrame, mosaic: tuple[float, float, float, float], zoom: int, bounds: tuple[float, float, float, float], long_side: int) -> DataFrame:
    """row_i, col_i, red, green, blue on an equal-area grid over bounds (minx, miny, maxx, maxy
    in Mollweide metres): bilinear samples of a web-Mercator mosaic, black outside."""
    from cityloom.operators.raster import bilinear

    minx, miny, maxx, maxy = bounds
    w, h = max(maxx - minx, 1.0), max(maxy - miny, 1.0)
    width = long_side if w >= h else max(1, round(long_side * w / h))
    height = long_side if h > w else max(1, round(long_side * h / w))
    res = 2 * geo.HALF_WORLD / 2**zoom / SIDE
    targets = spark.range(width * height).select(F.floor(F.col("id") / width).alias("out_row"), (F.col("id") % width).alias("out_col"))
    lon, lat = geo.mollweide_inverse(minx + (F.col("out_col") + 0.5) * (w / width), maxy - (F.col("out_row") + 0.5) * (h / height))
    x, y = geo.mercator(lon, lat)
    placed = targets.withColumn("src_col", (x - mosaic[0]) / res - 0.5).withColumn("src_row", (mosaic[3] - y) / res - 0.5).where("src_col IS NOT NULL AND src_row IS NOT NULL")
    out = None
    for band in ("red", "green", "blue"):
        one = bilinear(pixels.select("row_i", "col_i", F.col(band).cast("double").alias("value")), placed).select("row_i", "col_i", F.bround("value").cast("long").alias(band))
        out = one if out is None else out.join(one, ["row_i", "col_i"])
    return out


def build(spark: SparkSession, bounds: tuple[float, float, float, float], provider: Provider, fetch: Fetch, long_side: int = 1600, pad: float = 0.05, most_tiles: int = 64) -> tuple[DataFrame, dict]:
    """The basemap of Mollweide bounds and its metadata: pad, project, choose a zoom, mosaic, warp."""
    one = spark.range(1)
    padded = one.select(*[c.alias(n) for c, n in zip(geo.padded(*[F.lit(float(b)) for b in bounds], pad), ("minx", "miny", "maxx", "maxy"))])
    box = tuple(padded.first())
    edge = spark.range(4 * 64).select((F.col("id") % 64 / 63.0).alias("t"), F.floor(F.col("id") / 64).alias("s"))
    x = F.when(F.col("s") < 2, F.lit(box[0]) + F.col("t") * (box[2] - box[0])).when(F.col("s") == 2, F.lit(box[0])).otherwise(F.lit(box[2]))
    y = F.when(F.col("s") == 0, F.lit(box[1])).when(F.col("s") == 1, F.lit(box[3])).otherwise(F.lit(box[1]) + F.col("t") * (box[3] - box[1]))
    mx, my = geo.mercator(*geo.mollweide_inverse(x, y))
    minx, miny, maxx, maxy = edge.select(mx.alias("x"), my.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    zoom = back_off(minx, miny, maxx, maxy, long_side, provider.max_zoom, most_tiles)
    names = ["x_min", "x_max", "y_min", "y_max"]
    tiles = one.select(F.lit(zoom).alias("zoom"), *[c.alias(n) for c, n in zip(tile_range(F.lit(minx), F.lit(miny), F.lit(maxx), F.lit(maxy), F.lit(zoom)), names)])
    layout = mosaic_layout(tiles).first()
    pixels = tile_pixels(spark, zoom, *[layout[n] for n in names], provider, fetch)
    mosaic = (layout["left"], layout["bottom"], layout["right"], layout["top"])
    return warped(spark, pixels, mosaic, zoom, box, long_side), {"provider": provider.name, "zoom": zoom, "bounds_mollweide": list(box), "mosaic_bounds_3857": list(mosaic), "tiles": {n: layout[n] for n in names}}
