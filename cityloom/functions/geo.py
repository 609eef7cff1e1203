"""Map tiles and projections as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_WORLD = 20037508.342789244
MAX_LATITUDE = 85.05112878


def tile_x(lon: Column, zoom: Column) -> Column:
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.floor((wrapped + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    cut = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return F.floor((1.0 - F.asinh(F.tan(F.radians(cut))) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_bounds(x: Column, y: Column, zoom: Column) -> list[Column]:
    """left, bottom, right, top of a tile in web-Mercator metres."""
    span = 2.0 * HALF_WORLD / F.pow(F.lit(2.0), zoom)
    left, top = -HALF_WORLD + x * span, HALF_WORLD - y * span
    return [left, top - span, left + span, top]


def choose_zoom(minx: Column, miny: Column, maxx: Column, maxy: Column, pixels: int, most: int) -> Column:
    side = F.greatest(maxx - minx, maxy - miny, F.lit(1.0))
    zoom = F.floor(F.log2(F.lit(2.0 * HALF_WORLD / 256.0) / (side / max(pixels, 1))))
    return F.greatest(F.lit(0), F.least(F.lit(most), zoom)).cast("long")


def padded(minx: Column, miny: Column, maxx: Column, maxy: Column, share: float) -> list[Column]:
    """Bounds widened by a share of their extents (of at least 1)."""
    w, h = F.greatest(maxx - minx, F.lit(1.0)) * share, F.greatest(maxy - miny, F.lit(1.0)) * share
    return [minx - w, miny - h, maxx + w, maxy + h]


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    cut = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return lon * (HALF_WORLD / 180.0), F.asinh(F.tan(F.radians(cut))) * (HALF_WORLD / math.pi)


def mollweide(lon: Column, lat: Column, radius: float = 6378137.0, rounds: int = 12) -> tuple[Column, Column]:
    """Equal-area forward projection; the angle comes from Newton steps, exact at the poles."""
    phi = F.radians(lat)
    step = lambda t, _: t - (2 * t + F.sin(2 * t) - math.pi * F.sin(phi)) / F.nullif(2 + 2 * F.cos(2 * t), F.lit(0.0))
    theta = F.when(F.abs(lat) >= 90, F.signum(lat) * (math.pi / 2)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), phi * 0.9, step))
    root = math.sqrt(2.0) * radius
    return 2 * root / math.pi * F.radians(lon) * F.cos(theta), root * F.sin(theta)


def mollweide_inverse(x: Column, y: Column, radius: float = 6378137.0) -> tuple[Column, Column]:
    root = math.sqrt(2.0) * radius
    theta = F.asin(F.greatest(F.least(y / root, F.lit(1.0)), F.lit(-1.0)))
    return F.degrees(math.pi * x / F.nullif(2 * root * F.cos(theta), F.lit(0.0))), F.degrees(F.asin((2 * theta + F.sin(2 * theta)) / math.pi))


def cell_centre(row: Column, col: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    a, _, c, _, e, f = transform
    return c + (col + 0.5) * a, f + (row + 0.5) * e


def cell_of(x: Column, y: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    a, _, c, _, e, f = transform
    return F.floor((y - f) / e).cast("long"), F.floor((x - c) / a).cast("long")


def line_centroid(points: Column) -> Column:
    """Length-weighted centre (struct x, y) of a line (array of structs x, y); its first point if it has no length."""
    n = F.size(points)
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(steps, lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b")))
    long = lambda s: F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], F.lit(2.0)) + F.pow(s["b"]["y"] - s["a"]["y"], F.lit(2.0)))
    total = F.aggregate(parts, F.lit(0.0), lambda t, s: t + long(s))
    mean = lambda c: F.coalesce(F.aggregate(parts, F.lit(0.0), lambda t, s: t + long(s) * (s["a"][c] + s["b"][c]) / 2) / F.nullif(total, F.lit(0.0)), F.get(points, F.lit(0))[c])
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def line_between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A line (array of structs x, y) of two points."""
    return F.array(F.struct(x1.alias("x"), y1.alias("y")), F.struct(x2.alias("x"), y2.alias("y")))


def cell_ring(row: Column, col: Column, transform: tuple[float, ...]) -> Column:
    """The four corners of a grid cell as a ring, from its least x and y on."""
    a, _, c, _, e, f = transform
    left, right, one, two = c + col * a, c + (col + 1) * a, f + row * e, f + (row + 1) * e
    low, high = F.least(one, two), F.greatest(one, two)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((left, low), (right, low), (right, high), (left, high))])
