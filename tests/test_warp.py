"""Exact overlap areas against polygon clipping."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cityloom.operators import raster


def clipped_area(ring, r, c):
    """Area of a convex or concave ring (y, x) within the cell r, c."""
    for axis, bound, sign in ((0, r, 1), (0, r + 1, -1), (1, c, 1), (1, c + 1, -1)):
        out = []
        for a, b in zip(ring, [*ring[1:], ring[0]]):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, [*ring[1:], ring[0]]))) / 2


MAPS = {
    "turned": lambda r, c, m: (r * m.cos(0.5) * 0.8 - c * m.sin(0.5) * 0.8 + 6.3, r * m.sin(0.5) * 0.8 + c * m.cos(0.5) * 0.8 + 0.7),
    "mirrored and wide": lambda r, c, m: (9.0 - 2.3 * r * 0.5, 3.7 * c * 0.6 + 0.2 * r + 0.1),
    "whole steps": lambda r, c, m: (r + 2.0, c * 2.0),
    "curved": lambda r, c, m: (r * 1.1 + 0.02 * c * c + 0.5, c * 1.3 + 0.03 * r * r + 0.25),
}


@pytest.mark.parametrize("kind", MAPS)
@pytest.mark.parametrize("densify", [1, 3])
def test_shares_equal_clipped_areas_and_keep_the_mass(spark, kind, densify):
    rng = random.Random(4)
    cells = [(r, c, rng.uniform(1, 9)) for r in range(6) for c in range(7) if rng.random() < 0.8]
    place = MAPS[kind]
    frame = spark.createDataFrame([*cells, (3, 50, None)], "row_i long, col_i long, value double")
    got = {(r.row_i, r.col_i): r.value for r in raster.warp_exact(frame, lambda r, c: place(r, c, F) if kind != "turned" else place(r, c, math), 40, 40, densify).collect()}
    along = [i / densify for i in range(densify)]
    outline = [(0.0, t) for t in along] + [(t, 1.0) for t in along] + [(1.0, 1.0 - t) for t in along] + [(1.0 - t, 0.0) for t in along]
    want = {}
    for r, c, v in cells:
        ring = [place(r + a, c + b, math) for a, b in outline]
        whole = abs(sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(ring, [*ring[1:], ring[0]]))) / 2
        for i in range(math.floor(min(p[0] for p in ring)), math.ceil(max(p[0] for p in ring))):
            for j in range(math.floor(min(p[1] for p in ring)), math.ceil(max(p[1] for p in ring))):
                if (part := clipped_area(ring, i, j)) > 1e-12:
                    want[i, j] = want.get((i, j), 0.0) + v * part / whole
    inside = {k: v for k, v in want.items() if 0 <= k[0] < 40 and 0 <= k[1] < 40}
    assert {k for k, v in got.items() if v > 1e-9} == {k for k, v in inside.items() if v > 1e-9}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in inside.items() if v > 1e-9)
    if inside == want:
        assert sum(got.values()) == pytest.approx(sum(v for _, _, v in cells), rel=1e-9)


def test_images_without_area_and_outside(spark):
    frame = spark.createDataFrame([(0, 0, 2.0), (1, 1, 3.0)], "row_i long, col_i long, value double")
    got = raster.warp_exact(frame, lambda r, c: (F.lit(1.5) + r * 0, c * 1.0), 5, 5).collect()
    assert sorted((r.row_i, r.col_i, r.value) for r in got) == [(1, 0, 2.0), (1, 1, 3.0)]
    assert raster.warp_exact(frame, lambda r, c: (r + 100.0, c), 5, 5).count() == 0
    half = raster.warp_exact(frame.limit(1), lambda r, c: (r - 0.5, c - 0.25), 5, 5).collect()
    assert [(r.row_i, r.col_i, round(r.value, 12)) for r in half] == [(0, 0, 0.75)]
