"""Scan-line spans against the test of each point."""

import math
import random

import pytest

from cityloom.operators import regions


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def _star(rng, cx, cy, far, n):
    return [(cx + far * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + far * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("transform", [(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0.1, 0.0, -3.0, 0.0, -0.1, 7.0)])
def test_spans_equal_the_point_test(spark, transform):
    rng = random.Random(3)
    a, _, c, _, e, f = transform
    unit = abs(a)
    shapes = {}
    for i in range(6):  # concave outlines, a hole and a second part
        cx, cy = c + 30 * unit, f + e * 30
        shapes[i] = [_star(rng, cx, cy, 20 * unit, rng.randrange(5, 30)), _star(rng, cx, cy, 5 * unit, 7), _star(rng, cx + 50 * unit, cy, 9 * unit, 5)]
    shapes[10] = [[(c + a * x, f + e * y) for x, y in ((2.5, 2.5), (9.5, 2.5), (9.5, 8.5), (2.5, 8.5))]]  # sides through centres
    shapes[11] = [[(c, f), (c + a * 3, f)], [(c + a, f + e * 4.5), (c + a * 5, f + e * 4.5), (c + a * 9, f + e * 4.5)]]  # nothing inside
    shapes[12] = [[*((c + a * x, f + e * y) for x, y in ((1, 1), (8, 1), (8, 8))), (c + a * 1, f + e * 1)]]  # closed
    rows = [(i, f"n{i}", [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for i, rings in shapes.items()]
    frame = spark.createDataFrame(rows, "city_id long, city_name string, rings array<array<struct<x: double, y: double>>>")
    got = {(r.city_id, r.row_i, r.col_i) for r in regions.polygon_masks(frame, transform).collect()}
    want = {(i, r, k) for i, rings in shapes.items() for r in range(-5, 80) for k in range(-5, 110) if inside(c + (k + 0.5) * a, f + (r + 0.5) * e, rings)}
    assert got == want
    counts = {r.city_id: r.pixel_count_inside_mask for r in regions.roi_statistics(spark.createDataFrame([(1, 1, 2.0)], "row_i long, col_i long, value double"), frame, transform).collect()}
    assert counts == {i: sum(1 for j, _, _ in want if j == i) for i in shapes}
    with pytest.raises(ValueError):
        regions.spans(frame, (1.0, 0.5, 0.0, 0.0, 1.0, 0.0))
