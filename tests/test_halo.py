"""Neighbour features by tiles against least squares on whole frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.operators import forecast

SCHEMA = "frame long, row_i long, col_i long, value double"


def _rows(cube, first=0):
    return [(int(t) + first, int(r), int(c), float(cube[t, r, c])) for t, r, c in zip(*np.nonzero(cube))]


def _whole(cube, history, horizon, radius):
    """Predictions of the test windows by least squares on dense frames."""
    t, h, w = cube.shape
    padded = np.pad(cube, ((0, 0), (radius, radius), (radius, radius)))
    side = 2 * radius + 1
    x = lambda f: np.column_stack([np.ones(h * w), *(padded[f - k, i : i + h, j : j + w].ravel() for k in range(history) for i in range(side) for j in range(side))])
    ends = list(range(history - 1, t - horizon))
    tests = max(1, int(len(ends) * 0.15))
    train, test = ends[: len(ends) - 2 * tests], ends[-tests:]
    weights = np.linalg.lstsq(np.vstack([x(f) for f in train]), np.concatenate([cube[f + horizon].ravel() for f in train]), rcond=None)[0]
    return {(f, i // w, i % w): p for f in test for i, p in enumerate(x(f) @ weights)}


@pytest.mark.parametrize("horizon", [1, 2])
def test_equals_least_squares_across_tiles(spark, horizon):
    rng = np.random.default_rng(1)
    cube = rng.random((40, 9, 7)) * (rng.random((40, 9, 7)) < 0.7)
    df = spark.createDataFrame([*_rows(cube, 100), (120, 50, 1, 9.0)], SCHEMA)
    got = forecast.halo_regression(df, 9, 7, history=2, horizon=horizon, tile=4, block=8, ridge=0.0).collect()
    want = _whole(cube, 2, horizon, 1)
    assert {(r.frame - 100, r.row_i, r.col_i) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r.predicted == pytest.approx(want[r.frame - 100, r.row_i, r.col_i], abs=1e-9)
        assert r.value == cube[r.frame - 100 + horizon, r.row_i, r.col_i]


def test_beats_persistence_on_a_moving_pattern(spark):
    y, x = np.mgrid[:20, :20]
    cube = np.stack([np.exp(-(((y - (3 + 0.5 * t) % 20) ** 2) + (x - (5 + 0.7 * t) % 20) ** 2) / 6.0) for t in range(60)])
    cube[cube < 1e-3] = 0
    df = spark.createDataFrame(_rows(cube), SCHEMA)
    halo = forecast.errors(forecast.halo_regression(df, 20, 20, tile=8, block=16)).first()
    still = np.sqrt(np.mean((cube[-9:] - cube[-10:-1]) ** 2))
    assert halo.n > 0 and halo.rmse < 0.6 * still
    assert forecast.halo_regression(df.where("frame < 3"), 20, 20).count() == 0
    assert forecast.halo_regression(df.limit(0), 20, 20).withColumn("x", F.lit(1)).count() == 0
