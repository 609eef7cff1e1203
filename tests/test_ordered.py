"""Quantiles of small and large groups."""

import random

import numpy as np
from pyspark.sql import functions as F

from cityloom.operators import ordered


def test_small_groups_are_sorted_without_a_sketch(spark, monkeypatch):
    """Many small groups, one without a key, and one large group, which alone is sketched."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), float(rng.randrange(40))) for _ in range(600)] + [(99, rng.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "g long, v double")
    sketched, plain = [], ordered._sketched
    monkeypatch.setattr(ordered, "_sketched", lambda rows, *rest: sketched.append(rows) or plain(rows, *rest))
    got = {r.g: (r.a, r.b) for r in ordered.quantiles(df, ["g"], F.col("v"), {"a": 0.25, "b": 0.9}, 100).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, found in got.items():
        assert np.allclose(found, np.quantile([v for k, v in rows if k == g], [0.25, 0.9]))
    assert [r.g for r in sketched[0].select("g").distinct().collect()] == [99]
    sketched.clear()
    assert ordered.quantiles(df.where("g < 99"), ["g"], F.col("v"), {"a": 0.25}, 100).count() == 30 and not sketched
