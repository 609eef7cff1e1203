"""Interval and as-of joins against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cityloom.operators import temporal


def test_interval_join_equals_a_loop(spark):
    rng = random.Random(1)
    spells = []
    for i in range(120):
        a = rng.randrange(-60, 60)
        spells.append((i, a, a + rng.choice([0, 1, 2, 3, 7, 8, 33, 64, 10**9, -4])))
    spells += [(900, None, 5), (901, 5, None), (902, -(2**62), 2**62 - 1)]
    points = [(k, rng.randrange(-80, 80)) for k in range(60)] + [(99, None), (98, 10**9)]
    got = temporal.interval_join(spark.createDataFrame(points, "k long, at long"), "at", spark.createDataFrame(spells, "i long, a long, b long"), "a", "b")
    want = sorted((k, i) for k, at in points for i, a, b in spells if None not in (at, a, b) and a <= at < b)
    assert sorted((r.k, r.i) for r in got.collect()) == want
    explained = spark.createDataFrame(spells, "i long, a long, b long").limit(0)
    assert temporal.interval_join(spark.createDataFrame(points, "k long, at long"), "at", explained, "a", "b").count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("keyed", [True, False])
def test_as_of_equals_a_loop(spark, direction, keyed):
    rng = random.Random(2)
    left = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([40, 40, 40, rng.randrange(100)])) for i in range(300)] + [(999, 1, None), (998, 7, 5)]
    right = [(rng.choice([1, 1, 2, None]), t, f"v{t}") for t in rng.sample(range(0, 300, 3), 40)] + [(1, None, "none")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        by = ("key",) if keyed else ()
        a = spark.createDataFrame(left, "i long, key long, at long")
        b = spark.createDataFrame(right, "key long, t long, v string")
        got = {r.i: r.found and (r.found.t, r.found.v) for r in temporal.as_of(a, "at", b, "t", by, direction).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(left)
    for i, key, at in left:
        there = [(t, v) for k, t, v in right if t is not None and (k == key or not keyed)]
        below = max((x for x in there if at is not None and x[0] <= at), default=None)
        above = min((x for x in there if at is not None and x[0] >= at), default=None)
        near = below if above is None or (below is not None and at - below[0] <= above[0] - at) else above
        assert got[i] == {"backward": below, "forward": above, "nearest": near}[direction], (i, key, at)


def test_as_of_looks_at_each_row_once(spark):
    """One key in one task: frames that run to the end of their rows would take minutes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        a = spark.range(60_000).select("id", F.lit(1).alias("key"), (F.col("id") * 2).alias("at"))
        b = spark.range(60_000).select(F.lit(1).alias("key"), (F.col("id") * 2 + 1).alias("t"))
        for direction, step in (("forward", 1), ("nearest", -1), ("backward", -1)):
            began = time.perf_counter()
            found = temporal.as_of(a, "at", b, "t", ("key",), direction).where("id > 0")
            assert found.where(F.col("found.t") == F.col("at") + step).count() == 59_999
            assert time.perf_counter() - began < 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
