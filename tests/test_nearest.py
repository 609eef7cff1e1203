"""Nearest nodes against all distances, on crowded and far places."""

import random

import numpy as np

from pyspark.sql import functions as F

from cityloom.operators import demand, nearest


def _check(spark, points, nodes, leaf=4, fan=3):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "_point long, x double, y double")
    table = spark.createDataFrame(nodes, "node_id long, node_x double, node_y double")
    got = {r._point: (r.node_id, r.snap_distance_m) for r in nearest.nearest_nodes(frame, table, leaf, fan).collect()}
    for i, (x, y) in enumerate(points):
        d, n = min((float(np.sqrt((x - a) ** 2 + (y - b) ** 2)), k) for k, a, b in nodes)
        assert got[i] == (n, d), (i, got[i], n, d)
    assert len(got) == len(points)


def test_crowded_places_and_outliers(spark):
    rng = random.Random(1)
    nodes = [(k, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for k in range(200)] + [(300 + k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(150)] + [(999, 1e7, -1e7)]
    points = [(rng.gauss(0, 0.02), rng.gauss(0, 0.02)) for _ in range(60)] + [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(60)] + [(9e6, -9e6), (-1e9, 3.0)]
    _check(spark, points, nodes)


def test_ties_lines_and_one_place(spark):
    _check(spark, [(0.0, 0.0), (2.0, 0.0), (1.0, 5.0)], [(5, 1.0, 0.0), (4, 1.0, 0.0), (9, -1.0, 0.0)] + [(20 + k, 1.0, 0.0) for k in range(30)])
    _check(spark, [(float(k) / 2, 0.0) for k in range(20)], [(k, float(k), 0.0) for k in range(10)])
    _check(spark, [(3.0, 3.0)], [(1, 0.0, 0.0)])


def test_leaves_are_even(spark):
    rng = random.Random(2)
    nodes = [(k, rng.gauss(0, 1e-6), 0.0) for k in range(500)] + [(500 + k, rng.uniform(0, 1e6), rng.uniform(0, 1e6)) for k in range(500)]
    index = nearest.indexed(spark.createDataFrame(nodes, "node_id long, node_x double, node_y double"), 16, 8)
    sizes = [r["count"] for r in index.groupBy("_leaf").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 16 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    assert max(r["count"] for r in index.groupBy("_branch").count().collect()) <= 128


def test_snapping_keeps_columns(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, "a"), (1, 10.0, 0.0, "b")], "cluster_id long, x double, y double, name string")
    nodes = spark.createDataFrame([(7, 1, 0), (8, 9, 0)], "node_id int, x int, y int")
    assert {(r.name, r.node_id, r.snap_distance_m) for r in demand.snap_nearest(points, nodes).collect()} == {("a", 7, 1.0), ("b", 8, 1.0)}


def test_a_crowd_at_one_leaf_is_dealt_to_many_tasks(spark, monkeypatch):
    """All points ask for one leaf: no copy of it meets many more than HOT of them."""
    monkeypatch.setattr(nearest, "HOT", 50)
    points = spark.range(2000).select(F.col("id").alias("_point"), (F.col("id") % 40 / 1000).alias("x"), (F.col("id") / 100000).alias("y"), F.lit(7).alias("_leaf"))
    held = spark.createDataFrame([(7, [1, 2]), (8, [3])], "_leaf int, below array<int>")
    dealt = nearest._below(points, held, "_leaf")
    assert dealt.count() == 2000 and dealt.where("below <> array(1, 2)").count() == 0
    shares = points.withColumn("_copy", F.pmod(F.xxhash64("_point"), F.lit(41))).groupBy("_copy").count().agg(F.max("count"), F.count("*")).first()
    assert shares[1] == 41 and shares[0] < 100
    _check(spark, [(k % 20 / 1000, k / 100000) for k in range(300)], [(k, float(k % 30), float(k // 30)) for k in range(600)])


def test_snapped_points_are_found_once(spark):
    """What is made of snapped points reads them from a stored table."""
    points = spark.createDataFrame([(k, float(k), 0.0, 1, 1.0) for k in range(9)], "cluster_id long, x double, y double, pixel_count long, weight double")
    nodes = spark.createDataFrame([(7, 1.0, 0.0), (8, 6.0, 0.0)], "node_id long, x double, y double")
    whole = demand.node_demand(demand.snap_nearest(points, nodes))
    assert "nearest" not in "".join(whole.inputFiles()) and all("/snapped-" in f for f in whole.inputFiles())
