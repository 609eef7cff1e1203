"""Demand: clusters, snapping to nodes, weights and choices."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.operators.nearest import nearest_nodes
from cityloom.operators.ordered import quantiles, running_sum
from cityloom.sources.lineage import stored


def kmeans(cells: DataFrame, features: list[str], k: int, weight: str, seed: int = 42, rounds: int = 20, clusterer=None) -> DataFrame:
    """cells with cluster_id from weighted k-means on standardised features, with as many
    clusters as asked for or as there are cells.

    clusterer: another estimator of pyspark.ml that reads _x and writes cluster_id.
    """
    k = min(k, cells.count())
    if k < 2 and clusterer is None:  # one cluster, or no cells
        return cells.withColumn("cluster_id", F.lit(0))
    vectors = VectorAssembler(inputCols=features, outputCol="_raw").transform(cells)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(vectors).transform(vectors)
    clusterer = clusterer or KMeans(k=k, featuresCol="_x", predictionCol="cluster_id", weightCol=weight, seed=seed, maxIter=rounds)
    return clusterer.fit(scaled).transform(scaled).drop("_raw", "_x")


def cluster_summary(cells: DataFrame) -> DataFrame:
    """Sizes, scores and plain and weighted centres by cluster, in one aggregation."""
    weighted = lambda c: F.try_divide(F.sum(F.col("local_score") * F.col(c)), F.sum("local_score"))
    return cells.groupBy("cluster_id").agg(
        F.count("*").alias("pixel_count"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.avg("local_score").alias("mean_local_score"), F.sum("local_score").alias("weight_sum"),
        F.avg("row_i").alias("center_row"), F.avg("col_i").alias("center_col"), weighted("row_i").alias("weighted_center_row"), weighted("col_i").alias("weighted_center_col"),
    ).orderBy(F.desc("mean_local_score"), F.desc("pixel_count"), "cluster_id")


def snap_nearest(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (cluster_id, x, y, ...) with node_id, node_x, node_y, snap_distance_m of the
    nearest node (of equals, the smallest id); a stored table, as callers read it often."""
    points = stored(points.withColumn("_point", F.monotonically_increasing_id()), "snap-points")
    nodes = stored(nodes.select("node_id", F.col("x").cast("double").alias("node_x"), F.col("y").cast("double").alias("node_y")), "snap-nodes")
    if not nodes.limit(1).count():
        raise ValueError("there are no nodes to snap to")
    return stored(points.join(nearest_nodes(points, nodes), "_point").drop("_point"), "snapped")


def node_demand(snapped: DataFrame, scores: tuple[str, ...] = ("weight",)) -> DataFrame:
    """Clusters, cells and sums of scores by node: hotspot_count, sum_pixel_count, sum_*."""
    return snapped.groupBy("node_id").agg(F.count("*").alias("hotspot_count"), F.sum("pixel_count").alias("sum_pixel_count"), *[F.sum(s).alias(f"sum_{s}") for s in scores])


def demand_order(demand: DataFrame) -> DataFrame:
    """By sum_mean_local_score, then hotspot_count (both falling), then node."""
    return demand.orderBy(F.desc("sum_mean_local_score"), F.desc("hotspot_count"), "node_id")


def with_node_attributes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (node_id, ...) with the columns of nodes; a node that isn't there is an error."""
    joined = rows.join(nodes.withColumn("_there", F.lit(True)), "node_id", "left")
    lost = joined.where("_there IS NULL").select("node_id").limit(5).collect()
    if lost:
        raise KeyError("unknown nodes: " + ", ".join(str(r.node_id) for r in lost))
    return joined.drop("_there")


def within_nodes(demand: DataFrame, nodes: DataFrame) -> DataFrame:
    """Demand at the given nodes only, such as those of the strongly connected part."""
    return demand.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def attractor_points(nodes: DataFrame, attracting: DataFrame) -> DataFrame:
    """The nodes that attract."""
    return nodes.join(attracting.select("node_id"), "node_id", "left_semi")


def strongest_node(attracting: DataFrame) -> DataFrame:
    """node_id of the largest weight (of equals, the smallest id): one row."""
    return attracting.agg(F.min_by("node_id", F.struct(-F.col("sum_weight"), F.col("node_id"))).alias("node_id"))


def snap_statistics(snapped: DataFrame) -> DataFrame:
    d = F.col("snap_distance_m")
    found = quantiles(snapped, [], d, {"median_m": 0.5, "p95_m": 0.95}).first()
    halves = [F.lit(found and found[name]).cast("double").alias(name) for name in ("median_m", "p95_m")]
    return snapped.agg(F.min(d).alias("min_m"), F.max(d).alias("max_m"), F.avg(d).alias("mean_m")).select("*", *halves)


def attractors(demand: DataFrame, top: int) -> DataFrame:
    """The top nodes by weight, with their shares of the whole."""
    total = demand.agg(F.sum("sum_weight").alias("_t"))
    return demand.orderBy(F.desc("sum_weight"), "node_id").limit(top).crossJoin(F.broadcast(total)).select("node_id", "sum_weight", F.try_divide("sum_weight", "_t").alias("weight_share"))


def destination_weights(attracting: DataFrame, power: Column, surge: Column | float = 1.0, exclude: Column | None = None) -> DataFrame:
    """node_id, p: chances by (weight x surge) ** power, none for excluded nodes."""
    w = F.pow(F.col("sum_weight") * surge, power)
    w = F.when(exclude, 0.0).otherwise(w) if exclude is not None else w
    weighted = attracting.select("node_id", w.alias("_w"))
    total = weighted.agg(F.sum("_w").alias("_t"))
    return weighted.crossJoin(F.broadcast(total)).where("_t > 0").select("node_id", (F.col("_w") / F.col("_t")).alias("p"))


def weighted_choice(draws: DataFrame, chances: DataFrame) -> DataFrame:
    """draws (draw_id, u in [0, 1)) with the node whose stretch of the cumulated chances holds u.

    0..1 is cut into as many ranges as there are chances; chances are sent to the ranges
    they touch and draws to their own, so neither list is held whole.
    """
    ends = stored(running_sum(chances.select("node_id", "p"), "node_id", "p", "upto"), "choice")
    n, last = ends.agg(F.count("*"), F.max("node_id")).first()
    cuts = max(1, n)
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(cuts - 1), F.floor(x * cuts))).cast("long")
    touched = ends.select("node_id", "upto", F.explode(F.sequence(at(F.col("upto") - F.col("p") - 1e-9), at(F.col("upto") + 1e-9))).alias("_cut"))
    found = draws.withColumn("_cut", at(F.col("u"))).join(touched, "_cut").where("upto > u").groupBy("draw_id").agg(F.min("node_id").alias("node_id"))
    return draws.select("draw_id").join(found, "draw_id", "left").select("draw_id", F.coalesce("node_id", F.lit(last)).alias("node_id"))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Counter-based draw in [0, 1) that DuckDB can compute as well: products stay below 2**63."""
    p = F.lit(2147483647).cast("long")
    h = F.lit(seed).cast("long")
    for k in [*keys, F.lit(17)]:
        x = h + k.cast("long") + 1
        h = ((x * x) % p * 48271 + 12820163) % p
    return h / 2147483647.0


def hash_uniform_sql(seed: int, *keys: str) -> str:
    h = f"CAST({seed} AS BIGINT)"
    for k in [*keys, "17"]:
        x = f"({h} + CAST({k} AS BIGINT) + 1)"
        h = f"((({x} * {x}) % 2147483647 * 48271 + 12820163) % 2147483647)"
    return f"{h} / CAST(2147483647 AS DOUBLE)"
