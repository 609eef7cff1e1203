"""Tables behind figures and animations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions import geo
from cityloom.operators.flow import flow_delta, hour_at, nearest_tick, snapshot_ticks, top_corridors
from cityloom.operators.ordered import percentile, running_sum
from cityloom.operators.roads import is_major

METRICS = ["completed_trips", "mean_trip_minutes", "mean_distance_m", "max_utilization", "mean_utilization", "overloaded_edges"]


def timeseries(runs: dict[str, DataFrame]) -> DataFrame:
    """scenario, tick, metric, value of the tick metrics of several runs."""
    out = None
    for name, metrics in sorted(runs.items()):
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("p")
        rows = metrics.select(F.lit(name).alias("scenario"), "tick", pairs).select("scenario", "tick", "p.metric", "p.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def corridor_heatmap(used: DataFrame, n_ticks: int, most: int = 25) -> DataFrame:
    """rank, u, v, tick, utilization of the busiest corridors; 0 for ticks without load."""
    ranked = top_corridors(used, n_ticks, most).select("u", "v", "mean_utilization")
    order = F.row_number().over(Window.orderBy(F.desc("mean_utilization"), "u", "v"))
    grid = ranked.select(order.alias("rank"), "u", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_ticks - 1).cast("long"))).alias("tick"))
    return grid.join(used.select("tick", "u", "v", "utilization"), ["tick", "u", "v"], "left").select("rank", "u", "v", "tick", F.coalesce("utilization", F.lit(0.0)).alias("utilization"))


def animation_frames(used: DataFrame, edges: DataFrame, first: int, last: int, every: int, major_only: bool = True) -> DataFrame:
    """tick, u, v, road_class, utilization, width, caption of every frame's edges."""
    drawn = edges.where(is_major()) if major_only else edges
    width = F.when(is_major(), F.greatest(F.lit(0.8), F.lit(0.32 * 1.8))).otherwise(0.32)
    ticks = used.sparkSession.range(first, last + 1, every).withColumnRenamed("id", "tick")
    grid = F.broadcast(ticks).crossJoin(drawn.select("u", "v", "road_class"))
    joined = grid.join(used.select("tick", "u", "v", "utilization"), ["tick", "u", "v"], "left")
    return joined.select("tick", "u", "v", "road_class", F.coalesce("utilization", F.lit(0.0)).alias("utilization"), width.alias("width"), F.format_string("tick %d", "tick").alias("caption"))


def flow_snapshots(base: DataFrame, shock: DataFrame, first: int, last: int, n: int = 6) -> DataFrame:
    """tick, u, v, delta at n evenly spaced ticks."""
    return flow_delta(base, shock).where(F.col("tick").isin(snapshot_ticks(first, last, n)))


def grid_cells(mask: DataFrame, baseline: DataFrame, scored: DataFrame, candidate: DataFrame, transform: tuple[float, ...], width: int) -> DataFrame:
    """The cells of a region with 13 columns; values are null where the baseline isn't
    valid, clusters where the cell is no candidate.

    mask: row_i, col_i; baseline: value; scored: score, score_rank, local_score;
    candidate: cluster_id, each by row_i, col_i.
    """
    x, y = geo.cell_centre(F.col("row_i"), F.col("col_i"), transform)
    key = ["row_i", "col_i"]
    rows = mask.select(*key).join(baseline.select(*key, F.col("value").alias("baseline_value")), key, "left").join(scored.select(*key, "score", "score_rank", "local_score"), key, "left").join(candidate.select(*key, "cluster_id"), key, "left")
    return rows.select(
        F.col("row_i").alias("row"), F.col("col_i").alias("col"), (F.col("row_i") * width + F.col("col_i")).alias("cell_id"), x.alias("center_x"), y.alias("center_y"), F.lit(True).alias("in_roi"),
        F.col("baseline_value").isNotNull().alias("baseline_valid"), "baseline_value", "score", "score_rank", "local_score", F.col("cluster_id").isNotNull().alias("is_hotspot_candidate"), "cluster_id",
    )


def region_review(cells: DataFrame) -> DataFrame:
    """One row: valid cells, mean and percentiles of value and score (a stored table)."""
    shares = [("value", 0.5), ("value", 0.95), ("score", 0.5), ("score", 0.95)]
    found = [F.lit(percentile(cells, F.col(c), p)).cast("double").alias(f"{c}_p{int(100 * p)}") for c, p in shares]
    return cells.agg(F.count("value").alias("valid_pixels"), F.avg("value").alias("value_mean"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max")).select("*", *found)


def positions_at_peak(positions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sampled agents at the sampled tick nearest to that of the highest utilisation."""
    peak = metrics.agg(F.min_by("tick", F.struct(-F.col("max_utilization"), F.col("tick"))).alias("want"))
    near = nearest_tick(peak, positions.select("tick").distinct())
    return positions.join(F.broadcast(near.select("tick")), "tick")


def spatial_peak(used: DataFrame, metrics: DataFrame) -> DataFrame:
    """tick, u, v, utilization of a run's edges at its peak tick (one broadcast row)."""
    peak = metrics.agg(F.min_by("tick", F.struct(-F.col("max_utilization"), F.col("tick"))).alias("tick"))
    return used.join(F.broadcast(peak), "tick").select("tick", "u", "v", "utilization")


def marked_snapshots(base: DataFrame, shock: DataFrame, first: int, last: int, start: int, end: int, n: int = 6) -> DataFrame:
    """run, tick, u, v, utilization at n evenly spaced ticks of two runs, and whether the shock acts."""
    at = F.col("tick").isin(snapshot_ticks(first, last, n))
    both = base.select(F.lit("baseline").alias("run"), "tick", "u", "v", "utilization").union(shock.select(F.lit("scenario"), "tick", "u", "v", "utilization"))
    return both.where(at).withColumn("in_event", (F.col("tick") >= start) & (F.col("tick") < end) & (F.col("run") == "scenario"))


def edge_segments(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, x1, y1, x2, y2: edges as segments; where a node is missing, a point at the other."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    pick = lambda p, q, n: F.coalesce(p, q).alias(n)
    return edges.select("u", "v").join(a, "u", "left").join(b, "v", "left").select("u", "v", pick("xa", "xb", "x1"), pick("ya", "yb", "y1"), pick("xb", "xa", "x2"), pick("yb", "ya", "y2"))


def utilisation_matrix(used: DataFrame, edges: DataFrame, major_only: bool = False) -> DataFrame:
    """u, v, place, tick, utilization: the sparse matrix of edges (in order of u, v) by ticks."""
    kept = edges.where(is_major()) if major_only else edges
    numbered = running_sum(kept.select("u", "v", F.struct("u", "v").alias("_key"), F.lit(1).alias("_one")), "_key", "_one", "place")
    return numbered.select("u", "v", (F.col("place") - 1).alias("place")).join(used.select("tick", "u", "v", "utilization"), ["u", "v"])


def frame_captions(ticks: DataFrame, n_ticks: int, start: int, end: int, scenario: str, scope: str = "major", start_hour: float = 6.0) -> DataFrame:
    """tick, caption, edge_scope, in_event of animation frames."""
    hour = hour_at(F.col("tick"), start_hour)
    clock = F.format_string("%02d:%02d", F.floor(hour).cast("int"), F.floor((hour - F.floor(hour)) * 60 + 1e-9).cast("int"))
    inside = (F.col("tick") >= start) & (F.col("tick") < end)
    return ticks.select("tick", F.concat(F.lit(f"{scenario}, tick "), F.col("tick").cast("string"), F.lit(f" of {n_ticks}, "), clock, F.when(inside, " (event)").otherwise("")).alias("caption"), F.lit(scope).alias("edge_scope"), inside.alias("in_event"))


def with_source(tensors: dict[str, DataFrame]) -> DataFrame:
    """The rows of several tensors or windows, with the name of their source."""
    out = None
    for name, df in sorted(tensors.items()):
        rows = df.withColumn("source_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
