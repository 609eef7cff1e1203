"""Road tables: classes, capacities, cheapest edges and scenario edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions.text import list_tokens
from cityloom.operators.temporal import interval_join

# Class, priority (null: never first), capacity, penalty.
CLASSES = [
    ("motorway", 0, 220.0, 1.00),
    ("motorway_link", 1, 180.0, 1.03),
    ("trunk", 2, 180.0, 1.04),
    ("trunk_link", 3, 150.0, 1.08),
    ("primary", 4, 140.0, 1.10),
    ("primary_link", 5, 120.0, 1.14),
    ("secondary", 6, 100.0, 1.20),
    ("secondary_link", 7, 85.0, 1.24),
    ("tertiary", 8, 70.0, 1.34),
    ("tertiary_link", 9, 60.0, 1.40),
    ("residential", 10, 38.0, 1.62),
    ("living_street", 11, 24.0, 1.80),
    ("service", 12, 20.0, 1.95),
    ("unclassified", 13, 30.0, 1.55),
    ("other", None, 28.0, 1.70),
]
# Major classes, and the tiers that shocks are looked for in, in order.
MAJOR = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"]
TIERS = [["trunk", "trunk_link"], ["primary", "primary_link"], ["secondary", "secondary_link"], ["motorway", "motorway_link"]]


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "road_class string, priority int, capacity double, penalty double")


def road_class(highway: Column) -> Column:
    """First class of the priority list among the tokens, else the first token, else other."""
    tokens = list_tokens(highway)
    ordered = F.array(*[F.lit(c) for c, p, _, _ in CLASSES if p is not None])
    return F.coalesce(F.get(F.array_intersect(ordered, tokens), F.lit(0)), F.get(tokens, F.lit(0)), F.lit("other"))


def lane_count(lanes: Column) -> Column:
    """Mean of the numbers in a list-like value, at least 1; 1 without any."""
    numbers = F.filter(F.transform(list_tokens(lanes, ",;"), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(numbers), F.lit(0))
    return F.greatest(F.coalesce(mean, F.lit(1.0)), F.lit(1.0))


def routing_edges(raw: DataFrame) -> DataFrame:
    """Class, lanes, capacity and cost of each raw edge; unknown classes cost as other.

    Highway and lane values are few whatever the number of edges, so each pair of them is
    taken apart once and joined back.
    """
    dims = F.broadcast(class_table(raw.sparkSession).drop("priority"))
    other = next(c for c in CLASSES if c[0] == "other")
    kinds = raw.groupBy(F.col("highway").alias("_h"), F.col("lanes").alias("_l")).agg(F.count("*"))
    kinds = kinds.select("_h", "_l", road_class(F.col("_h")).alias("road_class"), lane_count(F.col("_l")).alias("lane_count"))
    classed = raw.join(kinds, F.col("highway").eqNullSafe(F.col("_h")) & F.col("lanes").eqNullSafe(F.col("_l")))
    length = F.greatest(F.coalesce(F.nullif("length_m", F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    return classed.join(dims, "road_class", "left").select(
        "u", "v", "edge_key", length.alias("length_m"), "road_class", "lane_count",
        (F.coalesce("capacity", F.lit(other[2])) * F.greatest("lane_count", F.lit(1.0))).alias("base_capacity"),
        F.coalesce("penalty", F.lit(other[3])).alias("road_penalty"),
        (length * F.coalesce("penalty", F.lit(other[3]))).alias("base_cost"),
    )


def cheapest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (u, v): the cheapest, then the smallest key."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    best = F.min_by(F.struct(*rest), F.struct("base_cost", "edge_key")).alias("e")
    return edges.groupBy("u", "v").agg(best).select("u", "v", "e.*")


def is_major(name: str = "road_class") -> Column:
    return F.col(name).isin(MAJOR)


def scenario_edges(edges: DataFrame, most: int = 8, least: int = 4, capacity: float = 40.0) -> DataFrame:
    """Edges that shocks hit: the lowest capacities of the first tier with enough edges,
    else of the major roads, else of all."""
    tier = F.lit(None).cast("int")
    for i, names in reversed(list(enumerate(TIERS))):
        tier = F.when(F.col("road_class").isin(names) & (F.col("base_capacity") >= capacity), i).otherwise(tier)
    ranked = edges.withColumn("tier", tier)
    enough = ranked.where("tier IS NOT NULL").groupBy("tier").count().where(F.col("count") >= least).agg(F.min("tier").alias("best"))
    majors = edges.agg(F.count_if(is_major()).alias("majors"))
    chosen = ranked.crossJoin(F.broadcast(enough)).crossJoin(F.broadcast(majors))
    fits = F.when(F.col("best").isNotNull(), F.col("tier") == F.col("best")).otherwise(is_major() | (F.col("majors") == 0))
    return chosen.where(fits).orderBy("base_capacity", "u", "v").limit(most).select("u", "v", "road_class", "base_capacity")


def event_edges(events: DataFrame) -> DataFrame:
    """kind, tick_start, tick_end, u, v, capacity_factor of events with ``edges``, one ``edge`` or none."""
    edges = F.coalesce("edges", F.when(F.col("edge").isNotNull(), F.array("edge")), F.array().cast(dict(events.dtypes)["edges"]))
    return events.select("kind", "tick_start", "tick_end", "capacity_factor", F.explode(edges).alias("e")).select("kind", "tick_start", "tick_end", F.col("e.u").alias("u"), F.col("e.v").alias("v"), "capacity_factor").distinct()


def active_factors(events: DataFrame, ticks: DataFrame) -> DataFrame:
    """tick, u, v, factor (product of active drops), closed, for edges with active events."""
    on = interval_join(ticks, "tick", events, "tick_start", "tick_end")
    drop = F.when(F.col("kind") == "capacity_drop", F.coalesce("capacity_factor", F.lit(1.0)))
    return on.groupBy("tick", "u", "v").agg(F.coalesce(F.product(drop), F.lit(1.0)).alias("factor"), F.bool_or(F.col("kind") == "edge_closure").alias("closed"))


def capacity_per_tick(capacity: Column, scale: float = 0.5, tick_minutes: float = 6.0) -> Column:
    return F.greatest(capacity * scale / (60.0 / tick_minutes), F.lit(0.1))


def snapshot_capacity(capacity: Column, scale: float = 0.5, tick_minutes: float = 6.0) -> Column:
    return F.greatest(capacity * scale, F.lit(0.1)) / (60.0 / tick_minutes)


def dynamic_costs(edges: DataFrame, loads: DataFrame, factors: DataFrame, alpha: float = 1.8, beta: float = 2.8, scale: float = 0.5, tick_minutes: float = 6.0) -> DataFrame:
    """u, v, cost of open edges under loads (u, v, load) and factors (u, v, factor, closed)."""
    both = edges.join(loads.select("u", "v", "load"), ["u", "v"], "left").join(factors.select("u", "v", "factor", "closed"), ["u", "v"], "left")
    effective = F.col("base_capacity") * F.coalesce("factor", F.lit(1.0))
    used = F.coalesce("load", F.lit(0)) / capacity_per_tick(effective, scale, tick_minutes)
    cost = F.col("base_cost") * (1.0 + alpha * F.pow(F.greatest(used, F.lit(0.0)), F.lit(beta)))
    return both.where(~F.coalesce("closed", F.lit(False))).select("u", "v", cost.alias("cost"))
