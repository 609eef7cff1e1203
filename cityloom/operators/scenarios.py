"""Scenarios: the catalog of shocks, the warm-up run that finds bottlenecks, and comparisons."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.operators import demand, flow, roads, simulation

NAMES = ["baseline", "capacity_drop", "edge_closure", "hotspot_surge"]
_EVENT = "scenario string, kind string, tick_start long, tick_end long, u long, v long, capacity_factor double, node_id long, multiplier double"


def span(n_ticks: int) -> tuple[int, int]:
    """First tick of the default shocks and the tick after their last."""
    start = max(4, n_ticks // 4)
    return start, max(start + 8, int(n_ticks * 0.75))


def hit_edges(edges: DataFrame, bottleneck: DataFrame | None = None, least: int = 4) -> tuple[DataFrame, str]:
    """place, u, v, road_class of the (at most eight) edges that shocks hit, and where
    they come from: bottlenecks (u, v, total_load) if there are enough, else capacities."""
    if bottleneck is not None:
        ranked = bottleneck.join(edges.select("u", "v", "road_class"), ["u", "v"]).withColumn("major", roads.is_major())
        n, majors = ranked.agg(F.count("*"), F.count_if("major")).first()
        if n >= least:
            ranked = ranked.where("major") if majors >= least else ranked
            place = F.row_number().over(Window.orderBy(F.desc("total_load"), "u", "v"))  # a few rows
            return ranked.select(place.alias("place"), "u", "v", "road_class").where("place <= 8"), "bottlenecks"
    place = F.row_number().over(Window.orderBy("base_capacity", "u", "v"))  # at most eight rows
    return roads.scenario_edges(edges).select(place.alias("place"), "u", "v", "road_class"), "capacities"


def catalog(edges: DataFrame, attracting: DataFrame, n_ticks: int, bottleneck: DataFrame | None = None) -> DataFrame:
    """Rows of events of the default scenarios: a capacity drop on the edges hit, a
    closure of the first three, a surge of the strongest attractor; the baseline has none."""
    hit, _ = hit_edges(edges, bottleneck)
    start, end = (F.lit(t).cast("long") for t in span(n_ticks))
    none = lambda kind: F.lit(None).cast(kind)
    drop = hit.select(F.lit("capacity_drop"), F.lit("capacity_drop"), start, end, "u", "v", F.lit(0.25), none("long"), none("double"))
    closure = hit.where("place <= 3").select(F.lit("edge_closure"), F.lit("edge_closure"), start, end, "u", "v", none("double"), none("long"), none("double"))
    surge = demand.strongest_node(attracting).select(F.lit("hotspot_surge"), F.lit("hotspot_surge"), start, end, none("long"), none("long"), none("double"), "node_id", F.lit(3.0))
    return drop.union(closure).union(surge).toDF(*[x.split()[0] for x in _EVENT.split(", ")])


def table(edges: DataFrame, n_ticks: int, bottleneck: DataFrame | None = None) -> DataFrame:
    """scenario, description, event_count, edge_source of the default scenarios."""
    hit, source = hit_edges(edges, bottleneck)
    start, end = span(n_ticks)
    kind = hit.agg(F.min_by("road_class", "place").alias("c"))
    told = {
        "baseline": F.lit("no shock"),
        "capacity_drop": F.format_string(f"a quarter of the capacity on %s edges in ticks {start} to {end}", "c"),
        "edge_closure": F.format_string(f"%s edges closed in ticks {start} to {end}", F.initcap("c")),
        "hotspot_surge": F.lit(f"the strongest attractor three times as strong in ticks {start} to {end}"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), told[n].alias("description"), F.lit(int(n != "baseline")).cast("long").alias("event_count"), F.lit(source).alias("edge_source")) for n in NAMES]))
    return kind.select(rows.alias("r")).select("r.*")


def events_of(events: DataFrame, scenario: str) -> DataFrame:
    return events.where(F.col("scenario") == scenario).drop("scenario")


def warm_up_bottlenecks(edges: DataFrame, origins: DataFrame, attracting: DataFrame, c: simulation.Config) -> DataFrame:
    """u, v, total_load of the edges with most load after the first replanning of a short
    run with steady demand and without shocks."""
    short = replace(c, n_ticks=c.replan + 5, diurnal=False, sample_size=0)
    none = edges.sparkSession.createDataFrame([], _EVENT).drop("scenario")
    run = simulation.simulate(edges, origins, attracting, none, short)
    return flow.bottlenecks(run.loads, edges, c.replan)


def compared(base: DataFrame, shock: DataFrame) -> DataFrame:
    """Metrics of two runs by tick, those of the second with the suffix _scenario."""
    return base.join(shock.select("tick", *[F.col(c).alias(f"{c}_scenario") for c in shock.columns if c != "tick"]), "tick")
