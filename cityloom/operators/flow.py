"""Flows: trips to edge loads, metrics by tick, snapshots and tensors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.operators.ordered import percentile
from cityloom.operators.roads import capacity_per_tick, is_major, snapshot_capacity
from cityloom.operators.temporal import as_of
from cityloom.sources.lineage import stored

# Share, speed (km/h), attraction power, dwelling ticks (mean, deviation).
PROFILES = {"commuter": (0.55, 28.0, 1.05, 8, 2), "errand": (0.30, 22.0, 0.95, 4, 1), "explorer": (0.15, 18.0, 0.75, 2, 1)}
# Fixed values of the two daily peaks: hours, widths, strength of the second, least activity.
DIURNAL = {"am": 8.0, "pm": 18.0, "am_width": 2.2, "pm_width": 2.6, "strength": 1.1, "floor": 0.06}


def metres_per_tick(profile: Column, tick_minutes: float = 6.0) -> Column:
    out = F.lit(None).cast("double")
    for name, (_, speed, *_rest) in PROFILES.items():
        out = F.when(profile == name, speed * 1000.0 / 60.0 * tick_minutes).otherwise(out)
    return out


def hour_at(tick: Column, start: float = 6.0, tick_minutes: float = 6.0) -> Column:
    return F.pmod(start + tick * tick_minutes / 60.0, F.lit(24.0))


def activity(hour: Column, am: float = DIURNAL["am"], pm: float = DIURNAL["pm"], am_width: float = DIURNAL["am_width"], pm_width: float = DIURNAL["pm_width"], strength: float = DIURNAL["strength"], floor: float = DIURNAL["floor"]) -> Column:
    """Share of agents that leave at an hour of the day: two peaks over a floor."""
    bump = lambda centre, width: F.exp(-0.5 * F.pow((hour - centre) / width, F.lit(2.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (floor + bump(am, am_width) + strength * bump(pm, pm_width)) / (floor + max(1.0, strength))))


def expand_trips(routes: DataFrame, tick_minutes: float = 6.0) -> DataFrame:
    """trip_id, tick, u, v: the ticks in which a trip is on each edge of its route.

    With m metres a tick, the edge between a and b along the route is used in ticks
    floor(a / m) to ceil(b / m) - 1 after departure.
    """
    along = Window.partitionBy("trip_id").orderBy("hop")
    end = F.sum("length_m").over(along)
    m = metres_per_tick(F.col("profile_name"), tick_minutes)
    ranged = routes.withColumn("b", end).withColumn("m", m)
    first, last = F.floor((F.col("b") - F.col("length_m")) / F.col("m")), F.ceil(F.col("b") / F.col("m")) - 1
    return ranged.select("trip_id", "u", "v", "depart_tick", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))).alias("k")).select("trip_id", (F.col("depart_tick") + F.col("k")).alias("tick"), "u", "v")


def route_positions(routes: DataFrame, tick_minutes: float = 6.0) -> DataFrame:
    """trip_id, tick, u, v, share: where a trip is at the end of each tick under way, as a
    share of its edge."""
    along = Window.partitionBy("trip_id").orderBy("hop")
    ranged = routes.withColumn("b", F.sum("length_m").over(along)).withColumn("m", metres_per_tick(F.col("profile_name"), tick_minutes))
    a = F.col("b") - F.col("length_m")
    first, last = F.floor(a / F.col("m")) + 1, F.ceil(F.col("b") / F.col("m")) - 1
    ticks = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = ranged.select("trip_id", "u", "v", "depart_tick", "length_m", "m", a.alias("a"), F.explode(ticks).alias("k"))
    return rows.select("trip_id", (F.col("depart_tick") + F.col("k") - 1).alias("tick"), "u", "v", ((F.col("k") * F.col("m") - F.col("a")) / F.col("length_m")).alias("share"))


def edge_loads(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("tick", "u", "v").agg(F.count("*").alias("load"))


def bottlenecks(loads: DataFrame, edges: DataFrame, from_tick: int, most: int = 8, least: int = 4) -> DataFrame:
    """The edges with most load from a tick on: those of major classes among the top ones if
    there are at least ``least``, else any."""
    total = loads.where(F.col("tick") >= from_tick).groupBy("u", "v").agg(F.sum("load").alias("total_load")).join(edges.select("u", "v", is_major().alias("_major")), ["u", "v"])
    top = lambda rows: rows.orderBy(F.desc("total_load"), "u", "v").limit(most)
    major = top(total.where("_major"))
    enough = major.agg((F.count("*") >= least).alias("_enough"))
    rows = major.union(top(total).withColumn("_major", F.lit(False))).crossJoin(F.broadcast(enough))
    return rows.where("_major = _enough").select("u", "v", "total_load").orderBy(F.desc("total_load"), "u", "v")


def utilisation(loads: DataFrame, edges: DataFrame, scale: float = 0.5, tick_minutes: float = 6.0) -> DataFrame:
    """tick, u, v, load, utilization of loaded edges that exist."""
    return loads.join(edges.select("u", "v", "base_capacity"), ["u", "v"]).select("tick", "u", "v", "load", (F.col("load") / capacity_per_tick(F.col("base_capacity"), scale, tick_minutes)).alias("utilization"))


def edge_snapshot(edges: DataFrame, loads: DataFrame, tick: int) -> DataFrame:
    """All edges with load and utilisation at a tick; 0 without load."""
    now = loads.where(F.col("tick") == tick).select("u", "v", "load")
    load = F.coalesce("load", F.lit(0))
    return edges.join(now, ["u", "v"], "left").select("u", "v", "road_class", load.alias("load"), (load / snapshot_capacity(F.col("base_capacity"))).alias("utilization"))


def tick_metrics(trips: DataFrame, used: DataFrame, reporters: dict[str, Column] | None = None, tick_minutes: float = 6.0) -> DataFrame:
    """Metrics by tick of arrivals; trips has depart_tick, arrive_tick, distance_m.

    reporters: further aggregates over the arrivals of a tick, by name.
    """
    arrived = trips.groupBy(F.col("arrive_tick").alias("tick")).agg(
        F.count("*").alias("arrivals"), F.sum(F.col("arrive_tick") - F.col("depart_tick")).alias("ticks_spent"), F.sum("distance_m").alias("metres"), *[c.alias(n) for n, c in (reporters or {}).items()]
    )
    loads = used.groupBy("tick").agg(F.max("utilization").alias("max_utilization"), F.avg("utilization").alias("mean_utilization"), F.count_if(F.col("utilization") > 1).alias("overloaded_edges"))
    to_date = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    both = arrived.join(loads, "tick", "full")
    done, spent, metres = (F.sum(F.coalesce(c, F.lit(0))).over(to_date) for c in ("arrivals", "ticks_spent", "metres"))
    return both.select(
        "tick", hour_at(F.col("tick"), 0.0, tick_minutes).alias("hour"), activity(hour_at(F.col("tick"), 0.0, tick_minutes)).alias("diurnal_lambda"), done.alias("completed_trips"),
        F.try_divide(spent * tick_minutes, done).alias("mean_trip_minutes"), F.try_divide(metres, done).alias("mean_distance_m"),
        F.coalesce("max_utilization", F.lit(0.0)).alias("max_utilization"), F.coalesce("mean_utilization", F.lit(0.0)).alias("mean_utilization"), F.coalesce("overloaded_edges", F.lit(0)).alias("overloaded_edges"), *[F.col(n) for n in reporters or {}],
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row: the state at the last tick and extremes over all."""
    last = lambda c: F.max_by(c, "tick")
    return metrics.agg(
        F.count("*").alias("n_ticks"), last("completed_trips").alias("completed_trips"), F.round(last("mean_trip_minutes"), 6).alias("mean_trip_minutes"),
        F.round(F.max("max_utilization"), 6).alias("peak_utilization"), F.sum("overloaded_edges").alias("overloaded_edge_ticks"), F.min_by("tick", F.struct(-F.col("max_utilization"), F.col("tick"))).alias("peak_tick"),
    )


def agent_metrics(trips: DataFrame, used: DataFrame, n_ticks: int, start: float = 6.0, tick_minutes: float = 6.0) -> DataFrame:
    """The thirteen metrics of each tick from 0 on, from trips and edge loads alone.

    trips: agent_id, depart_tick, arrive_tick (null: no way was found), distance_m.  An
    agent travels from its departure until its arrival and dwells from there until it next
    leaves; both are counted by changes at ticks, summed up over the ticks, so a trip is a
    few rows whatever it lasts.  Times are in ticks, means over all completed trips and
    over all agents so far; null before the first.
    """
    done = trips.where("arrive_tick IS NOT NULL")
    along = Window.partitionBy("agent_id").orderBy("depart_tick", "arrive_tick")
    next_leave = F.lead("depart_tick").over(along)
    stays = done.select("arrive_tick", F.when(next_leave > F.col("arrive_tick"), next_leave).when(next_leave.isNull(), F.lit(None)).otherwise(F.col("arrive_tick")).alias("until"))
    nothing = {c: F.lit(0).cast("long") for c in ("travel", "dwell", "arrivals", "spent", "queries", "failures")} | {"metres": F.lit(0.0)}

    def change(rows: DataFrame, tick: str, **values: Column) -> DataFrame:
        given = nothing | values
        return rows.where(F.col(tick).isNotNull()).select(F.greatest(F.col(tick).cast("long"), F.lit(0)).alias("tick"), *[given[c].cast("double" if c == "metres" else "long").alias(c) for c in nothing])

    one = F.lit(1)
    changes = (
        change(trips, "depart_tick", queries=one, failures=F.col("arrive_tick").isNull().cast("long"), travel=F.col("arrive_tick").isNotNull().cast("long"))
        .union(change(done, "arrive_tick", travel=-one, arrivals=one, spent=F.col("arrive_tick") - F.col("depart_tick"), metres=F.col("distance_m")))
        .union(change(stays, "arrive_tick", dwell=one)).union(change(stays, "until", dwell=-one))
    )
    by_tick = changes.groupBy("tick").agg(*[F.sum(c).alias(c) for c in nothing])
    loads = used.groupBy("tick").agg(F.max("utilization").alias("max_utilization"), F.avg("utilization").alias("mean_utilization"), F.count_if(F.col("utilization") > 1).alias("overloaded_edges"))
    agents = trips.agg(F.count_distinct("agent_id").alias("agents"))
    every = trips.sparkSession.range(n_ticks).withColumnRenamed("id", "tick").join(by_tick, "tick", "left").join(loads, "tick", "left").crossJoin(F.broadcast(agents))
    to_date = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # a row a tick
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(to_date)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    hour = hour_at(F.col("tick"), start, tick_minutes)
    return every.select(
        "tick", hour.alias("hour"), activity(hour).alias("diurnal_lambda"), total("travel").alias("active_travelers"), total("dwell").alias("dwellers"), total("arrivals").alias("completed_trips"),
        zero("queries").alias("route_queries"), zero("failures").alias("route_failures"), F.try_divide(total("spent"), total("arrivals")).alias("mean_trip_time"), F.try_divide(total("metres"), F.col("agents")).alias("mean_distance_m"),
        F.coalesce("max_utilization", F.lit(0.0)).alias("max_utilization"), F.coalesce("mean_utilization", F.lit(0.0)).alias("mean_utilization"), zero("overloaded_edges"),
    )


def agent_summary(metrics: DataFrame, scenario: str) -> DataFrame:
    """The ten fields of a run, from its agent_metrics(): one row."""
    last = lambda c, name: F.max_by(c, "tick").alias(name)
    return metrics.agg(
        F.lit(scenario).alias("scenario"), F.max("tick").alias("ticks"), last("active_travelers", "final_active_travelers"), last("dwellers", "final_dwellers"), last("completed_trips", "completed_trips"),
        F.round(F.max_by("mean_trip_time", "tick"), 2).alias("mean_trip_time_ticks"), F.round(F.max("max_utilization"), 3).alias("peak_max_utilization"), F.max("overloaded_edges").alias("peak_overloaded_edges"),
        F.sum("route_queries").alias("route_queries_total"), F.sum("route_failures").alias("route_failures_total"),
    )


def nearest_tick(asked: DataFrame, ticks: DataFrame) -> DataFrame:
    """asked (want) with the nearest tick there is, of equals the earlier."""
    return as_of(asked, "want", ticks.select("tick"), "tick", direction="nearest").where("found IS NOT NULL").select(*asked.columns, F.col("found.tick").alias("tick"))


def flow_delta(base: DataFrame, shock: DataFrame) -> DataFrame:
    """tick, u, v, delta of utilisation between two runs; a missing side is 0."""
    b = base.select("tick", "u", "v", F.col("utilization").alias("ub"))
    s = shock.select("tick", "u", "v", F.col("utilization").alias("us"))
    return b.join(s, ["tick", "u", "v"], "full").select("tick", "u", "v", (F.coalesce("us", F.lit(0.0)) - F.coalesce("ub", F.lit(0.0))).alias("delta"))


def delta_report(base: DataFrame, shock: DataFrame) -> DataFrame:
    """Tick of the largest difference of the runs' peaks; net and 97th percentile of it."""
    peak = lambda d, n: d.groupBy("tick").agg(F.max("utilization").alias(n))
    peaks = peak(base, "pb").join(peak(shock, "ps"), "tick")
    at = peaks.agg(F.min_by("tick", F.struct(-F.abs(F.col("ps") - F.col("pb")), F.col("tick"))).alias("tick"))
    moved = stored(flow_delta(base, shock).join(F.broadcast(at), "tick"), "flow-delta")
    p97 = percentile(moved, F.when(F.col("delta") != 0, F.abs("delta")), 0.97)
    return moved.groupBy("tick").agg(F.sum("delta").alias("net")).withColumn("p97", F.lit(p97).cast("double"))


def top_corridors(used: DataFrame, n_ticks: int, most: int = 25) -> DataFrame:
    """Edges by mean utilisation over all ticks, those without load counting 0."""
    return used.groupBy("u", "v").agg((F.sum("utilization") / n_ticks).alias("mean_utilization")).orderBy(F.desc("mean_utilization"), "u", "v").limit(most)


def colour_limit(used: DataFrame, pct: float = 0.95) -> DataFrame:
    """One row vmax: a percentile of the positive utilisations, 1 without any."""
    found = percentile(used, F.when(F.col("utilization") > 0, F.col("utilization")), pct)
    return used.sparkSession.range(1).select(F.lit(1.0 if found is None else found).alias("vmax"))


def edge_cells(edges: DataFrame, nodes: DataFrame, size: float, height: int, width: int) -> DataFrame:
    """u, v, cell, capacity: the grid cell of each edge's midpoint, inside the grid."""
    a, b = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu")), nodes.select(F.col("node_id").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    placed = edges.join(a, "u").join(b, "v")
    row, col = F.floor((F.col("yu") + F.col("yv")) / 2 / size), F.floor((F.col("xu") + F.col("xv")) / 2 / size)
    return placed.select("u", "v", "base_capacity", row.alias("row_i"), col.alias("col_i")).where((F.col("row_i") >= 0) & (F.col("row_i") < height) & (F.col("col_i") >= 0) & (F.col("col_i") < width)).select("u", "v", (F.col("row_i") * width + F.col("col_i")).alias("cell"), (F.col("base_capacity") * 0.5 / 10.0).alias("capacity"))


def traffic_tensor(loads: DataFrame, cells: DataFrame) -> DataFrame:
    """tick, cell, volume, utilization: sparse frames; absent cells are 0."""
    room = cells.groupBy("cell").agg(F.greatest(F.sum("capacity"), F.lit(0.1)).alias("room"))
    volume = loads.join(cells.select("u", "v", "cell"), ["u", "v"]).groupBy("tick", "cell").agg(F.sum("load").alias("volume"))
    return volume.join(room, "cell").select("tick", "cell", "volume", (F.col("volume") / F.col("room")).alias("utilization"))


def channel_scaled(tensor: DataFrame, channels: list[str]) -> DataFrame:
    """Channels over their maxima (a maximum of about nothing counts as 1)."""
    tops = tensor.agg(*[F.max(c).alias(f"_{c}") for c in channels])
    scale = lambda c: F.when(F.col(f"_{c}") <= 1e-6, 1.0).otherwise(F.col(f"_{c}"))
    return tensor.crossJoin(F.broadcast(tops)).select("tick", "cell", *[(F.col(c) / scale(c)).alias(c) for c in channels])


def line_position(x1: Column, y1: Column, x2: Column, y2: Column, progress: Column, length: Column) -> tuple[Column, Column]:
    """Point at a share of a straight edge, the share kept within 0..1."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress / F.greatest(length, F.lit(1e-9))))
    return x1 + f * (x2 - x1), y1 + f * (y2 - y1)


def snapshot_ticks(first: int, last: int, n: int) -> list[int]:
    """n evenly spaced ticks."""
    return [first] if n <= 1 else [int(math.floor(first + i * (last - first) / (n - 1) + 0.5)) for i in range(n)]
