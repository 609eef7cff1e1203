"""Agents on roads, epoch by epoch.

Costs and routes change only at the ends of epochs (replanning and event times), so
within one, agents don't depend on each other.  Agents are grouped by blocks of
destinations and meet the trees of shortest paths to these, a table, in one task; an
agent that takes a destination of another block goes on in the next round, grouped anew,
until all have reached the end of the epoch.  Groups are split by agent as well.  Draws are hashes of
(seed, agent, tick, number), so the result doesn't depend on partitions or retries.
State, loads, counters and positions are written to the shared folder in every round.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.operators import flow, roads, routing
from cityloom.operators.demand import hash_uniform, weighted_choice
from cityloom.sources.lineage import stored

_STATE = {
    "agent_id": "long", "profile_name": "string", "state": "string", "node": "long", "dest": "long", "next_node": "long", "edge_length": "double", "progress": "double", "budget": "double",
    "streak": "long", "dwell": "long", "trip_ticks": "long", "trips": "long", "reroutes": "long", "distance": "double", "travel_ticks": "long", "dwell_ticks": "long", "tick": "long",
}
_COUNTS = {**dict.fromkeys(("queries", "failures", "arrivals", "durations", "travelling", "dwelling"), "long"), "metres": "double"}
_OUT = {"kind": "string", **_STATE, "load": "long", **_COUNTS}
#: Agents in a group, on average, and rows of the trees that a group gets at most (or one tree).
GROUP = 5_000
TREE_ROWS = 2_000_000
#: Attractors are sent to every task.
MOST_ATTRACTORS = 100_000


@dataclass(frozen=True)
class Config:
    n_agents: int = 1500
    n_ticks: int = 80
    tick_minutes: float = 6.0
    seed: int = 42
    replan: int = 10
    sample_every: int = 1
    sample_size: int = 400
    capacity_scale: float = 0.5
    alpha: float = 1.8
    beta: float = 2.8
    diurnal: bool = True
    start_hour: float = 6.0

    def __post_init__(self):
        if self.n_agents < 1 or self.n_ticks < 1 or self.replan < 1 or self.sample_every < 1:
            raise ValueError("agents, ticks, the replan and the sample interval must be positive")

    def hour(self, tick: int) -> float:
        return (self.start_hour + tick * self.tick_minutes / 60.0) % 24.0


@dataclass(frozen=True)
class Run:
    """agents: final states; loads: tick, u, v, load; counts: by tick; positions: sampled
    agents by tick, with the share of their edge they have passed."""

    agents: DataFrame
    loads: DataFrame
    counts: DataFrame
    positions: DataFrame


def uniform(seed: int, *keys: int) -> float:
    h = seed
    for k in (*keys, 17):
        x = h + int(k) + 1
        h = ((x * x) % 2147483647 * 48271 + 12820163) % 2147483647
    return h / 2147483647.0


def activity(hour: float) -> float:
    """flow.activity() of a number."""
    d = flow.DIURNAL
    bump = lambda c, w: math.exp(-0.5 * ((hour - c) / w) ** 2)
    return max(0.0, min(1.0, (d["floor"] + bump(d["am"], d["am_width"]) + d["strength"] * bump(d["pm"], d["pm_width"])) / (d["floor"] + max(1.0, d["strength"]))))


class Chooser:
    """Draws destinations by (weight x surge) ** power, never the excluded node."""

    def __init__(self, nodes: list[int], weights: list[float], surges: list[tuple[int, float]]):
        self.nodes = nodes
        self.base = np.array(weights, dtype=float)
        for node, multiplier in surges:
            self.base[np.array(nodes) == node] *= multiplier
        self.sums: dict[tuple[str, int], np.ndarray] = {}

    def choose(self, profile: str, exclude: int, u: float) -> int | None:
        key = (profile, exclude)
        if key not in self.sums:
            w = self.base ** flow.PROFILES[profile][2]
            w[np.array(self.nodes) == exclude] = 0.0
            self.sums[key] = np.cumsum(w)
        sums = self.sums[key]
        if not len(sums) or sums[-1] <= 0:
            return None
        return self.nodes[min(int(np.searchsorted(sums, u * sums[-1], side="right")), int(np.searchsorted(sums, sums[-1])))]


def _dwelling_time(c: Config, agent: int, tick: int, profile: str) -> int:
    u1, u2 = max(1e-12, uniform(c.seed, agent, tick, 6)), uniform(c.seed, agent, tick, 7)
    normal = math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2)
    return max(1, round(flow.PROFILES[profile][3] + flow.PROFILES[profile][4] * normal))


def step(a: dict, c: Config, chooser: Chooser, here, hops: dict, loads: Counter, counts: dict) -> bool:
    """Moves an agent through its tick; False if it first needs the tree to a destination
    that isn't here."""
    tick, agent, profile = a["tick"], a["agent_id"], a["profile_name"]
    now = counts.setdefault(tick, dict.fromkeys(_COUNTS, 0))

    def arrive() -> None:
        now["arrivals"] += 1
        now["durations"] += a["trip_ticks"]
        a.update(state="dwelling", trips=a["trips"] + 1, dwell=_dwelling_time(c, agent, tick, profile), trip_ticks=0, next_node=None, progress=0.0)

    if a["state"] == "dwelling":
        a["dwell_ticks"] += 1
        a["dwell"] -= 1
        if a["dwell"] <= 0:
            goes = not c.diurnal or uniform(c.seed, agent, tick, 5) <= activity(c.hour(tick))
            dest = chooser.choose(profile, a["node"], uniform(c.seed, agent, tick, 4)) if goes else None
            if dest is None:
                a["dwell"] = 1
            else:
                a.update(dest=dest, state="travelling")
    else:
        if a["budget"] is None:
            a.update(budget=flow.PROFILES[profile][1] * 1000.0 / 60.0 * c.tick_minutes, streak=0)
        arrived = False
        while a["budget"] > 1e-6 and not arrived:
            if a["next_node"] is None:
                if a["node"] == a["dest"]:
                    arrive()
                    arrived = True
                    continue
                if not here(a["dest"]):
                    return False
                now["queries"] += 1
                hop = hops.get((a["dest"], a["node"]))
                if hop is None:
                    now["failures"] += 1
                    a["streak"] += 1
                    dest = chooser.choose(profile, a["node"], uniform(c.seed, agent, tick, 100 + a["streak"])) if a["streak"] <= 8 else None
                    if dest is None:
                        break
                    a.update(dest=dest, reroutes=a["reroutes"] + 1)
                    continue
                a.update(streak=0, next_node=hop[0], edge_length=hop[1], progress=0.0)
            rest = a["edge_length"] - a["progress"]
            loads[(tick, a["node"], a["next_node"])] += 1
            if a["budget"] >= rest:
                now["metres"] += rest
                a.update(budget=a["budget"] - rest, distance=a["distance"] + rest, node=a["next_node"], next_node=None, progress=0.0)
                if a["node"] == a["dest"]:
                    arrive()
                    arrived = True
            else:
                now["metres"] += a["budget"]
                a.update(progress=a["progress"] + a["budget"], distance=a["distance"] + a["budget"], budget=0.0)
        if not arrived:
            a.update(travel_ticks=a["travel_ticks"] + 1, trip_ticks=a["trip_ticks"] + 1)
    now[a["state"]] += 1
    a.update(tick=tick + 1, budget=None, streak=0)
    return True


def _epoch(c: Config, until: int, chooser_of, block_of: dict):
    whole = [k for k, t in _STATE.items() if t == "long"]

    def run(key, agents, tree):
        chooser = Chooser(*chooser_of)
        hops = dict(zip(zip(tree["dest"].tolist(), tree["node"].tolist()), zip(tree["next_node"].tolist(), tree["length_m"].tolist())))
        here = lambda dest: block_of.get(dest, 0) == key[0]
        loads: Counter = Counter()
        counts: dict = {}
        rows = []
        for a in agents[list(_STATE)].to_dict("records"):
            a = {k: None if pd.isna(v) else int(v) if k in whole else v for k, v in a.items()}
            while a["tick"] < until and step(a, c, chooser, here, hops, loads, counts):
                tick = a["tick"] - 1
                if tick % c.sample_every == 0 or tick == c.n_ticks - 1:
                    rows.append({"kind": "position", **a, "tick": tick})
                if a["state"] == "travelling" and a["next_node"] is None and not here(a["dest"]):
                    break
            rows.append({"kind": "agent", **a})
        rows += [{"kind": "load", "tick": t, "node": u, "next_node": v, "load": n} for (t, u, v), n in loads.items()]
        rows += [{"kind": "count", "tick": t, **n} for t, n in counts.items()]
        frame = pd.DataFrame(rows, columns=list(_OUT))
        return frame.astype({k: "Int64" for k, t in _OUT.items() if t == "long"} | {k: "float64" for k, t in _OUT.items() if t == "double"})

    return run


def _spawn(spark, origins: DataFrame, chooser: Chooser, c: Config) -> DataFrame:
    """Agents at origins drawn by weight; the first departure is spread over a day."""
    draw = lambda k: hash_uniform(c.seed, F.col("id"), F.lit(0), F.lit(k))
    placed = weighted_choice(spark.range(c.n_agents).select(F.col("id").alias("draw_id"), draw(2).alias("u")), origins)
    names = list(flow.PROFILES)
    sums = np.cumsum([flow.PROFILES[n][0] for n in names])
    day = max(1, round(24 * 60 / c.tick_minutes))

    def run(batches):
        for b in batches:
            rows = []
            for a, at in zip(b["draw_id"].tolist(), b["node_id"].tolist()):
                profile = names[min(int(np.searchsorted(sums, uniform(c.seed, a, 0, 1), side="right")), len(names) - 1)]
                dest = chooser.choose(profile, at, uniform(c.seed, a, 0, 3))
                state = {**dict.fromkeys(_STATE), **dict.fromkeys(("streak", "dwell", "trip_ticks", "trips", "reroutes", "travel_ticks", "dwell_ticks", "tick"), 0), "progress": 0.0, "distance": 0.0}
                state |= {"agent_id": a, "profile_name": profile, "state": "dwelling" if c.diurnal else "travelling", "node": at, "dest": at if dest is None else dest}
                state["dwell"] = 1 + int(uniform(c.seed, a, 0, 8) * day) if c.diurnal else 0
                rows.append(state)
            frame = pd.DataFrame(rows, columns=list(_STATE))
            yield frame.astype({k: "Int64" for k, t in _STATE.items() if t == "long"} | {k: "float64" for k, t in _STATE.items() if t == "double"})

    return placed.mapInPandas(run, ", ".join(f"{k} {t}" for k, t in _STATE.items()))


def boundaries(events: list, c: Config) -> list[int]:
    """Ticks at which epochs begin, and the end."""
    times = {t for e in events for t in (e["tick_start"], e["tick_end"])} | set(range(0, c.n_ticks, c.replan))
    return sorted({0, c.n_ticks} | {int(t) for t in times if 0 <= t < c.n_ticks})


def simulate(edges: DataFrame, origins: DataFrame, attracting: DataFrame, events: DataFrame, c: Config = Config()) -> Run:
    """Agents, edge loads, counters and positions of n_ticks.

    edges: routing edges; origins, attracting: node_id, sum_weight; events: kind,
    tick_start, tick_end, u, v, capacity_factor and, where there are surges, node_id,
    multiplier.
    """
    spark = edges.sparkSession
    edges = stored(edges.select("u", "v", "length_m", "base_cost", "base_capacity"), "sim-edges")
    attracting = stored(attracting.select("node_id", "sum_weight"), "sim-attractors")
    if attracting.count() > MOST_ATTRACTORS:
        raise ValueError(f"more than {MOST_ATTRACTORS} attractors; take the top ones")
    targets = attracting.orderBy("node_id").collect()
    total = sum(r.sum_weight for r in targets) or 1.0
    nodes, weights = [r.node_id for r in targets], [r.sum_weight / total for r in targets]
    for name, kind in (("node_id", "long"), ("multiplier", "double")):
        events = events if name in events.columns else events.withColumn(name, F.lit(None).cast(kind))
    times = events.select("kind", "tick_start", "tick_end", "node_id", "multiplier").distinct().collect()  # a scenario's few events
    whole = origins.agg(F.sum("sum_weight")).first()[0] or 1.0
    chances = origins.select("node_id", (F.col("sum_weight") / whole).alias("p"))
    agents = stored(_spawn(spark, chances, Chooser(nodes, weights, []), c), "sim-agents")
    salts = max(1, -(-c.n_agents // GROUP))
    per_block = max(1, TREE_ROWS // max(1, edges.select("u").distinct().count()))
    block_of = {n: i // per_block for i, n in enumerate(nodes)}
    blocks = stored(spark.createDataFrame(list(block_of.items()), "dest long, block int"), "sim-blocks")
    kept: dict[str, list[DataFrame]] = {"load": [], "count": [], "position": []}
    ends = boundaries(times, c)
    for begin, until in zip(ends, ends[1:]):
        now = spark.range(begin, begin + 1).withColumnRenamed("id", "tick")
        past = spark.createDataFrame([], "tick long, u long, v long, load long")
        for part in kept["load"][-2:]:  # epochs have a tick at least
            past = past.union(part)
        edge_events = events.where("u IS NOT NULL").select("kind", "tick_start", "tick_end", "u", "v", "capacity_factor")
        costs = roads.dynamic_costs(edges, past.where(F.col("tick") == begin - 2).select("u", "v", "load"), roads.active_factors(edge_events, now), c.alpha, c.beta, c.capacity_scale, c.tick_minutes)
        trees = routing.path_trees(costs, attracting.select("node_id"))
        ways = trees.where("node <> dest").join(edges.select(F.col("u").alias("node"), F.col("v").alias("next_node"), "length_m"), ["node", "next_node"])
        ways = stored(ways.join(blocks, "dest").select("block", "dest", "node", "next_node", "length_m").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "sim-ways")
        surges = [(e["node_id"], e["multiplier"]) for e in times if e["kind"] == "hotspot_surge" and e["tick_start"] <= begin < e["tick_end"]]
        walk = _epoch(c, until, (nodes, weights, surges), block_of)
        left, rounds = agents, []
        while True:
            placed = left.join(blocks, "dest", "left").withColumn("block", F.coalesce("block", F.lit(0))).withColumn("salt", F.pmod("agent_id", F.lit(salts)).cast("int"))
            asked = ways.join(placed.select("block", "salt").distinct(), ["block", "salt"], "left_semi")
            rounds.append(stored(placed.groupBy("block", "salt").cogroup(asked.groupBy("block", "salt")).applyInPandas(walk, ", ".join(f"{k} {t}" for k, t in _OUT.items())), "sim-epoch"))
            left = rounds[-1].where(f"kind = 'agent' AND tick < {until}").select(*_STATE)
            if not left.limit(1).count():
                break
        out = functools.reduce(DataFrame.union, rounds)
        agents = stored(out.where(f"kind = 'agent' AND tick >= {until}").select(*_STATE), "sim-agents")
        moved = out.where("kind = 'load'").groupBy("tick", F.col("node").alias("u"), F.col("next_node").alias("v")).agg(F.sum("load").alias("load"))
        kept["load"].append(stored(moved, "sim-loads"))
        kept["count"].append(stored(out.where("kind = 'count'").groupBy("tick").agg(*[F.sum(n).alias(n) for n in _COUNTS]), "sim-counts"))
        kept["position"].append(out.where("kind = 'position'").select(*_STATE))
    loads, counts, positions = (functools.reduce(DataFrame.union, kept[k]) for k in ("load", "count", "position"))
    return Run(agents, loads, counts, sampled(positions, c))


def sampled(positions: DataFrame, c: Config) -> DataFrame:
    """At most sample_size agents of each tick, without replacement, by a hash of (seed,
    tick, agent): tick, agent_id, profile_name, state, node, dest, next_node, share."""
    share = F.when(F.col("next_node").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress") / F.greatest("edge_length", F.lit(1e-6)))))
    rank = F.row_number().over(Window.partitionBy("tick").orderBy(hash_uniform(c.seed, F.col("tick"), F.col("agent_id")), "agent_id"))
    few = positions if c.sample_size >= c.n_agents else positions.withColumn("_r", rank).where(F.col("_r") <= c.sample_size)
    return few.select("tick", "agent_id", "profile_name", "state", "node", "dest", "next_node", share.alias("share"))


def place(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """positions with x, y: the place on the straight line between their nodes (node_id, x, y)."""
    a = nodes.select(F.col("node_id").alias("node"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("next_node"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    x, y = flow.line_position(F.col("x1"), F.col("y1"), F.coalesce("x2", "x1"), F.coalesce("y2", "y1"), F.col("share"), F.lit(1.0))
    return positions.join(a, "node", "left").join(b, "next_node", "left").select(*positions.columns, x.alias("x"), y.alias("y"))


def metrics(run: Run, edges: DataFrame, c: Config) -> DataFrame:
    """The 13 metrics of each tick; loads are those of the tick before."""
    used = flow.utilisation(run.loads.withColumn("tick", F.col("tick") + 1), edges, c.capacity_scale, c.tick_minutes)
    by_tick = used.groupBy("tick").agg(F.max("utilization").alias("hi"), F.avg("utilization").alias("mid"), F.count_if(F.col("utilization") > 1).alias("over"))
    moved = run.loads.sparkSession.range(c.n_ticks).withColumnRenamed("id", "tick").join(run.counts, "tick", "left").join(by_tick, "tick", "left")
    to_date = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as ticks
    zero = lambda n: F.coalesce(n, F.lit(0))
    trips, spent = F.sum(zero("arrivals")).over(to_date), F.sum(zero("durations")).over(to_date)
    hour = flow.hour_at(F.col("tick"), c.start_hour, c.tick_minutes)
    return moved.select(
        "tick", hour.alias("hour"), (flow.activity(hour) if c.diurnal else F.lit(1.0)).alias("diurnal_lambda"), zero("travelling").alias("active_travelers"), zero("dwelling").alias("dwellers"),
        trips.alias("completed_trips"), zero("queries").alias("route_queries"), zero("failures").alias("route_failures"), F.try_divide(spent, trips).alias("mean_trip_time"),
        (F.sum(F.coalesce("metres", F.lit(0.0))).over(to_date) / c.n_agents).alias("mean_distance_m"), F.coalesce("hi", F.lit(0.0)).alias("max_utilization"), F.coalesce("mid", F.lit(0.0)).alias("mean_utilization"), zero("over").alias("overloaded_edges"),
    )


def summary(by_tick: DataFrame, scenario: str) -> DataFrame:
    """One row of ten fields: the last tick's state, extremes and totals of metrics()."""
    last = lambda n: F.max_by(n, "tick")
    return by_tick.agg(
        F.lit(scenario).alias("scenario"), F.max("tick").alias("ticks"), last("active_travelers").alias("final_active_travelers"), last("dwellers").alias("final_dwellers"), last("completed_trips").alias("completed_trips"),
        F.bround(last("mean_trip_time"), 2).alias("mean_trip_time_ticks"), F.bround(F.max("max_utilization"), 3).alias("peak_max_utilization"), F.max("overloaded_edges").alias("peak_overloaded_edges"),
        F.sum("route_queries").alias("route_queries_total"), F.sum("route_failures").alias("route_failures_total"),
    )
