"""Edge cases with results worked out by hand."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.functions import geo, text
from cityloom.operators import demand, flow, graph, ordered, raster, regions, roads, routing, scenarios, simulation


def test_empty_and_constant_rasters(spark):
    empty = spark.createDataFrame([], "row_i long, col_i long, value double")
    assert raster.log_range(empty).first()[:] == (0.0, 0.0, 0)
    assert raster.normalise(empty).count() == 0
    flat = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0)], "row_i long, col_i long, value double")
    assert [r.value for r in raster.normalise(flat).collect()] == [0.0, 0.0]


def test_fusion_takes_the_side_that_has_a_value(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row_i long, col_i long, value double")
    b = spark.createDataFrame([(0, 1, 4.0), (1, 1, 8.0)], "row_i long, col_i long, value double")
    got = {(r.row_i, r.col_i): r.value for r in raster.fuse(a, b, 1, 1).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 3.0, (1, 1): 8.0}
    with pytest.raises(ValueError):
        raster.fuse(a, b, 0, 0)


def test_local_mean_counts_valid_neighbours_only(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (5, 5, 7.0)], "row_i long, col_i long, value double")
    got = {(r.row_i, r.col_i): r.local_mean for r in raster.local_mean(cells).collect()}
    assert got == {(0, 0): 2.0, (0, 1): 2.0, (5, 5): 7.0}
    with pytest.raises(ValueError):
        raster.local_mean(cells, window=2)


def test_percentile_rank_shares_ties(spark):
    cells = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "value double")
    got = sorted(r.p for r in raster.percentile_rank(cells, "value", "p").collect())
    assert got == [0.25, 0.625, 0.625, 1.0]


def test_unmatched_cities_are_an_error(spark):
    polygons = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "city_id long, city_name string")
    found = regions.match_cities(spark.createDataFrame([("A",), ("B",), ("C",)], "requested_name string"), polygons)
    assert {r.requested_name: r.status for r in found.collect()} == {"A": "matched", "B": "ambiguous", "C": "unresolved"}
    with pytest.raises(ValueError):
        regions.resolved(found)


def test_requested_cities(spark):
    ok = spark.createDataFrame([("﻿ Rome \n\n Oslo",)], "value string")
    assert [tuple(r) for r in regions.requested_cities(ok).collect()] == [(1, "Rome"), (2, "Oslo")]
    for bad in ("A\nA", " \n"):
        with pytest.raises(ValueError):
            regions.requested_cities(spark.createDataFrame([(bad,)], "value string"))


def test_polygon_and_area(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 0D, 'y', 3D))"
    row = spark.range(1).select(regions.inside_polygon(F.lit(1.0), F.lit(1.0), F.expr(ring)).alias("a"), regions.inside_polygon(F.lit(5.0), F.lit(1.0), F.expr(ring)).alias("b"), regions.ring_area(F.expr(ring)).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, 12.0)


def test_road_values(spark):
    rows = spark.createDataFrame([("['primary', 'trunk']", "['2', '3']"), ("busway", None), (None, "1;4"), ("nan", "0"), (" ['Motorway_Link','X'] ", "['1', 'x', '4']"), ("Residential; trunk", "NaN")], "h string, l string")
    got = [tuple(r) for r in rows.select(roads.road_class(F.col("h")), roads.lane_count(F.col("l"))).collect()]
    assert got == [("trunk", 2.5), ("busway", 1.0), ("other", 2.5), ("other", 1.0), ("motorway_link", 2.5), ("residential; trunk", 1.0)]


def test_event_edges(spark):
    events = spark.createDataFrame(
        [("capacity_drop", 1, 5, [(1, 2), (2, 3)], None, 0.5), ("edge_closure", 1, 5, None, (4, 5), None), ("other", 1, 5, None, None, None)],
        "kind string, tick_start long, tick_end long, edges array<struct<u:long,v:long>>, edge struct<u:long,v:long>, capacity_factor double",
    )
    assert {(r.u, r.v) for r in roads.event_edges(events).collect()} == {(1, 2), (2, 3), (4, 5)}


def test_components_and_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 5.0), (1, 3, 3.0), (7, 8, 1.0)], "u long, v long, cost double")
    assert {r.node: r.component for r in graph.weak_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert {r.node for r in graph.largest_scc(edges).collect()} == {1, 2, 3}
    assert {r.node for r in graph.largest_scc(edges, most=2).collect()} == {1, 2, 3}
    trees = routing.path_trees(edges, spark.createDataFrame([(3,)], "node_id long"))
    assert {(r.node, r.dist, r.next_node) for r in trees.collect()} == {(1, 2.0, 2), (2, 1.0, 3), (3, 0.0, 3)}


def test_snap_widens_until_sure(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 1, 1.0), (2, 90.0, 0.0, 1, 1.0)], "cluster_id long, x double, y double, pixel_count long, weight double")
    nodes = spark.createDataFrame([(5, 100.0, 0.0), (4, 80.0, 0.0)], "node_id long, x double, y double")
    assert {(r.cluster_id, r.node_id, r.snap_distance_m) for r in demand.snap_nearest(points, nodes).collect()} == {(1, 4, 80.0), (2, 4, 10.0)}


def test_trip_expansion_equals_stepping(spark):
    lengths = [(1, h, 700 * (h + 1) + 13 * t) for t in (1,) for h in range(4)]
    routes = spark.createDataFrame([(t, 3, h, h, h + 1, x, "commuter") for t, h, x in lengths], "trip_id long, depart_tick long, hop long, u long, v long, length_m long, profile_name string")
    got = sorted((r.tick, r.u) for r in flow.expand_trips(routes).collect())
    want, tick, left = set(), 3, 28.0 * 1000 / 60 * 6
    for _, h, x in lengths:
        while x > 0:
            if left <= 1e-9:
                tick, left = tick + 1, 2800.0
            want.add((tick, h))
            move = min(x, left)
            x, left = x - move, left - move
    assert got == sorted(want)


def test_projections_round_trip(spark):
    row = spark.createDataFrame([(12.5, 41.9), (-100.0, -65.0)], "lon double, lat double")
    x, y = geo.mollweide(F.col("lon"), F.col("lat"))
    lon, lat = geo.mollweide_inverse(x, y)
    for r in row.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.a - r.lon) < 1e-6 and abs(r.b - r.lat) < 1e-6


def test_strings(spark):
    row = spark.createDataFrame([(" Île de-France! ",), ("---",), (None,)], "s string")
    assert [r[0] for r in row.select(text.slugify(F.col("s"))).collect()] == ["le_de_france", "roi", "roi"]


def test_nearest_tick_prefers_the_earlier(spark):
    ticks = spark.createDataFrame([(0,), (4,)], "tick long")
    asked = spark.createDataFrame([(2,), (3,), (9,)], "want long")
    assert {r.want: r.tick for r in flow.nearest_tick(asked, ticks).collect()} == {2: 0, 3: 4, 9: 4}


def test_paths_equal_a_plain_search(spark):
    rng = random.Random(7)
    edges = sorted({(rng.randrange(40), rng.randrange(40)): float(rng.randrange(1, 9)) for _ in range(120)}.items())
    rows = [(u, v, w) for (u, v), w in edges if u != v]
    df = spark.createDataFrame(rows, "u long, v long, cost double")
    dests = spark.createDataFrame([(0,), (7,), (99,)], "node_id long")
    want = set()
    nodes = {n for u, v, _ in rows for n in (u, v)}
    for d in (0, 7):
        dist = {d: 0.0} if d in nodes else {}
        for _ in nodes:
            for u, v, w in rows:
                if v in dist and dist[v] + w < dist.get(u, 1e9):
                    dist[u] = dist[v] + w
        for n, far in dist.items():
            want.add((d, n, far, d if n == d else min(v for u, v, w in rows if u == n and dist.get(v, 1e9) + w == far)))
    assert {tuple(r) for r in routing.path_trees(df, dests).select("dest", "node", "dist", "next_node").collect()} == want
    assert {tuple(r) for r in routing.path_trees(df, dests, most=5).select("dest", "node", "dist", "next_node").collect()} == want


def test_components_of_a_long_chain(spark):
    names = list(range(200))
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])] + [(500, 501), (502, 501)], "u long, v long")
    got = {r.node: r.component for r in graph.weak_components(edges).collect()}
    assert got == {**dict.fromkeys(names, 0), 500: 500, 501: 500, 502: 500}


def test_percentiles_and_running_sums(spark):
    rng = random.Random(5)
    values = [rng.choice([1.0, 2.5, rng.random() * 100]) for _ in range(700)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double")
    for p in (0.0, 0.02, 0.5, 0.97, 1.0):
        assert ordered.percentile(df, F.col("v"), p) == pytest.approx(float(np.quantile(values, p)))
    assert ordered.percentile(df.limit(0), F.col("v"), 0.5) is None
    shares = {"a": 0.97, "b": 0.0, "c": 0.5, "d": 0.51, "e": 1.0}
    grouped = df.withColumn("g", F.when(F.col("k") < 650, 0).when(F.col("k") < 699, 1)).union(df.limit(1).select(F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(9)))
    for accuracy in (20, 50, 10_000):  # sketches that bracket, and groups that are sorted whole
        got = {r.g: r for r in ordered.quantiles(grouped.where("g IS NOT NULL"), ["g"], F.col("v"), shares, accuracy).collect()}
        assert set(got) == {0, 1}
        for g, part in ((0, values[:650]), (1, values[650:699])):
            assert [got[g][c] for c in shares] == pytest.approx([float(np.quantile(part, s)) for s in shares.values()])
    got = {r.k: r.s for r in ordered.running_sum(df, "k", "v", "s").collect()}
    assert all(got[i] == pytest.approx(x) for i, x in enumerate(np.cumsum(values)))


def test_weighted_choice_equals_a_search(spark):
    chances = [(i, p / 55) for i, p in enumerate([1, 0, 9, 20, 0, 25])]
    draws = [(i, i / 101) for i in range(101)] + [(200, 0.999999999)]
    got = {r.draw_id: r.node_id for r in demand.weighted_choice(spark.createDataFrame(draws, "draw_id long, u double"), spark.createDataFrame(chances, "node_id long, p double")).collect()}
    sums = np.cumsum([p for _, p in chances])
    assert got == {i: min(int(np.searchsorted(sums, u, side="right")), 5) for i, u in draws}


def test_missing_nodes_are_an_error(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], "node_id long, x double, y double")
    with pytest.raises(KeyError):
        demand.with_node_attributes(spark.createDataFrame([(1,), (2,)], "node_id long"), nodes)
    with pytest.raises(ValueError):
        demand.snap_nearest(spark.createDataFrame([(1, 0.0, 0.0)], "cluster_id long, x double, y double"), nodes.limit(0))


def test_masked_scan_checks_its_grids(spark):
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, -9999.0)], "row_i long, col_i long, value double")
    mask = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "row_i long, col_i long, value double")
    grid = {"width": 2, "height": 1, "transform": (1, 0, 0, 0, -1, 0), "crs": "a"}
    assert [tuple(r) for r in regions.masked_scan(cells, mask, grid, grid).collect()] == [(0, 0, 5.0)]
    for bad in ({**grid, "crs": "b"}, {**grid, "width": 3}):
        with pytest.raises(ValueError):
            regions.masked_scan(cells, mask, grid, bad)
    with pytest.raises(ValueError):
        regions.masked_scan(cells, mask.where("value = 0"), grid, grid)


def test_kmeans_converges_to_nearest_weighted_means(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    w = rng.integers(1, 5, 120).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, w))], "i long, a double, b double, w double")
    got = {r.i: r.cluster_id for r in demand.kmeans(df, ["a", "b"], 3, "w").collect()}
    label = np.array([got[i] for i in range(120)])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    means = np.stack([np.average(z[label == c], axis=0, weights=w[label == c]) for c in range(3)])
    assert (label == ((z[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)).all() and len(set(label[:40])) == 1
    assert demand.kmeans(df.limit(2), ["a", "b"], 9, "w").select("cluster_id").distinct().count() == 2
    assert demand.kmeans(df.limit(0), ["a", "b"], 3, "w").count() == 0


def test_regression_equals_least_squares(spark):
    from cityloom.operators import forecast

    rng = np.random.default_rng(2)
    values = rng.random((30, 4)).cumsum(axis=0)
    frames = spark.createDataFrame([(t, c, float(values[t, c])) for t in range(30) for c in range(4)], "frame long, cell long, value double")
    got = {(r.frame, r.cell): r.predicted for r in forecast.regression(frames, 3).collect()}
    ends = list(range(2, 29))
    test = max(1, int(len(ends) * 0.15))
    train = ends[: len(ends) - 2 * test]
    a = np.array([[*values[t - 2 : t + 1, c], 1] for t in train for c in range(4)])
    b = np.array([values[t + 1, c] for t in train for c in range(4)])
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    want = {(t, c): float(np.array([*values[t - 2 : t + 1, c], 1]) @ w) for t in ends[len(ends) - test :] for c in range(4)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_recurrent_gradient_and_training(spark, tmp_path):
    from cityloom.operators import recurrent

    rng = np.random.default_rng(3)
    model = recurrent.Model(3, 2, history=3, horizon=2, hidden=4).fresh(1)
    x, y = rng.random((2, 3, 3, 2)), rng.random((2, 2, 3, 2))
    _, grads = recurrent.gradient(model, x, y)
    for name in model.weights:
        at = tuple(rng.integers(0, n) for n in model.weights[name].shape)
        kept, losses = model.weights[name][at], []
        for e in (1e-5, -1e-5):
            model.weights[name][at] = kept + e
            losses.append(((recurrent.forward(model, x)[0] - y) ** 2).sum())
        model.weights[name][at] = kept
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-6)
    frames = spark.createDataFrame([(t, c, float(5 + 4 * np.sin(t / 2 + c))) for t in range(40) for c in range(6)], "frame long, cell long, value double")
    made = recurrent.windows(frames, 3, 2, 3, 2)
    first = made.orderBy("frame").first()
    assert made.count() == 36 and first.frame == 2 and [round(v[0], 4) for v in first.seen + first.ahead] == [round(float(np.float32(5 + 4 * np.sin(t / 2))), 4) for t in range(5)]
    model, told = recurrent.train(made, recurrent.Model(3, 2, 3, 2, 6), epochs=12, rate=0.03)
    assert min(t["val_mse"] for t in told) < 0.5 * told[0]["val_mse"]
    recurrent.save(model, f"file://{tmp_path}/model.npz")
    again = recurrent.load(spark, f"file://{tmp_path}/model.npz")
    one, two = ([tuple(r) for r in recurrent.predict_tail(frames, m).orderBy("step", "cell").collect()] for m in (model, again))
    assert one == two and len(one) == 12 and {r[0] for r in one} == {39} and all(r[4] is None for r in one)


# ---------------------------------------------------------------- agents


def _brute_run(edges, origins, attracting, events, c):
    """All agents tick by tick in one process, with the same draws."""
    total = sum(w for _, w in attracting)
    nodes, base = [n for n, _ in sorted(attracting)], [w / total for _, w in sorted(attracting)]
    lengths = {(u, v): (length, cost, cap) for u, v, length, cost, cap in edges}
    names, shares = list(flow.PROFILES), [flow.PROFILES[n][0] for n in flow.PROFILES]

    def pick(items, weights, u):
        sums = np.cumsum(weights)
        return items[min(int(np.searchsorted(sums, u * sums[-1], side="right")), len(items) - 1)] if sums[-1] > 0 else None

    def choose(a, tick, k):
        w = [x * math.prod([e[7] for e in events if e[0] == "hotspot_surge" and e[1] <= tick < e[2] and e[6] == n]) for n, x in zip(nodes, base)]
        w = [0.0 if n == a["node"] else x ** flow.PROFILES[a["profile"]][2] for n, x in zip(nodes, w)]
        return pick(nodes, w, simulation.uniform(c.seed, a["id"], tick, k))

    def trees(tick, past):
        costs = {}
        for e, (_, cost, cap) in lengths.items():
            on = [x for x in events if x[1] <= tick < x[2] and (x[3], x[4]) == e]
            if any(x[0] == "edge_closure" for x in on):
                continue
            room = max(cap * math.prod([x[5] for x in on if x[0] == "capacity_drop"]) * c.capacity_scale / (60 / c.tick_minutes), 0.1)
            costs[e] = cost * (1 + c.alpha * (past.get(e, 0) / room) ** c.beta)
        out = {}
        for d in nodes:
            dist = {d: 0.0}
            for _ in range(len(lengths)):
                for (u, v), w in costs.items():
                    if v in dist and dist[v] + w < dist.get(u, 1e18):
                        dist[u] = dist[v] + w
            for n in dist:
                if n != d:
                    out[d, n] = min(v for (u, v), w in costs.items() if u == n and abs(dist.get(v, 1e18) + w - dist[n]) < 1e-9 * dist[n])
        return out

    places = [n for n, _ in sorted(origins)]
    weights = [w for _, w in sorted(origins)]
    agents = []
    for i in range(c.n_agents):
        a = {"id": i, "profile": pick(names, shares, simulation.uniform(c.seed, i, 0, 1)), "node": pick(places, weights, simulation.uniform(c.seed, i, 0, 2)), "next": None, "done": 0.0, "trips": 0, "trip_ticks": 0, "metres": 0.0, "reroutes": 0}
        w = [0.0 if n == a["node"] else x ** flow.PROFILES[a["profile"]][2] for n, x in zip(nodes, base)]
        dest = pick(nodes, w, simulation.uniform(c.seed, i, 0, 3))
        a |= {"dest": a["node"] if dest is None else dest, "state": "dwelling", "dwell": 1 + int(simulation.uniform(c.seed, i, 0, 8) * round(1440 / c.tick_minutes))}
        if not c.diurnal:
            a |= {"state": "travelling", "dwell": 0}
        agents.append(a)
    loads, told, history = {}, [], []
    ends = {t for e in events for t in (e[1], e[2])} | set(range(0, c.n_ticks, c.replan))
    for tick in range(c.n_ticks):
        if tick in ends:
            hops = trees(tick, history[tick - 2] if tick >= 2 else {})
        now = {}
        queries = failures = 0
        for a in agents:
            profile = flow.PROFILES[a["profile"]]

            def arrive(a=a, profile=profile, tick=tick):
                u1, u2 = max(1e-12, simulation.uniform(c.seed, a["id"], tick, 6)), simulation.uniform(c.seed, a["id"], tick, 7)
                a.update(state="dwelling", trips=a["trips"] + 1, trip_ticks=0, next=None, done=0.0, dwell=max(1, round(profile[3] + profile[4] * math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2))))

            if a["state"] == "dwelling":
                a["dwell"] -= 1
                if a["dwell"] <= 0:
                    goes = not c.diurnal or simulation.uniform(c.seed, a["id"], tick, 5) <= simulation.activity((c.start_hour + tick * c.tick_minutes / 60) % 24)
                    dest = choose(a, tick, 4) if goes else None
                    a.update({"dwell": 1} if dest is None else {"dest": dest, "state": "travelling"})
                continue
            budget, streak, arrived = profile[1] * 1000 / 60 * c.tick_minutes, 0, False
            while budget > 1e-6:
                if a["node"] == a["dest"] and a["next"] is None:
                    arrive()
                    arrived = True
                    break
                if a["next"] is None:
                    queries += 1
                    hop = hops.get((a["dest"], a["node"]))
                    if hop is None:
                        failures += 1
                        streak += 1
                        dest = choose(a, tick, 100 + streak) if streak <= 8 else None
                        if dest is None:
                            break
                        a["dest"] = dest
                        a["reroutes"] += 1
                        continue
                    streak, a["next"], a["done"] = 0, hop, 0.0
                e = (a["node"], a["next"])
                rest = lengths[e][0] - a["done"]
                now[e] = now.get(e, 0) + 1
                move = min(budget, rest)
                budget -= move
                a["metres"] += move
                if move >= rest:
                    a.update(node=a["next"], next=None, done=0.0)
                    if a["node"] == a["dest"]:
                        arrive()
                        arrived = True
                        break
                else:
                    a["done"] += move
            if not arrived:
                a["trip_ticks"] += 1
        history.append(now)
        loads |= {(tick, *e): n for e, n in now.items()}
        told.append((tick, sum(a["state"] == "travelling" for a in agents), sum(a["trips"] for a in agents), queries, failures, sum(a["metres"] for a in agents) / c.n_agents))
    return agents, loads, told


_EVENTS = "kind string, tick_start long, tick_end long, u long, v long, capacity_factor double, node_id long, multiplier double"


@pytest.mark.parametrize("blocks", [1, 3])
def test_simulation_equals_a_plain_loop(spark, monkeypatch, blocks):
    edges = [(i, (i + d) % 7, 700.0 + 130 * i, (700.0 + 130 * i) * (1 + d / 5), 30.0 + 9 * d) for i in range(7) for d in (1, 2)] + [(8, 0, 900.0, 900.0, 40.0)]
    origins = [(i, float(i + 1)) for i in range(7)] + [(8, 2.0)]
    attracting = [(i, float(i + 1)) for i in (0, 2, 3, 5, 6)] + [(8, 1.0)]  # no way leads to 8
    events = [("capacity_drop", 5, 11, 0, 1, 0.25, None, None), ("edge_closure", 6, 12, 2, 3, None, None, None), ("hotspot_surge", 4, 9, None, None, None, 3, 3.0)]
    c = simulation.Config(n_agents=60, n_ticks=16, replan=6, diurnal=blocks == 1, sample_size=7)
    c = replace(c, tick_minutes=60.0) if blocks == 1 else c
    if blocks > 1:
        monkeypatch.setattr(simulation, "TREE_ROWS", 16)  # two destinations a group
        monkeypatch.setattr(simulation, "GROUP", 25)
    agents, loads, told = _brute_run(edges, origins, attracting, events, c)
    df = spark.createDataFrame(edges, "u long, v long, length_m double, base_cost double, base_capacity double")
    run = simulation.simulate(df, *(spark.createDataFrame(x, "node_id long, sum_weight double") for x in (origins, attracting)), spark.createDataFrame(events, _EVENTS), c)
    assert {(r.tick, r.u, r.v): r.load for r in run.loads.collect()} == loads and len(loads) > 50
    got = {r.agent_id: r for r in run.agents.collect()}
    assert len(got) == 60 and all((got[a["id"]].node, got[a["id"]].trips, got[a["id"]].reroutes) == (a["node"], a["trips"], a["reroutes"]) for a in agents)
    rows = simulation.metrics(run, df, c).orderBy("tick").collect()
    assert [(r.tick, r.active_travelers, r.completed_trips, r.route_queries, r.route_failures) for r in rows] == [t[:5] for t in told]
    assert all(r.mean_distance_m == pytest.approx(t[5]) for r, t in zip(rows, told)) and any(t[4] for t in told)
    assert {r.tick: r["count"] for r in run.positions.groupBy("tick").count().collect()} == dict.fromkeys(range(16), 7)
    one = simulation.summary(simulation.metrics(run, df, c), "x").first()
    assert (one.ticks, one.completed_trips, one.route_failures_total) == (15, told[-1][2], sum(t[4] for t in told))


def test_warm_up_finds_the_busiest_edges(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 5, 400.0, 400.0, 50.0, "primary" if i != 2 else "service") for i in range(5)], "u long, v long, length_m double, base_cost double, base_capacity double, road_class string")
    heavy = spark.createDataFrame([(i, 1.0) for i in range(5)], "node_id long, sum_weight double")
    found = scenarios.warm_up_bottlenecks(edges, heavy, heavy, simulation.Config(n_agents=40, replan=4)).collect()
    assert len(found) == 4 and all(r.u != 2 for r in found)
    rows = scenarios.catalog(edges, heavy, 40, spark.createDataFrame(found)).collect()
    assert [r.kind for r in rows].count("capacity_drop") == 4 and [r.kind for r in rows].count("edge_closure") == 3 and [r.node_id for r in rows if r.kind == "hotspot_surge"] == [0]
    assert scenarios.span(80) == (20, 60) and scenarios.span(8) == (4, 12)
