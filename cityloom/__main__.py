"""Command line: ``python -m cityloom COMMAND``; each builds its result as Parquet.

Tables are Parquet folders with the columns that the operators name.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cityloom")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("baseline", help="fuse two population rasters (row_i, col_i, value)")
    b.add_argument("raster_a"), b.add_argument("raster_b"), b.add_argument("out")
    b.add_argument("--weight-a", type=float, default=0.5), b.add_argument("--weight-b", type=float, default=0.5)
    b.add_argument("--low", type=float, default=1.0), b.add_argument("--high", type=float, default=99.5), b.add_argument("--bins", type=int, default=65_536)
    h = sub.add_parser("hotspots", help="score, smooth and cluster a fused raster")
    h.add_argument("raster"), h.add_argument("out")
    h.add_argument("--clusters", type=int, default=1000), h.add_argument("--quantile", type=float, default=0.5), h.add_argument("--window", type=int, default=3), h.add_argument("--seed", type=int, default=42)
    n = sub.add_parser("network", help="snap clusters to nodes and sum their demand")
    n.add_argument("clusters"), n.add_argument("nodes"), n.add_argument("out")
    n.add_argument("--top-k", type=int, default=150)
    s = sub.add_parser("simulate", help="run agents on raw edges towards attractors; writes loads, metrics, summary and positions")
    s.add_argument("edges"), s.add_argument("demand", help="node_id, sum_weight: origins, whose top nodes attract"), s.add_argument("out")
    s.add_argument("--scenario", default="baseline", choices=["baseline", "capacity_drop", "edge_closure", "hotspot_surge"])
    s.add_argument("--agents", type=int, default=1500), s.add_argument("--ticks", type=int, default=80), s.add_argument("--replan", type=int, default=10), s.add_argument("--seed", type=int, default=42), s.add_argument("--top-k", type=int, default=150)
    s.add_argument("--warm-up", action="store_true", help="look for bottlenecks in a short run first")
    f = sub.add_parser("forecast", help="score a regression and persistence on frames (frame, cell, value)")
    f.add_argument("frames"), f.add_argument("out"), f.add_argument("--history", type=int, default=12), f.add_argument("--horizon", type=int, default=3), f.add_argument("--top", type=int, default=20)
    t = sub.add_parser("train", help="train the recurrent forecaster on frames; writes a checkpoint and losses")
    t.add_argument("frames"), t.add_argument("checkpoint"), t.add_argument("out"), t.add_argument("--height", type=int, required=True), t.add_argument("--width", type=int, required=True)
    t.add_argument("--history", type=int, default=12), t.add_argument("--horizon", type=int, default=3), t.add_argument("--hidden", type=int, default=32), t.add_argument("--epochs", type=int, default=20)
    g = sub.add_parser("predict", help="forecast the frames after the last ones from a checkpoint")
    g.add_argument("frames"), g.add_argument("checkpoint"), g.add_argument("out")
    r = sub.add_parser("roi", help="clip a raster by polygons (city_id, city_name, ring), with masks and a manifest")
    r.add_argument("raster"), r.add_argument("polygons"), r.add_argument("out"), r.add_argument("--buffer", type=float, default=10_000.0)
    r.add_argument("--transform", type=float, nargs=6, default=(1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    o = sub.add_parser("overlay", help="frames of edge utilisation (tick, u, v, load) with captions")
    o.add_argument("edges"), o.add_argument("loads"), o.add_argument("out"), o.add_argument("--first", type=int, default=0), o.add_argument("--last", type=int, required=True), o.add_argument("--every", type=int, default=1)
    o.add_argument("--all-edges", action="store_true"), o.add_argument("--scenario", default="baseline")
    v = sub.add_parser("visualise", help="a raster as a grey picture between its 2nd and 98th percentile")
    v.add_argument("raster"), v.add_argument("out"), v.add_argument("--scale", type=int, default=1)
    i = sub.add_parser("inspect", help="statistics of a raster")
    i.add_argument("raster")
    ir = sub.add_parser("inspect-roi", help="match requested cities (requested_name) with polygons")
    ir.add_argument("asked"), ir.add_argument("polygons"), ir.add_argument("--transform", type=float, nargs=6, default=(1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    inn = sub.add_parser("inspect-network", help="candidates and clusters that two rasters would give")
    inn.add_argument("raster_a"), inn.add_argument("raster_b"), inn.add_argument("--clusters", type=int, default=1000), inn.add_argument("--quantile", type=float, default=0.5), inn.add_argument("--window", type=int, default=3)
    io = sub.add_parser("inspect-overlay", help="what a city's output folder holds")
    io.add_argument("folder")
    return p


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import functions as F

    from cityloom.operators import demand, flow, forecast, graph, inspect, raster, recurrent, report, roads, scenarios, simulation
    from cityloom.operators.ordered import percentile
    from cityloom.sources import outputs
    from cityloom.sources.lineage import stored

    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName(f"cityloom {a.command}").getOrCreate()
    read = spark.read.parquet
    if a.command == "inspect":
        raster.stats(read(a.raster)).show()
    elif a.command == "inspect-roi":
        inspect.requested_regions(read(a.asked), read(a.polygons), tuple(a.transform)).show(1000, truncate=False)
    elif a.command == "inspect-network":
        inspect.hotspot_input(read(a.raster_a), read(a.raster_b), a.clusters, a.quantile, a.window).show()
    elif a.command == "inspect-overlay":
        inspect.overlay_products(spark, a.folder).show(truncate=False)
    elif a.command == "baseline":
        parts = [raster.normalise(read(x), a.low, a.high, a.bins) for x in (a.raster_a, a.raster_b)]
        raster.fuse(*parts, a.weight_a, a.weight_b).write.mode("overwrite").parquet(a.out)
    elif a.command == "hotspots":
        scored = read(a.raster).select("row_i", "col_i", raster.saturation(F.col("value")).alias("score"))
        hot = raster.candidates(raster.local_mean(scored, "score", a.window, "local_score"), "local_score", a.quantile)
        weighted = hot.withColumn("w", F.greatest("local_score", F.lit(1.0)))
        k = min(a.clusters, weighted.count())
        demand.cluster_summary(demand.kmeans(weighted, ["col_i", "row_i", "score", "local_score"], k, "w", a.seed)).write.mode("overwrite").parquet(a.out)
    elif a.command == "network":
        snapped = demand.snap_nearest(read(a.clusters), read(a.nodes))
        demand.attractors(demand.node_demand(snapped), a.top_k).write.mode("overwrite").parquet(a.out)
    elif a.command == "simulate":
        edges = stored(roads.cheapest_edges(roads.routing_edges(read(a.edges))), "edges")
        inner = graph.largest_scc(edges).select(F.col("node").alias("node_id"))
        edges = stored(edges.join(inner.withColumnRenamed("node_id", "u"), "u", "left_semi").join(inner.withColumnRenamed("node_id", "v"), "v", "left_semi").select(*edges.columns), "network")
        origins = stored(demand.within_nodes(read(a.demand), inner), "origins")
        top = demand.attractors(origins, a.top_k)
        c = simulation.Config(n_agents=a.agents, n_ticks=a.ticks, replan=a.replan, seed=a.seed)
        bottleneck = scenarios.warm_up_bottlenecks(edges, origins, top, c) if a.warm_up else None
        run = simulation.simulate(edges, origins, top, scenarios.events_of(scenarios.catalog(edges, top, a.ticks, bottleneck), a.scenario), c)
        metrics = stored(simulation.metrics(run, edges, c), "metrics")
        for name, df in (("loads", run.loads), ("metrics", metrics), ("summary", simulation.summary(metrics, a.scenario)), ("positions", run.positions)):
            df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
    elif a.command == "train":
        made = recurrent.windows(read(a.frames), a.height, a.width, a.history, a.horizon)
        model, told = recurrent.train(made, recurrent.Model(a.height, a.width, a.history, a.horizon, a.hidden), a.epochs)
        recurrent.save(model, a.checkpoint)
        spark.createDataFrame(told, "epoch long, train_mse double, val_mse double").write.mode("overwrite").parquet(a.out)
    elif a.command == "predict":
        recurrent.predict_tail(read(a.frames), recurrent.load(spark, a.checkpoint)).write.mode("overwrite").parquet(a.out)
    elif a.command == "roi":
        outputs.roi_bundle(spark, a.out, read(a.raster), read(a.polygons), tuple(a.transform), a.buffer)
    elif a.command == "overlay":
        edges = read(a.edges)
        frames = report.animation_frames(flow.utilisation(read(a.loads), edges), edges, a.first, a.last, a.every, not a.all_edges)
        start, end = scenarios.span(a.last + 1)
        captions = report.frame_captions(spark.range(a.first, a.last + 1, a.every).withColumnRenamed("id", "tick"), a.last + 1, start, end, a.scenario, "all" if a.all_edges else "major")
        frames.drop("caption").join(captions, "tick").write.mode("overwrite").parquet(a.out)
    elif a.command == "visualise":
        cells = stored(raster.decimate(read(a.raster), a.scale), "picture")
        lo, hi = (percentile(cells, F.col("value"), p) or 0.0 for p in (0.02, 0.98))
        shown = cells.withColumn("value", F.greatest(F.col("value") - lo, F.lit(0.0))).withColumn("name", F.lit("baseline"))
        h, w = cells.agg(F.max("row_i") + 1, F.max("col_i") + 1).first()
        outputs.heat_pngs(shown, a.out, h or 1, w or 1, "name", max(hi - lo, 1e-9)).collect()
    elif a.command == "forecast":
        frames = read(a.frames)
        guess = forecast.regression(frames, a.history, a.horizon)
        rows = [("regression", guess), ("persistence", forecast.persistence(frames, a.horizon))]
        out = None
        for name, predicted in rows:
            one = forecast.errors(predicted).crossJoin(forecast.hit_rate(predicted, a.top)).withColumn("model", F.lit(name))
            out = one if out is None else out.union(one)
        out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
