"""What a run would work on, reported without building it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.operators import raster, regions


def requested_regions(asked: DataFrame, polygons: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """requested_name, status, city_id, bounds, area_km2 and the grid cells inside, for each
    requested city; only the first two where no polygon or several have its name."""
    found = regions.match_cities(asked.select("requested_name"), polygons)
    one = found.where("status = 'matched'").select("city_id")
    chosen = polygons.join(one, "city_id", "left_semi")
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    bounds = regions.ring_bounds(F.flatten(rings))
    area = F.aggregate(F.transform(rings, regions.ring_area), F.lit(0.0), lambda s, x: s + x) / 1e6
    shapes = chosen.select("city_id", *[b.alias(n) for b, n in zip(bounds, ("minx", "miny", "maxx", "maxy"))], area.alias("ring_km2"))
    cells = regions.spans(chosen, transform).groupBy("city_id").agg(F.sum(F.col("col_to") - F.col("col_from") + 1).alias("cells"))
    matched = F.when(F.col("status") == "matched", F.col("city_id"))
    return found.select("requested_name", "status", matched.alias("city_id")).join(shapes, "city_id", "left").join(cells, "city_id", "left").select(
        "requested_name", "status", "city_id", "minx", "miny", "maxx", "maxy", "ring_km2", F.when(F.col("status") == "matched", F.coalesce("cells", F.lit(0))).alias("cells")
    )


def hotspot_input(a: DataFrame, b: DataFrame, clusters: int = 1000, quantile: float = 0.9, window: int = 3) -> DataFrame:
    """One row: cells of both rasters, candidates, their threshold, and how many clusters they allow."""
    hot = raster.hotspots(a, b, quantile, window).agg(F.count("*").alias("candidate_count"), F.max("threshold").alias("threshold"))
    sizes = a.agg(F.count("value").alias("cells_a")).crossJoin(b.agg(F.count("value").alias("cells_b")))  # one row each
    return sizes.crossJoin(hot).select("cells_a", "cells_b", "candidate_count", F.round("threshold", 6).alias("threshold"), F.least(F.col("candidate_count"), F.lit(clusters)).alias("cluster_count"))


#: What a city's output folder holds, as patterns below it.
PRODUCTS = {"roi_manifest": "roi/roi_manifest.json", "network_manifest": "network/*/manifest.json", "basemap": "basemap/warped_basemap.png", "animation": "animation/*.gif"}


def overlay_products(spark: SparkSession, folder: str) -> DataFrame:
    """product, exists, path (the first there is) of a city's output folder."""
    rows = []
    for name, pattern in PRODUCTS.items():
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
        there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
        paths = sorted(s.getPath().toString() for s in there)
        rows.append((name, bool(paths), paths[0] if paths else None))
    return spark.createDataFrame(rows, "product string, exists boolean, path string")
