"""Registered queries and their DuckDB equivalents.

Each query takes (session, directory of tables); the oracle computes the same result
with other means on the same tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cityloom.functions import geo, text
from cityloom.operators import basemap, demand, flow, forecast, graph, inspect, raster, recurrent, regions, report, roads, routing, scenarios, simulation, temporal
from cityloom.operators.ordered import percentile, quantiles
from cityloom.plans.fixtures import sql, view
from cityloom.sources.lineage import stored
from cityloom.streaming import sessions
from cityloom.streaming import ticks as streaming

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function as the query of its name, with the oracle's SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def _edges(spark, d):
    return roads.cheapest_edges(roads.routing_edges(view(spark, d, "edges_raw")))


# ------------------------------------------------------------------ SQL parts

_STATS = "SELECT count(value) AS valid_count, count(*) FILTER (value = 0) AS zero_count, min(value) AS min_value, max(value) AS max_value, sum(value) AS sum_value FROM grid_a"


def _norm(grid: str, n: str) -> str:
    """Common table expressions that end in n (row_i, col_i, value) normalised."""
    return f"""
 {n}_r AS (SELECT min(ln(1 + value)) AS lo, max(ln(1 + value)) AS hi, count(*) AS n FROM {grid}),
 {n}_h AS (SELECT CASE WHEN hi <= lo THEN 0 ELSE CAST(least(greatest(floor((ln(1 + value) - lo) * 65535 / (hi - lo)), 0), 65535) AS BIGINT) END AS bin, count(*) AS c
          FROM {grid}, {n}_r GROUP BY 1),
 {n}_c AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS upto FROM {n}_h),
 {n}_p AS (SELECT p.pct, CASE WHEN r.n = 0 THEN 0 ELSE r.lo + (SELECT min(bin) FROM {n}_c WHERE upto >= ceil(p.pct / 100 * r.n)) * (r.hi - r.lo) / 65536 END AS value
          FROM (VALUES (CAST(1.0 AS DOUBLE)), (CAST(99.5 AS DOUBLE))) AS p(pct), {n}_r r),
 {n}_b AS (SELECT max(value) FILTER (pct = 1.0) AS lo, max(value) FILTER (pct = 99.5) AS hi FROM {n}_p),
 {n} AS (SELECT row_i, col_i, CASE WHEN hi <= lo THEN 0.0 ELSE least(greatest((ln(1 + value) - lo) / nullif(hi - lo, 0), 0.0), 1.0) END AS value FROM {grid}, {n}_b)"""


_FUSED = f"""{_norm("grid_a", "na")}, {_norm("grid_b", "nb")},
 fused AS (SELECT coalesce(na.row_i, nb.row_i) AS row_i, coalesce(na.col_i, nb.col_i) AS col_i,
   CASE WHEN na.value IS NULL THEN nb.value WHEN nb.value IS NULL THEN na.value ELSE 0.5 * na.value + 0.5 * nb.value END AS value
   FROM na FULL JOIN nb ON na.row_i = nb.row_i AND na.col_i = nb.col_i),
 scored AS (SELECT row_i, col_i, -log10(greatest(1 - value, 1e-6)) AS score FROM fused),
 smooth AS (SELECT c.row_i, c.col_i, any_value(c.score) AS score, avg(o.score) AS local_score
   FROM scored c JOIN scored o ON o.row_i BETWEEN c.row_i - 1 AND c.row_i + 1 AND o.col_i BETWEEN c.col_i - 1 AND c.col_i + 1 GROUP BY c.row_i, c.col_i)"""
_R = "CAST(row_i AS BIGINT) AS row_i, CAST(col_i AS BIGINT) AS col_i"


def _smooth(spark, d):
    fused = raster.fuse(raster.normalise(view(spark, d, "grid_a")), raster.normalise(view(spark, d, "grid_b")))
    return raster.local_mean(fused.select("row_i", "col_i", raster.saturation(F.col("value")).alias("score")), "score", 3, "local_score")


def _rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# ------------------------------------------------------------------ rasters


@query(_STATS)
def raster_stats(spark, d):
    return raster.stats(view(spark, d, "grid_a"))


@query("SELECT round(min(ln(1 + value)), 6) AS lo, round(max(ln(1 + value)), 6) AS hi, count(*) AS n FROM grid_a")
def log_bounds(spark, d):
    return _rounded(raster.log_range(view(spark, d, "grid_a")), "lo", "hi")


@query(f"WITH {_norm('grid_a', 'na')} SELECT pct, round(value, 6) AS value FROM na_p")
def log_hist_percentiles(spark, d):
    return _rounded(raster.histogram_percentiles(raster.log_histogram(view(spark, d, "grid_a")), [1.0, 99.5]), "value")


@query(f"WITH {_norm('grid_a', 'na')} SELECT {_R}, round(value, 6) AS value FROM na")
def normalize_grid(spark, d):
    return _rounded(raster.normalise(view(spark, d, "grid_a")), "value")


@query("""SELECT coalesce(a.row_i, b.row_i) AS row_i, coalesce(a.col_i, b.col_i) AS col_i,
  round(CASE WHEN a.value IS NULL THEN b.value WHEN b.value IS NULL THEN a.value ELSE 0.25 * a.value + 0.75 * b.value END, 6) AS value
  FROM grid_a a FULL JOIN grid_b b ON a.row_i = b.row_i AND a.col_i = b.col_i""")
def fuse_grids(spark, d):
    return _rounded(raster.fuse(view(spark, d, "grid_a"), view(spark, d, "grid_b"), 1, 3), "value")


@query(f"WITH {_FUSED} SELECT {_R}, round(score, 6) AS score FROM scored")
def saturation_score(spark, d):
    return _rounded(_smooth(spark, d).select("row_i", "col_i", "score"), "score")


@query("""SELECT row_i, col_i, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / count(*) OVER (), 6) AS pct_rank FROM grid_a""")
def pct_rank(spark, d):
    return _rounded(raster.percentile_rank(view(spark, d, "grid_a"), "value", "pct_rank").select("row_i", "col_i", "pct_rank"), "pct_rank")


@query(f"""SELECT c.row_i AS row_i, c.col_i AS col_i, round(avg(o.value), 6) AS local_mean FROM grid_b c JOIN grid_b o
  ON o.row_i BETWEEN c.row_i - 2 AND c.row_i + 2 AND o.col_i BETWEEN c.col_i - 2 AND c.col_i + 2 GROUP BY c.row_i, c.col_i""")
def local_mean(spark, d):
    return _rounded(raster.local_mean(view(spark, d, "grid_b"), "value", 5).select("row_i", "col_i", "local_mean"), "local_mean")


@query(f"""WITH {_FUSED}, t AS (SELECT quantile_cont(local_score, 0.9) AS threshold FROM smooth)
  SELECT {_R}, round(score, 6) AS score, round(local_score, 6) AS local_score, round(threshold, 6) AS threshold FROM smooth, t WHERE local_score >= threshold""")
def hotspot_candidates(spark, d):
    return _rounded(raster.hotspots(view(spark, d, "grid_a"), view(spark, d, "grid_b")), "score", "local_score", "threshold")


@query("SELECT CAST(floor(row_i / 4) AS BIGINT) AS row_i, CAST(floor(col_i / 4) AS BIGINT) AS col_i, arg_min(value, row_i * 1000 + col_i) AS value FROM grid_a GROUP BY 1, 2")
def decimate(spark, d):
    return raster.decimate(view(spark, d, "grid_a"), 4)


@query("""WITH image AS (SELECT value, row_i * 0.61 + 0.5 AS y0, (row_i + 1) * 0.61 + 0.5 AS y1, col_i * 0.37 - 2.25 AS x0, (col_i + 1) * 0.37 - 2.25 AS x1 FROM grid_a),
  t AS (SELECT CAST(r.range AS BIGINT) AS row_i, CAST(c.range AS BIGINT) AS col_i FROM range(30) r, range(18) c),
  o AS (SELECT t.row_i, t.col_i, value * (least(y1, t.row_i + 1) - greatest(y0, t.row_i)) * (least(x1, t.col_i + 1) - greatest(x0, t.col_i)) / (0.61 * 0.37) AS part
    FROM image JOIN t ON y0 < t.row_i + 1 AND y1 > t.row_i AND x0 < t.col_i + 1 AND x1 > t.col_i)
  SELECT row_i, col_i, round(sum(part), 6) AS value FROM o GROUP BY row_i, col_i HAVING sum(part) > 1e-9""")
def warp_exact(spark, d):
    place = lambda r, c: (r * 0.61 + 0.5, c * 0.37 - 2.25)
    return _rounded(raster.warp_exact(view(spark, d, "grid_a"), place, 30, 18).where("value > 1e-9"), "value")


@query("""SELECT CAST(floor((row_i + 0.5) * 0.3) AS BIGINT) AS row_i, CAST(floor((col_i + 0.5) * 0.3) AS BIGINT) AS col_i, sum(value) AS value FROM grid_a
  WHERE floor((row_i + 0.5) * 0.3) < 18 AND floor((col_i + 0.5) * 0.3) < 18 GROUP BY 1, 2""")
def warp_sum(spark, d):
    place = lambda c: F.floor((F.col(c) + 0.5) * 0.3)
    return raster.warp_sum(view(spark, d, "grid_a"), place("row_i"), place("col_i"), 18, 18)


@query("""WITH steps AS (SELECT i.range AS i, j.range AS j FROM range(4) i, range(4) j),
  cut AS (SELECT row_i + (i + 0.5) / 4 - 0.5 AS r, col_i + (j + 0.5) / 4 - 0.5 AS c, value / 16 AS value FROM grid_a, steps)
  SELECT CAST(floor((r + 0.5) * 0.3) AS BIGINT) AS row_i, CAST(floor((c + 0.5) * 0.3) AS BIGINT) AS col_i, round(sum(value), 6) AS value FROM cut
  WHERE floor((r + 0.5) * 0.3) < 20 AND floor((c + 0.5) * 0.3) < 20 GROUP BY 1, 2""")
def warp_sum_area(spark, d):
    place = lambda c: F.floor((F.col(c) + 0.5) * 0.3)
    return _rounded(raster.warp_sum_by_area(view(spark, d, "grid_a"), place("row_i"), place("col_i"), 20, 20), "value")


@query("""WITH t AS (SELECT r.range AS out_row, c.range AS out_col, r.range * 1.37 + 0.21 AS sr, c.range * 1.21 + 0.4 AS sc FROM range(40) r, range(40) c),
  k AS (SELECT i.range AS i, j.range AS j FROM range(2) i, range(2) j),
  asked AS (SELECT out_row, out_col, floor(sr) + i AS row_i, floor(sc) + j AS col_i,
    (CASE WHEN i = 1 THEN sr - floor(sr) ELSE 1 - (sr - floor(sr)) END) * (CASE WHEN j = 1 THEN sc - floor(sc) ELSE 1 - (sc - floor(sc)) END) AS w FROM t, k)
  SELECT out_row AS row_i, out_col AS col_i, round(sum(w * coalesce(value, 0)), 6) AS value FROM asked LEFT JOIN grid_a g ON g.row_i = asked.row_i AND g.col_i = asked.col_i GROUP BY out_row, out_col""")
def bilinear_warp(spark, d):
    t = spark.range(1600).select(F.floor(F.col("id") / 40).alias("out_row"), (F.col("id") % 40).alias("out_col"))
    t = t.withColumn("src_row", F.col("out_row") * 1.37 + 0.21).withColumn("src_col", F.col("out_col") * 1.21 + 0.4)
    return _rounded(raster.bilinear(view(spark, d, "grid_a"), t), "value")


@query("""WITH q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, min(value) AS a, max(value) AS b FROM grid_a)
  SELECT round(CASE WHEN abs(hi - lo) < 1e-9 THEN a ELSE lo END, 6) AS low, round(CASE WHEN abs(hi - lo) < 1e-9 THEN b ELSE hi END, 6) AS high FROM q""")
def robust_limits(spark, d):
    v, grid = F.col("value"), view(spark, d, "grid_a")
    lo, hi = (F.lit(percentile(grid, v, p)).cast("double") for p in (0.02, 0.98))
    flat = F.abs(hi - lo) < 1e-9
    return grid.agg(F.min(v).alias("a"), F.max(v).alias("b")).select(F.round(F.when(flat, F.col("a")).otherwise(lo), 6).alias("low"), F.round(F.when(flat, F.col("b")).otherwise(hi), 6).alias("high"))


@query("""SELECT row_i * 64 + col_i AS cell_id, 500.0 + (col_i + 0.5) * 10.0 AS center_x, 900.0 - (row_i + 0.5) * 10.0 AS center_y,
  CASE WHEN value >= 1 THEN value END AS baseline_value FROM grid_a""")
def cell_grid(spark, d):
    x, y = geo.cell_centre(F.col("row_i"), F.col("col_i"), (10.0, 0.0, 500.0, 0.0, -10.0, 900.0))
    return view(spark, d, "grid_a").select((F.col("row_i") * 64 + F.col("col_i")).alias("cell_id"), x.alias("center_x"), y.alias("center_y"), F.when(F.col("value") >= 1, F.col("value")).alias("baseline_value"))


# ------------------------------------------------------------------ regions


@query("SELECT city_id, row_i, col_i, value FROM grid_a, roi WHERE row_i BETWEEN row_min AND row_max AND col_i BETWEEN col_min AND col_max")
def roi_clip(spark, d):
    return regions.clip_boxes(view(spark, d, "grid_a"), view(spark, d, "roi")).select("city_id", "row_i", "col_i", "value")


@query("""WITH m AS (SELECT city_id, row_i, col_i, sqrt(CAST(pow(greatest(row_min - row_i, row_i - row_max, 0), 2) + pow(greatest(col_min - col_i, col_i - col_max, 0), 2) AS DOUBLE)) AS d FROM grid_a, roi)
  SELECT city_id, row_i, col_i, round(d, 6) AS distance FROM m WHERE d <= 2.5""")
def roi_buffer(spark, d):
    return _rounded(regions.clip_buffered(view(spark, d, "grid_a"), view(spark, d, "roi"), 2.5).select("city_id", "row_i", "col_i", "distance"), "distance")


@query("""SELECT city_id, city_name, CAST(max((row_max - row_min + 1) * (col_max - col_min + 1)) AS BIGINT) AS mask_cells, count(value) AS valid_cells, sum(value) AS value_sum
  FROM grid_a, roi WHERE row_i BETWEEN row_min AND row_max AND col_i BETWEEN col_min AND col_max GROUP BY city_id, city_name""")
def roi_summary(spark, d):
    clipped = regions.clip_boxes(view(spark, d, "grid_a"), view(spark, d, "roi"))
    return regions.region_summary(clipped, (F.col("row_max") - F.col("row_min") + 1) * (F.col("col_max") - F.col("col_min") + 1))


@query("""WITH asked AS (SELECT DISTINCT CASE WHEN c_custkey % 11 = 0 THEN 'NOWHERE ' || CAST(c_custkey % 5 AS VARCHAR) ELSE n_name END AS requested_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  p AS (SELECT city_name, city_id FROM roi UNION ALL SELECT city_name, city_id + 100 FROM roi WHERE city_id % 6 = 0)
  SELECT requested_name, count(city_id) AS matches, min(city_id) AS city_id,
    CASE count(city_id) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status
  FROM asked LEFT JOIN p ON city_name = requested_name GROUP BY requested_name""")
def city_match(spark, d):
    c, n, p = view(spark, d, "customer"), view(spark, d, "nation"), view(spark, d, "roi").select("city_id", "city_name")
    name = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("NOWHERE "), (F.col("c_custkey") % 5).cast("string"))).otherwise(F.col("n_name"))
    asked = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(name.alias("requested_name")).distinct()
    return regions.match_cities(asked, p.union(p.where("city_id % 6 = 0").select(F.col("city_id") + 100, "city_name")))


_SIDES = """sides AS (SELECT a.city_id, a.city_name, a.x AS ax, a.y AS ay, b.x AS cx, b.y AS cy FROM roi_vertices a JOIN roi_vertices b ON b.city_id = a.city_id AND b.seq = (a.seq + 1) % 5)"""
_IN_CITY = f"""{_SIDES}, grid AS (SELECT r.range AS row_i, c.range AS col_i, c.range + 0.5 AS x, r.range + 0.5 AS y FROM range(-20, 100) r, range(-20, 100) c),
  covered AS (SELECT city_id, city_name, row_i, col_i, count(*) FILTER ((ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / nullif(cy - ay, 0) + ax) % 2 = 1 AS inside,
    min(sqrt(pow(x - ax - t * (cx - ax), 2) + pow(y - ay - t * (cy - ay), 2))) AS far FROM (SELECT *, greatest(0, least(1, ((x - ax) * (cx - ax) + (y - ay) * (cy - ay)) / (pow(cx - ax, 2) + pow(cy - ay, 2)))) AS t FROM grid, sides) GROUP BY ALL)"""
_UNIT = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def _polygons(spark, d):
    return regions.polygons_of(view(spark, d, "roi_vertices"))


@query(f"""WITH {_IN_CITY}, asked AS (SELECT DISTINCT city_name AS requested_name FROM roi WHERE city_id % 2 = 0 UNION ALL SELECT 'NOWHERE'),
  n AS (SELECT city_name, min(city_id) AS city_id FROM roi_vertices GROUP BY city_name),
  b AS (SELECT city_id, min(ax) AS minx, min(ay) AS miny, max(ax) AS maxx, max(ay) AS maxy, abs(sum(ax * cy - cx * ay)) / 2 / 1e6 AS km2 FROM sides GROUP BY city_id), k AS (SELECT city_id, count(*) FILTER (inside) AS cells FROM covered GROUP BY city_id)
  SELECT requested_name, CASE WHEN n.city_id IS NULL THEN 'unresolved' ELSE 'matched' END AS status, n.city_id, round(minx, 6) AS minx, round(miny, 6) AS miny, round(maxx, 6) AS maxx, round(maxy, 6) AS maxy, round(km2, 9) AS ring_km2, cells
  FROM asked LEFT JOIN n ON n.city_name = requested_name LEFT JOIN b ON b.city_id = n.city_id LEFT JOIN k ON k.city_id = n.city_id""")
def inspect_regions(spark, d):
    asked = view(spark, d, "roi").where("city_id % 2 = 0").select(F.col("city_name").alias("requested_name")).distinct().union(spark.range(1).select(F.lit("NOWHERE")))
    found = inspect.requested_regions(asked, _polygons(spark, d), _UNIT)
    return _rounded(_rounded(found, "minx", "miny", "maxx", "maxy"), "ring_km2", digits=9)


_IN_RINGS = """ring_sides AS (SELECT a.city_id, a.city_name, a.x AS ax, a.y AS ay, b.x AS cx, b.y AS cy FROM roi_rings a JOIN roi_rings b ON b.city_id = a.city_id AND b.ring = a.ring AND b.seq = (a.seq + 1) % a.sides),
  spots AS (SELECT r.range AS row_i, c.range AS col_i, c.range + 0.5 AS x, r.range + 0.5 AS y FROM range(-20, 100) r, range(-20, 100) c),
  held AS (SELECT city_id, city_name, row_i, col_i FROM spots, ring_sides GROUP BY ALL HAVING count(*) FILTER ((ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / nullif(cy - ay, 0) + ax) % 2 = 1)"""


def _multipolygons(spark, d):
    return regions.multipolygons_of(view(spark, d, "roi_rings"))


@query(f"WITH {_IN_RINGS} SELECT h.city_id, h.city_name, h.row_i, h.col_i, value FROM held h JOIN grid_a g ON g.row_i = h.row_i AND g.col_i = h.col_i")
def multipolygon_clip(spark, d):
    return regions.clip_polygons(view(spark, d, "grid_a"), _multipolygons(spark, d), _UNIT).select("city_id", "city_name", "row_i", "col_i", "value")


@query(f"WITH {_IN_RINGS} SELECT city_id, row_i, col_i FROM held")
def multipolygon_mask(spark, d):
    return regions.polygon_masks(_multipolygons(spark, d), _UNIT)


@query(f"WITH {_IN_CITY} SELECT c.city_id, c.city_name, c.row_i, c.col_i, value FROM covered c JOIN grid_a g ON g.row_i = c.row_i AND g.col_i = c.col_i WHERE inside")
def polygon_clip(spark, d):
    return regions.clip_polygons(view(spark, d, "grid_a"), _polygons(spark, d), _UNIT).select("city_id", "city_name", "row_i", "col_i", "value")


@query(f"WITH {_IN_CITY} SELECT c.city_id, c.city_name, c.row_i, c.col_i, value FROM covered c JOIN grid_a g ON g.row_i = c.row_i AND g.col_i = c.col_i WHERE inside OR far <= 1.75")
def polygon_buffer(spark, d):
    return regions.clip_polygons(view(spark, d, "grid_a"), _polygons(spark, d), _UNIT, 1.75).select("city_id", "city_name", "row_i", "col_i", "value")


@query(f"""WITH {_IN_CITY}, m AS (SELECT city_id, count(*) AS n FROM covered WHERE inside GROUP BY city_id),
  s AS (SELECT c.city_id, count(value) AS valid, sum(value) AS total FROM covered c JOIN grid_a g ON g.row_i = c.row_i AND g.col_i = c.col_i WHERE inside GROUP BY c.city_id)
  SELECT v.city_id, v.city_name, CAST(floor(max(x)) - floor(min(x)) + 1 AS BIGINT) AS width, CAST(floor(max(y)) - floor(min(y)) + 1 AS BIGINT) AS height, coalesce(any_value(n), 0) AS pixel_count_inside_mask,
    coalesce(any_value(valid), 0) AS valid_baseline_pixels, coalesce(any_value(total), 0) AS baseline_sum FROM roi_vertices v LEFT JOIN m ON m.city_id = v.city_id LEFT JOIN s ON s.city_id = v.city_id GROUP BY v.city_id, v.city_name""")
def polygon_statistics(spark, d):
    return regions.roi_statistics(view(spark, d, "grid_a"), _polygons(spark, d), _UNIT).drop("bounds")


@query(f"WITH {_SIDES} SELECT round(min(ax), 6) AS minx, round(min(ay), 6) AS miny, round(max(ax), 6) AS maxx, round(max(ay), 6) AS maxy, round(CAST(sum(area) AS DOUBLE), 9) AS area_km2 FROM (SELECT *, 0.0 AS area FROM sides UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, abs(sum(ax * cy - cx * ay)) / 2 / 1e6 FROM sides GROUP BY city_id)")
def polygon_bounds(spark, d):
    return _rounded(_rounded(regions.total_bounds(_polygons(spark, d)), "minx", "miny", "maxx", "maxy"), "area_km2", digits=9)


@query("SELECT a.row_i, a.col_i, a.value FROM grid_a a JOIN mask_b m ON m.row_i = a.row_i AND m.col_i = a.col_i WHERE m.value = 1 AND a.value <> 100")
def roi_mask_scan(spark, d):
    grid = {"width": 64, "height": 64, "transform": _UNIT, "crs": "local"}
    return regions.masked_scan(view(spark, d, "grid_a"), view(spark, d, "mask_b"), grid, grid, nodata=100.0).select("row_i", "col_i", "value")


@query("""WITH j AS (SELECT a.value, b.value AS score FROM grid_a a JOIN grid_b b ON a.row_i = b.row_i AND a.col_i = b.col_i)
  SELECT count(*) AS valid_pixels, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95, round(avg(score), 6) AS score_mean,
    round(quantile_cont(score, 0.5), 6) AS score_p50, round(quantile_cont(score, 0.95), 6) AS score_p95, max(score) AS score_max FROM j""")
def region_review(spark, d):
    cells = stored(view(spark, d, "grid_a").join(view(spark, d, "grid_b").withColumnRenamed("value", "score"), ["row_i", "col_i"]), "review")
    return _rounded(report.region_review(cells), "value_mean", "value_p50", "value_p95", "score_mean", "score_p50", "score_p95")


@query("""SELECT m.row_i AS row, m.col_i AS col, m.row_i * 64 + m.col_i AS cell_id, m.col_i + 0.5 AS center_x, m.row_i + 0.5 AS center_y, true AS in_roi, a.value IS NOT NULL AS baseline_valid, a.value AS baseline_value,
    a.value AS score, a.value / 2 AS score_rank, a.value * 2 AS local_score, c.row_i IS NOT NULL AS is_hotspot_candidate, CASE WHEN c.row_i IS NOT NULL THEN (m.row_i + m.col_i) % 9 END AS cluster_id
  FROM mask_b m LEFT JOIN grid_a a ON a.row_i = m.row_i AND a.col_i = m.col_i LEFT JOIN (SELECT * FROM grid_a WHERE value >= 60) c ON c.row_i = m.row_i AND c.col_i = m.col_i WHERE m.value = 1""")
def grid_cells(spark, d):
    a = view(spark, d, "grid_a")
    scored = a.select("row_i", "col_i", F.col("value").alias("score"), (F.col("value") / 2).alias("score_rank"), (F.col("value") * 2).alias("local_score"))
    hot = a.where("value >= 60").select("row_i", "col_i", ((F.col("row_i") + F.col("col_i")) % 9).alias("cluster_id"))
    return report.grid_cells(view(spark, d, "mask_b").where("value = 1"), a, scored, hot, _UNIT, 64)


# ------------------------------------------------------------------ clusters and demand


@query(f"""WITH {_FUSED} SELECT (row_i // 8) * 8 + col_i // 8 AS cluster_id, count(*) AS pixel_count, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, round(avg(local_score), 6) AS mean_local_score,
  round(sum(local_score), 6) AS weight_sum, round(avg(row_i), 6) AS center_row, round(avg(col_i), 6) AS center_col,
  round(sum(local_score * row_i) / nullif(sum(local_score), 0), 6) AS weighted_center_row, round(sum(local_score * col_i) / nullif(sum(local_score), 0), 6) AS weighted_center_col
  FROM smooth GROUP BY 1""")
def cluster_summary(spark, d):
    cells = _smooth(spark, d).withColumn("cluster_id", F.floor(F.col("row_i") / 8) * 8 + F.floor(F.col("col_i") / 8))
    return _rounded(demand.cluster_summary(cells), "mean_score", "max_score", "mean_local_score", "weight_sum", "center_row", "center_col", "weighted_center_row", "weighted_center_col")


@query()
def kmeans_clusters(spark, d):
    cells = raster.candidates(_smooth(spark, d), "local_score", 0.5).withColumn("w", F.greatest("local_score", F.lit(1.0)))
    return demand.cluster_summary(demand.kmeans(cells, ["col_i", "row_i", "score", "local_score"], 20, "w"))


_SNAPPED = """ranked AS (SELECT c.cluster_id, c.pixel_count, c.weight, n.node_id, sqrt(pow(c.x - n.x, 2) + pow(c.y - n.y, 2)) AS d,
    row_number() OVER (PARTITION BY c.cluster_id ORDER BY sqrt(pow(c.x - n.x, 2) + pow(c.y - n.y, 2)), n.node_id) AS r FROM centres c, nodes n),
  snapped AS (SELECT * FROM ranked WHERE r = 1)"""
_DEMAND = _SNAPPED + ", dem AS (SELECT node_id, count(*) AS hotspot_count, CAST(sum(pixel_count) AS BIGINT) AS sum_pixel_count, sum(weight) AS sum_weight FROM snapped GROUP BY node_id)"


def _snapped(spark, d):
    return demand.snap_nearest(view(spark, d, "centres"), view(spark, d, "nodes"))


def _demand(spark, d):
    return demand.node_demand(_snapped(spark, d))


@query(f"WITH {_SNAPPED} SELECT cluster_id, node_id, round(d, 6) AS snap_distance_m FROM snapped")
def snap_nearest(spark, d):
    return _rounded(_snapped(spark, d).select("cluster_id", "node_id", "snap_distance_m"), "snap_distance_m")


@query(f"WITH {_DEMAND} SELECT * FROM dem")
def node_demand(spark, d):
    return _demand(spark, d)


@query(f"""WITH {_SNAPPED} SELECT s.node_id, count(*) AS hotspot_count, CAST(sum(s.pixel_count) AS BIGINT) AS sum_pixel_count, sum(s.weight) AS sum_weight, sum(c.mean_local_score) AS sum_mean_local_score
  FROM snapped s JOIN centres c ON c.cluster_id = s.cluster_id GROUP BY s.node_id""")
def demand_order(spark, d):
    return demand.demand_order(demand.node_demand(_snapped(spark, d), ("weight", "mean_local_score")))


@query(f"WITH {_DEMAND} SELECT arg_min(node_id, (-sum_weight, node_id)) AS node_id FROM dem")
def strongest_node(spark, d):
    return demand.strongest_node(_demand(spark, d))


@query(f"WITH {_DEMAND} SELECT * FROM dem WHERE node_id IN (SELECT u FROM edges_raw)")
def demand_in_network(spark, d):
    return demand.within_nodes(_demand(spark, d), view(spark, d, "edges_raw").select(F.col("u").alias("node_id")))


@query(f"WITH {_DEMAND}, top AS (SELECT * FROM dem ORDER BY sum_weight DESC, node_id LIMIT 20) SELECT node_id, x, y FROM nodes WHERE node_id IN (SELECT node_id FROM top)")
def attractor_points(spark, d):
    return demand.attractor_points(view(spark, d, "nodes"), demand.attractors(_demand(spark, d), 20))


@query(f"WITH {_SNAPPED} SELECT round(min(d), 6) AS min_m, round(max(d), 6) AS max_m, round(avg(d), 6) AS mean_m, round(quantile_cont(d, 0.5), 6) AS median_m, round(quantile_cont(d, 0.95), 6) AS p95_m FROM snapped")
def snap_stats(spark, d):
    return _rounded(demand.snap_statistics(_snapped(spark, d)), "min_m", "max_m", "mean_m", "median_m", "p95_m")


@query(f"WITH {_DEMAND} SELECT node_id, sum_weight, round(sum_weight / (SELECT sum(sum_weight) FROM dem), 9) AS weight_share FROM dem ORDER BY sum_weight DESC, node_id LIMIT 20")
def demand_weights(spark, d):
    return _rounded(demand.attractors(_demand(spark, d), 20), "weight_share", digits=9)


@query(f"""WITH {_DEMAND}, top AS (SELECT * FROM dem ORDER BY sum_weight DESC, node_id LIMIT 20)
  SELECT (SELECT count(*) FROM dem) AS demand_nodes, (SELECT count(*) FROM top) AS attractor_nodes, (SELECT sum(sum_weight) FROM dem) AS total_weight,
    round((SELECT sum(sum_weight) FROM top) / (SELECT sum(sum_weight) FROM dem), 6) AS coverage""")
def demand_summary(spark, d):
    whole = _demand(spark, d)
    top = demand.attractors(whole, 20).agg(F.count("*").alias("attractor_nodes"), F.sum("sum_weight").alias("t"))
    out = whole.agg(F.count("*").alias("demand_nodes"), F.sum("sum_weight").alias("total_weight")).crossJoin(F.broadcast(top))
    return out.select("demand_nodes", "attractor_nodes", "total_weight", F.round(F.col("t") / F.col("total_weight"), 6).alias("coverage"))


@query(f"""WITH {_DEMAND}, top AS (SELECT * FROM dem ORDER BY sum_weight DESC, node_id LIMIT 20),
  w AS (SELECT node_id, CASE WHEN node_id = (SELECT min(node_id) FROM top) THEN 0 ELSE pow(sum_weight * CASE WHEN node_id % 2 = 0 THEN 3.0 ELSE 1.0 END, 1.05) END AS w FROM top)
  SELECT node_id, round(w / (SELECT sum(w) FROM w), 9) AS p FROM w""")
def destination_weights(spark, d):
    top = demand.attractors(_demand(spark, d), 20)
    least = top.agg(F.min("node_id").alias("_least"))
    marked = top.crossJoin(F.broadcast(least))
    surge = F.when(F.col("node_id") % 2 == 0, 3.0).otherwise(1.0)
    return _rounded(demand.destination_weights(marked, F.lit(1.05), surge, F.col("node_id") == F.col("_least")), "p", digits=9)


@query(f"""WITH {_DEMAND}, top AS (SELECT * FROM dem ORDER BY sum_weight DESC, node_id LIMIT 20),
  p AS (SELECT node_id, sum_weight / (SELECT sum(sum_weight) FROM top) AS p FROM top),
  ends AS (SELECT node_id, sum(p) OVER (ORDER BY node_id ROWS UNBOUNDED PRECEDING) AS upto FROM p),
  draws AS (SELECT event_id AS draw_id, {demand.hash_uniform_sql(42, "event_id", "event_id % 7")} AS u FROM events)
  SELECT draw_id, coalesce((SELECT min(node_id) FROM ends WHERE upto > u), (SELECT max(node_id) FROM ends)) AS node_id FROM draws""")
def weighted_choice(spark, d):
    top = demand.attractors(_demand(spark, d), 20)
    chances = demand.destination_weights(top, F.lit(1.0))
    draws = view(spark, d, "events").select(F.col("event_id").cast("long").alias("draw_id"), demand.hash_uniform(42, F.col("event_id"), F.col("event_id") % 7).alias("u"))
    return demand.weighted_choice(draws, chances)


# ------------------------------------------------------------------ roads and graphs

_KNOWN = ", ".join(f"'{c}'" for c, p, _, _ in roads.CLASSES if p is not None)
_MAJORS = ", ".join(f"'{c}'" for c in roads.MAJOR)
_QUOTES = "'" * 3 + '"' + "'"
_CLASSED = f"""toks AS (SELECT *, CASE WHEN lower(trim(highway)) = 'nan' THEN [] ELSE list_filter(list_transform(string_split(trim(lower(trim(coalesce(highway, ''))), '[]'), ','), lambda x: trim(trim(x), {_QUOTES})), lambda x: x <> '') END AS tokens,
   list_filter(list_transform(string_split(replace(lower(trim(coalesce(lanes, ''))), ';', ','), ','), lambda x: TRY_CAST(trim(trim(trim(x), '[]'), {_QUOTES}) AS DOUBLE)), lambda x: x IS NOT NULL) AS nums FROM edges_raw),
 classed AS (SELECT u, v, edge_key, length_m, coalesce(list_filter([{_KNOWN}], lambda c: list_contains(tokens, c))[1], tokens[1], 'other') AS road_class,
   greatest(coalesce(list_avg(nums), 1.0), 1.0) AS lane_count FROM toks),
 dims AS (SELECT * FROM (VALUES {", ".join(f"('{c}', CAST({cap} AS DOUBLE), CAST({pen} AS DOUBLE))" for c, _, cap, pen in roads.CLASSES)}) AS d(name, capacity, penalty)),
 routed AS (SELECT u, v, edge_key, greatest(length_m, 1.0) AS length_m, road_class, lane_count, coalesce(capacity, 28.0) * lane_count AS base_capacity,
   coalesce(penalty, 1.7) AS road_penalty, greatest(length_m, 1.0) * coalesce(penalty, 1.7) AS base_cost FROM classed LEFT JOIN dims ON name = road_class),
 edges AS (SELECT u, v, arg_min(road_class, (base_cost, edge_key)) AS road_class, arg_min(base_capacity, (base_cost, edge_key)) AS base_capacity,
   min(base_cost) AS base_cost, arg_min(edge_key, (base_cost, edge_key)) AS edge_key FROM routed GROUP BY u, v)"""


@query(f"WITH {_CLASSED} SELECT edge_key, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS tokens FROM toks")
def highway_tokens(spark, d):
    tokens = text.list_tokens(F.col("highway"))
    return view(spark, d, "edges_raw").select("edge_key", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens"))


@query(f"WITH {_CLASSED} SELECT edge_key, road_class FROM classed")
def road_class(spark, d):
    return view(spark, d, "edges_raw").select("edge_key", roads.road_class(F.col("highway")).alias("road_class"))


@query(f"WITH {_CLASSED} SELECT edge_key, lane_count FROM classed")
def lane_mean(spark, d):
    return view(spark, d, "edges_raw").select("edge_key", roads.lane_count(F.col("lanes")).alias("lane_count"))


@query(f"WITH {_CLASSED} SELECT edge_key, base_capacity, road_penalty, round(base_cost, 6) AS base_cost FROM routed")
def road_capacity(spark, d):
    return _rounded(roads.routing_edges(view(spark, d, "edges_raw")).select("edge_key", "base_capacity", "road_penalty", "base_cost"), "base_cost")


@query(f"""WITH {_CLASSED} SELECT road_class, quantile_cont(length_m, 0.05) AS p05, quantile_cont(length_m, 0.5) AS median, quantile_cont(length_m, 0.95) AS p95, quantile_cont(length_m, 1.0) AS longest
  FROM routed GROUP BY road_class""")
def class_lengths(spark, d):
    routed = roads.routing_edges(view(spark, d, "edges_raw"))
    return quantiles(routed, ["road_class"], F.col("length_m"), {"p05": 0.05, "median": 0.5, "p95": 0.95, "longest": 1.0})


@query("""SELECT CAST(l_partkey AS BIGINT) AS part, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.75) AS q3 FROM lineitem GROUP BY 1""")
def price_quartiles(spark, d):
    """Many groups, of a few rows each."""
    rows = view(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("part"), "l_extendedprice")
    return quantiles(rows, ["part"], F.col("l_extendedprice"), {"q1": 0.25, "q3": 0.75})


@query(f"WITH {_CLASSED} SELECT u, v, edge_key, road_class, base_capacity, round(base_cost, 6) AS base_cost FROM edges")
def cheapest_edge(spark, d):
    return _rounded(_edges(spark, d).select("u", "v", "edge_key", "road_class", "base_capacity", "base_cost"), "base_cost")


@query(f"""WITH {_CLASSED}, tiered AS (SELECT *, CASE WHEN base_capacity < 40 THEN NULL WHEN road_class IN ('trunk', 'trunk_link') THEN 0 WHEN road_class IN ('primary', 'primary_link') THEN 1
    WHEN road_class IN ('secondary', 'secondary_link') THEN 2 WHEN road_class IN ('motorway', 'motorway_link') THEN 3 END AS tier FROM edges),
  best AS (SELECT min(tier) AS best FROM (SELECT tier FROM tiered WHERE tier IS NOT NULL GROUP BY tier HAVING count(*) >= 4))
  SELECT u, v, road_class, base_capacity FROM tiered, best WHERE CASE WHEN best IS NOT NULL THEN tier = best ELSE road_class IN ({_MAJORS}) END ORDER BY base_capacity, u, v LIMIT 8""")
def scenario_edges(spark, d):
    return roads.scenario_edges(_edges(spark, d))


@query("""WITH t AS (SELECT CAST(range AS BIGINT) AS tick FROM range(240))
  SELECT tick, u, v, coalesce(product(CASE WHEN kind = 'capacity_drop' THEN coalesce(capacity_factor, 1.0) END), 1.0) AS factor, bool_or(kind = 'edge_closure') AS closed
  FROM t JOIN scenario_events ON tick >= tick_start AND tick < tick_end GROUP BY tick, u, v""")
def active_events(spark, d):
    return roads.active_factors(view(spark, d, "scenario_events"), spark.range(240).withColumnRenamed("id", "tick"))


@query(f"""WITH {_CLASSED}, f AS (SELECT u, v, coalesce(product(CASE WHEN kind = 'capacity_drop' THEN capacity_factor END), 1.0) AS factor, bool_or(kind = 'edge_closure') AS closed
    FROM scenario_events WHERE 120 >= tick_start AND 120 < tick_end GROUP BY u, v),
  l AS (SELECT u, v, load FROM edge_history WHERE tick = 118)
  SELECT e.u, e.v, round(base_cost * (1 + 1.8 * pow(coalesce(load, 0) / greatest(base_capacity * coalesce(factor, 1.0) * 0.5 / 10.0, 0.1), 2.8)), 6) AS cost
  FROM edges e LEFT JOIN l ON l.u = e.u AND l.v = e.v LEFT JOIN f ON f.u = e.u AND f.v = e.v WHERE NOT coalesce(closed, false)""")
def dynamic_cost(spark, d):
    tick = spark.range(120, 121).withColumnRenamed("id", "tick")
    factors = roads.active_factors(view(spark, d, "scenario_events"), tick)
    return _rounded(roads.dynamic_costs(_edges(spark, d), view(spark, d, "edge_history").where("tick = 118"), factors), "cost")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT u, v FROM edges_raw), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
  r(node, other) AS (SELECT u, u FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.other) SELECT node, min(other) AS component FROM r GROUP BY node""")
def weak_components(spark, d):
    return graph.weak_components(view(spark, d, "edges_raw"))


_REACH = """e AS (SELECT DISTINCT u, v FROM edges_raw),
  r(a, b) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)"""


@query(f"""WITH RECURSIVE {_REACH}, s AS (SELECT x.a AS node, least(min(x.b), x.a) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
  n AS (SELECT node, scc FROM s UNION ALL SELECT node, node FROM (SELECT u AS node FROM e UNION SELECT v FROM e) WHERE node NOT IN (SELECT node FROM s)),
  size AS (SELECT scc, count(*) AS c FROM n GROUP BY scc) SELECT node FROM n WHERE scc = (SELECT arg_min(scc, (-c, scc)) FROM size)""")
def largest_scc(spark, d):
    return graph.largest_scc(view(spark, d, "edges_raw"))


# Walks longer than any shortest way of these dense graphs end the recursion.
_PATHS = """e AS (SELECT u, v, min(length_m) AS w FROM edges_raw GROUP BY u, v),
  p(dest, node, dist) AS (SELECT n, n, CAST(0 AS DOUBLE) FROM (SELECT u AS n FROM e UNION SELECT v FROM e)
    UNION SELECT p.dest, e.u, min(p.dist + e.w) FROM p JOIN e ON e.v = p.node WHERE p.dist + e.w < 3000 GROUP BY p.dest, e.u),
  best AS (SELECT dest, node, min(dist) AS dist FROM p GROUP BY dest, node)"""


def _trees(spark, d):
    edges = view(spark, d, "edges_raw").groupBy("u", "v").agg(F.min("length_m").alias("cost"))
    return routing.path_trees(edges, edges.select(F.col("v").alias("node_id")).union(edges.select("u")).distinct())


@query(f"WITH RECURSIVE {_PATHS} SELECT dest, node, dist FROM best")
def shortest_paths(spark, d):
    return _trees(spark, d).select("dest", "node", "dist")


@query(f"""WITH RECURSIVE {_PATHS}, asked AS (SELECT DISTINCT CAST(user_id % 100 AS BIGINT) AS node, CAST(event_id % 100 AS BIGINT) AS dest FROM events),
  step AS (SELECT b.dest, b.node, min(e.v) AS next_node FROM best b JOIN e ON e.u = b.node JOIN best c ON c.dest = b.dest AND c.node = e.v
    WHERE b.node <> b.dest AND abs(c.dist + e.w - b.dist) < 1e-9 GROUP BY b.dest, b.node)
  SELECT a.dest, a.node, next_node FROM asked a LEFT JOIN step USING (dest, node) WHERE a.dest <> a.node""")
def next_hop(spark, d):
    asked = view(spark, d, "events").select((F.col("user_id") % 100).cast("long").alias("node"), (F.col("event_id") % 100).cast("long").alias("dest")).distinct().where("node <> dest")
    return routing.next_hops(_trees(spark, d), asked).select("dest", "node", "next_node")


# Distances by key: a row is replaced where a shorter way is found.
_STREETS = """goals AS (SELECT CAST(n_nationkey * floor((SELECT count(*) FROM part) / 25) AS BIGINT) AS dest FROM nation),
  p(dest, node, dist) USING KEY (dest, node) AS (SELECT dest, dest, CAST(0 AS DOUBLE) FROM goals
    UNION SELECT n.dest, n.node, n.dist FROM (SELECT p.dest, e.u AS node, min(p.dist + e.length_m) AS dist FROM p JOIN streets e ON e.v = p.node GROUP BY p.dest, e.u) n
      LEFT JOIN recurring.p r ON r.dest = n.dest AND r.node = n.node WHERE r.dist IS NULL OR n.dist < r.dist)"""


@query(f"""WITH RECURSIVE {_STREETS}, step AS (SELECT b.dest, b.node, min(e.v) AS next_node FROM p b JOIN streets e ON e.u = b.node JOIN p c ON c.dest = b.dest AND c.node = e.v
    WHERE b.node <> b.dest AND c.dist + e.length_m = b.dist GROUP BY b.dest, b.node)
  SELECT p.dest, p.node, p.dist, coalesce(next_node, p.dest) AS next_node FROM p LEFT JOIN step s ON s.dest = p.dest AND s.node = p.node""")
def street_paths(spark, d):
    streets = view(spark, d, "streets")
    share = F.floor(F.lit(view(spark, d, "part").count()) / 25)
    goals = view(spark, d, "nation").select((F.col("n_nationkey") * share).cast("long").alias("node_id"))
    return routing.path_trees(streets, goals, "length_m")


# No way leads back into a block once it has left it, so ways within blocks tell components.
@query("""WITH RECURSIVE e AS (SELECT a.u, a.v FROM one_way_streets a JOIN (SELECT DISTINCT u, block FROM one_way_streets) b ON b.u = a.v WHERE a.block = b.block),
  r(a, b) AS (SELECT u, v FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
  s AS (SELECT x.a AS node, least(min(x.b), x.a) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
  SELECT n.node, coalesce(s.component, n.node) AS component FROM (SELECT u AS node FROM one_way_streets UNION SELECT v FROM one_way_streets) n LEFT JOIN s ON s.node = n.node""")
def street_components(spark, d):
    return graph.strong_components(view(spark, d, "one_way_streets"))


@query("""WITH n AS (SELECT node_id, x, y FROM nodes), r AS (SELECT l_orderkey % 100 AS node_id, count(*) AS c FROM lineitem GROUP BY 1)
  SELECT CAST(r.node_id AS BIGINT) AS node_id, c, x, y FROM r JOIN n ON n.node_id = r.node_id WHERE r.node_id > 0""")
def node_attributes(spark, d):
    rows = view(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 100).cast("long").alias("node_id")).agg(F.count("*").alias("c")).where("node_id > 0")
    return demand.with_node_attributes(rows, view(spark, d, "nodes")).select("node_id", "c", "x", "y")


# ------------------------------------------------------------------ scenarios and agents


def _heavy(edges):
    return edges.groupBy(F.col("v").alias("node_id")).agg(F.sum("base_capacity").alias("sum_weight"))


_CATALOG = """hit AS (SELECT row_number() OVER (ORDER BY base_capacity, u, v) AS place, u, v, road_class FROM shocked_edges),
  heavy AS (SELECT v AS node_id, sum(base_capacity) AS w FROM edges GROUP BY v)"""
_SHOCKED = f"""tiered AS (SELECT *, CASE WHEN base_capacity < 40 THEN NULL WHEN road_class IN ('trunk', 'trunk_link') THEN 0 WHEN road_class IN ('primary', 'primary_link') THEN 1
    WHEN road_class IN ('secondary', 'secondary_link') THEN 2 WHEN road_class IN ('motorway', 'motorway_link') THEN 3 END AS tier FROM edges),
  best AS (SELECT min(tier) AS best FROM (SELECT tier FROM tiered WHERE tier IS NOT NULL GROUP BY tier HAVING count(*) >= 4)),
  shocked_edges AS (SELECT u, v, road_class, base_capacity FROM tiered, best WHERE CASE WHEN best IS NOT NULL THEN tier = best ELSE road_class IN ({_MAJORS}) END ORDER BY base_capacity, u, v LIMIT 8)"""


@query(f"""WITH {_CLASSED}, {_SHOCKED}, {_CATALOG}
  SELECT 'capacity_drop' AS scenario, 'capacity_drop' AS kind, 20 AS tick_start, 60 AS tick_end, u, v, CAST(0.25 AS DOUBLE) AS capacity_factor, NULL AS node_id, CAST(NULL AS DOUBLE) AS multiplier FROM hit
  UNION ALL SELECT 'edge_closure', 'edge_closure', 20, 60, u, v, NULL, NULL, NULL FROM hit WHERE place <= 3
  UNION ALL SELECT 'hotspot_surge', 'hotspot_surge', 20, 60, NULL, NULL, NULL, (SELECT arg_min(node_id, (-w, node_id)) FROM heavy), 3.0""")
def scenario_catalog(spark, d):
    edges = _edges(spark, d)
    return scenarios.catalog(edges, _heavy(edges), 80)


@query(f"""WITH {_CLASSED}, {_SHOCKED}, {_CATALOG}, c AS (SELECT arg_min(road_class, place) AS c FROM hit)
  SELECT 'baseline' AS scenario, 'no shock' AS description, 0 AS event_count, 'capacities' AS edge_source
  UNION ALL SELECT 'capacity_drop', 'a quarter of the capacity on ' || c || ' edges in ticks 20 to 60', 1, 'capacities' FROM c
  UNION ALL SELECT 'edge_closure', upper(c[1]) || c[2:] || ' edges closed in ticks 20 to 60', 1, 'capacities' FROM c
  UNION ALL SELECT 'hotspot_surge', 'the strongest attractor three times as strong in ticks 20 to 60', 1, 'capacities'""")
def scenario_table(spark, d):
    return scenarios.table(_edges(spark, d), 80)


def _network(spark, d):
    """The edges of the strongly connected part, and the demand at its nodes."""
    edges = stored(_edges(spark, d), "edges")
    inner = graph.largest_scc(edges).select(F.col("node").alias("node_id"))
    ends = [inner.withColumnRenamed("node_id", n) for n in ("u", "v")]
    edges = stored(edges.join(ends[0], "u", "left_semi").join(ends[1], "v", "left_semi").select(*edges.columns), "network")
    return edges, stored(demand.within_nodes(_heavy(edges), inner), "heavy")


def _run(spark, d, c=simulation.Config()):
    edges, heavy = _network(spark, d)
    return edges, simulation.simulate(edges, heavy, demand.attractors(heavy, 30), view(spark, d, "scenario_events"), c)


@query()
def simulate(spark, d):
    return _run(spark, d, simulation.Config(n_ticks=120))[1].loads


@query()
def warmup_bottlenecks(spark, d):
    edges, heavy = _network(spark, d)
    return scenarios.warm_up_bottlenecks(edges, heavy, demand.attractors(heavy, 30), simulation.Config())


@query()
def simulation_metrics(spark, d):
    c = simulation.Config()
    edges, run = _run(spark, d, c)
    return simulation.metrics(run, edges, c)


@query()
def simulation_summary(spark, d):
    c = simulation.Config(n_ticks=40)
    edges, run = _run(spark, d, c)
    return simulation.summary(simulation.metrics(run, edges, c), "scenario events")


@query()
def agent_positions(spark, d):
    c = simulation.Config(n_ticks=40)
    return simulation.place(_run(spark, d, c)[1].positions, view(spark, d, "nodes"))


# ------------------------------------------------------------------ flows

_SPEED = "CASE profile_name WHEN 'commuter' THEN 28.0 WHEN 'errand' THEN 22.0 ELSE 18.0 END * 1000.0 / 60.0 * 6.0"
_EXPANDED = f"""ends AS (SELECT *, CAST(sum(length_m) OVER (PARTITION BY trip_id ORDER BY hop ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS b, CAST({_SPEED} AS DOUBLE) AS m FROM routes),
  expanded AS (SELECT trip_id, depart_tick + k.range AS tick, u, v FROM ends, range(CAST(0 AS BIGINT), CAST(200 AS BIGINT)) k
    WHERE k.range >= floor((b - length_m) / m) AND k.range <= greatest(ceil(b / m) - 1, floor((b - length_m) / m)))"""


@query(f"WITH {_EXPANDED} SELECT trip_id, CAST(tick AS BIGINT) AS tick, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM expanded")
def trip_expansion(spark, d):
    return flow.expand_trips(view(spark, d, "routes"))


@query(f"""WITH ends AS (SELECT *, CAST(sum(length_m) OVER (PARTITION BY trip_id ORDER BY hop ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS b, CAST({_SPEED} AS DOUBLE) AS m FROM routes)
  SELECT trip_id, depart_tick + k.range - 1 AS tick, u, v, round((k.range * m - b + length_m) / length_m, 6) AS share FROM ends, range(CAST(0 AS BIGINT), CAST(200 AS BIGINT)) k WHERE k.range * m > b - length_m AND k.range * m < b AND k.range > 0""")
def route_positions(spark, d):
    return _rounded(flow.route_positions(view(spark, d, "routes")), "share")


@query(f"WITH {_EXPANDED} SELECT CAST(tick AS BIGINT) AS tick, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, count(*) AS load FROM expanded GROUP BY tick, u, v")
def edge_history(spark, d):
    return flow.edge_loads(flow.expand_trips(view(spark, d, "routes")))


@query(f"""WITH {_CLASSED}, t AS (SELECT h.u, h.v, CAST(sum(load) AS BIGINT) AS total_load, any_value(road_class IN ({_MAJORS})) AS major FROM edge_history h JOIN edges e ON e.u = h.u AND e.v = h.v WHERE tick >= 100 GROUP BY h.u, h.v)
  SELECT u, v, total_load FROM t WHERE major OR (SELECT count(*) FROM t WHERE major) < 4 ORDER BY total_load DESC, u, v LIMIT 8""")
def bottleneck_edges(spark, d):
    return flow.bottlenecks(view(spark, d, "edge_history"), _edges(spark, d), 100)


_USED = """used AS (SELECT tick, h.u, h.v, load, load / greatest(base_capacity * 0.5 / 10.0, 0.1) AS utilization FROM edge_history h JOIN edges e ON e.u = h.u AND e.v = h.v),
  shocked AS (SELECT tick, h.u, h.v, load, load / greatest(base_capacity * 0.5 / 10.0, 0.1) AS utilization FROM shock_history h JOIN edges e ON e.u = h.u AND e.v = h.v)"""
_LAMBDA = "greatest(0, least(1, (0.06 + exp(-0.5 * pow((hour - 8.0) / 2.2, 2)) + 1.1 * exp(-0.5 * pow((hour - 18.0) / 2.6, 2))) / 1.16))"
_METRICS = f"""{_CLASSED}, {_USED}, done AS (SELECT trip_id, min(depart_tick) AS depart_tick, min(depart_tick) + CAST(ceil(sum(length_m) / min({_SPEED})) AS BIGINT) - 1 AS arrive_tick, sum(length_m) AS distance_m FROM routes GROUP BY trip_id),
  arrived AS (SELECT arrive_tick AS tick, count(*) AS arrivals, sum(arrive_tick - depart_tick) AS spent, sum(distance_m) AS metres FROM done GROUP BY 1),
  loads AS (SELECT tick, max(utilization) AS mx, avg(utilization) AS mn, count(*) FILTER (utilization > 1) AS over FROM used GROUP BY tick),
  joined AS (SELECT coalesce(a.tick, l.tick) AS tick, arrivals, spent, metres, mx, mn, over FROM arrived a FULL JOIN loads l ON a.tick = l.tick),
  metrics AS (SELECT tick, (tick * 6 / 60.0) % 24 AS hour, CAST(sum(coalesce(arrivals, 0)) OVER w AS BIGINT) AS completed_trips, sum(coalesce(spent, 0)) OVER w * 6.0 / nullif(sum(coalesce(arrivals, 0)) OVER w, 0) AS mean_trip_minutes,
    sum(coalesce(metres, 0)) OVER w / nullif(sum(coalesce(arrivals, 0)) OVER w, 0) AS mean_distance_m, coalesce(mx, 0) AS max_utilization, coalesce(mn, 0) AS mean_utilization, coalesce(over, 0) AS overloaded_edges
    FROM joined WINDOW w AS (ORDER BY tick ROWS UNBOUNDED PRECEDING))"""


def _metrics(spark, d):
    m = flow.metres_per_tick(F.col("profile_name"))
    trips = view(spark, d, "routes").groupBy("trip_id").agg(F.min("depart_tick").alias("depart_tick"), F.sum("length_m").alias("distance_m"), F.min(m).alias("m"))
    trips = trips.withColumn("arrive_tick", F.col("depart_tick") + F.ceil(F.col("distance_m") / F.col("m")).cast("long") - 1)
    return flow.tick_metrics(trips, flow.utilisation(view(spark, d, "edge_history"), _edges(spark, d)))


@query(f"""WITH {_METRICS} SELECT tick, round(CAST(hour AS DOUBLE), 6) AS hour, round(CAST({_LAMBDA} AS DOUBLE), 6) AS diurnal_lambda, completed_trips, round(mean_trip_minutes, 6) AS mean_trip_minutes, round(mean_distance_m, 6) AS mean_distance_m,
  round(max_utilization, 6) AS max_utilization, round(mean_utilization, 6) AS mean_utilization, CAST(overloaded_edges AS BIGINT) AS overloaded_edges FROM metrics""")
def tick_metrics(spark, d):
    return _rounded(_metrics(spark, d), "hour", "diurnal_lambda", "mean_trip_minutes", "mean_distance_m", "max_utilization", "mean_utilization")


@query(f"""WITH {_METRICS} SELECT count(*) AS n_ticks, arg_max(completed_trips, tick) AS completed_trips, round(arg_max(mean_trip_minutes, tick), 6) AS mean_trip_minutes,
  round(max(max_utilization), 6) AS peak_utilization, CAST(sum(overloaded_edges) AS BIGINT) AS overloaded_edge_ticks, arg_min(tick, (-max_utilization, tick)) AS peak_tick FROM metrics""")
def run_summary(spark, d):
    return flow.run_summary(_metrics(spark, d))


_AGENTS = f"""{_CLASSED}, {_USED}, walked AS (SELECT trip_id, min(depart_tick) AS depart_tick, min(depart_tick) + CAST(ceil(sum(length_m) / min({_SPEED})) AS BIGINT) AS at_tick, sum(length_m) AS distance_m FROM routes GROUP BY trip_id),
  went AS (SELECT t.agent_id, w.depart_tick, CASE WHEN w.trip_id % 17 <> 0 THEN at_tick END AS arrive_tick, distance_m FROM walked w JOIN trips t ON t.trip_id = w.trip_id),
  stays AS (SELECT arrive_tick, lead(depart_tick) OVER (PARTITION BY agent_id ORDER BY depart_tick, arrive_tick) AS leaves FROM went WHERE arrive_tick IS NOT NULL),
  t AS (SELECT CAST(range AS BIGINT) AS tick, (6.0 + range * 6 / 60.0) % 24 AS hour FROM range(260)),
  moving AS (SELECT tick, count(*) FILTER (depart_tick <= tick AND arrive_tick > tick) AS active, count(*) FILTER (arrive_tick <= tick) AS done, sum(arrive_tick - depart_tick) FILTER (arrive_tick <= tick) AS spent,
    sum(distance_m) FILTER (arrive_tick <= tick) AS metres, count(*) FILTER (depart_tick = tick) AS asked, count(*) FILTER (depart_tick = tick AND arrive_tick IS NULL) AS failed, count(DISTINCT agent_id) AS agents FROM t, went GROUP BY tick),
  staying AS (SELECT tick, count(*) FILTER (arrive_tick <= tick AND (leaves IS NULL OR leaves > tick)) AS dwell FROM t, stays GROUP BY tick),
  burden AS (SELECT tick, max(utilization) AS mx, avg(utilization) AS mn, count(*) FILTER (utilization > 1) AS over FROM used GROUP BY tick),
  agent AS (SELECT t.tick, hour, active, dwell, done, asked, failed, spent * 1.0 / nullif(done, 0) AS trip_time, coalesce(metres, 0) / agents AS metres, coalesce(mx, 0) AS mx, coalesce(mn, 0) AS mn, coalesce(over, 0) AS over
    FROM t JOIN moving m ON m.tick = t.tick JOIN staying s ON s.tick = t.tick LEFT JOIN burden b ON b.tick = t.tick)"""


def _agent_metrics(spark, d):
    m = flow.metres_per_tick(F.col("profile_name"))
    walked = view(spark, d, "routes").groupBy("trip_id").agg(F.min("depart_tick").alias("depart_tick"), F.sum("length_m").alias("distance_m"), F.min(m).alias("m"))
    at = F.col("depart_tick") + F.ceil(F.col("distance_m") / F.col("m")).cast("long")
    went = walked.join(view(spark, d, "trips").select("trip_id", "agent_id"), "trip_id").select("agent_id", "depart_tick", F.when(F.col("trip_id") % 17 != 0, at).alias("arrive_tick"), "distance_m")
    return flow.agent_metrics(went, flow.utilisation(view(spark, d, "edge_history"), _edges(spark, d)), 260)


@query(f"""WITH {_AGENTS} SELECT tick, round(CAST(hour AS DOUBLE), 6) AS hour, round(CAST({_LAMBDA} AS DOUBLE), 6) AS diurnal_lambda, active AS active_travelers, dwell AS dwellers, done AS completed_trips, asked AS route_queries, failed AS route_failures,
  round(trip_time, 6) AS mean_trip_time, round(metres, 6) AS mean_distance_m, round(mx, 6) AS max_utilization, round(mn, 6) AS mean_utilization, over AS overloaded_edges FROM agent""")
def agent_metrics(spark, d):
    return _rounded(_agent_metrics(spark, d), "hour", "diurnal_lambda", "mean_trip_time", "mean_distance_m", "max_utilization", "mean_utilization")


@query(f"""WITH {_AGENTS} SELECT 'trips' AS scenario, max(tick) AS ticks, arg_max(active, tick) AS final_active_travelers, arg_max(dwell, tick) AS final_dwellers, arg_max(done, tick) AS completed_trips, round(arg_max(trip_time, tick), 2) AS mean_trip_time_ticks,
  round(max(mx), 3) AS peak_max_utilization, max(over) AS peak_overloaded_edges, CAST(sum(asked) AS BIGINT) AS route_queries_total, CAST(sum(failed) AS BIGINT) AS route_failures_total FROM agent""")
def agent_summary(spark, d):
    return flow.agent_summary(_agent_metrics(spark, d), "trips")


@query(f"WITH t AS (SELECT range AS tick, (6.0 + range * 6 / 60.0) % 24 AS hour FROM range(300)) SELECT tick, round(CAST(hour AS DOUBLE), 6) AS hour, round(CAST({_LAMBDA} AS DOUBLE), 6) AS activity FROM t")
def diurnal_curve(spark, d):
    t = spark.range(300).select(F.col("id").alias("tick"), flow.hour_at(F.col("id")).alias("hour"))
    return t.select("tick", F.round("hour", 6).alias("hour"), F.round(flow.activity(F.col("hour")), 6).alias("activity"))


@query(f"WITH {_CLASSED}, {_USED} SELECT tick, u, v, load, round(utilization, 6) AS utilization FROM used")
def edge_utilization(spark, d):
    return _rounded(flow.utilisation(view(spark, d, "edge_history"), _edges(spark, d)), "utilization")


@query(f"WITH {_CLASSED}, l AS (SELECT u, v, load FROM edge_history WHERE tick = 120) SELECT e.u, e.v, road_class, coalesce(load, 0) AS load, round(coalesce(load, 0) / (greatest(base_capacity * 0.5, 0.1) / 10.0), 6) AS utilization FROM edges e LEFT JOIN l ON l.u = e.u AND l.v = e.v")
def edge_snapshot(spark, d):
    return _rounded(flow.edge_snapshot(_edges(spark, d), view(spark, d, "edge_history"), 120), "utilization")


@query("""WITH ticks AS (SELECT DISTINCT tick FROM edge_history WHERE tick % 7 = 0), asked AS (SELECT range AS want FROM range(250))
  SELECT want, arg_min(tick, abs(tick - want) * 100000 + tick) AS tick FROM asked, ticks GROUP BY want""")
def nearest_tick(spark, d):
    return flow.nearest_tick(spark.range(250).withColumnRenamed("id", "want"), view(spark, d, "edge_history").where("tick % 7 = 0").select("tick").distinct())


_SPELLS = """spells AS (SELECT CAST(l_orderkey % 1000 * 10 + l_linenumber AS BIGINT) AS tick_start, CAST(l_orderkey % 1000 * 10 + l_linenumber + CASE l_partkey % 50 WHEN 0 THEN 1000000000 ELSE l_suppkey % 37 END AS BIGINT) AS tick_end,
  CAST(l_linenumber AS BIGINT) AS n FROM lineitem)"""


@query(f"""WITH {_SPELLS}, asked AS (SELECT DISTINCT CAST(o_orderkey % 12000 AS BIGINT) AS tick FROM orders)
  SELECT tick, count(*) AS spells, CAST(sum(n) AS BIGINT) AS n FROM asked JOIN spells ON tick >= tick_start AND tick < tick_end GROUP BY tick""")
def active_spells(spark, d):
    """Intervals of 0 to 10**9 ticks, and the points in them."""
    lines = view(spark, d, "lineitem")
    begin = F.col("l_orderkey") % 1000 * 10 + F.col("l_linenumber")
    spells = lines.select(begin.cast("long").alias("tick_start"), (begin + F.when(F.col("l_partkey") % 50 == 0, 1_000_000_000).otherwise(F.col("l_suppkey") % 37)).cast("long").alias("tick_end"), F.col("l_linenumber").cast("long").alias("n"))
    asked = view(spark, d, "orders").select((F.col("o_orderkey") % 12000).cast("long").alias("tick")).distinct()
    return temporal.interval_join(asked, "tick", spells, "tick_start", "tick_end").groupBy("tick").agg(F.count("*").alias("spells"), F.sum("n").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id % 150 AS customer, event_id % 3000 * 8 AS place FROM events), o AS (SELECT o_custkey % 150 AS customer, o_orderkey FROM orders)
  SELECT event_id, max(o_orderkey) FILTER (o_orderkey <= place) AS last_order, min(o_orderkey) FILTER (o_orderkey >= place) AS next_order FROM e LEFT JOIN o ON o.customer = e.customer GROUP BY event_id""")
def order_as_of(spark, d):
    asked = view(spark, d, "events").select("event_id", (F.col("user_id") % 150).cast("long").alias("customer"), (F.col("event_id") % 3000 * 8).cast("long").alias("at"))
    held = view(spark, d, "orders").select((F.col("o_custkey") % 150).cast("long").alias("customer"), F.col("o_orderkey").cast("long").alias("o_orderkey"))
    last = temporal.as_of(asked, "at", held, "o_orderkey", ("customer",)).select("event_id", "customer", "at", F.col("found.o_orderkey").alias("last_order"))
    return temporal.as_of(last, "at", held, "o_orderkey", ("customer",), "forward").select("event_id", "last_order", F.col("found.o_orderkey").alias("next_order"))


@query(f"""WITH {_CLASSED}, {_USED}, p AS (SELECT b.tick, abs(max(b.utilization) - max(s.utilization)) AS gap FROM used b JOIN shocked s ON b.tick = s.tick GROUP BY b.tick),
  worst AS (SELECT arg_min(tick, (-gap, tick)) AS tick FROM p),
  m AS (SELECT coalesce(b.tick, s.tick) AS tick, coalesce(s.utilization, 0) - coalesce(b.utilization, 0) AS delta FROM used b FULL JOIN shocked s ON b.tick = s.tick AND b.u = s.u AND b.v = s.v)
  SELECT m.tick, round(sum(delta), 6) AS net, round(quantile_cont(CASE WHEN delta <> 0 THEN abs(delta) END, 0.97), 6) AS p97 FROM m JOIN worst ON m.tick = worst.tick GROUP BY m.tick""")
def flow_delta(spark, d):
    edges = _edges(spark, d)
    return _rounded(flow.delta_report(flow.utilisation(view(spark, d, "edge_history"), edges), flow.utilisation(view(spark, d, "shock_history"), edges)), "net", "p97")


@query(f"WITH {_CLASSED}, {_USED} SELECT u, v, round(sum(utilization) / 240, 6) AS mean_utilization FROM used GROUP BY u, v ORDER BY sum(utilization) DESC, u, v LIMIT 25")
def top_corridors(spark, d):
    return _rounded(flow.top_corridors(flow.utilisation(view(spark, d, "edge_history"), _edges(spark, d)), 240), "mean_utilization")


@query(f"WITH {_CLASSED}, {_USED} SELECT round(coalesce(quantile_cont(CASE WHEN utilization > 0 THEN utilization END, 0.95), 1.0), 6) AS vmax FROM used")
def vmax_p95(spark, d):
    return _rounded(flow.colour_limit(flow.utilisation(view(spark, d, "edge_history"), _edges(spark, d))), "vmax")


@query(f"WITH {_CLASSED}, {_USED}, peak AS (SELECT arg_min(tick, (-m, tick)) AS tick FROM (SELECT tick, max(utilization) AS m FROM used GROUP BY tick)) SELECT used.tick, u, v, round(utilization, 6) AS utilization FROM used JOIN peak ON peak.tick = used.tick")
def spatial_peak(spark, d):
    used = flow.utilisation(view(spark, d, "edge_history"), _edges(spark, d))
    return _rounded(report.spatial_peak(used, used.groupBy("tick").agg(F.max("utilization").alias("max_utilization"))), "utilization")


@query(f"""WITH {_CLASSED}, {_USED}, b AS (SELECT 'baseline' AS run, * FROM used UNION ALL SELECT 'scenario', * FROM shocked)
  SELECT run, tick, u, v, round(utilization, 6) AS utilization, run = 'scenario' AND tick >= 60 AND tick < 180 AS in_event FROM b WHERE tick IN (0, 48, 96, 143, 191, 239)""")
def flow_snapshots(spark, d):
    edges = _edges(spark, d)
    runs = [flow.utilisation(view(spark, d, n), edges) for n in ("edge_history", "shock_history")]
    return _rounded(report.marked_snapshots(*runs, 0, 239, 60, 180), "utilization")


@query(f"WITH {_CLASSED} SELECT u, v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v")
def edge_segments(spark, d):
    return report.edge_segments(_edges(spark, d), view(spark, d, "nodes"))


@query(f"WITH {_CLASSED}, {_USED}, p AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS place FROM edges WHERE road_class IN ({_MAJORS})) SELECT p.u, p.v, place, tick, round(utilization, 6) AS utilization FROM p JOIN used ON used.u = p.u AND used.v = p.v")
def utilisation_matrix(spark, d):
    edges = _edges(spark, d)
    return _rounded(report.utilisation_matrix(flow.utilisation(view(spark, d, "edge_history"), edges), edges, True), "utilization")


@query("""WITH t AS (SELECT range AS tick, (6.0 + range * 6 / 60.0) % 24 AS hour FROM range(240))
  SELECT tick, 'shock, tick ' || tick || ' of 240, ' || printf('%02d:%02d', CAST(floor(hour) AS INT), CAST(floor((hour - floor(hour)) * 60 + 1e-9) AS INT)) || CASE WHEN tick >= 60 AND tick < 180 THEN ' (event)' ELSE '' END AS caption, 'major' AS edge_scope, tick >= 60 AND tick < 180 AS in_event FROM t""")
def frame_captions(spark, d):
    return report.frame_captions(spark.range(240).withColumnRenamed("id", "tick"), 240, 60, 180, "shock")


@query(f"WITH {_CLASSED}, {_USED} SELECT coalesce(b.tick, -1) AS tick, round(max(b.utilization), 6) AS peak, round(max(s.utilization), 6) AS peak_scenario FROM (SELECT tick, max(utilization) AS utilization FROM used GROUP BY tick) b JOIN (SELECT tick, max(utilization) AS utilization FROM shocked GROUP BY tick) s ON s.tick = b.tick GROUP BY b.tick")
def compared_metrics(spark, d):
    edges = _edges(spark, d)
    peaks = [flow.utilisation(view(spark, d, n), edges).groupBy("tick").agg(F.max("utilization").alias("peak")) for n in ("edge_history", "shock_history")]
    return _rounded(scenarios.compared(*peaks), "peak", "peak_scenario")


_TENSOR = f"""{_CLASSED}, placed AS (SELECT e.u, e.v, base_capacity * 0.5 / 10.0 AS capacity, floor((a.y + b.y) / 2 / 1500) AS r, floor((a.x + b.x) / 2 / 1500) AS c FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v),
  cells AS (SELECT u, v, CAST(r * 6 + c AS BIGINT) AS cell, capacity FROM placed WHERE r BETWEEN 0 AND 5 AND c BETWEEN 0 AND 5),
  room AS (SELECT cell, greatest(sum(capacity), 0.1) AS room FROM cells GROUP BY cell),
  vol AS (SELECT tick, cell, CAST(sum(load) AS BIGINT) AS volume FROM edge_history h JOIN cells c ON c.u = h.u AND c.v = h.v GROUP BY tick, cell),
  tensor AS (SELECT tick, vol.cell, volume, volume / room AS utilization FROM vol JOIN room ON room.cell = vol.cell),
  frames AS (SELECT t.tick AS frame, c.cell, CAST(coalesce(x.volume, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT tick FROM tensor) t CROSS JOIN (SELECT DISTINCT cell FROM tensor) c LEFT JOIN tensor x ON x.tick = t.tick AND x.cell = c.cell)"""


def _tensor(spark, d):
    cells = flow.edge_cells(_edges(spark, d), view(spark, d, "nodes"), 1500.0, 6, 6)
    return flow.traffic_tensor(view(spark, d, "edge_history"), cells)


def _frames(spark, d):
    return forecast.dense(_tensor(spark, d).withColumnRenamed("tick", "frame"), "volume")


@query(f"WITH {_TENSOR} SELECT tick, cell, volume, round(utilization, 6) AS utilization FROM tensor")
def traffic_tensor(spark, d):
    return _rounded(_tensor(spark, d), "utilization")


@query(f"""WITH {_TENSOR}, m AS (SELECT max(volume) AS a, max(utilization) AS b FROM tensor)
  SELECT tick, cell, round(volume / CASE WHEN a <= 1e-6 THEN 1.0 ELSE a END, 6) AS volume, round(utilization / CASE WHEN b <= 1e-6 THEN 1.0 ELSE b END, 6) AS utilization FROM tensor, m""")
def channel_scale(spark, d):
    return _rounded(flow.channel_scaled(_tensor(spark, d), ["volume", "utilization"]), "volume", "utilization")


@query(f"""WITH {_TENSOR}, w AS (SELECT cell, frame, list(value) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS h, list(value) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS t FROM frames)
  SELECT cell, frame, array_to_string(list_transform(h, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS history, array_to_string(list_transform(t, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS targets FROM w WHERE len(h) = 4 AND len(t) = 2""")
def sliding_windows(spark, d):
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",").alias(c)
    return forecast.sliding_windows(_frames(spark, d), 4, 2).select("cell", "frame", text_of("history"), text_of("targets"))


@query(f"WITH {_TENSOR}, p AS (SELECT value, lag(value, 1) OVER (PARTITION BY cell ORDER BY frame) AS q FROM frames) SELECT count(*) AS n, round(avg(abs(q - value)), 6) AS mae, round(sqrt(avg(pow(q - value, 2))), 6) AS rmse FROM p WHERE q IS NOT NULL")
def persistence(spark, d):
    return _rounded(forecast.errors(forecast.persistence(_frames(spark, d))), "mae", "rmse")


@query(f"""WITH {_TENSOR}, p AS (SELECT frame, cell, value, lag(value, 1) OVER (PARTITION BY cell ORDER BY frame) AS q FROM frames),
  r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY value DESC, cell) AS rt, row_number() OVER (PARTITION BY frame ORDER BY q DESC, cell) AS rp FROM p WHERE q IS NOT NULL),
  f AS (SELECT frame, max(value) AS peak, count(*) FILTER (rt <= 3 AND rp <= 3) / 3.0 AS hit FROM r GROUP BY frame) SELECT count(*) AS frames, round(avg(hit), 6) AS hit_rate FROM f WHERE peak > 0""")
def hit_rate(spark, d):
    return _rounded(forecast.hit_rate(forecast.persistence(_frames(spark, d)), 3), "hit_rate")


@query(f"""WITH {_TENSOR}, r AS (SELECT frame, row_number() OVER (ORDER BY frame) AS r, count(*) OVER () AS t FROM (SELECT DISTINCT frame FROM frames))
  SELECT frame, CASE WHEN r > t - greatest(1, floor(t * 0.15)) THEN 'test' WHEN r > t - greatest(1, floor(t * 0.15)) - greatest(1, floor(t * 0.15)) THEN 'validate' ELSE 'train' END AS part FROM r""")
def chrono_split(spark, d):
    return forecast.chronological_split(_frames(spark, d))


@query()
def forecast_regression(spark, d):
    return _rounded(forecast.regression(_frames(spark, d)), "predicted")


@query()
def forecast_halo(spark, d):
    frames = _frames(spark, d).select("frame", F.floor(F.col("cell") / 6).alias("row_i"), (F.col("cell") % 6).alias("col_i"), "value")
    return _rounded(forecast.halo_regression(frames, 6, 6), "predicted")


@query()
def forecast_recurrent(spark, d):
    made = recurrent.windows(_frames(spark, d), 6, 6, 12, 3)
    model, _ = recurrent.train(made, recurrent.Model(6, 6, hidden=8), epochs=3)
    tail = made.join(forecast.chronological_split(made), "frame").where("part = 'test'").select("frame", "seen", "ahead")
    return recurrent.predict(tail, model)


# ------------------------------------------------------------------ map tiles, strings, streams


@query(f"""WITH b AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST((c_custkey * 7919) % 30000000 - 15000000 AS DOUBLE) AS minx, CAST((c_custkey * 104729) % 30000000 - 15000000 AS DOUBLE) AS miny, c_custkey % 9 AS zoom, 1 + c_custkey % 70000 AS w, 1 + (c_custkey * 3) % 50000 AS h FROM customer),
  s AS (SELECT *, 2 * 20037508.342789244 / pow(2, zoom) AS span, pow(2, zoom) - 1 AS top FROM b),
  t AS (SELECT *, greatest(0, least(top, floor((minx + 20037508.342789244) / span))) AS x0, greatest(0, least(top, floor((minx + w + 20037508.342789244) / span))) AS x1,
    greatest(0, least(top, floor((20037508.342789244 - miny - h) / span))) AS y0, greatest(0, least(top, floor((20037508.342789244 - miny) / span))) AS y1 FROM s)
  SELECT id, CAST((x1 - x0 + 1) * 256 AS BIGINT) AS width_px, CAST((y1 - y0 + 1) * 256 AS BIGINT) AS height_px, round(-20037508.342789244 + x0 * span, 4) AS "left", round(20037508.342789244 - y0 * span, 4) AS top,
    CASE WHEN w >= h THEN 1600 ELSE greatest(1, CAST(round_even(1600.0 * w / h, 0) AS BIGINT)) END AS out_width, CASE WHEN w >= h THEN greatest(1, CAST(round_even(1600.0 * h / w, 0) AS BIGINT)) ELSE 1600 END AS out_height FROM t""")
def mosaic_layout(spark, d):
    k = F.col("c_custkey").cast("long")
    b = view(spark, d, "customer").select(k.alias("id"), ((k * 7919) % 30000000 - 15000000).cast("double").alias("minx"), ((k * 104729) % 30000000 - 15000000).cast("double").alias("miny"), (k % 9).alias("zoom"), (1 + k % 70000).alias("w"), (1 + (k * 3) % 50000).alias("h"))
    maxx, maxy = F.col("minx") + F.col("w"), F.col("miny") + F.col("h")
    size = basemap.warped_size(F.col("minx"), F.col("miny"), maxx, maxy, 1600)
    tiles = b.select("id", "zoom", *[c.alias(n) for c, n in zip(basemap.tile_range(F.col("minx"), F.col("miny"), maxx, maxy, F.col("zoom")), ("x_min", "x_max", "y_min", "y_max"))], size[0].alias("out_width"), size[1].alias("out_height"))
    return _rounded(basemap.mosaic_layout(tiles).select("id", "width_px", "height_px", "left", "top", "out_width", "out_height"), "left", "top", digits=4)


@query("""SELECT row_i, col_i, round(500.0 + col_i * 10.0, 6) AS x1, round(900.0 - (row_i + 1) * 10.0, 6) AS y1, round(500.0 + (col_i + 1) * 10.0, 6) AS x2, round(900.0 - row_i * 10.0, 6) AS y2,
  round((sqrt(50) * (507.5 + col_i * 10.0) + 10.0 * (510.0 + col_i * 10.0)) / (sqrt(50) + 10.0), 4) AS centre_x FROM grid_a""")
def cell_rings(spark, d):
    t = (10.0, 0.0, 500.0, 0.0, -10.0, 900.0)
    ring = geo.cell_ring(F.col("row_i"), F.col("col_i"), t)
    x, y = geo.cell_centre(F.col("row_i"), F.col("col_i"), t)
    low, high = F.get(ring, F.lit(0)), F.get(ring, F.lit(2))
    line = F.concat(geo.line_between(x, y, x, y), F.array(F.struct((x + 5).alias("x"), (y + 5).alias("y")), F.struct((x + 5).alias("x"), (y - 5).alias("y"))))
    return _rounded(view(spark, d, "grid_a").select("row_i", "col_i", low["x"].alias("x1"), low["y"].alias("y1"), high["x"].alias("x2"), high["y"].alias("y2"), F.round(geo.line_centroid(line)["x"], 4).alias("centre_x")), "x1", "y1", "x2", "y2")


@query("SELECT CAST(page_id AS BIGINT) AS page_id, lower(replace(url, '.', '_')) AS folder FROM pages")
def provider_folder(spark, d):
    return view(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), basemap.provider_folder(F.col("url")).alias("folder"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(2, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '_' || coalesce(nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'roi') AS name FROM customer")
def output_name(spark, d):
    return view(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), text.output_name(F.col("c_custkey"), F.col("c_name")).alias("name"))

_LONLAT = "SELECT c_custkey AS id, CAST((c_custkey * 7919) % 72000 AS DOUBLE) / 100 - 360 AS lon, CAST((c_custkey * 104729) % 18000 AS DOUBLE) / 100 - 90 AS lat, c_custkey % 15 AS zoom FROM customer"


def _lonlat(spark, d):
    k = F.col("c_custkey")
    return view(spark, d, "customer").select(k.alias("id"), (((k * 7919) % 72000).cast("double") / 100 - 360).alias("lon"), (((k * 104729) % 18000).cast("double") / 100 - 90).alias("lat"), (k % 15).alias("zoom"))


_X = "CAST(floor(((((lon + 180) % 360) + 360) % 360 - 180 + 180) / 360 * pow(2, zoom)) AS BIGINT)"
_Y = "CAST(floor((1 - asinh(tan(radians(greatest(least(lat, 85.05112878), -85.05112878)))) / pi()) / 2 * pow(2, zoom)) AS BIGINT)"


@query(f"WITH p AS ({_LONLAT}) SELECT CAST(id AS BIGINT) AS id, {_X} AS x, {_Y} AS y FROM p")
def tile_index(spark, d):
    return _lonlat(spark, d).select(F.col("id").cast("long").alias("id"), geo.tile_x(F.col("lon"), F.col("zoom")).alias("x"), geo.tile_y(F.col("lat"), F.col("zoom")).alias("y"))


@query(f"""WITH p AS ({_LONLAT}), t AS (SELECT id, zoom, {_X} AS x, {_Y} AS y, 2 * 20037508.342789244 / pow(2, zoom) AS span FROM p)
  SELECT CAST(id AS BIGINT) AS id, round(-20037508.342789244 + x * span, 4) AS "left", round(20037508.342789244 - (y + 1) * span, 4) AS bottom, round(-20037508.342789244 + (x + 1) * span, 4) AS "right", round(20037508.342789244 - y * span, 4) AS top FROM t""")
def tile_bounds(spark, d):
    p = _lonlat(spark, d)
    b = geo.tile_bounds(geo.tile_x(F.col("lon"), F.col("zoom")), geo.tile_y(F.col("lat"), F.col("zoom")), F.col("zoom"))
    return p.select(F.col("id").cast("long").alias("id"), *[F.round(x, 4).alias(n) for x, n in zip(b, ("left", "bottom", "right", "top"))])


@query("""WITH b AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 500 AS DOUBLE) AS w, CAST(c_custkey * 53 % 90000 AS DOUBLE) AS h FROM customer)
  SELECT CAST(id AS BIGINT) AS id, CAST(greatest(0, least(19, floor(log2(2 * 20037508.342789244 / 256 / (greatest(w, h, 1.0) / 1600))))) AS BIGINT) AS zoom FROM b""")
def choose_zoom(spark, d):
    k = F.col("c_custkey")
    zoom = geo.choose_zoom(F.lit(0.0), F.lit(0.0), (k * 37 % 500).cast("double"), (k * 53 % 90000).cast("double"), 1600, 19)
    return view(spark, d, "customer").select(k.cast("long").alias("id"), zoom.alias("zoom"))


@query(f"""WITH p AS ({_LONLAT}), z AS (SELECT id, lon % 180 AS lon, lat / 2 AS lat, CAST(range AS BIGINT) AS zoom FROM p, range(13)),
  t AS (SELECT id, zoom, ({_X.replace("lon", "(lon + 0.4)")} - {_X} + 1) * ({_Y} - {_Y.replace("lat", "(lat + 0.3)").replace("f(lat + 0.3)", "lat")} + 1) AS tiles FROM z)
  SELECT CAST(id AS BIGINT) AS id, max(zoom) AS zoom, arg_max(tiles, zoom) AS tiles FROM t WHERE tiles BETWEEN 1 AND 64 GROUP BY id""")
def tile_range(spark, d):
    p = _lonlat(spark, d).select("id", (F.col("lon") % 180).alias("lon"), (F.col("lat") / 2).alias("lat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("zoom"))
    z = F.col("zoom")
    wide = geo.tile_x(F.col("lon") + 0.4, z) - geo.tile_x(F.col("lon"), z) + 1
    high = geo.tile_y(F.col("lat"), z) - geo.tile_y(F.col("lat") + 0.3, z) + 1
    fits = p.withColumn("tiles", wide * high).where("tiles BETWEEN 1 AND 64")
    return fits.groupBy(F.col("id").cast("long").alias("id")).agg(F.max("zoom").alias("zoom"), F.max_by("tiles", "zoom").alias("tiles"))


@query("""SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'roi') AS slug FROM pages""")
def slugify(spark, d):
    return view(spark, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), text.slugify(F.col("url")).alias("slug"))


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(regexp_replace(regexp_replace(text, '^﻿+', ''), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')) AS cleaned_md5 FROM documents""")
def clean_text(spark, d):
    return view(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(text.clean_text(F.col("text")), "UTF-8")).alias("cleaned_md5"))


@query("""SELECT CAST(floor(epoch(ts) / 360) AS BIGINT) AS tick, CAST(user_id % 5 AS BIGINT) AS u, count(*) AS load FROM events GROUP BY 1, 2""")
def streaming_ticks(spark, d):
    return streaming.replayed_ticks(spark, f"{d.rstrip('/')}/events.parquet", (F.col("user_id") % 5).cast("long"))


@query("""WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
  SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS ended, count(*) AS events, round(sum(value), 3) AS total FROM s GROUP BY user_id, n""")
def streaming_sessions(spark, d):
    found = sessions.replayed(spark, f"{d.rstrip('/')}/events.parquet", lambda e: sessions.dwell_sessions(e, ["user_id"], "6 hours", "value"))
    return found.select("user_id", F.unix_timestamp("started").alias("started"), F.unix_timestamp("ended").alias("ended"), "events", F.round("total", 3).alias("total"))


@query("""SELECT CAST(floor(epoch(ts) / 600) - k AS BIGINT) AS tick, event_type, count(*) AS load FROM events, (VALUES (0), (1), (2)) AS v(k) GROUP BY 1, 2""")
def streaming_sliding_loads(spark, d):
    found = sessions.replayed(spark, f"{d.rstrip('/')}/events.parquet", lambda e: sessions.sliding_loads(e, ["event_type"]))
    return found.select(F.floor(F.unix_timestamp("started") / 600).cast("long").alias("tick"), "event_type", "load")
