"""Views of the star-schema tables with the shapes of rasters, roads and trips.

Each view is a select that Spark and DuckDB both run; ``sql(*names, body)`` joins the
views that a query needs into one WITH statement for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "grid_a": """SELECT CAST(l_partkey % 64 AS BIGINT) AS row_i, CAST(l_suppkey % 64 AS BIGINT) AS col_i,
        CAST(sum(l_quantity) AS DOUBLE) AS value
        FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_partkey % 64, l_suppkey % 64""",
    "grid_b": """SELECT CAST(o_custkey % 64 AS BIGINT) AS row_i, CAST(o_orderkey % 64 AS BIGINT) AS col_i,
        CAST(count(*) AS DOUBLE) AS value
        FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey % 64, o_orderkey % 64""",
    "roi": """SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name,
        CAST((n_nationkey % 5) * 12 AS BIGINT) AS row_min, CAST((n_nationkey % 5) * 12 + 15 AS BIGINT) AS row_max,
        CAST(n_regionkey * 12 AS BIGINT) AS col_min, CAST(n_regionkey * 12 + 15 AS BIGINT) AS col_max FROM nation""",
    "roi_vertices": """SELECT city_id, city_name, CAST(p.seq AS BIGINT) AS seq,
        CAST(col_min + 8.3 AS DOUBLE) + p.dx * (1 + city_id % 3 * 0.25) AS x, CAST(row_min + 7.6 AS DOUBLE) + p.dy * (1 + city_id % 3 * 0.25) AS y
        FROM roi CROSS JOIN (SELECT * FROM (VALUES (0, CAST(0.0 AS DOUBLE), CAST(-7.0 AS DOUBLE)), (1, CAST(7.5 AS DOUBLE), CAST(-2.0 AS DOUBLE)),
        (2, CAST(1.5 AS DOUBLE), CAST(1.0 AS DOUBLE)), (3, CAST(5.5 AS DOUBLE), CAST(7.0 AS DOUBLE)), (4, CAST(-6.0 AS DOUBLE), CAST(6.0 AS DOUBLE))) AS v(seq, dx, dy)) AS p""",
    "roi_rings": """SELECT city_id, city_name, CAST(0 AS BIGINT) AS ring, seq, x, y, CAST(5 AS BIGINT) AS sides FROM roi_vertices
        UNION ALL SELECT city_id, city_name, CAST(1 AS BIGINT), CAST(p.seq AS BIGINT), CAST(col_min + 8.1 AS DOUBLE) + p.dx, CAST(row_min + 8.4 AS DOUBLE) + p.dy, CAST(3 AS BIGINT)
        FROM roi CROSS JOIN (SELECT * FROM (VALUES (0, CAST(-1.0 AS DOUBLE), CAST(-1.5 AS DOUBLE)), (1, CAST(1.4 AS DOUBLE), CAST(-0.5 AS DOUBLE)), (2, CAST(-0.5 AS DOUBLE), CAST(2.0 AS DOUBLE))) AS v(seq, dx, dy)) AS p
        UNION ALL SELECT city_id, city_name, CAST(2 AS BIGINT), CAST(p.seq AS BIGINT), CAST(col_min + 25.5 AS DOUBLE) + p.dx, CAST(row_min + 3.5 AS DOUBLE) + p.dy, CAST(4 AS BIGINT)
        FROM roi CROSS JOIN (SELECT * FROM (VALUES (0, CAST(-2.0 AS DOUBLE), CAST(0.0 AS DOUBLE)), (1, CAST(0.0 AS DOUBLE), CAST(-3.0 AS DOUBLE)), (2, CAST(2.0 AS DOUBLE), CAST(0.0 AS DOUBLE)), (3, CAST(0.0 AS DOUBLE), CAST(3.0 AS DOUBLE))) AS v(seq, dx, dy)) AS p""",
    "mask_b": """SELECT row_i, col_i, CAST(CASE WHEN (row_i * 7 + col_i) % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM grid_b""",
    "nodes": """SELECT CAST(k AS BIGINT) AS node_id,
        CAST((k % w) * 1000 + (k * 37) % 211 AS DOUBLE) AS x, CAST(floor(k / w) * 1000 + (k * 53) % 197 AS DOUBLE) AS y
        FROM (SELECT p_partkey AS k, (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM part) AS w FROM part) AS p""",
    "streets": """SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, w, CAST(50 + (u * 31 + v * 17) % 350 AS DOUBLE) AS length_m FROM (
        SELECT w, n, CASE way WHEN 1 THEN k WHEN 2 THEN k + 1 WHEN 3 THEN k ELSE k + w END AS u, CASE way WHEN 1 THEN k + 1 WHEN 2 THEN k WHEN 3 THEN k + w ELSE k END AS v
        FROM (SELECT p_partkey AS k, (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM part) AS w, (SELECT count(*) FROM part) AS n FROM part) AS p
        CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4)) AS t(way)) AS t
        WHERE (way > 2 OR k % w <> w - 1) AND NOT (way = 2 AND (k * k) % 11 = 3) AND NOT (way = 1 AND (k * k) % 13 = 4) AND NOT (way = 4 AND (k * k) % 17 = 2)) AS s
        WHERE u < n AND v < n""",
    "one_way_streets": """SELECT u, v, CAST(floor(floor(u / w) / 10) * w + floor((u % w) / 10) AS BIGINT) AS block FROM streets
        WHERE (u * 13 + v * 29) % 4 <> 0 AND (u < v OR (floor(floor(u / w) / 10) = floor(floor(v / w) / 10) AND floor((u % w) / 10) = floor((v % w) / 10)))""",
    "edges_raw": """SELECT CAST(l_suppkey % 100 AS BIGINT) AS u, CAST(l_partkey % 100 AS BIGINT) AS v,
        CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS edge_key,
        CAST(100 + (l_partkey * 31 + l_suppkey * 17 + l_orderkey * 7) % 900 AS DOUBLE) AS length_m,
        CASE l_orderkey % 7 WHEN 0 THEN 'Motorway' WHEN 1 THEN '[''primary'', ''Trunk'']'
             WHEN 2 THEN ' secondary_link ' WHEN 3 THEN 'RESIDENTIAL' WHEN 4 THEN 'Busway; trunk' WHEN 5 THEN 'NaN' ELSE NULL END AS highway,
        CASE l_orderkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '[''2'', ''3'']' WHEN 2 THEN '1;4' ELSE NULL END AS lanes
        FROM lineitem WHERE l_suppkey % 100 <> l_partkey % 100""",
    "trips": """SELECT CAST(event_id AS BIGINT) AS trip_id, CAST(user_id AS BIGINT) AS agent_id,
        CAST(floor((hour(ts) * 60 + minute(ts)) / 6) AS BIGINT) AS depart_tick,
        CAST(user_id % 100 AS BIGINT) AS origin, CAST((event_id * 13 + 7) % 100 AS BIGINT) AS destination,
        CASE WHEN event_id % 20 < 11 THEN 'commuter' WHEN event_id % 20 < 17 THEN 'errand' ELSE 'explorer' END AS profile_name
        FROM events""",
    "edge_history": """SELECT CAST(floor((hour(ts) * 60 + minute(ts)) / 6) AS BIGINT) AS tick,
        CAST(user_id % 5 AS BIGINT) AS u, CAST(10 + event_id % 5 AS BIGINT) AS v, CAST(count(*) AS BIGINT) AS load
        FROM events GROUP BY floor((hour(ts) * 60 + minute(ts)) / 6), user_id % 5, 10 + event_id % 5""",
    "shock_history": """SELECT tick, u, v, CAST(load + (tick + u * 3 + v) % 4 AS BIGINT) AS load FROM edge_history WHERE (tick + u + v) % 5 <> 0""",
    "scenario_events": """SELECT * FROM (VALUES
        ('capacity_drop', CAST(60 AS BIGINT), CAST(180 AS BIGINT), CAST(1 AS BIGINT), CAST(20 AS BIGINT), CAST(0.25 AS DOUBLE)),
        ('capacity_drop', CAST(100 AS BIGINT), CAST(140 AS BIGINT), CAST(1 AS BIGINT), CAST(20 AS BIGINT), CAST(0.5 AS DOUBLE)),
        ('edge_closure', CAST(60 AS BIGINT), CAST(180 AS BIGINT), CAST(2 AS BIGINT), CAST(33 AS BIGINT), CAST(NULL AS DOUBLE)))
        AS e(kind, tick_start, tick_end, u, v, capacity_factor)""",
    "routes": """SELECT trip_id, depart_tick, h.hop AS hop,
        CASE WHEN h.hop = 0 THEN origin ELSE (origin + destination + h.hop) % 100 END AS u,
        CASE WHEN h.hop = 2 THEN destination ELSE (origin + destination + h.hop + 1) % 100 END AS v,
        CAST(200 + (trip_id * 37 + h.hop * 411) % 3000 AS BIGINT) AS length_m, profile_name
        FROM trips CROSS JOIN (SELECT CAST(0 AS BIGINT) AS hop UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) AS h""",
    "centres": """SELECT CAST(c_custkey AS BIGINT) AS cluster_id,
        CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 9973 AS DOUBLE) AS y,
        CAST(1 + c_custkey % 7 AS BIGINT) AS pixel_count, CAST(1 + (c_custkey * 13) % 50 AS DOUBLE) AS weight, CAST((c_custkey * 29) % 64 AS DOUBLE) / 64 AS mean_local_score
        FROM customer""",
}


def _named(text: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", text)]


def _ordered(text: str, found: list[str]) -> list[str]:
    for name in _named(text):
        if name not in found:
            _ordered(VIEWS[name], found)
            found.append(name)
    return found


def sql(body: str) -> str:
    """A DuckDB statement: body, with the views that it names as a WITH list."""
    names = _ordered(body, [])
    ctes = [f"{n} AS ({VIEWS[n]})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[5:]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or a table of sf_dir; no names are registered in the session."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    text = VIEWS[name]
    used = {n: view(spark, sf_dir, n) for n in [*VIEWS, *_TABLES] if n != name and re.search(rf"\b{n}\b(?=[\s)]|$)", text) and re.search(rf"(FROM|JOIN) {n}\b", text)}
    for n in used:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}} AS {n}", text)
    return spark.sql(text, **used) if used else spark.sql(text)
