"""Regions of interest: city matching, clipping, buffers and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions import geo
from cityloom.operators.raster import valid


def requested_cities(lines: DataFrame, value: str = "value") -> DataFrame:
    """ord, requested_name of a text of one name a line; blanks go, duplicates are an error."""
    from cityloom.functions.text import clean_text

    rows = lines.select(F.posexplode(F.split(value, "\r?\n")).alias("line", "requested_name")).select("line", clean_text(F.col("requested_name")).alias("requested_name")).where("requested_name <> ''")
    twice = rows.groupBy("requested_name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} is asked for twice")
    if not rows.limit(1).count():
        raise ValueError("no city is asked for")
    return rows.select(F.row_number().over(Window.orderBy("line")).alias("ord"), "requested_name")


def match_cities(asked: DataFrame, polygons: DataFrame, name: str = "city_name") -> DataFrame:
    """asked (requested_name) with the number of polygons of that name and the least id."""
    found = polygons.groupBy(F.col(name).alias("requested_name")).agg(F.count("*").alias("matches"), F.min("city_id").alias("city_id"))
    status = F.when(F.coalesce("matches", F.lit(0)) == 0, "unresolved").when(F.col("matches") > 1, "ambiguous").otherwise("matched")
    return asked.join(found, "requested_name", "left").select("requested_name", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), "city_id", status.alias("status"))


def resolved(matches: DataFrame) -> DataFrame:
    """matches if all are unique, else an error that names some of the others."""
    bad = matches.where("status <> 'matched'").limit(20).collect()
    if bad:
        raise ValueError("not matched exactly once: " + ", ".join(r.requested_name for r in bad))
    return matches


def inside_box(row: str = "row_i", col: str = "col_i") -> Column:
    return F.col(row).between(F.col("row_min"), F.col("row_max")) & F.col(col).between(F.col("col_min"), F.col("col_max"))


def _tiled_cells(cells: DataFrame, tile: int) -> DataFrame:
    return cells.withColumn("_tr", F.floor(F.col("row_i") / tile)).withColumn("_tc", F.floor(F.col("col_i") / tile))


def _tiled_boxes(boxes: DataFrame, tile: int, margin: float = 0.0) -> DataFrame:
    """boxes once for each tile that they, widened by margin, touch."""
    low = lambda c: F.floor((F.col(c) - margin) / tile)
    high = lambda c: F.floor((F.col(c) + margin) / tile)
    return boxes.withColumn("_tr", F.explode(F.sequence(low("row_min"), high("row_max")))).withColumn("_tc", F.explode(F.sequence(low("col_min"), high("col_max"))))


def clip_boxes(cells: DataFrame, boxes: DataFrame, tile: int = 16) -> DataFrame:
    """Cells in each box: an equi join on tiles, then the exact test."""
    return _tiled_cells(cells, tile).join(_tiled_boxes(boxes, tile), ["_tr", "_tc"]).where(inside_box()).drop("_tr", "_tc")


def box_distance(row: str = "row_i", col: str = "col_i") -> Column:
    dr = F.greatest(F.col("row_min") - F.col(row), F.col(row) - F.col("row_max"), F.lit(0))
    dc = F.greatest(F.col("col_min") - F.col(col), F.col(col) - F.col("col_max"), F.lit(0))
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def clip_buffered(cells: DataFrame, boxes: DataFrame, distance: float, tile: int = 16) -> DataFrame:
    """Cells within distance of each box."""
    joined = _tiled_cells(cells, tile).join(_tiled_boxes(boxes, tile, distance), ["_tr", "_tc"])
    return joined.withColumn("distance", box_distance()).where(F.col("distance") <= distance).drop("_tr", "_tc")


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule for a ring (array of structs x, y; closed or not)."""
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))
    crossed = F.filter(sides, lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]))
    return F.size(crossed) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def polygons_of(vertices: DataFrame) -> DataFrame:
    """city_id, city_name, ring (array of x, y) of a table of vertices (seq, x, y) in order."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return vertices.groupBy("city_id", "city_name").agg(ring.alias("ring"))


def multipolygons_of(vertices: DataFrame) -> DataFrame:
    """city_id, city_name, rings of a table of vertices (ring, seq, x, y): parts and holes alike."""
    point = F.struct("seq", "x", "y")
    rings = vertices.groupBy("city_id", "city_name", "ring").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return rings.groupBy("city_id", "city_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))


def ring_bounds(ring: Column) -> list[Column]:
    """minx, miny, maxx, maxy of a ring."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)]


def total_bounds(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """One row minx, miny, maxx, maxy, area_km2 of all rings."""
    minx, miny, maxx, maxy = ring_bounds(F.col(ring))
    return polygons.agg(F.min(minx).alias("minx"), F.min(miny).alias("miny"), F.max(maxx).alias("maxx"), F.max(maxy).alias("maxy"), (F.sum(ring_area(F.col(ring))) / 1e6).alias("area_km2"))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to the nearest side of a ring."""
    n = F.size(ring)

    def far(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return F.sqrt(F.pow(x - a["x"] - t * dx, F.lit(2.0)) + F.pow(y - a["y"] - t * dy, F.lit(2.0)))

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), far))


def _rings(polygons: DataFrame) -> Column:
    """All rings of a polygon or multi-polygon: its column rings, or else ring alone."""
    return F.col("rings") if "rings" in polygons.columns else F.array("ring")


def _window(rings: Column, transform: tuple[float, ...], distance: float) -> list[Column]:
    """row_min, row_max, col_min, col_max of the cells that the widened rings' bounds touch."""
    minx, miny, maxx, maxy = ring_bounds(F.flatten(rings))
    r1, c1 = geo.cell_of(minx - distance, maxy + distance, transform)
    r2, c2 = geo.cell_of(maxx + distance, miny - distance, transform)
    return [F.least(r1, r2), F.greatest(r1, r2), F.least(c1, c2), F.greatest(c1, c2)]


def windows(polygons: DataFrame, transform: tuple[float, ...], distance: float = 0.0) -> DataFrame:
    """polygons with row_min, row_max, col_min, col_max."""
    return polygons.withColumns(dict(zip(("row_min", "row_max", "col_min", "col_max"), _window(_rings(polygons), transform, distance))))


def _covers(rings: Column, transform: tuple[float, ...], distance: float) -> Column:
    """Whether a cell's centre is inside by the even-odd rule over all rings, or near a side."""
    x, y = geo.cell_centre(F.col("row_i"), F.col("col_i"), transform)
    inside = F.aggregate(F.transform(rings, lambda r: inside_polygon(x, y, r).cast("int")), F.lit(0), lambda n, i: n + i) % 2 == 1
    return inside | (F.array_min(F.transform(rings, lambda r: ring_distance(x, y, r))) <= distance) if distance > 0 else inside


def spans(polygons: DataFrame, transform: tuple[float, ...], keys: tuple[str, ...] = ("city_id",)) -> DataFrame:
    """keys, row_i, col_from, col_to (both included) of the cells whose centre is in a polygon.

    Scan lines: each side of each ring gives the place where it crosses the rows' centre
    lines; a row's crossings in order, taken in pairs, bound its spans.  Holes and several
    parts need nothing else (even-odd rule; parts must not overlap).  The work follows the
    rings' length in rows and their crossings, not the area, and no cell is tested.
    Rotated or mirrored columns are an error.
    """
    a, turn, c, shear, e, f = transform
    if turn or shear or a <= 0 or e == 0:
        raise ValueError("scan lines need an unrotated grid whose columns run to the right")
    ring = polygons.select(*keys, F.explode(_rings(polygons)).alias("ring")).where(F.size("ring") > 2)
    n = F.size("ring")
    side = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b"))))
    sides = ring.select(*keys, side.alias("s")).select(*keys, *(F.col(f"s.{p}.{v}").alias(p + v) for p in "ab" for v in "xy")).where("ay <> by")
    row = lambda y: F.floor((F.col(y) - f) / e).cast("long")
    lines = sides.withColumn("row_i", F.explode(F.sequence(F.least(row("ay"), row("by")) - 1, F.greatest(row("ay"), row("by")) + 1)))
    _, y = geo.cell_centre(F.col("row_i"), F.lit(0), transform)
    lines = lines.withColumn("y", y).where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    crossing = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    rows = lines.groupBy(*keys, "row_i").agg(F.sort_array(F.collect_list(crossing)).alias("x"))
    pairs = rows.select(*keys, "row_i", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("from"), F.get("x", 2 * i + 1).alias("to")))).alias("p"))
    return pairs.select(*keys, "row_i", _first_column("p.from", transform).alias("col_from"), (_first_column("p.to", transform) - 1).alias("col_to")).where("col_from <= col_to")


def _first_column(x: str, transform: tuple[float, ...]) -> Column:
    """The first column whose centre isn't left of x, by the centres' own numbers."""
    guess = F.ceil((F.col(x) - transform[2]) / transform[0] - 0.5).cast("long")
    centre = lambda k: geo.cell_centre(F.lit(0), k, transform)[0]
    return guess + F.when(centre(guess - 1) >= F.col(x), -1).when(centre(guess) < F.col(x), 1).otherwise(0)


def clip_polygons(cells: DataFrame, polygons: DataFrame, transform: tuple[float, ...], distance: float = 0.0, tile: int = 64) -> DataFrame:
    """Cells whose centre is in a polygon (column ring, or rings with holes and parts), with
    its other columns: cells meet scan-line spans of their row by equi joins on tiles of
    columns.  With a distance, cells that near are in as well, by an exact test of each
    cell in the polygon's box."""
    rest = [c for c in polygons.columns if c not in ("ring", "rings")]
    if distance > 0:
        joined = _tiled_cells(cells, tile).join(_tiled_boxes(windows(polygons, transform, distance), tile), ["_tr", "_tc"])
        return joined.where(inside_box()).where(_covers(_rings(polygons), transform, distance)).drop("_tr", "_tc", "ring", "rings")
    held = spans(polygons, transform, tuple(rest)).withColumnsRenamed({"row_i": "_row"})
    held = held.withColumn("_tc", F.explode(F.sequence(F.floor(F.col("col_from") / tile), F.floor(F.col("col_to") / tile))))
    joined = cells.withColumn("_row", F.col("row_i").cast("long")).withColumn("_tc", F.floor(F.col("col_i") / tile)).join(held, ["_row", "_tc"])
    return joined.where(F.col("col_i").between(F.col("col_from"), F.col("col_to"))).drop("_row", "_tc", "col_from", "col_to")


def polygon_masks(polygons: DataFrame, transform: tuple[float, ...], distance: float = 0.0) -> DataFrame:
    """city_id, row_i, col_i of all cells of the grid whose centre is in a polygon, with or without data."""
    if distance <= 0:
        return spans(polygons, transform).select("city_id", "row_i", F.explode(F.sequence("col_from", "col_to")).alias("col_i"))
    rows = windows(polygons, transform, distance).withColumn("row_i", F.explode(F.sequence("row_min", "row_max")))
    cells = rows.repartition("city_id", "row_i").withColumn("col_i", F.explode(F.sequence("col_min", "col_max")))
    return cells.where(_covers(_rings(polygons), transform, distance)).select("city_id", "row_i", "col_i")


def masked_scan(baseline: DataFrame, mask: DataFrame, baseline_grid: dict, mask_grid: dict, nodata: float | None = -9999.0) -> DataFrame:
    """row_i, col_i, value of the valid cells under the mask (value 1) of two rasters.

    Grids (width, height, transform, crs) must agree, and a cell must be left.
    """
    for k in ("transform", "crs", "width", "height"):
        if baseline_grid.get(k) != mask_grid.get(k):
            raise ValueError(f"the {k} of the mask isn't that of the baseline")
    found = baseline.where(roi_valid(nodata)).join(mask.where("value = 1").select("row_i", "col_i"), ["row_i", "col_i"], "left_semi")
    if not found.limit(1).count():
        raise ValueError("no valid cell lies under the mask")
    return found


def roi_valid(nodata: float | None = -9999.0, value: str = "value") -> Column:
    return valid(value, nodata)


def roi_statistics(cells: DataFrame, polygons: DataFrame, transform: tuple[float, ...], distance: float = 0.0) -> DataFrame:
    """Per polygon: window (width, height, bounds), cells under the mask, valid ones, their sum."""
    a, _, c, _, e, f = transform
    boxes = windows(polygons, transform, distance).select("city_id", "city_name", "row_min", "row_max", "col_min", "col_max")
    if distance > 0:
        masks = polygon_masks(polygons, transform, distance).groupBy("city_id").agg(F.count("*").alias("pixel_count_inside_mask"))
    else:  # spans know their cells' number
        masks = spans(polygons, transform).groupBy("city_id").agg(F.sum(F.col("col_to") - F.col("col_from") + 1).alias("pixel_count_inside_mask"))
    sums = clip_polygons(cells, polygons, transform, distance).groupBy("city_id").agg(F.count("value").alias("valid_baseline_pixels"), F.sum("value").alias("baseline_sum"))
    bounds = F.array(c + F.col("col_min") * a, f + (F.col("row_max") + 1) * e, c + (F.col("col_max") + 1) * a, f + F.col("row_min") * e)
    zero = lambda n, x: F.coalesce(n, F.lit(x)).alias(n)
    return boxes.join(masks, "city_id", "left").join(sums, "city_id", "left").select(
        "city_id", "city_name", (F.col("col_max") - F.col("col_min") + 1).alias("width"), (F.col("row_max") - F.col("row_min") + 1).alias("height"), bounds.alias("bounds"),
        zero("pixel_count_inside_mask", 0), zero("valid_baseline_pixels", 0), zero("baseline_sum", 0.0),
    )


def region_summary(clipped: DataFrame, all_cells: Column) -> DataFrame:
    """Per city: cells of the mask, valid ones and their sum."""
    return clipped.groupBy("city_id", "city_name").agg(F.max(all_cells).alias("mask_cells"), F.count("value").alias("valid_cells"), F.sum("value").alias("value_sum"))
