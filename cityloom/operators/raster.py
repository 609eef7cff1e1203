"""Rasters as long tables (row_i, col_i, value); an absent row or null is nodata."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.operators.ordered import percentile, ranked, running_sum
from cityloom.sources.lineage import stored

KEY = ["row_i", "col_i"]


def valid(value: str = "value", nodata: float | None = -9999.0) -> Column:
    """Whether a sample counts: finite without a nodata value, else unequal to it
    (not-a-number counts then, unless nodata is not a number)."""
    v = F.col(value)
    if nodata is None:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return v.isNotNull() & (~F.isnan(v) if nodata != nodata else v != F.lit(nodata))


def stats(raster: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return raster.agg(
        F.count(v).alias("valid_count"), F.count_if(v == 0).alias("zero_count"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum_value")
    )


def log_range(raster: DataFrame, value: str = "value") -> DataFrame:
    """One row lo, hi, n of log1p values; zeros for an empty raster."""
    v = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    return raster.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("lo"), F.coalesce(F.max(v), F.lit(0.0)).alias("hi"), F.count(v).alias("n"))


def log_histogram(raster: DataFrame, bins: int = 65_536, value: str = "value") -> DataFrame:
    """bin, n, lo, hi: counts over fixed bins of log1p between its extremes.

    The bin of x is floor((x - lo) (bins - 1) / (hi - lo)) within range.
    """
    ranged = raster.where(F.col(value).isNotNull()).crossJoin(F.broadcast(log_range(raster, value).select("lo", "hi")))
    v = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    at = F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.floor((v - F.col("lo")) * (bins - 1) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))))
    return ranged.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))


def histogram_percentiles(histogram: DataFrame, percents: list[float], bins: int = 65_536) -> DataFrame:
    """pct, value: lower edge of the first bin whose running count reaches the share
    (bins are (hi - lo) / bins wide); the extremes at 0 and 100, 0 without counts."""
    spark = histogram.sparkSession
    running = F.sum("n").over(Window.orderBy("bin"))
    cumulated = histogram.withColumn("up_to", running)
    asked = spark.createDataFrame([(float(p),) for p in percents], "pct double")
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    want = asked.crossJoin(F.broadcast(total)).withColumn("target", F.ceil(F.col("pct") / 100 * F.col("total")))
    ends = cumulated.agg(F.array_sort(F.collect_list(F.struct("up_to", "bin"))).alias("ends"))  # at most bins
    first = want.crossJoin(F.broadcast(ends)).withColumn("bin", F.array_min(F.transform(F.filter("ends", lambda e: e["up_to"] >= F.col("target")), lambda e: e["bin"])))
    edge = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    value = F.when(F.col("total") == 0, 0.0).when(F.col("pct") <= 0, F.col("lo")).when(F.col("pct") >= 100, F.col("hi")).otherwise(edge)
    return first.select("pct", value.alias("value"))


def normalised(v: Column, lo: Column, hi: Column) -> Column:
    """log1p(v) from lo..hi to 0..1, cut off; 0 for an empty range."""
    scaled = (F.log1p(F.greatest(v, F.lit(0.0))) - lo) / F.nullif(hi - lo, F.lit(0.0))
    return F.when(hi <= lo, 0.0).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def normalise(raster: DataFrame, low_pct: float = 1.0, high_pct: float = 99.5, bins: int = 65_536) -> DataFrame:
    """row_i, col_i, value between the two log percentiles, scaled to 0..1."""
    bounds = histogram_percentiles(log_histogram(raster, bins), [low_pct, high_pct], bins).agg(
        F.max(F.when(F.col("pct") == low_pct, F.col("value"))).alias("lo"), F.max(F.when(F.col("pct") == high_pct, F.col("value"))).alias("hi")
    )
    return raster.crossJoin(F.broadcast(bounds)).select(*KEY, normalised(F.col("value"), F.col("lo"), F.col("hi")).alias("value"))


def fuse(a: DataFrame, b: DataFrame, weight_a: float = 0.5, weight_b: float = 0.5) -> DataFrame:
    """Weighted sum where both have a value, else the one that has."""
    if weight_a + weight_b <= 0:
        raise ValueError("weights must have a positive sum")
    wa, wb = weight_a / (weight_a + weight_b), weight_b / (weight_a + weight_b)
    both = a.select(*KEY, F.col("value").alias("va")).join(b.select(*KEY, F.col("value").alias("vb")), KEY, "full")
    return both.select(*KEY, F.coalesce(F.col("va") * wa + F.col("vb") * wb, "va", "vb").alias("value"))


def saturation(value: Column, eps: float = 1e-6) -> Column:
    return -F.log10(F.greatest(1 - value, F.lit(eps)))


def percentile_rank(cells: DataFrame, by: str, name: str) -> DataFrame:
    """Rank over count, ties sharing the mean of their ranks; ranks come from running
    counts of equal values, which are summed range by range."""
    counts = cells.groupBy(by).agg(F.count("*").alias("_c"))
    upto = running_sum(counts, by, "_c", "_upto")
    total = cells.count()
    ranks = upto.select(by, ((F.col("_upto") - F.col("_c") + 1 + (F.col("_c") - 1) / 2) / F.lit(total)).alias(name))
    return cells.join(ranks, by)


def local_mean(cells: DataFrame, value: str = "value", window: int = 3, name: str = "local_mean", tile: int = 64) -> DataFrame:
    """Mean over the valid cells of a window x window square around each valid cell.

    Cells are dealt to square tiles, those near a border to the neighbours as well; a
    tile sums its own windows, so a cell is moved once or a little more often.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be odd")
    r = window // 2
    if r > tile:
        raise ValueError("a window can't be wider than two tiles")
    reach = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-r, 0, r)]))
    dealt = cells.where(F.col(value).isNotNull()).select(*KEY, F.col(value).cast("double").alias(value)).withColumn("_tr", F.explode(reach("row_i"))).withColumn("_tc", F.explode(reach("col_i")))

    def run(key, frame):
        top, left = int(key[0]) * tile - r, int(key[1]) * tile - r
        total, count = np.zeros((2, tile + 2 * r + 1, tile + 2 * r + 1))
        row, col = frame["row_i"].to_numpy() - top, frame["col_i"].to_numpy() - left
        v = frame[value].to_numpy()
        np.add.at(total, (row, col), v)
        np.add.at(count, (row, col), 1)

        def windows(x):  # sums of whole windows, direct, so that values of other cells add no rounding
            out = np.zeros((tile, tile))
            for i in range(window):
                for j in range(window):
                    out += x[i : i + tile, j : j + tile]
            return out

        own = (row >= r) & (row < r + tile) & (col >= r) & (col < r + tile)
        a, b = row[own] - r, col[own] - r
        return pd.DataFrame({"row_i": frame["row_i"].to_numpy()[own], "col_i": frame["col_i"].to_numpy()[own], value: v[own], name: windows(total)[a, b] / windows(count)[a, b]})

    return dealt.groupBy("_tr", "_tc").applyInPandas(run, f"row_i long, col_i long, {value} double, {name} double")


def candidates(cells: DataFrame, score: str, quantile: float = 0.5) -> DataFrame:
    """Cells whose score reaches the exact (interpolated) quantile of all scores.  cells
    should be a stored table: it is read for the quantile as well."""
    limit = percentile(cells, F.col(score), quantile)
    return cells.withColumn("threshold", F.lit(limit).cast("double")).where(F.col(score) >= F.col("threshold"))


def log_bounds(rasters: DataFrame, by: str, percents: tuple[float, float] = (1.0, 99.5), bins: int = 65_536) -> dict:
    """For each value of by, the two log percentiles of normalise(), all in two passes: the
    first bin that reaches a share is the bin of the value of that rank."""
    v = F.log1p(F.greatest(F.col("value"), F.lit(0.0)))
    rank = lambda n, s: [F.greatest(F.lit(0), F.least(n, F.ceil(F.lit(s) * n)) - 1)]
    out = {}
    for r in ranked(rasters, [by], v, [p / 100 for p in percents], rank).collect():  # one row a raster
        edges = [r.low if p <= 0 else r.high if p >= 100 or r.high <= r.low else r.low + math.floor((x - r.low) * (bins - 1) / (r.high - r.low)) * (r.high - r.low) / bins for p, x in zip(percents, r.found)]
        out[r[by]] = tuple(edges)
    return out


def hotspots(a: DataFrame, b: DataFrame, quantile: float = 0.9, window: int = 3) -> DataFrame:
    """The whole path: normalise both, fuse, score, smooth, keep the hottest cells."""
    both = stored(a.select(*KEY, "value", F.lit("a").alias("_which")).union(b.select(*KEY, "value", F.lit("b"))), "rasters")  # read for the bounds and the result
    bounds = log_bounds(both, "_which")
    parts = [both.where(F.col("_which") == k).select(*KEY, normalised(F.col("value"), *map(F.lit, bounds.get(k, (0.0, 0.0)))).alias("value")) for k in "ab"]
    scored = fuse(*parts).select(*KEY, saturation(F.col("value")).alias("score"))
    return candidates(stored(local_mean(scored, "score", window, "local_score"), "raster-scores"), "local_score", quantile)


def decimate(raster: DataFrame, scale: int) -> DataFrame:
    """One cell of each scale x scale block: the first by row and column."""
    block = [F.floor(F.col(c) / scale).cast("long").alias(c) for c in KEY]
    return raster.groupBy(*block).agg(F.min_by("value", F.struct("row_i", "col_i")).alias("value"))


def warp_sum(raster: DataFrame, to_row: Column, to_col: Column, height: int, width: int) -> DataFrame:
    """Mass-preserving move of cells to the target cells of their centres."""
    moved = raster.select(to_row.cast("long").alias("row_i"), to_col.cast("long").alias("col_i"), "value")
    inside = (F.col("row_i") >= 0) & (F.col("row_i") < height) & (F.col("col_i") >= 0) & (F.col("col_i") < width)
    return moved.where(inside).groupBy(*KEY).agg(F.sum("value").alias("value"))


def warp_sum_by_area(raster: DataFrame, to_row: Column, to_col: Column, height: int, width: int, parts: int = 4) -> DataFrame:
    """As warp_sum with each cell cut into parts x parts cells of equal mass."""
    steps = F.sequence(F.lit(0), F.lit(parts - 1))
    cut = raster.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select(
        (F.col("row_i") + (F.col("_i") + 0.5) / parts - 0.5).alias("row_i"), (F.col("col_i") + (F.col("_j") + 0.5) / parts - 0.5).alias("col_i"), (F.col("value") / parts**2).alias("value")
    )
    return warp_sum(cut, to_row, to_col, height, width)


def warp_exact(raster: DataFrame, place, height: int, width: int, densify: int = 1) -> DataFrame:
    """Mass-preserving move by true overlap: a cell's value is shared among the target cells
    by the areas that its image covers in them.

    place(row, col) gives the target's (row, column) as columns for a place in the source,
    whose cell (r, c) lies between r, c and r + 1, c + 1; ``densify`` points a side follow
    curved maps.  The image's outline is cut where it crosses target lines; a piece covers
    its own cell in part and the cells after it in the row whole, with the sign of its way
    up or down, so the pieces' shares of each target cell add up to the exact area, for
    any shape.  It is one sum by target cell.  What falls outside the target goes; an image
    without area counts as its first corner.
    """
    along = [i / densify for i in range(densify)]
    outline = [(0.0, t) for t in along] + [(t, 1.0) for t in along] + [(1.0, 1.0 - t) for t in along] + [(1.0 - t, 0.0) for t in along]
    points = []
    for dr, dc in outline:
        y, x = place(F.col("row_i") + F.lit(dr), F.col("col_i") + F.lit(dc))
        points.append(F.struct(y.cast("double").alias("y"), x.cast("double").alias("x")))
    images = raster.where(F.col("value").isNotNull()).select(F.col("value").cast("double").alias("value"), F.array(*points).alias("p"))
    n = len(outline)
    side = lambda i: (F.get("p", F.lit(i)), F.get("p", F.lit((i + 1) % n)))
    area = -sum(((b["y"] - a["y"]) * (a["x"] + b["x"]) / 2 for a, b in map(side, range(n))), F.lit(0.0))
    last = F.floor(F.array_max(F.transform("p", lambda q: q["x"])))
    edges = F.array(*[F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")) for a, b in map(side, range(n))])
    images = images.withColumns({"area": area, "last": last})
    flat = images.where("area = 0").select("value", F.floor(F.col("p")[0]["y"]).alias("row_i"), F.floor(F.col("p")[0]["x"]).alias("col_i"))
    cut = images.where("area <> 0").select((F.col("value") / F.col("area")).alias("mass"), "last", F.explode(edges).alias("e")).select("mass", "last", "e.*").where("y0 <> y1")

    def lines(a: str, b: str) -> Column:  # where along the edge it crosses lines of one direction
        low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
        return F.when((low <= high) & (F.col(a) != F.col(b)), F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k - F.col(a)) / (F.col(b) - F.col(a)))).otherwise(F.array().cast("array<double>"))

    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.concat(lines("x0", "x1"), lines("y0", "y1")), lambda t: (t > 0) & (t < 1)))))
    pieces = cut.withColumn("t", stops).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("t") - 2)))
    t0, t1 = F.get("t", F.col("k")), F.get("t", F.col("k") + 1)
    middle = lambda a, b: F.col(a) + (t0 + t1) / 2 * (F.col(b) - F.col(a))
    pieces = pieces.select("mass", "last", ((t1 - t0) * (F.col("y1") - F.col("y0"))).alias("dy"), middle("x0", "x1").alias("x"), F.floor(middle("y0", "y1")).alias("row_i"))
    own = F.floor("x")
    shared = pieces.where((F.col("row_i") >= 0) & (F.col("row_i") < height)).withColumn("col_i", F.explode(F.sequence(own, F.greatest(own, F.least(F.col("last"), F.greatest(own, F.lit(width - 1)))))))
    covered = F.when(F.col("col_i") == own, F.col("dy") * (own + 1 - F.col("x"))).otherwise(F.col("dy"))
    shares = shared.select((F.col("mass") * covered).alias("value"), "row_i", "col_i").unionByName(flat)
    inside = (F.col("row_i") >= 0) & (F.col("row_i") < height) & (F.col("col_i") >= 0) & (F.col("col_i") < width)
    touched = shares.where(inside).groupBy(*KEY).agg(F.sum("value").alias("value"), F.max(F.abs("value")).alias("_most"))
    # Cells beside an image get shares that cancel out, but for rounding.
    return touched.where(F.abs("value") > 1e-12 * F.col("_most")).select(F.col("row_i").cast("long").alias("row_i"), F.col("col_i").cast("long").alias("col_i"), "value")


def bilinear(raster: DataFrame, targets: DataFrame, nodata: float = 0.0) -> DataFrame:
    """Values at the fractional source places (src_row, src_col) of target cells, from
    the four source cells around each; absent sources count as nodata."""
    row, col = F.floor("src_row"), F.floor("src_col")
    fr, fc = F.col("src_row") - row, F.col("src_col") - col
    corners = F.array(*[F.struct((row + i).alias("row_i"), (col + j).alias("col_i"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    asked = targets.select("out_row", "out_col", F.explode(corners).alias("c")).select("out_row", "out_col", "c.*")
    return (
        asked.join(raster, KEY, "left").groupBy("out_row", "out_col").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(nodata))).alias("value"))
        .select(F.col("out_row").alias("row_i"), F.col("out_col").alias("col_i"), "value")
    )
