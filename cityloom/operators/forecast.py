"""Short-horizon forecasts of frames: windows, splits, persistence, regression, scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense(frames: DataFrame, value: str, frame: str = "frame") -> DataFrame:
    """frame, cell, value for every frame and cell there is; absent ones are 0."""
    every = frames.agg(F.collect_set(frame).alias("_all"))  # one row: a number a frame
    grid = frames.select("cell").distinct().crossJoin(F.broadcast(every)).select("cell", F.explode("_all").alias(frame))
    return grid.join(frames.select(frame, "cell", value), [frame, "cell"], "left").select(frame, "cell", F.coalesce(value, F.lit(0.0)).cast("double").alias("value"))


def sliding_windows(frames: DataFrame, history: int, horizon: int) -> DataFrame:
    """cell, frame, history (array of the last frames' values), targets (array of the next)."""
    order = Window.partitionBy("cell").orderBy("frame")
    seen, ahead = order.rowsBetween(1 - history, 0), order.rowsBetween(1, horizon)
    rows = frames.select("cell", "frame", F.collect_list("value").over(seen).alias("history"), F.collect_list("value").over(ahead).alias("targets"))
    return rows.where((F.size("history") == history) & (F.size("targets") == horizon))


def chronological_split(frames: DataFrame, validate: float = 0.15, test: float = 0.15) -> DataFrame:
    """n and part (train, validate, test) of window starts in order, at least one each of the latter."""
    order = frames.select("frame").distinct()
    rank = F.row_number().over(Window.orderBy("frame"))
    total = F.count("*").over(Window.partitionBy())
    ranked = order.select("frame", rank.alias("r"), total.alias("t"))
    v, t = (F.greatest(F.lit(1), F.floor(F.col("t") * F.lit(x))) for x in (validate, test))
    part = F.when(F.col("r") > F.col("t") - t, "test").when(F.col("r") > F.col("t") - t - v, "validate").otherwise("train")
    return ranked.select("frame", part.alias("part"))


def persistence(frames: DataFrame, horizon: int = 1) -> DataFrame:
    """frame, cell, value, predicted: the value seen horizon frames before."""
    order = Window.partitionBy("cell").orderBy("frame")
    return frames.withColumn("predicted", F.lag("value", horizon).over(order)).where("predicted IS NOT NULL")


def errors(predicted: DataFrame) -> DataFrame:
    gap = F.col("predicted") - F.col("value")
    return predicted.agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def hit_rate(predicted: DataFrame, top: int = 20) -> DataFrame:
    """Mean share of a frame's top cells that the prediction's top cells hold; frames
    without any positive value don't count."""
    rank = lambda c: F.row_number().over(Window.partitionBy("frame").orderBy(F.desc(c), "cell"))
    ranked = predicted.withColumn("rt", rank("value")).withColumn("rp", rank("predicted"))
    per = ranked.groupBy("frame").agg(F.max("value").alias("peak"), (F.count_if((F.col("rt") <= top) & (F.col("rp") <= top)) / top).alias("hit"))
    return per.where("peak > 0").agg(F.count("*").alias("frames"), F.avg("hit").alias("hit_rate"))


def regression(frames: DataFrame, history: int = 4, horizon: int = 1) -> DataFrame:
    """frame, cell, value, predicted of the test windows, by a linear regression on each
    cell's history fitted to the training windows."""
    windows = sliding_windows(frames, history, horizon)
    rows = windows.join(F.broadcast(chronological_split(windows)), "frame").select("frame", "cell", "part", F.get("targets", F.lit(horizon - 1)).alias("value"), *[F.get("history", F.lit(i)).alias(f"h{i}") for i in range(history)])
    vectors = VectorAssembler(inputCols=[f"h{i}" for i in range(history)], outputCol="features").transform(rows)
    model = LinearRegression(labelCol="value", predictionCol="predicted", regParam=1e-6).fit(vectors.where("part = 'train'"))
    return model.transform(vectors.where("part = 'test'")).select("frame", "cell", "value", "predicted")


def _cube(key, rows: pd.DataFrame, tile: int, block: int, history: int, horizon: int, radius: int) -> np.ndarray:
    """Dense frames of a tile and block with their halos; absent cells are 0."""
    out = np.zeros((block + history - 1 + horizon, tile + 2 * radius, tile + 2 * radius))
    at = rows["frame"].to_numpy() - (int(key[2]) * block - history + 1), rows["row_i"].to_numpy() - (int(key[0]) * tile - radius), rows["col_i"].to_numpy() - (int(key[1]) * tile - radius)
    out[at] = rows["value"].to_numpy()
    return out


def _features(cube: np.ndarray, at: int, tile: int, history: int, radius: int, inside: np.ndarray) -> np.ndarray:
    """One row a cell: 1, then for each lag (the last frame first) its neighbourhood in row order."""
    side = 2 * radius + 1
    parts = [cube[at - lag, i : i + tile, j : j + tile][inside] for lag in range(history) for i in range(side) for j in range(side)]
    return np.column_stack([np.ones(int(inside.sum())), *parts])


def halo_regression(frames: DataFrame, height: int, width: int, history: int = 4, horizon: int = 1, radius: int = 1, ridge: float = 1e-9, tile: int = 64, block: int = 64) -> DataFrame:
    """frame (the last one seen), row_i, col_i, value, predicted of the test windows, by a linear
    regression on the last ``history`` frames of each cell and its neighbours up to radius.

    frames: frame (whole numbers, one step apart), row_i, col_i, value; absent cells are 0.
    Cells are dealt to tiles and blocks of frames, those near a border to the neighbours as
    well; a task adds up the normal equations of its windows, so only sums of the number of
    features squared leave it, and a second pass predicts.  Tiles without a value in a
    block count as zeros in the fit and aren't predicted.
    """
    first, last = frames.agg(F.min("frame"), F.max("frame")).first()
    schema = "frame long, row_i long, col_i long, value double, predicted double"
    n = 0 if first is None else last - horizon - (first + history - 1) + 1
    if n < 3:
        return frames.sparkSession.createDataFrame([], schema)
    begin, tests = first + history - 1, max(1, int(n * 0.15))  # as chronological_split
    train_end, test_begin = begin + n - 2 * tests, begin + n - tests
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile) for d in (-radius, 0, radius)]))
    blocks = F.sequence(F.floor((F.col("frame") - horizon) / block), F.floor((F.col("frame") + history - 1) / block))
    inside = (F.col("row_i") >= 0) & (F.col("row_i") < height) & (F.col("col_i") >= 0) & (F.col("col_i") < width) & F.col("value").isNotNull()
    dealt = frames.where(inside).select(F.col("frame").cast("long").alias("frame"), "row_i", "col_i", F.col("value").cast("double").alias("value"))
    dealt = dealt.withColumn("_tr", F.explode(near("row_i"))).withColumn("_tc", F.explode(near("col_i"))).withColumn("_b", F.explode(blocks)).groupBy("_tr", "_tc", "_b")
    size = 1 + history * (2 * radius + 1) ** 2

    def windows(key, rows, low: int, high: int):
        """(frame, which cells of the tile are in the grid, features, targets) of the block's windows."""
        cube = _cube(key, rows, tile, block, history, horizon, radius)
        r, c = np.arange(tile) + int(key[0]) * tile, np.arange(tile) + int(key[1]) * tile
        held = ((r >= 0) & (r < height))[:, None] & ((c >= 0) & (c < width))[None, :]
        for f in range(max(low, int(key[2]) * block), min(high, (int(key[2]) + 1) * block)):
            at = f - int(key[2]) * block + history - 1
            yield f, held, _features(cube, at, tile, history, radius, held), cube[at + horizon, radius : radius + tile, radius : radius + tile][held]

    def sums(key, rows):
        total = np.zeros((size, size + 1))
        for _, _, x, y in windows(key, rows, begin, train_end):
            total += x.T @ np.column_stack([x, y])
        return pd.DataFrame({"at": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    total = np.zeros(size * (size + 1))
    for row in dealt.applyInPandas(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many as the equations have numbers
        total[row["at"]] = row["value"]
    total = total.reshape(size, size + 1)
    total[0, 0] = (train_end - begin) * height * width  # windows of tiles without a value are all 0 but for the constant
    weights = np.linalg.lstsq(total[:, :-1] + ridge * np.trace(total[:, :-1]) / size * np.eye(size), total[:, -1], rcond=None)[0]

    def predict(key, rows):
        out = []
        for f, held, x, y in windows(key, rows, test_begin, begin + n):
            r, c = np.nonzero(held)
            out.append(pd.DataFrame({"frame": np.int64(f), "row_i": r + int(key[0]) * tile, "col_i": c + int(key[1]) * tile, "value": y, "predicted": x @ weights}))
        return pd.concat(out) if out else pd.DataFrame({"frame": np.zeros(0, np.int64), "row_i": np.zeros(0, np.int64), "col_i": np.zeros(0, np.int64), "value": np.zeros(0), "predicted": np.zeros(0)})

    return dealt.applyInPandas(predict, schema)
