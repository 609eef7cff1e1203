"""Nearest neighbours by an index that follows the data: a space-filling curve cut by counts.

Nodes are sorted along a Z-shaped curve and cut into leaves of LEAF nodes, FAN leaves to a
branch, branches to a range (one for each task of the sort).  So a crowded place has many
small boxes and an outlier one of its own, and no leaf or branch is larger than another.

A point first goes down to the nearest box of each level, which gives a distance that it
can't do worse than; then it goes down again to all boxes that aren't farther.  Both ways
are equi joins of points with the boxes or nodes below a parent, kept as arrays; where many
points ask for one parent, it is copied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.sources.lineage import stored

LEAF, FAN = 32, 64
#: Points of a task, and of a copy of a box that many points ask for.
HOT = 20_000


def _curve(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Places along the curve: the bits of both coordinates, 31 each, in turn."""
    out = np.zeros(len(x), dtype=np.int64)
    for v, low, high, shift in ((x, box[0], box[1], 0), (y, box[2], box[3], 1)):
        at = np.floor((v - low) / (high - low) * (2**31 - 1)).astype(np.int64) if high > low else np.zeros(len(v), dtype=np.int64)
        for bit in range(31):
            out |= ((at >> bit) & 1) << (2 * bit + shift)
    return out


def indexed(nodes: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """nodes (node_id, node_x, node_y) with _range, _branch and _leaf, a stored table."""
    box = nodes.agg(F.min("node_x"), F.max("node_x"), F.min("node_y"), F.max("node_y")).first()

    def placed(batches):
        for batch in batches:
            z = _curve(batch.column("node_x").to_numpy(zero_copy_only=False), batch.column("node_y").to_numpy(zero_copy_only=False), box)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*batch.schema.names, "_z"])

    kind = dict(nodes.dtypes)["node_id"]
    schema = f"node_id {kind}, node_x double, node_y double"
    on_curve = nodes.mapInArrow(placed, f"{schema}, _z long")
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // (leaf * fan * fan) + 1)

    def numbered(batches):
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            at = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            columns = [pa.array(np.full(len(at), task)), pa.array((task << 32) + at // (leaf * fan)), pa.array((task << 32) + at // leaf)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["node_id", "node_x", "node_y", "_range", "_branch", "_leaf"])

    dealt = on_curve.repartitionByRange(tasks, "_z", "node_id").sortWithinPartitions("_z", "node_id")
    return stored(dealt.mapInArrow(numbered, f"{schema}, _range long, _branch long, _leaf long"), "nearest-index")


def _boxes(index: DataFrame, child: str, parent: str | None) -> DataFrame:
    """parent, below: an array of the boxes of its children; one row without a parent."""
    edges = [F.min("node_x").alias("x0"), F.max("node_x").alias("x1"), F.min("node_y").alias("y0"), F.max("node_y").alias("y1")]
    boxes = index.groupBy(child, *([parent] if parent else [])).agg(*edges)
    below = F.collect_list(F.struct(F.col(child).alias("id"), "x0", "x1", "y0", "y1")).alias("below")
    return boxes.groupBy(parent).agg(below) if parent else boxes.agg(below)


def _to_box(b: Column) -> Column:
    dx = F.greatest(b["x0"] - F.col("x"), F.lit(0.0), F.col("x") - b["x1"])
    dy = F.greatest(b["y0"] - F.col("y"), F.lit(0.0), F.col("y") - b["y1"])
    return F.sqrt(dx * dx + dy * dy)


def _below(points: DataFrame, table: DataFrame, parent: str) -> DataFrame:
    """points with what table has below their parent.  A parent that many points ask for
    has a copy for every HOT of them, so no task gets all of a crowd's points."""
    counts = points.groupBy(parent).agg(F.count("*").alias("_n"))
    copies = table.join(counts, parent).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / HOT).cast("int")))).drop("_n")
    asked = points.join(counts.withColumnRenamed("_n", "_of"), parent)
    asked = asked.withColumn("_copy", F.pmod(F.xxhash64("_point"), F.floor(F.col("_of") / HOT) + 1).cast("int")).drop("_of")
    return asked.join(copies, [parent, "_copy"]).drop("_copy")


def nearest_nodes(points: DataFrame, nodes: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """_point, node_id, node_x, node_y, snap_distance_m: the nearest node (of equals, that of
    the smallest id) of each of points (_point, x, y)."""
    index = indexed(nodes, leaf, fan)
    top = _boxes(index, "_range", None)  # a box for each task
    branches, leaves = _boxes(index, "_branch", "_range"), _boxes(index, "_leaf", "_branch")
    held = index.groupBy("_leaf").agg(F.collect_list(F.struct("node_id", "node_x", "node_y")).alias("below"))
    branches, leaves, held = (stored(t, "nearest-level") for t in (branches, leaves, held))

    def far(n: Column) -> Column:
        dx, dy = F.col("x") - n["node_x"], F.col("y") - n["node_y"]
        return F.sqrt(dx * dx + dy * dy)

    best = F.array_min(F.transform("below", lambda n: F.struct(far(n).alias("d"), n["node_id"].alias("node_id"), n["node_x"].alias("node_x"), n["node_y"].alias("node_y"))))
    closest = F.array_min(F.transform("below", lambda b: F.struct(_to_box(b).alias("d"), b["id"].alias("id"))))["id"]
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count() // HOT + 1)
    asked = points.select("_point", "x", "y").repartition(tasks)
    levels = ((branches, "_range", "_branch"), (leaves, "_branch", "_leaf"))
    down = stored(asked.crossJoin(F.broadcast(top)).withColumn("_range", closest).drop("below"), "nearest-down")  # one row
    for table, parent, child in levels:
        down = stored(_below(down, table, parent).withColumn(child, closest).drop("below", parent), "nearest-down")
    bound = _below(down, held, "_leaf").select("_point", "x", "y", best["d"].alias("most"))
    within = F.explode(F.transform(F.filter("below", lambda b: _to_box(b) <= F.col("most")), lambda b: b["id"]))
    again = stored(bound.crossJoin(F.broadcast(top)).withColumn("_range", within).drop("below"), "nearest-again")
    for table, parent, child in levels:
        again = stored(_below(again, table, parent).withColumn(child, within).drop("below", parent), "nearest-again")
    found = _below(again, held, "_leaf").select("_point", best.alias("b")).groupBy("_point").agg(F.min("b").alias("b"))
    return found.select("_point", "b.node_id", "b.node_x", "b.node_y", F.col("b.d").alias("snap_distance_m"))
