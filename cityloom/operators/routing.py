"""Shortest-path trees over a partition of the graph into cells.

1. Each cell is packed into one row: its nodes, the edges that start in it, its entries
   (nodes that an edge from outside leads to).  Where node ids follow the map, cells are
   ranges of ids; where they don't, cells are grown.
2. In a round, distances at entries go to the cells with edges to them.  There a task
   settles what it was sent, for every few destinations, and passes on the entries that
   got nearer; this ends when none does.  Ranges are settled two at a time, in turn with
   the next and with the one before, so that what is a border in one round lies deep
   inside in the next: ways along a border would cross it in a round each.
3. In each cell, a task for every few destinations starts from the distances of the heads
   and finds those of all nodes, and the next nodes.

Neither edges nor distances pass through the driver, and no task sees more than two cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.operators.cells import celled_edges, grown_cells
from cityloom.sources.lineage import stored

#: Most nodes that a task sees, and about how many edges.
CELL, CELL_EDGES = 1_000_000, 8_000_000
#: Most destinations that a task takes at a time, and about how many distances at least (where that leaves cores idle) and at most.
DESTS, FEW, LABELS = 64, 1_000_000, 8_000_000
#: Ranges of node ids are no cells if they cut more than this share of the edges.
_CUT = 0.25
_ARRAYS = {"names": np.int64, "entries": np.int32, "tail": np.int32, "head": np.int32, "weight": np.float64}
_PACKED = "cell long, " + ", ".join(f"{c} binary" for c in _ARRAYS)
_PASSED = "block long, dest long, node long, dist double"
_FOUND = "dest long, node long, dist double, next_node long"


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a cell from kind 0 edges u, v, w (v may lie outside) and kind 1 entries u."""
    edge = rows["kind"].to_numpy() == 0
    u, v, w = rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64), rows["w"].to_numpy(float)
    names = np.unique(np.concatenate([u, v[edge]]))
    tail, head, entries = (np.searchsorted(names, x).astype(np.int32) for x in (u[edge], v[edge], np.unique(u[~edge])))
    by = np.lexsort((tail, head))
    return pd.DataFrame({"cell": [int(rows["cell"].iloc[0])], "names": [names], "entries": [entries], "tail": [tail[by]], "head": [head[by]], "weight": [w[edge][by]]})


def _as_bytes(rows: pd.DataFrame) -> pd.DataFrame:
    """_packed with its arrays as bytes, which Spark copies whole."""
    cell = _packed(rows)
    return cell.assign(**{c: [cell[c][0].tobytes()] for c in _ARRAYS})


def _arrays(cells: pd.DataFrame) -> tuple:
    """names, entries, tail, head, weight of packed cells together; edges are sorted by head."""
    found = [[np.frombuffer(x, kind) if isinstance(x, bytes) else np.asarray(x) for x in cells[c]] for c, kind in _ARRAYS.items()]
    if len(cells) == 1:
        return tuple(x[0] for x in found)
    names = np.unique(np.concatenate(found[0]))
    to = [np.searchsorted(names, x).astype(np.int32) for x in found[0]]
    entries, tail, head = (np.concatenate([place[x] for place, x in zip(to, of)]) for of in found[1:4])
    by = np.argsort(head, kind="stable")
    return names, entries, tail[by], head[by], np.concatenate(found[4])[by]


def _settled(tail: np.ndarray, head: np.ndarray, weight: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Distances (nodes x targets) once no edge shortens any; edges are sorted by head.
    Only what got nearer in the step before is passed on, the nearest part of it first."""
    n, k = dist.shape
    first = np.concatenate([[0], np.cumsum(np.bincount(head, minlength=n))])
    row = tail.astype(np.int64) * k
    flat = dist.reshape(-1)
    step = 2 * weight.mean() if len(weight) else 0.0
    waits = np.flatnonzero(np.isfinite(flat))
    held, last = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=np.int32)
    held[waits] = True
    while len(waits):
        far = flat[waits]
        now = far <= far.min() + step
        at, far, waits = waits[now], far[now], waits[~now]
        held[at] = False
        node = at // k
        count = first[node + 1] - first[node]
        of = np.repeat(np.arange(len(at)), count)
        edge = np.arange(len(of)) + (first[node] - (np.cumsum(count) - count))[of]
        to, far = row[edge] + (at - node * k)[of], weight[edge] + far[of]
        less = far < flat[to]
        to = to[less]
        np.minimum.at(flat, to, far[less])
        to = to[~held[to]]
        held[to] = True
        last[to] = np.arange(len(to))
        waits = np.concatenate([waits, to[last[to] == np.arange(len(to))]])  # each once
    return flat.reshape(n, k)


def _started(cell: pd.DataFrame, known: pd.DataFrame) -> tuple:
    """The arrays of a cell or two, the destinations of known (dest, node, dist) and the settled distances."""
    names, entries, tail, head, weight = _arrays(cell)
    dests = np.unique(known["dest"].to_numpy())
    dist = np.full((len(names), len(dests)), np.inf)
    np.minimum.at(dist, (np.searchsorted(names, known["node"].to_numpy()), np.searchsorted(dests, known["dest"].to_numpy())), known["dist"].to_numpy())
    return names, entries, tail, head, weight, dests, _settled(tail, head, weight, dist)


def _passed(cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Distances from a cell's entries by what was sent to it."""
    if not len(cell) or not len(known):
        return pd.DataFrame({"dest": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "dist": np.zeros(0)})
    names, entries, _, _, _, dests, dist = _started(cell, known)
    i, j = np.nonzero(np.isfinite(dist[entries]))
    return pd.DataFrame({"dest": dests[j], "node": names[entries[i]], "dist": dist[entries[i], j]})


def _descent(cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Distances and next nodes of a cell's nodes, from those known at its heads and destinations."""
    if not len(cell) or not len(known):
        return pd.DataFrame({"dest": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "dist": np.zeros(0), "next_node": np.zeros(0, np.int64)})
    names, entries, tail, head, weight, dests, dist = _started(cell, known)
    own = np.zeros(len(names), dtype=bool)
    own[tail] = True
    own[entries] = True
    none = np.iinfo(np.int64).max
    following = np.full(dist.shape, none)
    if len(tail):
        by = np.argsort(tail, kind="stable")
        tail, head, weight = tail[by], head[by], weight[by]
        at = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
        to = names[head]
        for j in range(len(dests)):
            far = dist[:, j].copy()
            following[tail[at], j] = np.minimum.reduceat(np.where(weight + far[head] == far[tail], to, none), at)
    here = np.searchsorted(names, dests)
    there = (here < len(names)) & (names[np.minimum(here, len(names) - 1)] == dests)
    following[here[there], np.flatnonzero(there)] = dests[there]
    i, j = np.nonzero(np.isfinite(dist) & own[:, None])
    return pd.DataFrame({"dest": dests[j], "node": names[i], "dist": dist[i, j], "next_node": following[i, j]})


def _asked(known: DataFrame) -> DataFrame:
    return known.select("cell", F.col("block").alias("part")).distinct()


def _by_blocks(packed: DataFrame, known: DataFrame, asked: DataFrame, count: int, kernel, schema: str) -> DataFrame:
    """kernel on each of the count asked blocks of destinations (part) of a cell, with what is known there, a task for each."""
    tasks = 4 * count or 1  # so that few tasks get two
    given = packed.join(F.broadcast(asked), "cell").repartition(tasks, "cell", "part")  # asked has a row for each task
    return given.groupBy("cell", "part").cogroup(known.repartition(tasks, "cell", "block").groupBy("cell", "block")).applyInPandas(kernel, schema)


def _ranged(edges: DataFrame, count: int):
    """A function that adds the range of ids, of ``count`` with about as many edges each, to rows: in_ranges(df, cell="node")."""
    cuts = np.array(edges.agg(F.percentile_approx("u", [i / count for i in range(1, count)], max(10_000, 100 * count))).first()[0], dtype=np.int64)

    def in_ranges(df: DataFrame, **of: str) -> DataFrame:
        def placed(batches):
            for batch in batches:
                yield batch.assign(**{c: np.searchsorted(cuts, batch[node].to_numpy(), side="right") for c, node in of.items()})

        return df.mapInPandas(placed, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *(f"{c} long" for c in of)]))

    return in_ranges


def _placed(edges: DataFrame, goals: DataFrame, cells: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame, int, int, bool]:
    """Edges with cu and cv, goals with cell, about how many nodes a task sees and how many
    cells (or pairs of ranges) there are, and whether they are pairs of ranges."""
    m, starts, ends = edges.agg(F.count("*"), F.approx_count_distinct("u"), F.approx_count_distinct("v")).first()
    n = max(starts, ends, 1)
    most = max(1, min(most, CELL_EDGES * n // max(m, 1)))
    count = -(-n // most)
    room = -(-n // count)
    if cells is None:
        goals = goals.join(edges.select(F.explode(F.array("u", "v")).alias("dest")), "dest", "left_semi")
        if count == 1:
            zero = F.lit(0).cast("long")
            return edges.withColumns({"cu": zero, "cv": zero}), goals.withColumn("cell", zero), room, 1, False
        in_ranges = _ranged(edges, 2 * count)
        placed = stored(in_ranges(edges, cu="u", cv="v"), "path-ranges")
        if placed.where("cu <> cv").count() <= _CUT * m:
            return placed, in_ranges(goals, cell="dest"), room, count, True
        cells = stored(grown_cells(edges, most), "path-grown")
    return celled_edges(edges, cells), goals.join(cells.withColumnRenamed("node", "dest"), "dest").select("dest", "cell"), room, max(count, 2), False


def _dealt(goals: DataFrame, room: int, cells: int) -> tuple[DataFrame, int]:
    """goals with their blocks, which tasks take at a time, and the number of blocks."""
    goals = stored(goals, "path-goals")
    count = goals.count()
    if not count:
        return goals.withColumn("block", F.lit(0).cast("long")), 0
    each = max(FEW // room, count * cells // (2 * goals.sparkSession.sparkContext.defaultParallelism))
    each = max(1, min(DESTS, LABELS // room, each))
    blocks = -(-count // each)
    block = F.expr(f"monotonically_increasing_id() div {-(-count // blocks)}")
    if count <= 10_000:
        return goals.coalesce(1).sortWithinPartitions("dest").withColumn("block", block), blocks
    return stored(goals.repartitionByRange(count // 10_000 + 1, "dest").sortWithinPartitions("dest").withColumn("block", block), "path-blocks"), blocks


def path_trees(edges: DataFrame, destinations: DataFrame, cost: str = "cost", cells: DataFrame | None = None, most: int = CELL) -> DataFrame:
    """dest, node, dist, next_node: shortest distances to each destination (node_id) and the
    first step on the way (of equals, the smallest node; a destination's own is itself).

    Costs must be positive; of parallel edges the cheapest counts; edges without a cost
    don't.  cells (node, cell) may give a partition that is known, such as squares of a
    map; otherwise a task sees two ranges of node ids with about ``most`` nodes, or, where
    ranges cut many edges, a cell grown to at most ``most``.  Nodes that can't reach a
    destination, and destinations without edges, have no row.
    """
    lightest = edges.groupBy(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).agg(F.min(F.col(cost).cast("double")).alias("w"))
    lightest = stored(lightest.where("w IS NOT NULL AND u <> v"), "path-edges")
    goals = destinations.select(F.col("node_id").cast("long").alias("dest")).distinct()
    if cells is not None:
        cells = cells.select(F.col("node").cast("long").alias("node"), F.col("cell").cast("long").alias("cell"))
    placed, goals, room, count, paired = _placed(lightest, goals, cells, most)
    goals, blocks = _dealt(goals, room, count)
    crossing = stored(placed.where("cu <> cv").select("u", "v", "cu", "cv"), "path-crossing") if count > 1 else None
    # A destination is an entry too, so that it is among its cell's nodes.
    entries = goals.select("cell", F.col("dest").alias("v"))
    entries = entries if crossing is None else entries.union(crossing.select("cv", "v")).distinct()
    given = placed.select(F.col("cu").alias("cell"), F.lit(0).alias("kind"), "u", "v", "w").union(entries.select("cell", F.lit(1), "v", F.lit(-1).cast("long"), F.lit(0.0)))
    packed = given.groupBy("cell").applyInPandas(_as_bytes, _PACKED)

    def at_heads(cell: Column, heads: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
        own = goals.select(cell.alias("cell"), "block", "dest", F.col("dest").alias("node"), F.lit(0.0).alias("dist"), F.lit(-1).alias("turn"))
        return own if best is None else own.unionByName(heads.join(best, "node"))

    if crossing is None:
        known = at_heads(F.col("cell"))
        return _by_blocks(packed, known, _asked(known), blocks, _descent, _FOUND)
    packed = stored(packed, "path-cells")
    best = _at_entries(packed, crossing, at_heads, paired)
    heads = crossing.select(F.col("cu").alias("cell"), F.col("v").alias("node")).distinct()
    known = stored(at_heads(F.col("cell"), heads, best), "path-known")
    asked = stored(_asked(known), "path-asked")
    return _by_blocks(packed, known, asked, asked.count(), _descent, _FOUND)


def _at_entries(packed: DataFrame, crossing: DataFrame, at_heads, paired: bool) -> DataFrame | None:
    """block, dest, node, dist: the distances of entries, in rounds; None if there are none."""

    def together(cell: str, turn: int) -> Column:
        return F.expr(f"({cell} + {turn % 2}) div 2") if paired else F.col(cell)

    def passed(key: tuple, cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _passed(cell, known).assign(block=key[1])[["block", "dest", "node", "dist"]]

    heads = []
    for turn in range(2 if paired else 1):
        cu, cv = together("cu", turn), together("cv", turn)
        heads.append(stored(crossing.where(cu != cv).select(cu.alias("cell"), F.col("v").alias("node")).distinct(), "path-heads"))
    best, turn, every = None, 0, len(heads)
    while True:
        cell = together("cell", turn)
        known = stored(at_heads(cell, heads[turn % every], best), "path-known")
        # What cells haven't seen: distances of the rounds since their last one, and others' of that.
        news = known.where(F.col("turn") >= turn - every).select("cell", "dest").distinct()
        known = known.join(news, ["cell", "dest"], "left_semi")
        asked = stored(_asked(known), "path-asked")
        count = asked.count()
        if count:
            come = _by_blocks(packed.withColumn("cell", cell), known, asked, count, passed, _PASSED).withColumn("turn", F.lit(turn))
            come = come if best is None else best.unionByName(come)
            best = stored(come.groupBy("block", "dest", "node").agg(F.min(F.struct("dist", "turn")).alias("of")).select("block", "dest", "node", "of.*"), "path-best")
        elif turn % every == 0:
            return best
        turn += 1


def next_hops(trees: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (node, dest) with next_node; null where there is no way."""
    return asked.join(trees.select("dest", "node", "next_node"), ["dest", "node"], "left")
