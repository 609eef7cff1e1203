"""A graph cut into cells of bounded size, which one task can search.

Edges are (u, v).  Cells are connected parts, grown by contraction: in a round half of
the clusters, by a coin, join the neighbour among the others that they share most edges
with, as long as it has room.  A round takes away a share of the clusters, so their
number of rounds is logarithmic in a cell's size, not in the graph's diameter.  Where
ids follow the map, ranges of them cut few edges and take no rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.sources.lineage import stored

#: Most nodes of a cell.
CELL = 1000
_MOST_ROUNDS = 60


def grown_cells(edges: DataFrame, most: int = CELL) -> DataFrame:
    """node, cell: connected cells of at most ``most`` nodes; a graph of no more is one cell."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    nodes = stored(both.select(F.col("a").alias("node")).distinct(), "cell-nodes")
    if nodes.limit(most + 1).count() <= most:
        return nodes.withColumn("cell", F.lit(0).cast("long"))
    labels = nodes.select("node", F.col("node").alias("cell"))
    sizes = labels.select("cell", F.lit(1).cast("long").alias("size"))
    links = stored(both.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "cell-links")
    idle = 0
    for t in range(_MOST_ROUNDS):
        joins = F.pmod(F.xxhash64("a", F.lit(t)), F.lit(2)) == 0
        asked = links.where(joins & (F.pmod(F.xxhash64("b", F.lit(t)), F.lit(2)) == 1))
        asked = asked.join(sizes.select(F.col("cell").alias("a"), F.col("size").alias("own")), "a").join(sizes.select(F.col("cell").alias("b"), F.col("size").alias("room")), "b")
        asked = asked.where(F.col("own") + F.col("room") <= most)
        # Few nodes and many common edges first, so that cells grow evenly.
        best = asked.groupBy("a", "own").agg(F.max(F.struct((F.col("n") / F.col("room")).alias("worth"), F.xxhash64("a", "b").alias("h"), "b", "room")).alias("to")).select("a", "own", "to.*")
        filled = F.sum("own").over(Window.partitionBy("b").orderBy(F.desc("worth"), "a"))
        moved = stored(best.withColumn("filled", filled).where(F.col("filled") + F.col("room") <= most).select("a", "b"), "cell-moves")
        if not moved.limit(1).count():
            idle += 1
            if idle == 4:  # no cluster with room for another
                break
            continue
        idle = 0
        to = moved.select(F.col("a").alias("cell"), F.col("b").alias("next"))
        labels = stored(labels.join(to, "cell", "left").select("node", F.coalesce("next", "cell").alias("cell")), "cell-labels")
        sizes = stored(labels.groupBy("cell").agg(F.count("*").alias("size")), "cell-sizes")
        for end in ("a", "b"):
            links = links.join(moved.select(F.col("a").alias(end), F.col("b").alias("next")), end, "left").withColumn(end, F.coalesce("next", end)).drop("next")
        links = stored(links.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n")), "cell-links")
    return labels


def ranged_cells(edges: DataFrame, most: int = CELL) -> DataFrame:
    """node, cell: runs of at most ``most`` nodes by id, not always connected (a stored table); a graph of no more is one cell."""
    nodes = stored(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cell-nodes")
    n = nodes.count()
    if n <= most:
        return nodes.withColumn("cell", F.lit(0).cast("long"))
    dealt = nodes.repartitionByRange(n // (8 * most) + 1, "node").sortWithinPartitions("node")
    return stored(dealt.withColumn("cell", F.expr(f"monotonically_increasing_id() div {most}")), "cell-ranges")


def celled_edges(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """edges with cu and cv, the cells of both ends (a stored table)."""
    ends = [cells.select(F.col("node").alias(n), F.col("cell").alias("c" + n)) for n in ("u", "v")]
    return stored(edges.join(ends[0], "u").join(ends[1], "v"), "celled-edges")
