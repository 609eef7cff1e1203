"""Graph operators over edges (u, v): weak and strong components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.operators.cells import celled_edges, grown_cells, ranged_cells
from cityloom.sources.lineage import stored

#: Most nodes of a cell.  Where nodes have more than _DENSE edges, cells have fewer, but _DENSE_CELL nodes.
CELL = 10_000
_DENSE_CELL, _DENSE = 1000, 16
# Rows of a contracted cell: a node and its group (alone for good, kept, or between kept ones), an edge (kept, or between all open groups).
_ALONE, _KEPT, _BETWEEN, _EDGE, _OPEN_EDGE = range(5)


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reached when directions don't count).

    In a round every root takes the least root that an edge leads to, trees are made flat
    by pointer jumping, and edges are drawn between the new roots; it ends when no edge
    is left.  Two rounds at least halve the roots that have edges.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "weak-edges")
    labels = None
    while True:
        flat = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "weak-roots")
        while True:
            far = flat.select(F.col("node").alias("root"), F.col("root").alias("far"))
            step = stored(flat.join(far, "root").select("node", "root", "far"), "weak-step")
            flat = step.select("node", F.col("far").alias("root"))
            if not step.where("far <> root").limit(1).count():
                break
        to = flat.select(F.col("node").alias("component"), F.col("root"))
        labels = flat.select("node", F.col("root").alias("component")) if labels is None else labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = stored(labels, "weak-labels")
        drawn = both.join(flat.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(flat.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        both = stored(drawn.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "weak-edges")
        if not both.limit(1).count():
            return labels


def _ends(edges: pd.DataFrame, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(edges):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.searchsorted(names, edges["u"]), np.searchsorted(names, edges["v"])


def _peeled(edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a cell that are left once those without an edge in or out have gone, again and again."""
    state = state.sort_values("node")
    u, v = _ends(edges, state["node"].to_numpy())
    n, live = len(state), np.ones(len(state), dtype=bool)
    come, go = state["comes"].to_numpy(dtype=bool), state["goes"].to_numpy(dtype=bool)
    while True:
        held = live[u] & live[v]
        keep = live & (come | (np.bincount(v[held], minlength=n) > 0)) & (go | (np.bincount(u[held], minlength=n) > 0))
        if keep.sum() == live.sum():
            return state.loc[keep, ["cell", "node"]]
        live = keep


def _draws(node: np.ndarray, t: int) -> np.ndarray:
    """A permutation of all 64-bit numbers, another one for each t."""
    x = node.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (t + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _coloured(edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Labels of a cell's nodes once each is the largest among those that reach it within the cell."""
    state = state.sort_values("node")
    u, v = _ends(edges, state["node"].to_numpy())
    label = state["label"].to_numpy().copy()
    if len(u):
        by = np.argsort(v, kind="stable")
        u, v = u[by], v[by]
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        while True:
            come = np.maximum.reduceat(label[u], at)
            if not (come > label[v[at]]).any():
                break
            label[v[at]] = np.maximum(label[v[at]], come)
    return state.assign(label=label)[["cell", "node", "label"]]


def _reaching(edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Marks of a cell's nodes once each that leads to a marked one of its colour has one."""
    state = state.sort_values("node")
    u, v = _ends(edges, state["node"].to_numpy())
    label, mark = state["label"].to_numpy(), state["mark"].to_numpy(dtype=bool).copy()
    same = label[u] == label[v]
    u, v = u[same], v[same]
    while len(u):
        new = u[mark[v] & ~mark[u]]
        if not len(new):
            break
        mark[new] = True
    return state.assign(mark=mark)[["cell", "node", "label", "mark"]]


def _in_cells(celled: DataFrame, state: DataFrame, kernel, schema: str) -> DataFrame:
    inner = celled.where("cu = cv").select(F.col("cu").alias("cell"), "u", "v")
    return inner.groupBy("cell").cogroup(state.groupBy("cell")).applyInPandas(kernel, schema)


def _trimmed(celled: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes without those that can't lie on a cycle for want of an edge in or out."""
    n = alive.count()
    while n:
        crossing = celled.where("cu <> cv")
        state = alive.join(crossing.select(F.col("v").alias("node"), F.lit(True).alias("comes")).distinct(), "node", "left")
        state = state.join(crossing.select(F.col("u").alias("node"), F.lit(True).alias("goes")).distinct(), "node", "left").fillna(False, ["comes", "goes"])
        alive = stored(_in_cells(celled, state, _peeled, "cell long, node long"), "scc-alive")
        m = alive.count()
        if m == n:
            break
        for end in ("u", "v"):
            celled = celled.join(alive.select(F.col("node").alias(end)), end, "left_semi")
        celled, n = stored(celled, "scc-edges"), m
    return celled, alive


def _spread(celled: DataFrame, state: DataFrame, kernel, schema: str, send) -> DataFrame:
    """state at its fixed point: kernel settles cells, then send(crossing edges, state) gives
    each node's state after what edges between cells bring, and whether it changed (moved)."""
    crossing = celled.where("cu <> cv")
    apart = crossing.limit(1).count()
    while True:
        state = stored(_in_cells(celled, state, kernel, schema), "scc-state")
        if not apart:
            return state
        sent = stored(send(crossing, state), "scc-sent")
        if not sent.where("moved").limit(1).count():
            return state
        state = sent.drop("moved")


def _send_labels(crossing: DataFrame, state: DataFrame) -> DataFrame:
    come = crossing.join(state.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.max("label").alias("come"))
    moved = F.coalesce(F.col("come") > F.col("label"), F.lit(False))
    return state.join(come, "node", "left").select("cell", "node", F.greatest("label", "come").alias("label"), moved.alias("moved"))


def _send_marks(crossing: DataFrame, state: DataFrame) -> DataFrame:
    marked = state.where("mark").select(F.col("node").alias("v"), "label")
    come = crossing.join(marked, "v").select(F.col("u").alias("node"), "label", F.lit(True).alias("come")).distinct()
    moved = F.col("come").isNotNull() & ~F.col("mark")
    return state.join(come, ["node", "label"], "left").select("cell", "node", "label", (F.col("mark") | F.col("come").isNotNull()).alias("mark"), moved.alias("moved"))


def _by_colours(celled: DataFrame, alive: DataFrame) -> DataFrame:
    """node, label (a node's own, or one that a component's nodes have in common).

    In a round nodes that can't lie on a cycle are trimmed; each other node takes the
    largest of random labels that reach it, its colour; the nodes of a colour that lead
    back to the label's own node are a component, found for all colours at once.  The
    rest goes on by colours, with new labels.  Tasks settle cells, joins carry labels
    between cells, so a round takes as many jobs as ways have cells, not edges.
    """
    celled, alive = stored(celled, "scc-edges"), stored(alive.select("cell", "node"), "scc-alive")
    cells, found, t = alive, [], 0
    while True:
        celled, alive = _trimmed(celled, alive)
        if not alive.limit(1).count():
            break

        def labelled(batches, t=t):
            for batch in batches:
                yield batch.assign(label=_draws(batch["node"].to_numpy(), t))

        state = alive.mapInPandas(labelled, "cell long, node long, label long")
        colours = _spread(celled, state, _coloured, "cell long, node long, label long", _send_labels)

        def rooted(batches, t=t):
            for batch in batches:
                yield batch.assign(mark=_draws(batch["node"].to_numpy(), t) == batch["label"].to_numpy())

        state = colours.mapInPandas(rooted, "cell long, node long, label long, mark boolean")
        marks = _spread(celled, state, _reaching, "cell long, node long, label long, mark boolean", _send_marks)
        whole = marks.where("mark")
        least = whole.groupBy("label").agg(F.min("node").alias("component"))
        found.append(stored(whole.join(least, "label").select("node", F.col("component").alias("label")), "scc-found"))
        rest = marks.where("NOT mark")
        for end in ("u", "v"):
            celled = celled.join(rest.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end)
        celled = stored(celled.where("lu = lv").select("u", "v", "cu", "cv"), "scc-edges")
        alive, t = stored(rest.select("cell", "node"), "scc-alive"), t + 1
    single = cells.select("node", F.col("node").alias("label"))
    for part in found:
        single = single.join(part, "node", "left_anti")
    for part in found:
        single = single.union(part)
    return single


def _strong(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Numbers of the strong components of nodes 0 to n - 1 (Tarjan's); an edge between two leads to the lower number."""
    to, first = v[np.argsort(u, kind="stable")].tolist(), np.searchsorted(np.sort(u), np.arange(n + 1)).tolist()
    at, seen, low, part = first[:-1], [0] * n, [0] * n, [-1] * n
    held, count, parts = [], 0, 0
    for root in range(n):
        if seen[root]:
            continue
        way = [root]
        while way:
            x = way[-1]
            if not seen[x]:
                count += 1
                seen[x] = low[x] = count
                held.append(x)
            if at[x] < first[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if not seen[y]:
                    way.append(y)
                elif part[y] < 0 and seen[y] < low[x]:
                    low[x] = seen[y]
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[x])
            if low[x] == seen[x]:
                while part[x] < 0:
                    part[held.pop()] = parts
                parts += 1
    return np.array(part, dtype=np.int64)


def _covers(ahead: list[list[int]], border: list[int], most: int) -> list[tuple[int, int]] | None:
    """Fewest pairs of border groups that keep which of them reach which, or None if more than most.
    ahead has the groups, each of a lower number, that edges of a group lead to."""
    bit = {p: i for i, p in enumerate(border)}
    reach, found = [0] * len(ahead), []
    for p, to in enumerate(ahead):
        rest = 0
        for q in to:
            rest |= reach[q]
        reach[p] = rest | (1 << bit[p] if p in bit else 0)
        while rest and p in bit:  # what the highest of them reaches needs no pair
            q = border[rest.bit_length() - 1]
            found.append((p, q))
            rest &= ~reach[q]
            if len(found) > most:
                return None
    return found


def _contracted(rows: pd.DataFrame) -> pd.DataFrame:
    """A cell's groups and edges from its edges (way 0) and the nodes that edges leave (1) or enter (2) it by.

    A group is a strong component within the cell, named by its smallest node.  It is open
    if a way from an entry to an exit goes through it; others are components of the whole
    graph.  Of the open ones those at entries and exits are kept, with edges that keep
    which of them reach which; all are kept if that takes fewer edges.
    """
    way, u, v = (rows[c].to_numpy() for c in ("way", "u", "v"))
    names = np.unique(np.concatenate([u, v[way == 0]]))
    u = np.searchsorted(names, u)
    inner = way == 0
    part = _strong(len(names), u[inner], np.searchsorted(names, v[inner]))
    k = int(part.max()) + 1
    group = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(group, part, names)
    leaves, enters = np.zeros(k, dtype=bool), np.zeros(k, dtype=bool)
    leaves[part[u[way == 1]]], enters[part[u[way == 2]]] = True, True
    pu, pv = part[u[inner]], part[np.searchsorted(names, v[inner])]
    pairs = np.unique((pu * k + pv)[pu != pv])
    pu, pv = np.divmod(pairs, k)
    ahead = [x.tolist() for x in np.split(pv, np.searchsorted(pu, np.arange(1, k)))]
    come, go = enters.tolist(), leaves.tolist()
    for p in range(k - 1, -1, -1):
        if come[p]:
            for q in ahead[p]:
                come[q] = True
    for p in range(k):
        go[p] = go[p] or any(go[q] for q in ahead[p])
    is_open = np.array(come) & np.array(go)
    border = is_open & (enters | leaves)
    held = is_open[pu] & is_open[pv]
    pu, pv = pu[held], pv[held]
    found = _covers([[q for q in to if is_open[q]] if is_open[p] else [] for p, to in enumerate(ahead)], np.flatnonzero(border).tolist(), len(pu)) if (is_open & ~border).any() else None
    kind = np.where(is_open, _KEPT, _ALONE) if found is None else np.where(border, _KEPT, np.where(is_open, _BETWEEN, _ALONE))
    out = [(kind[part], names, group[part])]
    if found is None:
        out.append((np.full(len(pu), _EDGE), group[pu], group[pv]))
    else:
        out.append((np.full(len(pu), _OPEN_EDGE), group[pu], group[pv]))
        a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
        out.append((np.full(len(a), _EDGE), group[a], group[b]))
    kinds, a, b = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"cell": rows["cell"].iloc[0], "kind": kinds, "a": a, "b": b})


def _filled(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Labels of a cell's groups that lie between kept ones of the same label."""
    none = pd.DataFrame({"node": np.zeros(0, np.int64), "label": np.zeros(0, np.int64)})
    if not len(edges) or not len(known):
        return none
    known = known.sort_values("label")
    node, label = known["node"].to_numpy(), known["label"].to_numpy()
    first = np.concatenate([[True], label[1:] != label[:-1]])
    # A ring of the kept groups of each label: from each to the next, from the last to the first.
    after = np.arange(1, len(node) + 1)
    after[np.append(first[1:], True)] = np.flatnonzero(first)
    names = np.unique(np.concatenate([edges["u"], edges["v"], node]))
    u = np.searchsorted(names, np.concatenate([edges["u"], node]))
    v = np.searchsorted(names, np.concatenate([edges["v"], node[after]]))
    part = _strong(len(names), u, v)
    of = np.full(int(part.max()) + 1, -1)
    of[part[np.searchsorted(names, node)]] = np.arange(len(node))
    new = (of[part] >= 0) & ~np.isin(names, node)
    return pd.DataFrame({"node": names[new], "label": label[of[part[new]]]}) if new.any() else none


def _level(celled: DataFrame) -> DataFrame:
    """cell, kind, a, b: the cells of a graph contracted (a stored table)."""
    crossing = celled.where("cu <> cv")
    out = crossing.select(F.col("cu").alias("cell"), F.lit(1).alias("way"), "u", F.lit(0).cast("long").alias("v"))
    into = crossing.select(F.col("cv").alias("cell"), F.lit(2).alias("way"), F.col("v").alias("u"), F.lit(0).cast("long").alias("v"))
    rows = celled.where("cu = cv").select(F.col("cu").alias("cell"), F.lit(0).alias("way"), "u", "v").union(out.union(into).distinct())
    return stored(rows.groupBy("cell").applyInPandas(_contracted, "cell long, kind int, a long, b long"), "scc-level")


def _above(celled: DataFrame, level: DataFrame) -> DataFrame:
    """Edges between the kept groups of a level (a stored table)."""
    crossing, kept = celled.where("cu <> cv").select("u", "v"), level.where(F.col("kind") == _KEPT)
    for end in ("u", "v"):
        crossing = crossing.join(kept.select(F.col("a").alias(end), F.col("b").alias("g" + end)), end)
    inner = level.where(F.col("kind") == _EDGE).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return stored(crossing.select(F.col("gu").alias("u"), F.col("gv").alias("v")).distinct().union(inner), "scc-edges")


def _group_labels(level: DataFrame, found: DataFrame | None) -> DataFrame:
    """node (an open group of the level), label; found has the labels of the graph above."""
    groups = level.where("a = b").select("cell", "kind", F.col("a").alias("node"))
    kept = groups.where(F.col("kind") == _KEPT).select("cell", "node")
    if found is None:
        return kept.select("node", F.col("node").alias("label"))
    kept = stored(kept.join(found, "node", "left").select("cell", "node", F.coalesce("label", "node").alias("label")), "scc-kept")
    # Nothing lies between kept groups if no two of a cell are in one component.
    two = kept.groupBy("cell", "label").agg(F.count("*").alias("n")).where("n > 1").select("cell").distinct()
    edges = level.where(F.col("kind") == _OPEN_EDGE).select("cell", F.col("a").alias("u"), F.col("b").alias("v"))
    filled = edges.groupBy("cell").cogroup(kept.join(two, "cell", "left_semi").groupBy("cell")).applyInPandas(_filled, "node long, label long")
    between = groups.where(F.col("kind") == _BETWEEN).join(filled, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    return kept.select("node", "label").union(between)


def _room(edges: DataFrame, most: int) -> tuple[int, int]:
    """The number of edges, and how many nodes a cell may have: fewer than most if edges are many."""
    n, starts, ends = edges.agg(F.count("*"), F.approx_count_distinct("u"), F.approx_count_distinct("v")).first()
    return n, min(most, max(_DENSE_CELL, _DENSE * most * max(starts, ends) // max(n, 1)))


def strong_components(edges: DataFrame, cells: DataFrame | None = None, most: int = CELL) -> DataFrame:
    """node, component (its smallest node), where a component's nodes reach each other.

    The graph is cut into cells (the first given as node, cell, or else ranges of node ids,
    or grown where these cut most edges).  A task contracts each cell to the groups at its
    entries and exits and to which of them reach which; that graph is cut and contracted in
    turn, until a cell holds it all.  Then labels go down again, level by level.  A graph
    that neither way of cutting makes smaller goes by colours.  So there are as many rounds
    as levels, whatever ways are long; no task sees more than a cell.
    """
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    # A node whose edges lack the other end has an edge to itself, and so has each node of given cells.
    edges = edges.select(F.coalesce(u, v).alias("u"), F.coalesce(v, u).alias("v")).where("u IS NOT NULL")
    if cells is not None:
        cells = cells.select(F.col("node").cast("long").alias("node"), F.col("cell").cast("long").alias("cell"))
        edges = edges.union(cells.select("node", "node"))
    edges = stored(edges.distinct(), "scc-given")
    levels, found, grow = [], None, False
    n, room = _room(edges, most)
    while n:
        parts = (None if grow else ranged_cells(edges, room)) if cells is None else cells
        celled = None if parts is None else celled_edges(edges, parts)
        if cells is None and (grow or 2 * celled.where("cu <> cv").count() > n):
            grow, parts = True, stored(grown_cells(edges, room), "scc-cells")
            celled = celled_edges(edges, parts)
        levels.append(_level(celled))
        edges, cells, before = _above(celled, levels[-1]), None, n
        n, room = _room(edges, most)
        little = 4 * n > 3 * before
        if little and grow:
            alive = levels[-1].where((F.col("kind") == _KEPT) & (F.col("a") == F.col("b"))).select("cell", F.col("a").alias("node"))
            found = _by_colours(celled_edges(edges, alive), alive)
            break
        grow = little
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for level in reversed(levels):
        open_groups = stored(_group_labels(level, found), "scc-labels")
        if level is levels[0]:
            least = open_groups.groupBy("label").agg(F.min("node").alias("least"))
            open_groups = open_groups.join(least, "label").select("node", F.col("least").alias("label"))
        nodes = level.where(F.col("kind") <= _BETWEEN).select(F.col("a").alias("node"), "kind", F.col("b").alias("group"))
        named = nodes.where(F.col("kind") != _ALONE).join(open_groups.withColumnRenamed("node", "group"), "group").select("node", "label")
        found = nodes.where(F.col("kind") == _ALONE).select("node", F.col("group").alias("label")).union(named)
    return found.withColumnRenamed("label", "component")


def largest_scc(edges: DataFrame, cells: DataFrame | None = None, most: int = CELL) -> DataFrame:
    """node of the largest strongly connected component (of equals, that of the smallest node)."""
    parts = stored(strong_components(edges, cells, most), "scc")
    best = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(best), "component", "left_semi").select("node")  # one row
