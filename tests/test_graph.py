"""Strong components and shortest paths over cells against plain searches."""

import heapq
import random
from collections import defaultdict

import pandas as pd
import pytest

from cityloom.operators import cells, graph, routing


def heap_trees(rows, dests):
    """(dest, node, dist, next_node) by a heap on the reversed graph."""
    back, ahead = defaultdict(list), defaultdict(list)
    best = {}
    for u, v, w in rows:
        best[u, v] = min(w, best.get((u, v), w))
    for (u, v), w in best.items():
        if u != v:
            back[v].append((u, w))
            ahead[u].append((v, w))
    nodes = {n for u, v, _ in rows for n in (u, v)}
    out = set()
    for d in dests:
        if d not in nodes:
            continue
        dist, heap = {d: 0.0}, [(0.0, d)]
        while heap:
            far, x = heapq.heappop(heap)
            if far > dist[x]:
                continue
            for y, w in back[x]:
                if far + w < dist.get(y, float("inf")):
                    dist[y] = far + w
                    heapq.heappush(heap, (dist[y], y))
        for n, far in dist.items():
            out.add((d, n, far, d if n == d else min(v for v, w in ahead[n] if v in dist and dist[v] + w == far)))
    return out


def plain_components(rows):
    """node -> smallest node of its strong component, by depth-first search without recursion."""
    ahead, nodes = defaultdict(list), sorted({n for e in rows for n in e[:2]})
    back = defaultdict(list)
    for u, v in {e[:2] for e in rows}:
        ahead[u].append(v)
        back[v].append(u)
    seen, order = set(), []
    for root in nodes:
        stack = [(root, 0)]
        while stack:
            x, i = stack.pop()
            if i == 0:
                if x in seen:
                    continue
                seen.add(x)
            if i < len(ahead[x]):
                stack.append((x, i + 1))
                if ahead[x][i] not in seen:
                    stack.append((ahead[x][i], 0))
            else:
                order.append(x)
    label = {}
    for root in reversed(order):
        if root in label:
            continue
        part, stack = [], [root]
        label[root] = None
        while stack:
            x = stack.pop()
            part.append(x)
            for y in back[x]:
                if y not in label:
                    label[y] = None
                    stack.append(y)
        for x in part:
            label[x] = min(part)
    return label


def lattice(side, rng, one_way=0.2):
    """Streets between neighbours of a square, some one-way, with whole lengths."""
    rows = []
    for r in range(side):
        for c in range(side):
            for to in ((r, c + 1), (r + 1, c)):
                if to[0] < side and to[1] < side:
                    a, b, w = r * side + c, to[0] * side + to[1], float(rng.randrange(50, 400))
                    way = rng.random()
                    if way > one_way / 2:
                        rows.append((a, b, w))
                    if way < 1 - one_way / 2:
                        rows.append((b, a, w + rng.randrange(3)))
    return rows


EDGES = "u long, v long, cost double"


def test_cells_are_connected_and_bounded(spark):
    rows = lattice(30, random.Random(1))
    found = {r.node: r.cell for r in cells.grown_cells(spark.createDataFrame(rows, EDGES), 60).collect()}
    assert set(found) == set(range(900))
    near = defaultdict(set)
    for u, v, _ in rows:
        if found[u] == found[v]:
            near[u].add(v)
            near[v].add(u)
    parts = defaultdict(set)
    for n, c in found.items():
        parts[c].add(n)
    assert max(map(len, parts.values())) <= 60 and len(parts) <= 60
    for part in parts.values():
        reached, todo = set(), [next(iter(part))]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += near[x] - reached
        assert reached == part


def test_paths_on_streets_equal_a_heap_search(spark):
    rows = lattice(22, random.Random(2)) + [(1000, 1001, 5.0), (3, 3, 1.0), (5, 6, None)]
    dests = [0, 250, 483, 1001, 1000, 77777]
    df = spark.createDataFrame(rows, EDGES)
    got = routing.path_trees(df, spark.createDataFrame([(d,) for d in dests], "node_id long"), most=50)
    assert {tuple(r) for r in got.select("dest", "node", "dist", "next_node").collect()} == heap_trees([r for r in rows if r[2] is not None], dests)


@pytest.mark.parametrize("most", [1000, 12])
def test_paths_on_a_random_graph_equal_a_heap_search(spark, most):
    """Dense between cells: cells put their own edges into the overlay."""
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(1, 9))) for _ in range(400)]
    dests = list(range(0, 60, 7))
    got = routing.path_trees(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(d,) for d in dests], "node_id long"), most=most)
    assert {tuple(r) for r in got.select("dest", "node", "dist", "next_node").collect()} == heap_trees(rows, dests)


def test_paths_in_given_cells_and_without_edges(spark):
    rows = lattice(12, random.Random(5))
    squares = spark.createDataFrame([(n, n // 12 // 4 * 3 + n % 12 // 4) for n in range(144)], "node long, cell long")
    got = routing.path_trees(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(7,)], "node_id long"), cells=squares)
    assert {tuple(r) for r in got.select("dest", "node", "dist", "next_node").collect()} == heap_trees(rows, [7])
    assert routing.path_trees(spark.createDataFrame([], EDGES), spark.createDataFrame([(7,)], "node_id long")).count() == 0


@pytest.mark.parametrize(("kind", "most"), [("random", 1000), ("random", 10), ("chain", 10), ("rings in a row", 10), ("one giant", 10)])
def test_strong_components_equal_a_depth_first_search(spark, kind, most):
    rng = random.Random(len(kind))
    n = 48
    names = rng.sample(range(-500, 500), n)
    if kind == "random":
        rows = [(rng.choice(names), rng.choice(names)) for _ in range(60)]
    elif kind == "chain":
        rows = list(zip(names, names[1:]))
    elif kind == "rings in a row":
        rows = [e for i in range(0, n, 4) for e in [*zip(names[i : i + 4], [*names[i + 1 : i + 4], names[i]]), (names[i + 3], names[(i + 4) % n])] if not (i == n - 4 and e[1] == names[0])]
    else:
        rows = list(zip(names, [*names[1:], names[0]])) + [(600 + i, names[i]) for i in range(5)]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(rows, "u long, v long"), most=most).collect()}
    want = plain_components(rows)
    assert got == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    first = min(sizes, key=lambda c: (-sizes[c], c))
    if most == 1000:
        assert {r.node for r in graph.largest_scc(spark.createDataFrame(rows, "u long, v long"), most=most).collect()} == {n for n, c in want.items() if c == first}


def test_a_cell_passes_on_distances_at_its_entries_only():
    """A ring of six with an edge out: no shortcuts between entries and heads are kept."""
    ring = [(i, (i + 1) % 6, 1.0 + i) for i in range(6)] + [(2, 50, 4.0)]
    rows = pd.DataFrame([(9, 0, *e) for e in ring] + [(9, 1, 0, -1, 0.0), (9, 1, 4, -1, 0.0)], columns=["cell", "kind", "u", "v", "w"])
    cell = routing._packed(rows)
    assert len(cell) == 1 and len(cell["tail"][0]) == len(ring)
    got = routing._passed(cell, pd.DataFrame({"dest": [77, 50], "node": [50, 50], "dist": [10.0, 0.0]}))
    assert sorted(got.itertuples(index=False, name=None)) == [(50, 0, 7.0), (50, 4, 18.0), (77, 0, 17.0), (77, 4, 28.0)]


def meanders(wide, high):
    """Streets of a map whose ids go row by row; the nearest way along any two rows goes to and fro between them."""
    rows = []
    for r in range(high):
        for c in range(wide):
            a = r * wide + c
            if c + 1 < wide:
                rows += [(a, a + 1, 1.0 if (r + c) % 2 else 90.0), (a + 1, a, 95.0 + c % 7)]
            if r + 1 < high:
                rows += [(a, a + wide, 2.0), (a + wide, a, 2.0 + (r + c) % 2)]
    return rows


def test_paths_along_borders_take_turns(spark, monkeypatch):
    """Ways that go to and fro between rows: pairs of ranges, in turn, hold those along a border whole."""
    tables = []
    monkeypatch.setattr(routing, "stored", lambda df, tag, made=routing.stored: tables.append(tag) or made(df, tag))
    rows = meanders(24, 30) + [(5000, 5001, 5.0), (3, 3, 1.0), (5, 6, None)]
    dests = [0, 263, 500, 719, 5001, 77777]
    got = routing.path_trees(spark.createDataFrame(rows, EDGES), spark.createDataFrame([(d,) for d in dests], "node_id long"), most=240)
    assert {tuple(r) for r in got.select("dest", "node", "dist", "next_node").collect()} == heap_trees([r for r in rows if r[2] is not None], dests)
    assert "path-ranges" in tables and "path-grown" not in tables and tables.count("path-best") <= 10


def test_a_town_is_one_cell(spark, monkeypatch):
    """12,100 nodes take no rounds between cells."""
    tables = []
    monkeypatch.setattr(routing, "stored", lambda df, tag, made=routing.stored: tables.append(tag) or made(df, tag))
    rows = lattice(110, random.Random(4))
    got = routing.path_trees(spark.createDataFrame(pd.DataFrame(rows, columns=["u", "v", "cost"])), spark.createDataFrame([(7,), (12000,)], "node_id long"))
    assert {tuple(r) for r in got.select("dest", "node", "dist", "next_node").collect()} == heap_trees(rows, [7, 12000])
    assert "path-best" not in tables


def test_packed_cells_are_put_together():
    """Two neighbouring cells, packed apart, pass on what they pass on as one."""
    rows = [(u, v, w) for u, v, w in meanders(6, 8) if u < 36]  # edges that leave the last row's cell aren't there
    frame = lambda rows, cell: pd.DataFrame([(cell, 0, *e) for e in rows] + [(cell, 1, n, -1, 0.0) for n in (0, 17, 18, 35) if any(e[0] == n for e in rows)], columns=["cell", "kind", "u", "v", "w"])
    apart = pd.concat([routing._as_bytes(frame([e for e in rows if e[0] < 18], 0)), routing._as_bytes(frame([e for e in rows if e[0] >= 18], 1))])
    known = pd.DataFrame({"dest": [2, 9, 9], "node": [2, 38, 41], "dist": [0.0, 7.0, 1.0]})
    got, want = (sorted(routing._passed(cell, known).itertuples(index=False, name=None)) for cell in (apart, routing._packed(frame(rows, 0))))
    assert got == want and len(got) == 8


@pytest.mark.parametrize("kind", ["one ring", "rings in a row", "streets"])
def test_strong_components_take_levels_not_rounds_along_ways(spark, monkeypatch, kind):
    """Ways through 20 cells: few working tables, labels of nodes between entries and exits."""
    tables = []
    monkeypatch.setattr(graph, "stored", lambda df, tag, made=graph.stored: tables.append(tag) or made(df, tag))
    n = 240
    if kind == "one ring":
        rows = [(i, (i + 1) % n) for i in range(n)]
    elif kind == "rings in a row":
        rows = [e for i in range(0, n, 4) for e in [(i, i + 1), (i + 1, i + 2), (i + 2, i + 3), (i + 3, i), (i + 3, i + 4)]]
    else:
        rows = [r[:2] for r in lattice(15, random.Random(8), 1.6)]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(rows, "u long, v long"), most=24 if kind == "streets" else 12).collect()}
    assert got == plain_components(rows)
    assert len(tables) <= 25 and "scc-alive" not in tables


def test_a_contracted_cell_keeps_what_reaches_what():
    """Random cells: closed groups are whole, kept ones reach each other as before, by no more edges."""
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randrange(1, 30)
        edges = [(0, rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))]
        given = edges + [(rng.choice([1, 2]), rng.randrange(n), 0) for _ in range(rng.randrange(1, 8))]
        got = graph._contracted(pd.DataFrame(given, columns=["way", "u", "v"]).assign(cell=5))
        label = plain_components([e[1:] for e in edges] + [(e[1], e[1]) for e in given])
        nodes = got[got["kind"] <= graph._BETWEEN]
        assert dict(zip(nodes["a"], nodes["b"])) == label

        def reached(pairs):
            far = {(x, x) for x in set(label.values())} | set(pairs)
            while True:
                more = {(a, d) for a, b in far for c, d in far if b == c} - far
                if not more:
                    return far
                far |= more

        full = reached({(label[u], label[v]) for _, u, v in edges})
        enters, leaves = ({label[u] for way, u, _ in given if way == w} for w in (2, 1))
        is_open = {x for x in label.values() if any((e, x) in full for e in enters) and any((x, e) in full for e in leaves)}
        kind = dict(zip(nodes["b"], nodes["kind"]))
        assert {x for x in kind if kind[x] != graph._ALONE} == is_open
        kept = {x for x in kind if kind[x] == graph._KEPT}
        assert kept >= is_open & (enters | leaves)
        by = got[got["kind"] == graph._EDGE]
        given_pairs = {(label[u], label[v]) for _, u, v in edges if label[u] != label[v] and {label[u], label[v]} <= is_open}
        assert {p for p in reached(zip(by["a"], by["b"])) if set(p) <= kept} == {p for p in full if set(p) <= kept} and len(by) <= len(given_pairs)


def test_cells_of_dense_graphs_have_fewer_nodes(spark):
    ring = spark.range(3000).selectExpr("id AS u", "(id + 1) % 3000 AS v")
    dense = spark.range(60).selectExpr("id AS k").crossJoin(ring.select("u")).selectExpr("u", "(u + k * k + 1) % 3000 AS v").distinct()
    assert graph._room(ring, 10_000) == (3000, 10_000)
    n, room = graph._room(dense, 10_000)
    assert n == dense.count() and 1000 <= room < 5000
    assert graph._room(dense, 50) == (n, 50) and graph._room(ring.limit(0), 10_000)[0] == 0
