"""N-gram Jaccard join with vertical partitioning of a global n-gram order.

The global order puts n-grams by how often their bucket of a counting sketch occurs
(rare first, in steps of a few per cent), then by hash.  The sketch grows with the
number of rows.  The order is cut into fragments of about equal mass.

* Candidates share an n-gram among their first ``n - ceil(t n) + 1`` ones and pass the
  length and position bounds.  In each n-gram's list every document is first paired
  with one hub only; pairs that don't involve the hub are made for those documents
  that the hub's component doesn't reach.  So a group of near copies gives a star and
  not all its pairs, and no link that matters for components is lost.
* Overlaps are counted for each fragment by itself and summed for each pair.  The
  first fragment's count already rejects pairs whose remaining n-grams can't suffice.

Documents with equal sets are one class, told apart by 128 bits of a digest of the set;
a class is named by 63 of them, or by others where two classes would share a name.
N-grams of a text are compared by 64-bit hashes (see textops).  Rows of n-grams that
hold more than a thousandth of a list table are dealt to many tasks.

Texts that are null or without words have no n-grams and link with nothing.  A null
doc_id gets a null component.  Repeated rows are returned as often as they come; rows
that share a doc_id with another text keep results of their own.  Memory of a task
follows its longest text.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace, bit_set, components, may_hold, maybe_in, row_keys, spread_join
from cityloom.llm.textops import pieces, shingles, words

_BLOCKS = 32
_MOST = (1 << 31) - 1


def _sets(column: pa.Array, k: int):
    """(row, sorted distinct n-gram hashes) of each text."""
    for first, hashes, offsets, _, _ in words(column):
        grams, cuts = shingles(hashes, offsets, k)
        for r in range(len(cuts) - 1):
            yield first + r, np.unique(grams[cuts[r] : cuts[r + 1]])


def _digest(grams: np.ndarray, bits: int) -> tuple[int, int]:
    """128 bits (the first cut to bits) that tell sets of n-grams apart, as signed numbers."""
    data = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "big") >> (64 - bits), int.from_bytes(data[8:], "big", signed=True)


def _name(high: int, low: int, ambiguous: frozenset) -> int:
    return (low & 0xFFFFFFFFFFFFFFFF) >> 1 if high in ambiguous else high


def sketch_bits(rows: int) -> int:
    """Buckets as a power of two: about 32 a row, 2**16 to 2**24."""
    return min(24, max(16, (32 * rows).bit_length() - 1))


def _profile(docs: DataFrame, k: int, bits: int, name_bits: int) -> DataFrame:
    """kind 0: row key, doc_id, n and digest of a text; kind 1: sums of the counting sketch."""
    shift = np.uint64(64 - bits)

    def run(batches):
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        for batch in pieces(batches):
            n, high, low = np.zeros((3, batch.num_rows), dtype=np.int64)
            for r, grams in _sets(batch.column(3), k):
                n[r], (high[r], low[r]) = len(grams), _digest(grams, name_bits)
                at, c = np.unique(grams >> shift, return_counts=True)
                sketch[at.astype(np.int64)] += c.astype(np.uint32)
            zero = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(batch.num_rows, dtype=np.int32)), *batch.columns[:3], pa.array(n), pa.array(high), pa.array(low), zero, pa.nulls(batch.num_rows, pa.binary())], names
            )
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, _BLOCKS)]
        none = [pa.nulls(_BLOCKS, pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(_BLOCKS, dtype=np.int32)), *none, pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["kind", "row_a", "row_b", "doc_id", "n", "high", "low", "block", "counts"]
    rows = docs.select(*row_keys("doc_id", "text"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "kind int, row_a long, row_b long, doc_id long, n long, high long, low long, block int, counts binary")


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of a twelfth, as one byte."""
    return np.floor(8 * np.log2(1.0 + counts)).astype(np.uint8)


def _summed(profile: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The levels of all buckets, and how many n-grams are on each level."""

    def run(batches):
        total = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(data), dtype=np.uint32)
                total[block] = total[block] + part if block in total else part.astype(np.int64)
        levels = [_levels(np.minimum(x, _MOST)) for x in total.values()]
        mass = [np.bincount(v, weights=x, minlength=256).astype(np.int64) for v, x in zip(levels, total.values())]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (levels, mass))], ["block", "levels", "mass"])

    blocks = profile.where("kind = 1").select("block", "counts").repartition(_BLOCKS, "block").mapInArrow(run, "block int, levels binary, mass binary")
    levels, mass = np.zeros(1 << bits, dtype=np.uint8), np.zeros(256, dtype=np.int64)
    size = len(levels) // _BLOCKS
    for row in blocks.collect():
        levels[row.block * size : (row.block + 1) * size] = np.frombuffer(row.levels, dtype=np.uint8)
        mass += np.frombuffer(row["mass"], dtype=np.int64)
    return levels, mass


class Order:
    """The global order, by (level of the bucket, hash), and where fragments begin in it."""

    def __init__(self, levels: np.ndarray, mass: np.ndarray, fragments: int):
        self.levels = levels
        self.shift = np.uint64(64 - len(levels).bit_length() + 1)
        upto, total = np.cumsum(mass), int(mass.sum())
        cuts = []
        for share in (total * i / fragments for i in range(1, fragments)):
            at = int(np.searchsorted(upto, share, side="left"))
            inside = 1 - (upto[at] - share) / max(1, mass[at]) if total else 0.0
            cuts.append((at << 56) + int(inside * ((1 << 56) - 1)))
        self.cuts = np.array(cuts, dtype=np.uint64)
        mean = total / len(levels)
        self.crowded = int(_levels(np.array(mean + 6 * np.sqrt(mean)))) + 1  # least level of a crowded bucket

    def sort(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """n-grams in order, their fragments, and how many are in no crowded bucket."""
        level = self.levels[(grams >> self.shift).astype(np.int64)]
        key = (level.astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
        by = np.argsort(key, kind="stable")
        return grams[by], np.searchsorted(self.cuts, key[by], side="right"), int((level < self.crowded).sum())


def _lists(docs: DataFrame, k: int, shared, num: int, den: int, name_bits: int) -> DataFrame:
    """Postings of prefixes (token set) and first fragments (token null), one text of
    each class in a task."""
    names = ["token", "node", "hub", "n", "pos", "part"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def run(batches):
        seen = set()
        order, ambiguous = shared.value
        for batch in pieces(batches):
            tokens, rows, parts = [], [], []
            for _, grams in _sets(batch.column(0), k):
                n = len(grams)
                digest = _digest(grams, name_bits)
                if not n or digest in seen:
                    continue
                seen.add(digest)
                name = _name(*digest, ambiguous)
                ordered, fragment, rare = order.sort(grams)
                prefix = n - -(-num * n // den) + 1
                hub = (min(rare, (1 << 20) - 1) << 43) | (name >> 20)
                tokens.append(ordered[:prefix])
                rows.append((name, hub, n, prefix))
                parts.append(ordered[fragment == 0].view(np.int64))
            if not rows:
                continue
            node, hub, n, prefix = (np.array(x, dtype=np.int64) for x in zip(*rows))
            total = int(prefix.sum())
            ends = np.cumsum(prefix)
            pos = np.arange(total) - np.repeat(ends - prefix, prefix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(node, prefix)), pa.array(np.repeat(hub, prefix)), pa.array(np.repeat(n, prefix).astype(np.int32)), pa.array(pos.astype(np.int32)), pa.nulls(total, kinds[5])],
                names,
            )
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(rows), pa.int64()), pa.array(node), pa.array(hub), pa.array(n.astype(np.int32)), pa.nulls(len(rows), pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts)))],
                names,
            )

    out = docs.select("text").mapInArrow(run, "token long, node long, hub long, n int, pos int, part array<bigint>")
    return out.withColumn("posting", F.col("token").isNotNull())


def _fragments(docs: DataFrame, ids: DataFrame, k: int, shared, name_bits: int, work: Workspace) -> DataFrame:
    """node, fragment, part of texts whose row key may be in ids, all fragments but the first."""
    held = bit_set(ids, "row_a", work)

    def run(batches):
        order, ambiguous = shared.value
        for batch in pieces(batches):
            if held is not None:
                batch = batch.filter(pa.array(may_hold(held.value, batch.column(1).to_numpy())))
            out_nodes, out_fragments, parts = [], [], []
            for _, grams in _sets(batch.column(0), k):
                ordered, fragment, _ = order.sort(grams)
                name = _name(*_digest(grams, name_bits), ambiguous)
                for f in np.unique(fragment):
                    if f:
                        out_nodes.append(name)
                        out_fragments.append(int(f))
                        parts.append(np.sort(ordered[fragment == f]).view(np.int64))
            if parts:
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_nodes, pa.int64()), pa.array(out_fragments, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(parts)))],
                    ["node", "fragment", "part"],
                )

    keyed = docs.select("text", row_keys("doc_id", "text")[0])
    keyed = keyed if held is not None else keyed.join(ids, "row_a", "left_semi").select("text", "row_a")
    return keyed.mapInArrow(run, "node long, fragment int, part array<bigint>").dropDuplicates(["node", "fragment"])


def _need(num: int, den: int) -> str:
    """SQL: the least overlap of sets of na and nb n-grams that link."""
    return f"CAST(ceil({num} * CAST(na + nb AS DOUBLE) / {num + den}) AS INT)"


def _verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, classes: DataFrame, k: int, shared, num: int, den: int, name_bits: int, work: Workspace) -> DataFrame:
    """The pairs (a, b, na, nb) that link; overlaps are counted by fragment."""
    left = first.select(F.col("node").alias("a"), F.col("part").alias("pa"))
    right = first.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.expr(_need(num, den)).alias("need"),
        F.size(F.array_intersect("pa", "pb")).alias("got"),
        F.least(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb")).alias("rest"),
    )
    hopeful = work.written(both.where("got + rest >= need").select("a", "b", "need", "got"), "jaccard-hopeful")
    nodes = hopeful.select(F.col("a").alias("node")).union(hopeful.select(F.col("b").alias("node"))).distinct()
    ids = work.written(nodes.join(classes, "node").select("row_a"), "jaccard-wanted")
    parts = work.written(_fragments(docs, ids, k, shared, name_bits, work), "jaccard-fragments")
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("pa"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("pb"))
    counts = (
        hopeful.select("a", "b", "need").join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "need", F.size(F.array_intersect("pa", "pb")).alias("got"))
    )
    summed = hopeful.union(counts).groupBy("a", "b", "need").agg(F.sum("got").alias("got"))
    links = work.written(summed.where("got >= need").select("a", "b"), "jaccard-links")
    work.drop(hopeful, ids, parts)
    return links


def _bounded(x: str, y: str, num: int, den: int) -> str:
    """SQL: two postings of one n-gram, aliased x and y, may link by length and position."""
    return (
        f"{den} * least({x}n, {y}n) >= {num} * greatest({x}n, {y}n) AND "
        f"{num + den} * least({x}n - {x}pos, {y}n - {y}pos) >= {num} * ({x}n + {y}n)"
    )


def _pair(x: str, y: str) -> list[str]:
    swap = f"{x}node < {y}node"
    return [f"least({x}node, {y}node) AS a", f"greatest({x}node, {y}node) AS b", f"if({swap}, {x}n, {y}n) AS na", f"if({swap}, {y}n, {x}n) AS nb"]


def linked_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, fragments: int = 16, name_bits: int = 63) -> DataFrame:
    """row_a, row_b (the row's key), doc_id, n_shingles, component_id: the smallest doc_id
    that links reach, where two texts link when den * |common n-grams| >= num * |all
    n-grams of both|.

    name_bits below 63 let classes share names, for tests of what happens then.
    """
    work = Workspace(docs.sparkSession)
    bits = sketch_bits(docs.count())
    profile = work.written(_profile(docs, k, bits, name_bits), "jaccard-profile", ("kind",))
    rows = profile.where("kind = 0").select("row_a", "row_b", "doc_id", "n", "high", "low")
    order = Order(*_summed(profile, bits), fragments)
    named = rows.where("n > 0").groupBy("high", "low").agg(F.min("row_a").alias("row_a"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    named = work.written(named, "jaccard-named")
    twice = [r.high for r in named.groupBy("high").count().where("count > 1").limit(10_001).collect()]
    if len(twice) > 10_000:  # chance gives a few for as many texts as there are anywhere
        raise RuntimeError("too many classes share a name")
    node = F.when(F.col("high").isin(twice), F.shiftrightunsigned("low", 1)).otherwise(F.col("high")).alias("node")
    classes = work.written(named.select(node, "row_a", "least_id", "copies"), "jaccard-classes")
    if twice and classes.groupBy("node").count().where("count > 1").limit(1).count():
        raise RuntimeError("two classes share both names")
    shared = work.share((order, frozenset(twice)))

    # A class has a list entry from every task that met it; they are equal.
    lists = work.written(_lists(docs, k, shared, num, den, name_bits), "jaccard-lists", ("posting",))
    postings = lists.where("posting").select("token", "node", "hub", "n", "pos")
    first = work.written(lists.where("NOT posting").select("node", "part").dropDuplicates(["node"]), "jaccard-first")
    hubs = postings.groupBy("token").agg(F.min("hub").alias("least"), F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("c")).where("low < high")
    hubs = work.written(hubs.select("token", "least", "c"), "jaccard-hubs")
    much = max(1000, (hubs.agg(F.sum("c")).first()[0] or 0) // 1000)  # as many n-grams at most hold more
    hot = hubs.where(F.col("c") > much).select("token")
    some, _ = maybe_in(postings, "token", hubs.select("token"), work)  # most n-grams have one posting
    candidates = work.written(spread_join(some, hubs.select("token", "least"), ["token"], hot).distinct(), "jaccard-shared")
    work.drop(lists)
    hub = candidates.where("hub = least").select("token", F.col("node").alias("hub_node"), F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos"))
    met = spread_join(candidates.select("token", "node", "n", "pos"), hub, ["token"], hot)
    pairs = met.where(f"node <> hub_node AND {_bounded('', 'hub_', num, den)}").selectExpr(*_pair("", "hub_")).distinct()
    pairs = work.written(pairs, "jaccard-pairs")
    wanted = (first, docs, classes, k, shared, num, den, name_bits, work)
    links = _verified(pairs, *wanted)

    # What the hubs' components don't hold is compared with the rest of its lists.
    reached = components(links, work)
    label = reached.select("node", F.col("component").alias("near"))
    placed = work.written(candidates.join(label, "node", "left").withColumn("near", F.coalesce("near", "node")), "jaccard-placed")
    centre = placed.where("hub = least").select("token", F.col("node").alias("hub_node"), F.col("near").alias("hub_near"))
    outside = spread_join(placed, centre, ["token"], hot).where("near <> hub_near AND node <> hub_node").select("token", "node", "n", "pos", "near").distinct()
    others = placed.where("hub <> least").selectExpr("token", "node AS o_node", "n AS o_n", "pos AS o_pos", "near AS o_near")
    again = outside.join(others, "token").where(f"near <> o_near AND {_bounded('', 'o_', num, den)}").selectExpr(*_pair("", "o_")).distinct()
    again = work.written(again, "jaccard-pairs")
    work.drop(candidates, placed, pairs)
    more = _verified(again, *wanted)

    # A component's id is the smallest doc_id of its classes; links found later join those found before.
    found = reached
    if more.limit(1).count():
        whole = work.written(more.union(reached.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))), "jaccard-links")
        found = components(whole, work)
    ends = classes.join(found, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least = ends.groupBy("component").agg(F.min("least_id").alias("component_id"))
    answer = work.written(ends.join(least, "component").select("node", "component", "component_id"), "jaccard-answer")
    kept = work.written(rows.select("row_a", "row_b", "doc_id", "n", F.when(F.col("n") > 0, node).alias("node")), "jaccard-rows")
    much = max(1000, kept.count() // 1000)  # as many classes at most hold more rows
    crowded = classes.where(F.col("copies") > much).select("node")
    work.close(answer, kept, classes)
    out = spread_join(kept, answer, ["node"], crowded, "left")
    id_or_null = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("row_a", "row_b", "doc_id", F.col("n").alias("n_shingles"), "component", id_or_null.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those that links join to one that stays: of every component the row
    with the smallest doc_id (null ones last), then row key.

    Rows are told apart by doc_id and text, so rows that share a doc_id with another
    text stay or go by their own text.  Of repeated rows one stays.  Texts without
    words all stay.
    """
    work = Workspace(docs.sparkSession)
    found = work.written(linked_components(docs, **options).where("component IS NOT NULL").select("row_a", "row_b", "doc_id", "component"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_a", "row_b")
    first = found.groupBy("component").agg(F.min(order).alias("first"))
    crowd = max(1000, found.count() // 1000)
    hot = found.groupBy("component").count().where(F.col("count") > crowd).select("component")
    placed = spread_join(found, first, ["component"], hot).withColumn("stays", (F.col("row_a") == F.col("first.row_a")) & (F.col("row_b") == F.col("first.row_b")))
    gone = work.written(placed.where("NOT stays").select("row_a", "row_b").distinct(), "groups-gone")
    again = work.written(placed.where("stays").groupBy("row_a", "row_b").count().where("count > 1").select("row_a", "row_b"), "groups-again")
    work.drop(found)
    a, b = row_keys("doc_id", "text")
    keyed = docs.select("*", a.alias("_row_a"), b.alias("_row_b"))
    named = lambda df: df.withColumnsRenamed({"row_a": "_row_a", "row_b": "_row_b"})
    key = ["_row_a", "_row_b"]
    some, rest = maybe_in(keyed, "_row_a", named(gone), work)
    kept = some.join(named(gone), key, "left_anti")
    kept = kept if rest is None else kept.unionByName(rest)
    if again.limit(1).count():
        some, rest = maybe_in(kept, "_row_a", named(again), work)
        both = some.join(named(again), key, "left_semi").dropDuplicates(key)
        kept = both.unionByName(some.join(named(again), key, "left_anti"))
        kept = kept if rest is None else kept.unionByName(rest)
    return kept.select(*docs.columns)


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, by three words and 90 of 100."""
    return linked_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = s.doc_id
"""
