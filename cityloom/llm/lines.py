"""Line dedup: content-defined chunks of lines that repeat anywhere are removed.

Lines end at line feeds (a missing one at the end counts as there).  A boundary stands
after a line where a rolling hash of it and the line before it falls in any but one of
``spread`` classes, so boundaries find back into step after lines put in or taken out.
From each line a chunk runs to the first boundary that leaves it ``least_lines`` lines, or
to the text's end: a chunk depends on its own lines alone, whatever stands around it.  Of
the repeated passages of two lines, 1 - 1 / spread hold a chunk; longer ones nearly always
do, and lose at most their last lines behind the last boundary.  windows=True adds all
stretches of two lines, which finds every repeated passage.  A line of at least
``long_line`` words is a unit by itself (0: none is).

Units are looked up in all texts by 128-bit digests.  The first place of a unit
(smallest doc_id, then row, then place in the text) stays; elsewhere its lines go, but for
lines that belong to another unit's first place.  Before that the bytes of all places of
a unit are compared: a unit whose places differ stays everywhere.

A null doc_id comes after all others.  Null texts stay null and empty ones empty.
Repeated rows with equal doc_id and text count as one place, so they end up equal.
Extra columns stay.  Memory of a task follows its longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace, bit_set, may_hold, maybe_in, row_keys, spread_join
from cityloom.llm.textops import pieces

_LAST = (1 << 63) - 1


def split_lines(text: bytes) -> list[bytes]:
    """Lines without their line feeds."""
    parts = text.split(b"\n")
    if not parts[-1]:
        parts.pop()
    return parts


#: Classes of the rolling hash, of which all but one are boundaries.
SPREAD = 16


def chunks(lines: list[bytes], spread: int = SPREAD) -> list[int]:
    """The boundaries: first lines after them, 0 and the number of lines."""
    hashes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in lines]
    cuts = [i + 1 for i in range(len(lines)) if (3 * hashes[i - 1] * (i > 0) + hashes[i]) % (1 << 64) % (spread << 20) >> 20 != 0]
    return sorted({0, *cuts, len(lines)})


def units(text: bytes, spread: int, least_lines: int, long_line: int, windows: bool) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(first line, number of lines) of each unit of a text, and its lines."""
    lines = split_lines(text)
    edges, out, at = chunks(lines, spread), [], 0
    for i in range(len(lines) - least_lines + 1):
        while edges[at] < i + least_lines:
            at += 1
        out.append((i, edges[at] - i))
        if windows and edges[at] - i > 2:
            out.append((i, 2))
    if long_line:
        out += [(i, 1) for i, x in enumerate(lines) if len(x) >= 2 * long_line - 1 and len(x.split()) >= long_line]
    return out, lines


_DIGEST = {"digest_size": 16}


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(*row_keys("doc_id", "text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")


def _places(documents: DataFrame, options: tuple) -> DataFrame:
    """row_a, row_b, doc_id, place (first line and number of lines), high, low (a digest) of all units."""

    def run(batches):
        for batch in pieces(batches):
            rows, places, digests = [], [], []
            for r, text in enumerate(batch.column(3).cast(pa.large_binary()).to_pylist()):
                if text:
                    found, lines = units(text, *options)
                    for first, n in found:
                        rows.append(r)
                        places.append(first << 32 | n)
                        digests.append(hashlib.blake2b(b"\n".join(lines[first : first + n]), **_DIGEST).digest())
            at = pa.array(rows, pa.int64())
            words = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(places, pa.int64()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names)

    names = ["row_a", "row_b", "doc_id", "place", "high", "low"]
    return _rows(documents).mapInArrow(run, "row_a long, row_b long, doc_id long, place long, high long, low long")


def _differing(documents: DataFrame, firsts: DataFrame, options: tuple, work: Workspace) -> DataFrame:
    """high, low of repeated units whose places don't all have the same bytes.

    A task compares the places of a batch and passes on each body once; a unit's least
    and greatest body differ just where any two do.
    """
    held = bit_set(firsts.select("high"), "high", work)

    def run(batches):
        for batch in pieces(batches):
            known: set[tuple[bytes, bytes]] = set()
            for text in batch.column(0).cast(pa.large_binary()).to_pylist():
                if not text:
                    continue
                found, lines = units(text, *options)
                bodies = [b"\n".join(lines[first : first + n]) for first, n in found]
                digests = [hashlib.blake2b(x, **_DIGEST).digest() for x in bodies]
                keep = np.ones(len(bodies), dtype=bool)
                if held is not None:
                    keep = may_hold(held.value, np.frombuffer(b"".join(digests), dtype="<i8")[::2])
                known.update((digests[i], bodies[i]) for i in np.flatnonzero(keep))
            keys = np.frombuffer(b"".join(d for d, _ in known), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([b for _, b in known], pa.binary())], ["high", "low", "body"])

    bodies = documents.select("text").mapInArrow(run, "high long, low long, body binary")
    if held is None:
        bodies = bodies.join(firsts.select("high", "low"), ["high", "low"], "left_semi")
    return bodies.groupBy("high", "low").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("high", "low")


def repeated_units(documents: DataFrame, options: tuple, work: Workspace) -> DataFrame:
    """row_a, row_b, doc_id, gone and held: the places that go, and the first places of
    repeated units, for each text that has any that go (a table of work)."""
    places = work.written(_places(documents, options), "line-places")
    at = F.struct("doc_id", "row_a", "row_b", "place")
    first = places.groupBy("high", "low").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("first <> last")
    first = work.written(first.select("high", "low", "first", "n"), "line-firsts")
    wrong = work.written(_differing(documents, first, options, work), "line-differing")
    right = first.join(wrong, ["high", "low"], "left_anti").select("high", "low", "first")
    much = max(1000, places.count() // 1000)  # so at most a thousand are hot
    hot = first.where(F.col("n") > much).select("high", "low")
    found = spread_join(places, right, ["high", "low"], hot).select("row_a", "row_b", "doc_id", "place", (at == F.col("first")).alias("is_first"))
    out = found.groupBy("row_a", "row_b", "doc_id").agg(
        F.collect_set(F.when(~F.col("is_first"), F.col("place"))).alias("gone"), F.collect_set(F.when(F.col("is_first"), F.col("place"))).alias("held")
    ).where("size(gone) > 0")
    out = work.written(out, "line-gone")
    work.close(out)
    return out


def deduplicated(documents: DataFrame, spread: int = SPREAD, least_lines: int = 2, long_line: int = 50, windows: bool = False) -> DataFrame:
    """documents with repeated units removed from text, and _removed_chunks int: the runs of
    lines removed (columns of that name and _row_a, _row_b, _id, _maybe, gone and held are replaced)."""
    documents = documents.drop("_removed_chunks", "_row_a", "_row_b", "_id", "_maybe", "gone", "held")
    found = repeated_units(documents, (spread, least_lines, long_line, windows), Workspace(documents.sparkSession))
    found = found.withColumnsRenamed({"row_a": "_row_a", "row_b": "_row_b", "doc_id": "_id"})
    keys = dict(zip(("_row_a", "_row_b"), row_keys("doc_id", "text"))) | {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))}
    some, rest = maybe_in(documents.withColumns(keys), "_row_a", found.select("_row_a"), Workspace(documents.sparkSession))
    joined = some.join(found, list(keys), "left")
    if rest is not None:
        kind = "array<bigint>"
        joined = joined.unionByName(rest.withColumns({"gone": F.lit(None).cast(kind), "held": F.lit(None).cast(kind)}))
    joined = joined.select(*documents.columns, "gone", "held")
    at = documents.columns.index("text")
    width = len(documents.columns)

    def covered(places: list[int], size: int) -> np.ndarray:
        out = np.zeros(size, dtype=bool)
        for place in places:
            out[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)] = True
        return out

    def run(batches):
        for batch in pieces(batches):
            column = batch.column(at)
            texts, removed = column.to_pylist(), np.zeros(batch.num_rows, dtype=np.int32)
            gone, held = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            for r, text in enumerate(texts):
                if gone[r]:
                    parts = text.split("\n")
                    parts = [x + "\n" for x in parts[:-1]] + parts[-1:] * bool(parts[-1])
                    out = covered(gone[r], len(parts)) & ~covered(held[r], len(parts))
                    texts[r] = "".join(x for x, away in zip(parts, out) if not away)
                    removed[r] = int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum())
            columns = list(batch.columns[:width])
            columns[at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], [*batch.schema.names[:width], "_removed_chunks"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return joined.mapInArrow(run, f"{kinds}, _removed_chunks int")


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, kept_chars, removed_chunks (runs of lines) and the digest of the remaining text of every row."""
    out = deduplicated(documents.select("doc_id", "text"))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("kept_chars"), F.col("_removed_chunks").alias("removed_chunks"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    )
