"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

The seeds of a benchmark item are its pairs of neighbouring words but for a twelfth that
is commonest in the documents (pairs are counted over all of them).  Seeds put item and text on a diagonal.  Where
diagonals less than an item's length apart hold enough seeds, and the stretch of text
around them holds enough of the item's words, that stretch is aligned with the item by
words; the local score over the item's best possible one is the similarity.  Pairs of at
least ``least_score`` are reported.

A copy of L words with words replaced or left out that scores 0.5 keeps at least
L / 3 - 1 of its pairs, which is no less than a sixth of them from four words on, so at
least as many seeds as that less those dropped; shorter items are looked up by single
words.  So only a copy with words put in at more than two thirds of its places can score
0.5 and be missed.

Items are broadcast in blocks of bounded size; every block meets all documents, so a
large benchmark takes more passes and not more memory.  Rows are handled one by one: no
shuffle of texts, no grouping.  Memory of a task follows its longest text.

Null, empty and blank texts match nothing, nor do items without words.  Repeated
documents each report their matches, whatever their doc_id; repeated items are items of
their own.  Of equal scores in a text the first stretch counts; equally common pairs
go by hash.  Case, ASCII white space and ASCII punctuation don't matter.  Extra columns
stay in ``decontaminated`` and are ignored in ``contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace
from cityloom.llm.textops import pieces, shingles, words

MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two word sequences and the stretch of text it covers.

    Rows are words of the item.  Within a row, gaps in the text carry on from the
    left: a running maximum of score plus distance.
    """
    m = len(text)
    at = np.arange(m + 1)
    score, begin = np.zeros(m + 1, dtype=np.int64), at.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        upper = score[1:] + GAP
        row, origin = np.zeros(m + 1, dtype=np.int64), at.copy()
        take = diagonal >= upper
        row[1:] = np.where(take, diagonal, upper)
        origin[1:] = np.where(take, begin[:-1], begin[1:])
        low = row <= 0
        row[low], origin[low] = 0, at[low]
        lifted = row - GAP * at
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, at, 0))
        row, origin = reach + GAP * at, origin[source]
        low = row <= 0
        row[low], origin[low] = 0, at[low]
        score, begin = row, origin
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(origin[top]), top)
    return best


class Items:
    """A block of benchmark items: their words, n-grams and seeds."""

    def __init__(self, rows: list, n: int):
        self.n, self.ids = n, [r.item_id for r in rows]
        self.words, grams, owner, place = [], [], [], []
        for first, hashes, offsets, _, _ in words(pc.utf8_lower(pa.array([r.text for r in rows], pa.string())), punctuation=True):
            found, cuts = shingles(hashes, offsets, n)
            for r in range(len(offsets) - 1):
                self.words.append(hashes[offsets[r] : offsets[r + 1]])
                grams.append(found[cuts[r] : cuts[r + 1]])
                owner.append(np.full(len(grams[-1]), first + r))
                place.append(np.arange(len(grams[-1])))
        grams, owner, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (grams, owner, place))
        self._set(grams.astype(np.uint64), owner, place)
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.needs = np.ones(len(self.words), dtype=np.int64)

    def _set(self, grams: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
        by = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[by], owner[by], place[by]

    def seed(self, counts: dict[int, int], least_score: float) -> Items:
        """Keeps the rarest n-grams of every item, and how many of them a match must have."""
        score = min(least_score, 0.5)
        share = max(0.0, 4 * score - 1) / 6 if self.n > 1 else score
        needs = np.maximum(1, np.ceil(self.lengths * share - 1e-9).astype(np.int64))
        dropped = needs // 2 if self.n > 1 else np.zeros_like(needs)
        common = np.array([counts.get(int(g), 0) for g in self.grams], dtype=np.int64)
        by = np.lexsort((self.grams, -common, self.owner))
        owner = self.owner[by]
        rank = np.arange(len(by)) - np.searchsorted(owner, owner, side="left")
        kept = np.sort(by[rank >= dropped[owner]])
        self._set(self.grams[kept], self.owner[kept], self.place[kept])
        self.needs = needs - dropped
        return self

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in grams and in this block's sorted n-grams, for all equal pairs."""
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        some = np.flatnonzero(high > low)
        reps = (high - low)[some]
        inner = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        return np.repeat(some, reps), np.repeat(low[some], reps) + inner

    def matches(self, hashes: np.ndarray, offsets: np.ndarray, least_score: float):
        """(row, item, score, start, end) of all matches of a segment of texts."""
        grams, cuts = shingles(hashes, offsets, self.n)
        spot, seed = self.hits(grams)
        row, owner = np.searchsorted(cuts, spot, side="right") - 1, self.owner[seed]
        best: dict[int, tuple[int, int, int]] = {}
        n = max(1, len(self.lengths))
        for pair, lo, hi in _dense(row * n + owner, spot - cuts[row] - self.place[seed], self.needs[owner], self.lengths[owner]):
            r, o = divmod(pair, n)
            item, text = self.words[o], hashes[offsets[r] : offsets[r + 1]]
            a, b = max(0, lo - len(item)), min(len(text), hi + 2 * len(item))
            if np.isin(item, text[a:b]).sum() < least_score * len(item):
                continue  # too few matches for the score
            score, start, end = align(item, text[a:b])
            if score > best.get(pair, (0, 0, 0))[0]:
                best[pair] = (score, a + start, a + end)
        for pair, (score, start, end) in sorted(best.items()):
            r, o = divmod(pair, n)
            share = score / (MATCH * len(self.words[o]))
            if share >= least_score:
                yield r, self.ids[o], share, start, end


def _dense(pair: np.ndarray, diagonal: np.ndarray, need: np.ndarray, width: np.ndarray) -> list[tuple[int, int, int]]:
    """(pair, lowest, highest diagonal) of groups with need hits on diagonals within width."""
    if not len(pair):
        return []
    by = np.lexsort((diagonal, pair))
    pair, diagonal, need, width = pair[by], diagonal[by], need[by], width[by]
    span = int(diagonal.max() - diagonal.min() + width.max()) + 2
    key = pair * span + (diagonal - diagonal.min())
    last = np.searchsorted(key, key + width, side="right")
    at = np.arange(len(key))
    full = np.flatnonzero(last - at >= need)
    edge = np.zeros(len(key) + 1, dtype=np.int64)
    np.add.at(edge, full, 1)
    np.add.at(edge, last[full], -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    cuts = np.flatnonzero(np.diff(key[at]) > width[at][1:]) + 1
    return [(int(pair[g[0]]), int(diagonal[g[0]]), int(diagonal[g[-1]])) for g in np.split(at, cuts) if len(g)]


def _counted(documents: DataFrame, grams: np.ndarray, n: int, work: Workspace) -> dict[int, int]:
    """How often each of the n-grams of a block occurs in all documents."""
    known = np.unique(grams)
    held = work.share(known)

    def run(batches):
        known = held.value
        total = np.zeros(len(known), dtype=np.int64)
        for batch in pieces(batches):
            for _, hashes, offsets, _, _ in words(pc.utf8_lower(batch.column(0)), punctuation=True):
                found, _ = shingles(hashes, offsets, n)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                total += np.bincount(at[known[at] == found], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "c"])

    rows = documents.select("text").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect()
    return {int(known[r["at"]]): r["c"] for r in rows}


def _blocks(documents: DataFrame, benchmark: DataFrame, least_score: float, block_chars: int, work: Workspace):
    """Broadcasts of the seeded items of each block (short items, others), and whether it is the last."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.select("item_id", "text").orderBy("item_id", "text").collect()
        long = [len(w) for w in Items(rows, 1).words]
        short, others = Items([r for r, n in zip(rows, long) if 0 < n < 4], 1), Items([r for r, n in zip(rows, long) if n >= 4], 2)
        counts = _counted(documents, others.grams, 2, work) if len(others.grams) else {}
        yield work.share((short.seed({}, least_score), others.seed(counts, least_score))), b == blocks - 1


def contaminated(documents: DataFrame, benchmark: DataFrame, least_score: float = 0.5, block_chars: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, score (0 to 1), word_start, word_end of each match."""
    work = Workspace(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    names = ["doc_id", "item_id", "score", "word_start", "word_end"]
    out = None
    for block, last in _blocks(documents, benchmark, least_score, block_chars, work):

        def run(batches, block=block):
            for batch in pieces(batches):
                ids, found = batch.column(0).to_pylist(), []
                for first, hashes, offsets, _, _ in words(pc.utf8_lower(batch.column(1)), punctuation=True):
                    found += [(ids[first + r], *rest) for items in block.value for r, *rest in items.matches(hashes, offsets, least_score)]
                columns = list(zip(*found)) if found else [()] * 5
                kinds = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        part = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, score double, word_start long, word_end long")
        part = part if last else work.written(part, "contaminated")
        out = part if out is None else out.union(part)
    return out


def decontaminated(documents: DataFrame, benchmark: DataFrame, least_score: float = 0.5, block_chars: int = 1_000_000) -> DataFrame:
    """documents without the rows whose text matches an item, whatever their doc_id."""
    work = Workspace(documents.sparkSession)
    at = documents.columns.index("text")
    for block, last in _blocks(documents, benchmark, least_score, block_chars, work):

        def run(batches, block=block):
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, hashes, offsets, _, _ in words(pc.utf8_lower(batch.column(at)), punctuation=True):
                    for items in block.value:
                        keep[[first + r for r, *_ in items.matches(hashes, offsets, least_score)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
        documents = documents if last else work.written(documents, "decontaminated")
    return documents
