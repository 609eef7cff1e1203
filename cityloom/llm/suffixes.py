"""Exact removal of repeated byte strings by a Burrows-Wheeler transform.

Of every string of ``length`` bytes, the first place in the order of (doc_id, start) stays
and every other place's bytes go; strings are judged on the input and never cross texts.

1. Documents are dealt to classes of a few MB by a hash, in one exchange that is used
   three times.  In each window of ``length`` bytes the CORE bytes with the least hash are
   its anchor, so equal windows have equal anchors; a slice is a run of windows with one
   anchor.  Anchors found once in all documents can't lie in a repeated string.
2. Slices of the other anchors are brought together by anchor; equal slices of a class
   travel once, with their first place.  Their texts (the anchor written as one number)
   are concatenated, sorted and transformed.  From the intervals of all strings of four
   symbols on, a breadth-first search extends intervals backward, symbol by symbol, and
   so derives the common prefixes of neighbouring suffixes by increasing value; it stops
   at ``length``.  Neighbours that got no value have a longer one: runs of them are the
   places of one repeated window, and its first place is the least of them.
3. Each class gets a bit for each window of its slices that has an earlier place, and
   removes what these cover.

A slice costs a message for each class, not for each place.  An anchor with many different
slices (a common line among other texts) is split by what surrounds it, in bands of BAND
windows, before it is brought together; a third of all texts may share one.

Strings compare equal by bytes; anchors by 64-bit hashes, and again by bytes on either side.
Null texts count as empty; a null doc_id ranks with the largest number; rows that share a
doc_id are one document, so equal starts are neither's earlier place: equal rows give equal
results.  doc_id must be a whole number.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.store import row_keys
from cityloom.llm.textops import mix64, text_buffer

CORE = 32
BAND = 9
#: Bytes of a class of documents.
CLASS = 4 << 20
#: An anchor is split if it has more different slices than this, and than this many a class.
MANY, MANY_A_CLASS = 256, 4
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_AT = _U((1 << 21) - 1)
#: Symbols: 0 ends a slice, then bytes plus one, then two digits of an anchor's number.
_DIGIT = 1 << 12
_ONE, _TWO = 1 << 9, 1 << 13
_SYMBOLS = 1 << 20


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join([np.array([x.nbytes for x in arrays], dtype=np.int64).tobytes(), *(x.tobytes() for x in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd")
    ends = np.cumsum(np.frombuffer(raw, dtype=np.int64, count=len(kinds))) + 8 * len(kinds)
    return [np.frombuffer(raw[a:b], dtype=k) for a, b, k in zip([8 * len(kinds), *ends], ends, kinds)]


def _six(keys: np.ndarray) -> np.ndarray:
    """The upper six bytes of 64-bit keys, enough to tell candidates."""
    return np.ascontiguousarray((keys >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of stretches of data, in blocks of eight bytes."""
    out = mix64(sizes.astype(_U) * _MULT + _U(1))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    masks = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)
    rest, done = np.flatnonzero(sizes > 0), 0
    while len(rest):
        block = blocks[starts[rest] + done].view("<u8").ravel() & masks[np.minimum(sizes[rest] - done, 8)]
        out[rest] = mix64(out[rest] * _MULT + block)
        done += 8
        rest = rest[sizes[rest] > done]
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _blocks(offsets: np.ndarray, length: int):
    """(first byte, end of the windows' first bytes, end of the bytes in sight, end of its row for
    each first byte): short rows together, long ones in parts counted from their start."""
    sizes, i, n = np.diff(offsets), 0, len(offsets) - 1
    while i < n:
        if sizes[i] > _BLOCK:
            for a in range(int(offsets[i]), int(offsets[i + 1]), _BLOCK):
                b = min(a + _BLOCK, int(offsets[i + 1]))
                yield a, b, min(b + length - 1, int(offsets[i + 1])), np.full(b - a, offsets[i + 1])
            i += 1
            continue
        j = i
        while j < n and sizes[j] <= _BLOCK and offsets[j + 1] - offsets[i] <= _BLOCK:
            j += 1
        yield int(offsets[i]), int(offsets[j]), int(offsets[j]), np.repeat(offsets[i + 1 : j + 1], sizes[i:j])
        i = j


def _core_ranks(part: np.ndarray) -> np.ndarray:
    """A hash of the CORE bytes at each place, with the place itself in the lowest bits."""
    h = mix64(np.arange(1, 257))[part]
    size, power = 1, _MULT
    while size < CORE:
        h = h[:-size] * power + h[size:]
        size, power = 2 * size, power * power
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return (h & ~_AT) | np.arange(len(h), dtype=_U)


def _slices(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, windows, bytes left of the anchor, and anchor key, of all slices of a class."""
    found = []
    for a, b, top, ends in _blocks(offsets, length):
        part = data[a:top]
        if len(part) < length:
            continue
        anchor = (_sliding_least(_core_ranks(part), length - CORE + 1)[: b - a] & _AT).astype(np.int64)
        m = len(anchor)
        ok = np.arange(a + length, a + length + m) <= ends[:m]
        turn = anchor[1:] != anchor[:-1]
        first, last = ok.copy(), ok.copy()
        first[1:] &= turn | ~ok[:-1]
        last[:-1] &= turn | ~ok[1:]
        start = np.flatnonzero(first)
        at = anchor[start]
        found.append((start + a, np.flatnonzero(last) - start + 1, at - start, _hashes(part, at, np.full(len(at), CORE))))
    if not found:
        return (*np.zeros((3, 0), dtype=np.int64), np.zeros(0, dtype=_U))
    return tuple(np.concatenate(x) for x in zip(*found))


def _banded(data: np.ndarray, slices: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, ...]:
    """The slices cut where the distance to the anchor passes a multiple of BAND; keys take in
    the bytes that all windows of a band hold."""
    start, n, left, key = slices
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    band = (left[of] - step) // BAND
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (band[1:] != band[:-1])]) if len(of) else np.zeros(0, dtype=bool))
    of, step, band, size = of[first], step[first], band[first], np.diff(np.append(first, len(of)))
    before, after = band * BAND, np.maximum(0, length - CORE - band * BAND - BAND + 1)
    common = _hashes(data, start[of] + left[of] - before, before + CORE + after)
    return start[of] + step, size, left[of] - step, mix64(key[of] + _MULT * common + band.astype(_U))


def _names(data: np.ndarray, left_at: np.ndarray, left: np.ndarray, right_at: np.ndarray, right: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix64(_hashes(data, left_at, left) * _MULT + _hashes(data, right_at, right) + mix64(key))


def _named(data: np.ndarray, slices: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    start, n, left, key = slices
    return _names(data, start, left, start + left + CORE, n + length - 1 - CORE - left, key)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> _U(32)) * _U(buckets)) >> _U(32)


def _parts(of: np.ndarray):
    """Values of the sorted array of, and where they begin and end."""
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, dtype=np.int64)
    return zip(of[cuts].tolist(), cuts, np.append(cuts[1:], len(of)))


def _rows(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


_SENT = {"bucket": pa.int64(), "pid": pa.int64(), "kind": pa.int32(), "held": pa.binary()}
_SENT_SCHEMA = "bucket long, pid long, kind int, held binary"
_BACK = {"pid": pa.int64(), "kind": pa.int32(), "held": pa.binary()}
_BACK_SCHEMA = "pid long, kind int, held binary"


def _anchor_keys(length: int, buckets: int):
    """Of a class: its different anchors by bucket, with 0 for one place, else the number of slices."""

    def run(docs: pa.Table) -> pa.Table:
        data, offsets = text_buffer(docs.column("text"))
        slices = _slices(data, offsets, length)
        order = np.argsort(slices[3])
        key = slices[3][order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        code = np.zeros(len(at), dtype=np.uint8)
        often = order[np.repeat(size > 1, size)]
        group = np.repeat(np.arange(len(at)), size)[np.repeat(size > 1, size)]
        name = _named(data, tuple(x[often] for x in slices), length)
        by = np.lexsort((name, group))
        group, name = group[by], name[by]
        differ = np.concatenate([[True], (group[1:] != group[:-1]) | (name[1:] != name[:-1])]) if len(group) else np.zeros(0, dtype=bool)
        counts = np.bincount(group[differ], minlength=len(at))
        code[:] = np.minimum(counts, 255)
        key = key[at]
        pid = docs.column("pid")[0].as_py()
        return _rows(_SENT, [(b, pid, 0, _packed(_six(key[i:j]), code[i:j])) for b, i, j in _parts(_bucket(key, buckets))])

    return run


def _repeated_keys(sent: pa.Table) -> pa.Table:
    """The keys of each class that also stand elsewhere, and whether they are to be split."""
    blobs = [_unpacked(b, "u1", "u1") for b in sent.column("held").to_pylist()]
    keys = [_from_six(k) for k, _ in blobs]
    key, code = np.concatenate(keys), np.concatenate([c for _, c in blobs]).astype(np.int64)
    of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.lexsort((of, key))
    key, code, of = key[order], code[order], of[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(at, len(key)))
    slices = np.add.reduceat(np.maximum(code, 1), at)
    keep = np.repeat((size > 1) | (np.maximum.reduceat(code, at) > 0), size)
    split = np.repeat((slices > MANY) & (slices > MANY_A_CLASS * size), size)
    key, of, split = key[keep], of[keep], split[keep]
    order = np.lexsort((key, of))
    pids = sent.column("pid").to_pylist()
    key, of, split = key[order], of[order], split[order].astype(np.uint8)
    return _rows(_BACK, [(pids[i], 0, _packed(_six(key[a:b] << _U(16)), split[a:b])) for i, a, b in _parts(of)])


def _split_by(slices: tuple[np.ndarray, ...], data: np.ndarray, length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    if not hot.any():
        return slices
    cut = _banded(data, tuple(x[hot] for x in slices), length)
    return tuple(np.concatenate([x[~hot], y]) for x, y in zip(slices, cut))


def _places(docs: pa.Table, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id (null: the largest number) and start in the text of slices."""
    doc = docs.column("doc_id").combine_chunks().cast(pa.int64()).fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
    row = np.searchsorted(offsets, start, side="right") - 1
    return doc[row], start - offsets[row]


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among sorted_keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _sent_slices(length: int, buckets: int):
    """Of a class: its different slices with a repeated anchor, each with its first place, by bucket."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows or not back.num_rows:
            return _rows(_SENT, [])
        blobs = [_unpacked(b, "u1", "u1") for b in back.column("held").to_pylist()]
        known, split = np.concatenate([_from_six(k) for k, _ in blobs]), np.concatenate([s for _, s in blobs]).astype(bool)
        order = np.argsort(known)
        known, split = known[order], split[order]
        data, offsets = text_buffer(docs.column("text"))
        slices = _slices(data, offsets, length)
        there, at = _in(known, slices[3] >> _U(16))
        slices, hot = tuple(x[there] for x in slices), split[at[there]]
        slices = _split_by(slices, data, length, hot)
        name = _named(data, slices, length)
        doc, place = _places(docs, offsets, slices[0])
        order = np.lexsort((place, doc, name, slices[3]))
        name, key = name[order], slices[3][order]
        order = order[np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])])] if len(order) else order
        start, n, left, key = (x[order] for x in slices)
        doc, place = doc[order], place[order].astype(np.int32)
        right = n + length - 1 - CORE - left
        pid, rows = docs.column("pid")[0].as_py(), []
        for b, i, j in _parts(_bucket(key, buckets)):
            texts = [_flat(data, start[i:j], left[i:j]), _flat(data, start[i:j] + left[i:j] + CORE, right[i:j])]
            rows.append((b, pid, 0, _packed(key[i:j], doc[i:j], place[i:j], n[i:j].astype(np.uint8), left[i:j].astype(np.uint8), *texts)))
        rows.append((pid % buckets, pid, 1, _packed(_six(known[split] << _U(16)))))
        return _rows(_SENT, rows)

    return run


def _flat(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of data, one after the other."""
    total = int(sizes.sum())
    return data[np.arange(total) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]


def sorted_suffixes(symbols: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes, their ranks, and common prefixes of neighbours below four symbols
    (else 255).  rest is the symbols up to and with the end of the slice; ends rank by place."""
    n, depth = len(symbols), 4
    key, seen = np.zeros(n, dtype=_U), np.concatenate([symbols, np.zeros(depth, dtype=symbols.dtype)]).astype(_U)
    for d in range(depth):
        key = (key << _U(16)) | np.where(rest > d, seen[d : d + n], _U(0))
    order = np.argsort(key)
    key = key[order]
    differ = key[1:] ^ key[:-1]
    border = np.concatenate([[True], differ != 0])
    common = np.full(n + 1, 255, dtype=np.uint8)
    common[0] = common[n] = 0
    inside = np.full(n - 1, 255, dtype=np.uint8)
    for d in range(depth):
        inside[(inside == 255) & ((differ >> _U(16 * (depth - 1 - d))) & _U(0xFFFF) != 0)] = d
    ended = (inside == 255) & (rest[order[1:]] <= depth)
    inside[ended] = rest[order[1:]][ended] - 1  # equal up to the ends
    common[1:n] = inside
    first = np.maximum.accumulate(np.where(border, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    longest, slots = int(rest.max(initial=0)), np.arange(n)
    while len(slots):
        alone = border[slots] & np.append(border[slots[1:]] | (slots[1:] != slots[:-1] + 1), True)
        slots = slots[~alone]
        which = order[slots]
        if depth >= longest:
            by = np.argsort((rank[which] << 32) | which)
        else:
            ahead = np.minimum(which + depth, n - 1)
            by = np.argsort((rank[which] << 32) | np.where(rest[which] > depth, rank[ahead] + 1, 0))
        second = np.where(rest[which] > depth, rank[np.minimum(which + depth, n - 1)] + 1, 0)[by]
        held = rank[which][by]
        order[slots] = which[by]
        if depth >= longest:
            rank[order[slots]] = slots
            break
        new = np.concatenate([[True], (held[1:] != held[:-1]) | (second[1:] != second[:-1])]) if len(slots) else np.zeros(0, dtype=bool)
        border[slots] = new
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        depth *= 2
    return order, rank, common


def common_prefixes(symbols: np.ndarray, rest: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and the common prefix of each with the one before it, where that is
    below most (255 where it isn't), by backward extension of intervals, breadth first."""
    order, rank, common = sorted_suffixes(symbols, rest)
    n = len(symbols)
    before = symbols[order - 1]
    before[order == 0] = 0
    step = np.where(before > 0, rank[order - 1], -1).astype(np.int32)
    # Intervals of strings of four symbols whose right border is new at that length.
    cuts = np.flatnonzero(common < 255)
    begin, end = cuts[:-1], cuts[1:] - 1
    fresh = common[end + 1] == 3
    begin, end = begin[fresh], end[fresh]
    mark = np.full(n + 2, -1, dtype=np.int32)
    for length in range(4, most):
        if not len(begin):
            break
        size = end - begin + 1
        of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        row = step[np.arange(len(of)) + np.repeat(begin - np.cumsum(size) + size, size)]
        of, row = of[row >= 0], row[row >= 0]
        mark[row + 1] = of
        # Rows of one interval and symbol go to a run; borders within it have no value yet.
        last = row[(mark[row + 2] != of) | (common[row + 1] < 255)]
        begin = row[(mark[row] != of) | (common[row] < 255)]
        mark[row + 1] = -1
        end, begin = np.sort(last).astype(np.int64), np.sort(begin).astype(np.int64)
        fresh = common[end + 1] == 255
        begin, end = begin[fresh], end[fresh]
        common[end + 1] = length
    return order, common[:n]


def _firsts(key: np.ndarray, n: np.ndarray, left: np.ndarray, place: np.ndarray, texts: np.ndarray, lefts: np.ndarray, rights: np.ndarray, length: int) -> np.ndarray:
    """The least place of each window's string, for slices that are sorted by key; place is
    the slice's own, by (document's rank, start)."""
    number = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    right = n + length - 1 - CORE - left
    size = left + right + 3
    ends = np.cumsum(size)
    symbols = np.zeros(int(ends[-1]), dtype=np.uint16)
    begin = ends - size
    run = lambda at, sizes: np.arange(int(sizes.sum())) + np.repeat(at - np.cumsum(sizes) + sizes, sizes)
    symbols[run(begin, left)] = _flat(texts, lefts, left).astype(np.uint16) + 1
    symbols[run(begin + left + 2, right)] = _flat(texts, rights, right).astype(np.uint16) + 1
    symbols[begin + left] = _ONE + number // _DIGIT
    symbols[begin + left + 1] = _TWO + number % _DIGIT
    rest = np.repeat(ends, size) - np.arange(len(symbols))
    deep = length - CORE + 2
    order, common = common_prefixes(symbols, rest, deep)
    of = np.repeat(np.arange(len(n)), size)[order]
    step = order - begin[of]
    window = step < n[of]
    group = np.cumsum(common < 255)[window]
    of, step = of[window], step[window]
    own = place[of] + step
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(group))))
    out = np.empty(len(own), dtype=np.int64)
    out[(np.cumsum(n) - n)[of] + step] = least
    return out


def _earlier_windows(length: int):
    """Of a bucket: for each class, the names of its slices and a bit a window, set where the
    window's string has a place before the slice's first one."""
    wide = (length - CORE + 8) // 8

    def run(sent: pa.Table) -> pa.Table:
        kinds, pids, blobs = (sent.column(c).to_pylist() for c in ("kind", "pid", "held"))
        rows = [(p, 1, b) for k, p, b in zip(kinds, pids, blobs) if k]
        pids = [p for k, p in zip(kinds, pids) if not k]
        parts = [_unpacked(b, "u8", "i8", "i4", "u1", "u1", "u1", "u1") for k, b in zip(kinds, blobs) if not k]
        if not parts:
            return _rows(_BACK, rows)
        key, doc, start, n, left = (np.concatenate([p[i] for p in parts]) for i in range(5))
        n, left, start = n.astype(np.int64), left.astype(np.int64), start.astype(np.int64)
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        texts = np.concatenate([p[i] for i in (5, 6) for p in parts])
        right = n + length - 1 - CORE - left
        lefts = np.cumsum(left) - left
        rights = int(left.sum()) + np.cumsum(right) - right
        name = _names(texts, lefts, left, rights, right, key)
        ids, doc = np.unique(doc, return_inverse=True)
        place = (doc << 32) | start
        order = np.lexsort((place, name, key))
        new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (key[order][1:] != key[order][:-1])])
        mine = np.empty(len(order), dtype=np.int64)
        mine[order] = np.cumsum(new) - 1
        one = order[new]  # each different slice, at its first place
        total = np.cumsum(n[one])
        first = np.empty(int(total[-1]), dtype=np.int64)
        # Groups of one anchor are independent: some of them at a time.
        edges = np.flatnonzero(np.concatenate([[True], key[one][1:] != key[one][:-1]]))
        weight = np.cumsum(left[one] + right[one] + 3)
        cuts, i = [0], 0
        while i < len(edges):
            reached = weight[edges[i] - 1] if edges[i] else 0
            j = max(i + 1, int(np.searchsorted(np.append(weight[edges[1:] - 1], weight[-1]), reached + _SYMBOLS, side="right")))
            cuts.append(int(edges[j]) if j < len(edges) else len(one))
            i = j
        for a, b in zip(cuts, cuts[1:]):
            at = one[a:b]
            low = int(total[a] - n[at[0]])
            first[low : int(total[b - 1])] = _firsts(key[at], n[at], left[at], place[at], texts, lefts[at], rights[at], length)
        bits = np.zeros((len(n), 8 * wide), dtype=bool)
        base = (total - n[one])[mine]
        for a in range(0, len(n), 1 << 16):
            each = n[a : a + (1 << 16)]
            of = np.repeat(np.arange(a, a + len(each)), each)
            step = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            bits[of, step] = first[base[of] + step] < place[of] + step
        held = np.packbits(bits, axis=1)
        for i, a, b in _parts(source):
            rows.append((pids[i], 0, _packed(name[a:b], held[a:b])))
        return _rows(_BACK, rows)

    return run


def _kept(length: int):
    """Of a class: each text's removed spans and what is left."""
    wide = (length - CORE + 8) // 8
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), span, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
        data, offsets = text_buffer(docs.column("text"))
        starts = np.zeros(0, dtype=np.int64)
        if back.num_rows:
            pairs = list(zip(back.column("kind").to_pylist(), back.column("held").to_pylist()))
            hot = np.sort(np.concatenate([np.zeros(0, dtype=_U), *(_from_six(_unpacked(b, "u1")[0]) for k, b in pairs if k)]))
            parts = [_unpacked(b, "u8", "u1") for k, b in pairs if not k]
            names = np.concatenate([np.zeros(0, dtype=_U), *(p[0] for p in parts)])
            held = np.concatenate([np.zeros(0, dtype=np.uint8), *(p[1] for p in parts)]).reshape(-1, wide)
            order = np.argsort(names)
            names, held = names[order], held[order]
            slices = _slices(data, offsets, length)
            slices = _split_by(slices, data, length, _in(hot, slices[3] >> _U(16))[0])
            name = _named(data, slices, length)
            there, at = _in(names, name)
            slices, name, at = tuple(x[there] for x in slices), name[there], at[there]
            doc, place = _places(docs, offsets, slices[0])
            order = np.lexsort((place, doc, name))
            new = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            first = np.zeros(len(order), dtype=bool)
            first[order] = (doc[order] == doc[lead]) & (place[order] == place[lead])  # others have an earlier place in this class
            found = [starts]
            for a in range(0, len(name), 1 << 14):
                b = min(len(name), a + (1 << 14))
                bits = np.unpackbits(held[at[a:b]], axis=1).astype(bool) | ~first[a:b, None]
                bits &= np.arange(8 * wide) < slices[1][a:b, None]
                i, step = np.nonzero(bits)
                found.append(slices[0][a:b][i] + step)
            starts = np.sort(np.concatenate(found))
        row = np.searchsorted(offsets, starts, side="right") - 1
        cut = np.concatenate([[True], (np.diff(starts) > length) | (np.diff(row) > 0)]) if len(starts) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(cut)
        begin, end, row = starts[at], starts[np.append(at[1:], len(starts)) - 1] + length if len(at) else starts, row[at]
        upto = np.searchsorted(row, np.arange(docs.num_rows + 1))
        spans, kept = [], []
        for r, (a, b) in enumerate(zip(upto, upto[1:])):
            lo, hi = int(offsets[r]), int(offsets[r + 1])
            edges = [lo, *np.column_stack([begin[a:b], end[a:b]]).ravel().tolist(), hi]
            spans.append([{"start": x - lo, "end": y - lo} for x, y in zip(edges[1:-1:2], edges[2:-1:2])])
            kept.append(b"".join(data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])))
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def deduplicated(documents: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, maximal, from start to end) and kept (the other
    bytes, concatenated), a row for each of documents."""
    if not CORE + 8 <= length <= CORE + 200:
        raise ValueError(f"length is {CORE + 8} to {CORE + 200} bytes")
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = max(2 * tasks, total // CLASS + 1)
    # Equal rows are told apart by the input's partition, so that no class gets too many of them.
    pid = F.pmod(F.xxhash64("row_a", "row_b", F.spark_partition_id()), F.lit(classes))
    dealt = rows.select("*", *row_keys("doc_id", "text")).select(pid.alias("pid"), "doc_id", "text").repartition(tasks, "pid")
    keys = dealt.groupBy("pid").applyInArrow(_anchor_keys(length, classes), _SENT_SCHEMA)
    again = keys.groupBy("bucket").applyInArrow(_repeated_keys, _BACK_SCHEMA)
    sent = dealt.groupBy("pid").cogroup(again.groupBy("pid")).applyInArrow(_sent_slices(length, classes), _SENT_SCHEMA)
    earlier = sent.groupBy("bucket").applyInArrow(_earlier_windows(length), _BACK_SCHEMA)
    return dealt.groupBy("pid").cogroup(earlier.groupBy("pid")).applyInArrow(_kept(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def suffix_report(documents: DataFrame) -> DataFrame:
    """Removed bytes, spans and the digest of what is left, for each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduplicated(documents).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
