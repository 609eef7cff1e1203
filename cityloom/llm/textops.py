"""Vectorised byte-level text kernels shared by the Python stages.

Everything works on whole UTF-8 texts.  A "word" is a maximal run of bytes other
than the ASCII white space characters (space and 0x09-0x0D); A-Z compare equal to
a-z where ``lower`` is set.  A batch is worked on in segments of a few MB cut between
texts; a longer text is a segment of its own, so memory is a small multiple of the
larger of a segment and the longest text.

Words are hashed in blocks of eight bytes, each mixed in by a bijection that isn't
linear; words of over 64 bytes by BLAKE2b.  Equal hashes of different words come by
chance only (2**-64 for a pair), whatever pattern the words have.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 20
_LONG = 64
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCTUATION = _SPACE.copy()
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def digest64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _hashed(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of part from starts to ends."""
    length = ends - starts
    out = mix64(length.astype(np.uint64) * _MULT + _U(1))
    padded = np.concatenate([part, np.zeros(8, dtype=np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(part) + 1, 8), (1, 1))
    rest, done = np.flatnonzero((length > 0) & (length <= _LONG)), 0
    while len(rest):
        block = blocks[starts[rest] + done].view("<u8").ravel() & _MASKS[np.minimum(length[rest] - done, 8)]
        out[rest] = mix64(out[rest] * _MULT + block)
        done += 8
        rest = rest[length[rest] > done]
    for i in np.flatnonzero(length > _LONG):
        out[i] = digest64(part[starts[i] : ends[i]].tobytes())
    return out


def pieces(batches, rows: int = 1024):
    """Batches in slices of few rows, so that what a task makes of one at a time is small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def _segments(offsets: np.ndarray):
    """Ranges of rows holding about one segment of bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + _SEGMENT, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _runs(data: np.ndarray, cuts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data; none crosses a cut (row start)."""
    word = ~between[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    inside = cuts[cuts < len(data)]
    before[inside] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends_at = inside[inside > 0] - 1
    after[ends_at] = False
    return starts, np.flatnonzero(word & ~after) + 1


def words(column: pa.Array, lower: bool = True, punctuation: bool = False):
    """Yields (first row, hashes, row offsets into hashes, starts, ends) by segment.

    With punctuation, ASCII punctuation separates words as white space does.
    starts and ends are byte positions relative to the segment's first row's text.
    """
    data, offsets = text_buffer(column)
    for i, j in _segments(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        part = data[lo:hi]
        cuts = offsets[i : j + 1] - lo
        if not len(part):
            zero = np.zeros(0, dtype=np.int64)
            yield i, np.zeros(0, dtype=np.uint64), np.zeros(j - i + 1, dtype=np.int64), zero, zero
            continue
        starts, ends = _runs(part, cuts[:-1], _PUNCTUATION if punctuation else _SPACE)
        yield i, _hashed(_LOWER[part] if lower else part, starts, ends), np.searchsorted(starts, cuts), starts, ends


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their row offsets; a shorter row with
    words gives one hash of all its words, a row without words none."""
    counts = np.diff(offsets)
    out = np.zeros(len(hashes), dtype=np.uint64)
    total = max(0, len(hashes) - k + 1)
    acc = np.full(total, k, dtype=np.uint64)
    for d in range(k):
        acc = mix64(acc * _MULT + hashes[d : d + total])
    out[:total] = acc
    keep = np.ones(len(hashes), dtype=bool)
    for d in range(1, k):
        keep[(offsets[1:] - d)[counts >= d]] = False
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        a, b = int(offsets[r]), int(offsets[r + 1])
        acc1 = np.full(1, b - a, dtype=np.uint64)
        for d in range(a, b):
            acc1 = mix64(acc1 * _MULT + hashes[d : d + 1])
        out[a] = acc1[0]
        keep[a] = True
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])
