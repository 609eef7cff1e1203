"""Media columns: PNG images held in binary columns.

``encode`` stores any bytes losslessly as 8-bit samples of a PNG; ``decode`` reads
PNG chunks with checksum tests, inflates and unfilters with numpy; ``features``
takes the low frequencies of a two-dimensional cosine transform as a 64-bit hash.
Null bytes count as empty; an empty payload is an image of one padded row; equal
payloads give equal images and hashes; a damaged image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD_UNIT = 192
# Fixed values of the PNG format.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def padded(data: bytes, unit: int = PAYLOAD_UNIT) -> bytes:
    """data with spaces appended up to a positive multiple of unit."""
    return data + b" " * (unit - len(data) if len(data) < unit else -len(data) % unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, unit: int = PAYLOAD_UNIT, level: int = 1, chunk: int = 1 << 16) -> bytes:
    """RGB PNG with unit / 3 pixels a row; payload is a positive multiple of unit.

    All rows take whichever of the filters None, Sub and Up makes the smallest sum of
    absolute differences in a sample of them.
    """
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, unit)
    sub, up = rows.copy(), rows.copy()
    sub[:, 3:] -= rows[:, :-3]
    up[1:] -= rows[:-1]
    probe = slice(None, None, max(1, len(rows) // 32))
    costs = [int(np.abs(x[probe].view(np.int8).astype(np.int32)).sum()) for x in (rows, sub, up)]
    kind = int(np.argmin(costs))
    filtered = np.empty((len(rows), unit + 1), dtype=np.uint8)
    filtered[:, 0] = kind
    filtered[:, 1:] = (rows, sub, up)[kind]
    body = zlib.compress(filtered.tobytes(), level)
    head = struct.pack(">IIBBBBB", unit // 3, len(rows), 8, 2, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[i : i + chunk]) for i in range(0, len(body), chunk))
    return _SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def chunks(image: bytes):
    """(type, body) of each chunk after tests of signature, length and CRC."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("cut-off chunk")
        size = int.from_bytes(image[at : at + 4], "big")
        end = at + 8 + size
        if end + 4 > len(image):
            raise ValueError("cut-off chunk")
        if zlib.crc32(image[at + 4 : end]) != int.from_bytes(image[end : end + 4], "big"):
            raise ValueError("chunk checksum does not match")
        yield image[at + 4 : at + 8], image[at + 8 : end]
        at = end + 4


def _unfilter_sequential(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Average and Paeth need the pixel to the left: pixel by pixel, channels at once."""
    out = row.astype(np.int32)
    up = above.astype(np.int32)
    for i in range(0, len(out), step):
        left = out[i - step : i] if i else np.zeros(step, dtype=np.int32)
        if kind == 3:
            guess = (left + up[i : i + step]) >> 1
        else:
            corner = up[i - step : i] if i else np.zeros(step, dtype=np.int32)
            base = left + up[i : i + step] - corner
            far_left, far_up, far_corner = np.abs(base - left), np.abs(base - up[i : i + step]), np.abs(base - corner)
            guess = np.where(
                (far_left <= far_up) & (far_left <= far_corner), left, np.where(far_up <= far_corner, up[i : i + step], corner)
            )
        out[i : i + step] = (out[i : i + step] + guess) & 255
    return out.astype(np.uint8)


def decode(image: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG as (height, width, channels)."""
    head, data = None, []
    ended = False
    for kind, body in chunks(image):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in _CHANNELS or interlace:
        raise ValueError("only 8-bit, non-interlaced samples are read")
    step = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    if raw.size != height * (width * step + 1):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(height, width * step + 1)
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [height]])):
        kind = int(kinds[a])
        if kind == 1:
            pixels = out[a:b].reshape(b - a, width, step)
            np.cumsum(pixels, axis=1, dtype=np.uint8, out=pixels)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for r in range(a, b):
                out[r] = _unfilter_sequential(kind, out[r], out[r - 1] if r else np.zeros_like(out[r]), step)
        elif kind:
            raise ValueError("unknown filter")
    return out.reshape(height, width, step)


def _cosine(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (x + 0.5) * k / n)


_SIDE, _LOW = 32, 8
_BASIS = _cosine(_SIDE, _LOW)


def _pooled(values: np.ndarray, size: int) -> np.ndarray:
    """Means of size equal stretches of the first axis (repeats when it is shorter)."""
    edges = np.linspace(0, len(values), size + 1)
    low = np.minimum(np.floor(edges[:-1]).astype(int), len(values) - 1)
    high = np.maximum(np.ceil(edges[1:]).astype(int), low + 1)
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (total[high] - total[low]) / (high - low).reshape(-1, *[1] * (values.ndim - 1))


def low_frequency_hash(samples: np.ndarray) -> str:
    """16 hex digits: signs of the lowest 8 x 8 cosine coefficients against their median."""
    grey = samples.astype(np.float64).mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0].astype(np.float64)
    small = _pooled(_pooled(grey, _SIDE).T, _SIDE).T
    low = np.round(_BASIS @ small @ _BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def encoded(df: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """key, n_bytes, media: the binary column data as lossless PNG images."""

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([encode(padded(x)) for x in raw], pa.binary()),
                ],
                ["key", "n_bytes", "media"],
            )

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")


def media_features(df: DataFrame) -> DataFrame:
    """key, n_bytes and digests of what the column media holds, read back from it."""

    def run(batches):
        for batch in batches:
            rows = []
            for image in batch.column(2).to_pylist():
                samples = decode(image)
                payload = samples.tobytes()
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(image),
                        hashlib.sha256(image).hexdigest(),
                        low_frequency_hash(samples),
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["key", "n_bytes", *_FEATURES],
            )

    kind = dict(df.dtypes)["key"]
    return df.select("key", "n_bytes", "media").mapInArrow(
        run,
        f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


_FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def document_media(documents: DataFrame) -> DataFrame:
    """One PNG a document from its UTF-8 text (null: empty), with digests read back."""
    data = documents.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return media_features(encoded(data)).withColumnRenamed("key", "doc_id")
