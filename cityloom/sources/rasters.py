"""GeoTIFF rasters as a Spark data source, read and written by tile blocks.

Reading plans from headers alone: a partition is a run of blocks of one file, and a task
reads the bytes of its own blocks by ranges.  Windows on row_i, col_i, band and raster_id
narrow the blocks, given as options or as filters (where Spark hands filters to Python
sources: ``spark.sql.python.filterPushdown.enabled``).  A block is the unit of memory, so
files may be of any size.

Writing has two phases: tasks append compressed tiles to part files of a draft folder and
report their sizes; the commit lays out offsets from the sizes, joins the parts, writes
the directory and renames the whole.  A failed task or commit leaves no file behind.

Files are opened by range through pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import fnmatch
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "cityloom_raster"
#: Bytes of samples that a partition reads, at least one block.
RUN = 32 << 20
SCHEMA = "raster_id string, band int, row_i long, col_i long, value double"


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def ranged(path: str):
    """A function (offset, size) that reads bytes of a file."""
    store, name = store_of(path)
    file = store.open_input_file(name)
    return lambda at, size: file.read_at(size, at)


def raster_files(path: str) -> list[str]:
    """A file, the .tif and .tiff files below a folder, or those that a pattern (* ? [] within
    names) matches, with the scheme of path."""
    store, name = store_of(path)
    head = path[: len(path) - len(name)] if path.endswith(name) else path.split("//", 1)[0] + "//" if "//" in path else "file:"
    steps = name.split("/")
    wild = next((i for i, x in enumerate(steps) if re.search(r"[*?\[]", x)), None)
    if wild is None and store.get_file_info(name).type == pafs.FileType.File:
        return [path]
    found = store.get_file_info(pafs.FileSelector("/".join(steps[:wild]), recursive=True))
    files = [f.path for f in found if f.type == pafs.FileType.File]
    if wild is None:
        files = [f for f in files if f.lower().endswith((".tif", ".tiff"))]
    else:
        files = [f for f in files if f.count("/") == name.count("/") and all(map(fnmatch.fnmatchcase, f.split("/"), steps))]
    return sorted(head + f for f in files)


# ---------------------------------------------------------------- blocks

# Fixed values of the TIFF format: types and their codes.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_OFFSETS, _SIZES = (324, 273), (325, 279)


@dataclass(frozen=True)
class Layout:
    """What a file's directory says; block addresses stay in the file until they are asked for."""

    order: str
    dtype: str
    width: int
    height: int
    block: tuple[int, int]  # rows, columns
    tiled: bool
    bands: int
    woven: int
    method: int
    predictor: int
    nodata: float | None
    transform: tuple[float, ...] | None
    addresses: tuple[tuple[int, int, str], tuple[int, int, str]]

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])


def layout(read) -> Layout:
    """The layout of a file, from its header and directory."""
    head = read(0, 16)
    e = "<" if head[:2] == b"II" else ">"
    big = struct.unpack_from(e + "H", head, 2)[0] == 43
    word, entry, room = ("Q", 20, 8) if big else ("I", 12, 4)
    at = struct.unpack_from(e + word, head, 8 if big else 4)[0]
    n = struct.unpack(e + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
    at += 8 if big else 2
    rows = read(at, entry * n)
    tags, places = {}, {}
    for i in range(n):
        tag, kind = struct.unpack_from(e + "HH", rows, entry * i)
        count = struct.unpack_from(e + word, rows, entry * i + 4)[0]
        code = _TYPES.get(kind)
        if code is None:
            continue
        size, value = struct.calcsize(e + code) * count, at + entry * i + (12 if big else 8)
        if size > room:
            value = struct.unpack_from(e + word, rows, value - at)[0]
        places[tag] = (value, count, code)
        if tag not in (*_OFFSETS, *_SIZES):
            data = read(value, size) if size > room else rows[value - at : value - at + size]
            tags[tag] = data if code == "s" else struct.unpack(f"{e}{count * len(code)}{code[0]}", data)
    first = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, tiled = tags[256][0], tags[257][0], 322 in tags
    kind = {1: "u", 2: "i", 3: "f"}[first(339, 1)]
    bands, transform = first(277, 1), None
    if 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[33550], tags[33922]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return Layout(
        e, f"{e}{kind}{tags[258][0] // 8}", width, height, (tags[323][0], tags[322][0]) if tiled else (min(height, first(278, height)), width), tiled, bands,
        bands if first(284, 1) == 1 else 1, first(259, 1), first(317, 1), float(tags[42113].rstrip(b"\0 ")) if 42113 in tags else None, transform,
        tuple(next(places[t] for t in pair if t in places) for pair in (_OFFSETS, _SIZES)),
    )


def addresses(read, found: Layout, first: int, count: int) -> list[tuple[int, int]]:
    """Offsets and sizes of count blocks from the block first on."""
    out = []
    for at, _, code in found.addresses:
        size = struct.calcsize(found.order + code)
        out.append(struct.unpack(f"{found.order}{count}{code}", read(at + first * size, count * size)))
    return list(zip(*out))


def _lzw(data: bytes) -> bytes:
    """TIFF's variable-width LZW, most significant bit first."""
    out = bytearray()
    value = bits = at = 0
    width, table, last = 9, [bytes([i]) for i in range(256)] + [b"", b""], b""
    while True:
        while bits < width and at < len(data):
            value = (value << 8) | data[at]
            at, bits = at + 1, bits + 8
        if bits < width:
            return bytes(out)
        bits -= width
        code = (value >> bits) & ((1 << width) - 1)
        value &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            width, table, last = 9, table[:258], b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            width = max(9, (len(table) + 1).bit_length())
        out += entry
        last = entry


def decoded(raw: bytes, found: Layout, rows: int) -> np.ndarray:
    """The samples (rows, columns, woven bands) of a block; no bytes are a block of no data."""
    shape = (rows, found.block[1], found.woven)
    dtype = np.dtype(found.dtype)
    if not raw:
        return np.full(shape, found.nodata or 0, dtype=dtype)
    if found.method == 5:
        raw = _lzw(raw)
    elif found.method in (8, 32946):
        raw = zlib.decompress(raw)
    elif found.method != 1:
        raise ValueError(f"compression {found.method} isn't read")
    count = int(np.prod(shape))
    if found.predictor == 3:  # differences of bytes, in planes from the highest byte on
        planes = np.frombuffer(raw, dtype=np.uint8, count=count * dtype.itemsize).reshape(rows, -1, found.woven)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, -1)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    block = np.frombuffer(raw, dtype=dtype, count=count).reshape(shape)
    if found.predictor == 2:
        return np.cumsum(block, axis=1, dtype=dtype)
    if found.predictor != 1:
        raise ValueError(f"predictor {found.predictor} isn't read")
    return block


def block_rows(found: Layout, y: int) -> int:
    return found.block[0] if found.tiled else min(found.block[0], found.height - y * found.block[0])


# ---------------------------------------------------------------- reading


@dataclass
class Run(InputPartition):
    """Blocks of one file: (plane, block row, first and end block column)."""

    path: str
    blocks: list[tuple[int, int, int, int]]

    def __init__(self, path: str, blocks: list):
        super().__init__(None)
        self.path, self.blocks = path, blocks


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.window = {c: [int(options.get(f"{c}_from", 0)), int(options.get(f"{c}_to", 1 << 62))] for c in ("row_i", "col_i")}  # from inclusive, to exclusive
        self.band = int(options["band"]) if "band" in options else None
        self.names: list[str] | None = None
        self.run = int(options.get("run_bytes", RUN))

    def partitions(self):
        out = []
        for path in raster_files(self.path):
            if self.names is not None and path.rsplit("/", 1)[-1] not in self.names:
                continue
            found = layout(ranged(path))
            if self.band is not None and not 1 <= self.band <= found.bands:
                raise ValueError(f"{path} has no band {self.band} of {found.bands}")
            (r0, r1), (c0, c1) = self.window["row_i"], self.window["col_i"]
            r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, found.height), min(c1, found.width)
            if r0 >= r1 or c0 >= c1:
                continue
            h, w = found.block
            most = max(1, self.run // (h * w * found.woven * np.dtype(found.dtype).itemsize))
            planes = [0] if found.woven > 1 or found.bands == 1 else range(found.bands) if self.band is None else [self.band - 1]
            held, n = [], 0
            for plane in planes:
                for y in range(r0 // h, -(-r1 // h)):
                    for x in range(c0 // w, -(-c1 // w), most):
                        end = min(x + most, -(-c1 // w))
                        if n and n + end - x > most:
                            out.append(Run(path, held))
                            held, n = [], 0
                        held.append((plane, y, x, end))
                        n += end - x
            if held:
                out.append(Run(path, held))
        return out or [Run("", [])]

    def read(self, partition: Run):
        if not partition.blocks:
            return
        read = ranged(partition.path)
        found, name = layout(read), partition.path.rsplit("/", 1)[-1]
        h, w = found.block
        (r0, r1), (c0, c1) = self.window["row_i"], self.window["col_i"]
        for plane, y, x, end in partition.blocks:
            places = addresses(read, found, (plane * found.down + y) * found.across + x, end - x)
            for k, (offset, size) in enumerate(places):
                rows = block_rows(found, y)
                block = decoded(read(offset, size) if size else b"", found, rows)
                top, left = y * h, (x + k) * w
                a, b = max(r0 - top, 0), min(r1 - top, rows, found.height - top)
                c, d = max(c0 - left, 0), min(c1 - left, w, found.width - left)
                for s in range(found.woven):
                    band = s + 1 if found.woven > 1 else plane + 1
                    if self.band is not None and band != self.band:
                        continue
                    part = block[a:b, c:d, s].astype(float)
                    keep = ~np.isnan(part) if found.nodata is None else ~np.isnan(part) & (part != float(np.dtype(found.dtype).type(found.nodata)))
                    i, j = np.nonzero(keep)
                    columns = [pa.array([name] * len(i), pa.string()), pa.array(np.full(len(i), band), pa.int32()), pa.array(i + a + top), pa.array(j + c + left), pa.array(part[i, j])]
                    yield pa.RecordBatch.from_arrays(columns, ["raster_id", "band", "row_i", "col_i", "value"])


class FilteredRasterReader(RasterReader):
    """A reader that also takes windows from filters; only where the session hands them on."""

    def pushFilters(self, filters):
        for f in filters:
            column, value = f.attribute[-1] if getattr(f, "attribute", None) else None, getattr(f, "value", None)
            if column in self.window and isinstance(value, int):
                span = self.window[column]
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    span[0] = max(span[0], value)
                if isinstance(f, GreaterThan):
                    span[0] = max(span[0], value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    span[1] = min(span[1], value + 1)
                if isinstance(f, LessThan):
                    span[1] = min(span[1], value)
            elif isinstance(f, EqualTo) and column == "band" and self.band is None:
                self.band = value
            elif isinstance(f, EqualTo) and column == "raster_id":
                self.names = [value]
            yield f  # Spark tests the rows again


# ---------------------------------------------------------------- writing


def directory(shape: tuple[int, int, int], dtype: np.dtype, transform, nodata: float | None, tile: int, epsg: int | None, offsets: list[int], sizes: list[int], place: int, big: bool) -> bytes:
    """The directory, and what it points to, of a tiled file of deflated bands apart, for
    a directory that stands at place."""
    n, h, w = shape
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]
    a, _, c, _, e, f = transform
    keys = [1, 1, 0, 1, 1025, 0, 1, 1] if epsg is None else [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, epsg]
    long = ("Q", 16) if big else ("I", 4)
    tags = [
        (256, "I", 4, [w]), (257, "I", 4, [h]), (258, "H", 3, [np.dtype(dtype).itemsize * 8] * n), (259, "H", 3, [8]), (262, "H", 3, [1]), (277, "H", 3, [n]), (284, "H", 3, [2 if n > 1 else 1]),
        (322, "H", 3, [tile]), (323, "H", 3, [tile]), (324, *long, offsets), (325, *long, sizes), (339, "H", 3, [kind] * n),
        (33550, "d", 12, [a, -e, 0.0]), (33922, "d", 12, [0.0, 0.0, 0.0, c, f, 0.0]), (34735, "H", 3, keys),
    ]
    if nodata is not None:
        tags.append((42113, "s", 2, [f"{nodata:g}".encode() + b"\0"]))
    entry, room = (20, 8) if big else (12, 4)
    extra_at = place + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    out, extra = struct.pack("<Q" if big else "<H", len(tags)), b""
    for tag, code, type_, values in tags:
        data = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        out += struct.pack("<HHQ" if big else "<HHI", tag, type_, len(data) if code == "s" else len(values))
        if len(data) <= room:
            out += data.ljust(room, b"\0")
        else:
            out += struct.pack("<Q" if big else "<I", extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
    return out + struct.pack("<Q" if big else "<I", 0) + extra


def file_head(place: int, big: bool) -> bytes:
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, place) if big else struct.pack("<2sHI", b"II", 42, place)


def deflated(block: np.ndarray) -> bytes:
    data = zlib.compress(np.ascontiguousarray(block).astype(block.dtype.newbyteorder("<")).tobytes())
    return data + b"\0" * (len(data) % 2)


@dataclass
class Part(WriterCommitMessage):
    name: str
    tiles: list[int]
    sizes: list[int]


class RasterWriter(DataSourceArrowWriter):
    """Writes rows (tile long: its place among the file's blocks, data binary)."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.path = options["path"]
        self.draft = f"{self.path}.draft-{uuid.uuid4().hex}"

    def write(self, iterator):
        store, name = store_of(f"{self.draft}/{uuid.uuid4().hex}")
        store.create_dir(name.rpartition("/")[0], recursive=True)
        tiles, sizes = [], []
        with store.open_output_stream(name) as out:
            for batch in iterator:
                for tile, data in zip(batch.column("tile").to_pylist(), batch.column("data").to_pylist()):
                    out.write(data)
                    tiles.append(tile)
                    sizes.append(len(data))
        return Part(name, tiles, sizes)

    def commit(self, messages):
        o = json.loads(self.options["layout"])
        shape, tile = tuple(o["shape"]), o["tile"]
        count = shape[0] * -(-shape[1] // tile) * -(-shape[2] // tile)
        parts = [m for m in messages if m is not None]
        total = sum(sum(m.sizes) for m in parts)
        big = total + 64 * count > (1 << 32) - (1 << 20) or bool(o.get("big"))
        offsets, sizes, at = [0] * count, [0] * count, len(file_head(0, big))
        for m in parts:
            for k, size in zip(m.tiles, m.sizes):
                if sizes[k]:
                    raise ValueError(f"block {k} is there twice")
                offsets[k], sizes[k], at = at, size, at + size
        store, final = store_of(self.path)
        _, whole = store_of(f"{self.draft}/whole")
        store.create_dir(whole.rpartition("/")[0], recursive=True)
        with store.open_output_stream(whole) as out:
            out.write(file_head(at, big))
            for m in parts:
                with store.open_input_stream(m.name) as part:
                    while data := part.read(8 << 20):
                        out.write(data)
            out.write(directory(shape, np.dtype(o["dtype"]), o["transform"], o["nodata"], tile, o["epsg"], offsets, sizes, at, big))
        store.move(whole, final)
        self.abort(messages)

    def abort(self, messages):
        store, name = store_of(self.draft)
        if store.get_file_info(name).type != pafs.FileType.NotFound:
            store.delete_dir(name)


class RasterSource(DataSource):
    """spark.read.format("cityloom_raster"): options path, band, row_i_from, row_i_to, col_i_from,
    col_i_to (ends not included), run_bytes, and filters ("true" where filters are handed on)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FilteredRasterReader(self.options) if self.options.get("filters") == "true" else RasterReader(self.options)

    def writer(self, schema, overwrite):
        return RasterWriter(self.options)


def scan(spark: SparkSession, path: str, band: int | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None, run_bytes: int = RUN) -> DataFrame:
    """raster_id, band, row_i, col_i, value of the samples in a window (ends not included);
    nodata and NaN samples are left out.  Only blocks that meet the window are read."""
    spark.dataSource.register(RasterSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(NAME).option("run_bytes", run_bytes).option("filters", filters)
    if band is not None:
        reader = reader.option("band", band)
    for column, span in (("row_i", rows), ("col_i", columns)):
        if span is not None:
            reader = reader.option(f"{column}_from", span[0]).option(f"{column}_to", span[1])
    return reader.load(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """raster_id, width, height, bands, block_rows, block_columns, nodata, transform (six numbers
    or null) of GeoTIFF files, from their headers alone."""
    files = spark.createDataFrame([(f,) for f in raster_files(path)], "path string")

    def run(batches):
        for batch in batches:
            for name in batch["path"]:
                x = layout(ranged(name))
                row = {"raster_id": name.rsplit("/", 1)[-1], "width": x.width, "height": x.height, "bands": x.bands, "block_rows": x.block[0], "block_columns": x.block[1], "nodata": x.nodata}
                yield pd.DataFrame({**{k: [v] for k, v in row.items()}, "transform": [None if x.transform is None else list(x.transform)]})

    return files.mapInPandas(run, "raster_id string, width long, height long, bands long, block_rows long, block_columns long, nodata double, transform array<double>")


def write(cells: DataFrame, path: str, transform: tuple[float, ...], height: int, width: int, bands: int = 1, nodata: float = -9999.0, dtype: str = "float32", tile: int = 256, epsg: int | None = None, big: bool = False) -> None:
    """One GeoTIFF of cells (row_i, col_i, value, and band from 1 where there are several).

    Cells go to tiles by one shuffle; a tile is compressed in a task; tiles without a cell
    take no room.  Of several values of a cell the largest stays; cells outside the raster,
    and tiles of other sizes than a multiple of 16, are an error.
    """
    if tile % 16 or tile <= 0:
        raise ValueError("a tile's side is a multiple of 16")
    across, down = -(-width // tile), -(-height // tile)
    band = F.col("band").cast("int") if "band" in cells.columns else F.lit(1)
    row, col = F.col("row_i").cast("long"), F.col("col_i").cast("long")
    inside = (row >= 0) & (row < height) & (col >= 0) & (col < width) & (band >= 1) & (band <= bands)
    place = ((band - 1) * down + F.floor(row / tile)) * across + F.floor(col / tile)
    at = F.when(inside, place).otherwise(F.raise_error(F.lit("a cell lies outside the raster")).cast("long"))
    kept = cells.where("value IS NOT NULL").select(at.cast("long").alias("tile"), (row % tile).cast("int").alias("r"), (col % tile).cast("int").alias("c"), F.col("value").cast("double").alias("value"))

    def run(key, frame):
        frame = frame.sort_values("value")
        block = np.full((tile, tile), nodata, dtype=dtype)
        block[frame["r"].to_numpy(), frame["c"].to_numpy()] = frame["value"].to_numpy()
        return pd.DataFrame({"tile": [key[0]], "data": [deflated(block)]})

    given = {"shape": [bands, height, width], "tile": tile, "dtype": dtype, "transform": list(transform), "nodata": nodata, "epsg": epsg, "big": big}
    spark = cells.sparkSession
    spark.dataSource.register(RasterSource)
    tiles = kept.groupBy("tile").applyInPandas(run, "tile long, data binary")
    tiles.write.format(NAME).option("layout", json.dumps(given)).mode("append").save(path)
