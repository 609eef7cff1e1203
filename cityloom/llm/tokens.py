"""Token-ID output: sequences in training order, in shards of fixed stride.

Texts become token ids and an end mark, packed one after another into sequences of
``length`` ids (the last of a task's is filled with the end mark).  Sequences get dense
numbers; a keyed Feistel permutation with cycle-walking maps number to slot, so order
is a random-looking bijection that needs no sort by random keys and no state.  Slots
are range-partitioned; a task writes whole shards, where slot s is at byte
``(s % per_shard) * stride`` of shard ``s // per_shard``, so a reader may begin anywhere.

Sequences are compressed for the shuffle with a dictionary of a thousand of them.
A shard is written under a name of its own and then renamed, so a repeated or lost
task leaves one whole file.  Null texts count as empty; an empty text is an end mark;
an empty table has no sequences.  Repeated rows are repeated in the output, null doc_ids
stay null, extra columns are ignored.  What a sequence holds depends on how Spark splits
the input; every token is in one in any case.  Memory of a task follows its longest text.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm.store import Workspace
from cityloom.llm.textops import mix64, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256
# The splitting pattern of the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---------------------------------------------------------------- permutation


def permuted(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of range(size) at numbers: a balanced Feistel network over
    the least power of four that holds size, walked until the result is in range."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.array([(key * 0x9E3779B97F4A7C15 + i) % (1 << 64) for i in range(1, rounds + 1)], dtype=np.uint64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= size).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


# ---------------------------------------------------------------- tokens

class Tokenizer:
    """Encodes whole texts with the content of a byte-pair vocabulary file; no special tokens."""

    def __init__(self, content: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids of text as two bytes each, lowest first."""
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


@dataclass(frozen=True)
class Layout:
    length: int = 1024
    per_shard: int = 2048
    key: int = 20_240_501
    vocabulary: str = VOCABULARY

    @property
    def stride(self) -> int:
        return 2 * self.length


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file: of the driver's disk, or of any store that Spark reads."""
    if "://" in path and not path.startswith("file:"):
        return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with open("/" + path[5:].lstrip("/") if path.startswith("file:") else path, "rb") as file:
        return file.read()


_PACKED = "part int, local long, ids binary, docs array<bigint>, starts array<int>"


def packed(documents: DataFrame, layout: Layout, work: Workspace) -> DataFrame:
    """part, local, ids, docs, starts: a task's texts packed into sequences.

    docs and starts name the texts that have ids in a sequence and where they begin
    in it (0 for one that goes on from the sequence before).
    """
    stride = layout.stride
    words = work.share(vocabulary(documents.sparkSession, layout.vocabulary))
    names = [x.split()[0] for x in _PACKED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = Tokenizer(words.value)
        end = END.to_bytes(2, "little")
        n, held, docs, starts, out = 0, bytearray(), [], [], []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(coder.encode(text or "") + end)
                at = 0
                while at < len(ids):
                    docs.append(doc)
                    starts.append(len(held) // 2)
                    take = min(len(ids) - at, stride - len(held))
                    held += ids[at : at + take]
                    at += take
                    if len(held) == stride:
                        out.append((part, n, bytes(held), docs, starts))
                        n, held, docs, starts = n + 1, bytearray(), [], []
                        if len(out) >= 1000:
                            yield table()
                            out = []
        if held:
            out.append((part, n, bytes(held) + end * ((stride - len(held)) // 2), docs, starts))
        if out:
            yield table()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PACKED)


# ---------------------------------------------------------------- shards


def _store(uri: str):
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _trained(sample: list[bytes]) -> bytes:
    """A compression dictionary; none where the sample is too small or too plain for one."""
    try:
        return zstandard.train_dictionary(1 << 17, sample).as_bytes() if len(sample) >= 100 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


_INDEX = "slot long, shard long, offset long, docs array<bigint>, starts array<int>, crc long"


def write_shards(sequences: DataFrame, path: str, layout: Layout, work: Workspace) -> DataFrame:
    """Writes shards from packed() rows; returns slot, shard, offset, docs, starts, crc.

    The rows must be stable (a stored table): slots depend on counts of its parts.
    """
    counts = {r.part: r.n for r in sequences.groupBy("part").agg(F.max("local").alias("n")).collect()}
    total, before = 0, {}
    for part in sorted(counts):
        before[part] = total
        total += counts[part] + 1
    sample = [r.ids for r in sequences.select("ids").limit(1000).collect()]  # 2 MB at the default length
    words = work.share(_trained(sample))
    firsts = np.array([before.get(p, 0) for p in range(max(counts, default=0) + 1)], dtype=np.int64)

    def place(batches):
        pack = zstandard.ZstdCompressor(level=6, **_dictionary(words.value))
        for batch in batches:
            number = firsts[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            slot = permuted(number, total, layout.key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // layout.per_shard), pa.array([pack.compress(x) for x in batch.column(2).to_pylist()], pa.binary()), *batch.columns[3:]], ["slot", "shard", "ids", "docs", "starts"])

    shards = max(1, -(-total // layout.per_shard))  # ids are compressed for the shuffle only
    placed = sequences.mapInArrow(place, "slot long, shard long, ids binary, docs array<bigint>, starts array<int>")
    ordered = placed.repartitionByRange(min(shards, 20_000), "shard").sortWithinPartitions("slot")
    stride, per_shard = layout.stride, layout.per_shard

    def write(batches):
        store, root = _store(path)
        unpack = zstandard.ZstdDecompressor(**_dictionary(words.value))
        store.create_dir(root, recursive=True)
        now, file, name = None, None, None

        def close():
            if file:
                file.close()
                store.move(name, f"{root}/{shard_name(now)}")

        for batch in batches:
            slot, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            crc = []
            for s, packed_ids in zip(shard.tolist(), batch.column(2).to_pylist()):
                ids = unpack.decompress(packed_ids, max_output_size=stride)
                if s != now:
                    close()
                    now, name = s, f"{root}/.{shard_name(s)}.{uuid.uuid4().hex}"
                    file = store.open_output_stream(name)
                file.write(ids)
                crc.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((slot % per_shard) * stride), batch.column(3), batch.column(4), pa.array(crc, pa.int64())], ["slot", "shard", "offset", "docs", "starts", "crc"])
        close()

    return work.written(ordered.mapInArrow(write, _INDEX), "token-index")


def read_shards(spark: SparkSession, path: str, total: int, layout: Layout, first: int = 0) -> DataFrame:
    """slot, n_tokens, n_ends, sum, crc of the slots from first to total, read in order."""
    stride, per_shard = layout.stride, layout.per_shard
    ids = spark.range(first // per_shard, max(first // per_shard, -(-total // per_shard)), 1, max(1, min(20_000, -(-total // per_shard))))

    def run(batches):
        store, root = _store(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                low = max(first, shard * per_shard)
                rows = []
                with store.open_input_file(f"{root}/{shard_name(shard)}") as file:
                    file.seek((low % per_shard) * stride)
                    for slot in range(low, min(total, (shard + 1) * per_shard)):
                        data = file.read(stride)
                        if len(data) != stride:
                            raise ValueError(f"shard {shard} ends before slot {slot}")
                        x = np.frombuffer(data, dtype="<u2")
                        rows.append((slot, len(x), int((x == END).sum()), int(x.sum(dtype=np.int64)), zlib.crc32(data)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["slot", "n_tokens", "n_ends", "id_sum", "crc"])

    return ids.mapInArrow(run, "slot long, n_tokens long, n_ends long, id_sum long, crc long")


def read_slots(index: DataFrame, path: str, layout: Layout) -> DataFrame:
    """The rows of write_shards() with what their slots hold now: n_tokens, n_ends, id_sum.

    Rows of a shard lie together in order, so its file is read front to back.  Bytes
    that differ from those written raise ValueError.
    """
    names = ["slot", "shard", "offset", "doc_ids", "starts", "n_tokens", "n_ends", "id_sum", "crc"]

    def run(batches):
        store, root = _store(path)
        now, file = None, None
        for batch in batches:
            rows = []
            for slot, shard, offset, crc in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if shard != now:
                    if file:
                        file.close()
                    now, file = shard, store.open_input_file(f"{root}/{shard_name(shard)}")
                data = file.read_at(layout.stride, offset)
                if zlib.crc32(data) != crc:
                    raise ValueError(f"slot {slot} read back differs from what was written")
                x = np.frombuffer(data, dtype="<u2")
                rows.append((len(x), int((x == END).sum()), int(x.sum(dtype=np.int64))))
            found = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found, batch.column(5)], names)
        if file:
            file.close()

    return index.select("slot", "shard", "offset", "docs", "starts", "crc").mapInArrow(
        run, "slot long, shard long, offset long, doc_ids array<bigint>, starts array<int>, n_tokens long, n_ends long, id_sum long, crc long"
    )


def materialised(documents: DataFrame, layout: Layout = Layout(), path: str | None = None) -> DataFrame:
    """Writes all documents as shards under path and reads every slot back.

    One row a slot: slot, shard, offset, doc_ids, starts, n_tokens, n_ends, id_sum, crc.
    """
    work = Workspace(documents.sparkSession)
    path = path or work.path("shards")
    dense = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
    sequences = work.written(packed(documents, layout, work), "token-sequences", options=dense)
    index = write_shards(sequences, path, layout, work)
    work.drop(sequences)
    return read_slots(index, path, layout)
