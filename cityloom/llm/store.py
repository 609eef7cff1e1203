"""Shared working storage, readers and connected components.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` so that any
executor, also a replacement for a lost one, can read them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources.lineage import Shared


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only a local session, whose executors share the driver's disk, gets a folder of its
    own where none is set; on a cluster a missing setting raises ValueError.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cityloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else "file://" + root


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_open: list[Workspace] = []
#: Rows that go to Python at a time.
BATCH = 1000


class Workspace:
    """Working tables and broadcast values of one run of one operator.

    Everything made through it is removed by close(), but for what is named there, and
    at the latest when the driver ends.  Two runs never touch each other's tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.values = spark, [], []
        most = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if int(spark.conf.get(most, "10000")) > BATCH:  # texts may be long, and batches lie outside the heap
            spark.conf.set(most, str(BATCH))
        _open.append(self)

    def path(self, tag: str) -> str:
        path = f"{shared_root(self.spark).rstrip('/')}/cityloom/{tag}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def written(self, df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> DataFrame:
        """Cuts the lineage: writes df as Parquet in the shared folder and reads it back."""
        path = self.path(tag)
        writer = df.write.options(**(options or {}))
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_at = path
        return out

    def share(self, value):
        """value as a broadcast, so that closures stay small; its classes travel with it."""
        out = Shared(self.spark, value)
        self.values.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of written() that nothing will read again."""
        for df in tables:
            remove(self.spark, df.stored_at)
            self.paths.remove(df.stored_at)

    def close(self, *kept: DataFrame) -> None:
        stay = [df.stored_at for df in kept]
        for path in self.paths:
            if path not in stay:
                remove(self.spark, path)
        for value in self.values:
            value.destroy()
        self.paths, self.values = stay, []
        if not stay:
            _open.remove(self)


@atexit.register
def _clean() -> None:
    for work in _open:
        try:
            for path in work.paths:
                remove(work.spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Smallest node reachable from each node of undirected edges (a, b).

    In a round every node takes the least of its neighbours and itself as its label, and
    that one's label in turn; edges are drawn anew between labels, and between a label
    and its own label where these differ, so no connection is lost.  Labels only fall
    and a component's smallest node keeps itself; it ends when no edge is left, and
    labels that haven't converged are never returned.
    Tables of a round are written to the shared folder; only counts come to the driver.
    Nodes without edges don't appear.  Returns node, component (a table of work).
    """
    edges = edges.select("a", "b").where("a <> b")
    both = work.written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None
    for _ in range(_MOST_ROUNDS):
        least = work.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("near")), "cc-least")
        far = least.select(F.col("node").alias("near"), F.col("near").alias("label"))
        jumped = work.written(least.join(far, "near").select("node", "label"), "cc-jumped")
        work.drop(least)
        to = jumped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        if labels is None:
            labels, old = jumped, []
        else:
            old = [labels, jumped]
            labels = work.written(labels.join(to, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "cc-labels")
        drawn = both.where("a < b")
        for end in ("a", "b"):
            drawn = drawn.join(jumped.select(F.col("node").alias(end), F.col("label").alias("root")), end).drop(end).withColumnRenamed("root", end)
        chain = jumped.join(to, "label").select(F.col("label").alias("a"), F.col("next").alias("b"))
        drawn = drawn.select("a", "b").union(chain).where("a <> b")
        drawn = work.written(drawn.union(drawn.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
        work.drop(both, *old)
        both = drawn
        if not both.limit(1).count():
            work.drop(both)
            out = labels.select("node", F.col("label").alias("component"))
            out.stored_at = labels.stored_at
            return out
    raise RuntimeError("components don't converge")


#: Far more than labels need to fall along a path of as many nodes as 64 bits can name.
_MOST_ROUNDS = 512


def row_keys(*columns: str) -> list[F.Column]:
    """Two 64-bit hashes of the columns, as row_a and row_b: 128 bits that name a row."""
    return [F.xxhash64(*columns).alias("row_a"), F.xxhash64(F.lit("second"), *columns[::-1]).alias("row_b")]


#: Keys a bit set takes at most (2**28 bits, 32 MB); above it keys are joined by shuffle.
MOST_KEYS = 1 << 24


def bit_set(keys: DataFrame, key: str, work: Workspace):
    """A broadcast bit set over the long column key of a stored table, 16 bits a key; None
    beyond MOST_KEYS keys."""
    n = keys.count()
    if n > MOST_KEYS:
        return None
    bits = 1 << 16
    while bits < 16 * n:
        bits *= 2
    block = min(bits, 1 << 19)
    spots = keys.select(F.explode(F.array(F.pmod(key, F.lit(bits)), F.pmod(F.shiftright(key, 32), F.lit(bits)))).alias("at")).withColumn("block", F.floor(F.col("at") / block))

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at, of = (batch.column(i).to_numpy() for i in (0, 1))
            for b in np.unique(of).tolist():
                held = parts.setdefault(b, np.zeros(block, dtype=bool))
                held[at[of == b] - b * block] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()], pa.binary())], ["block", "held"])

    words = np.zeros(bits // 32, dtype=np.uint32)
    for row in spots.repartition(max(1, bits // block), "block").mapInArrow(run, "block long, held binary").collect():  # 32 MB at most
        words[row.block * block // 32 : (row.block + 1) * block // 32] |= np.frombuffer(row.held, dtype="<u4")
    return work.share(words)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (signed) may be in a bit set: all that are, and few others."""
    keep = np.ones(len(hashes), dtype=bool)
    for at in (np.mod(hashes, 32 * len(words)), np.mod(hashes >> 32, 32 * len(words))):
        keep &= ((words[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
    return keep


def maybe_in(df: DataFrame, key: str, keys: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Rows of df whose long column key may be among the column key of keys, and the rest.

    A bit set decides, so nearly all other rows are told apart without a shuffle; a join
    must follow for certainty.  Where there are too many keys for one, every row may be
    in (the rest is None) and the join sees all.
    """
    held = bit_set(keys, key, work)
    if held is None:
        return df, None

    @F.pandas_udf("boolean")
    def inside(hashes: pd.Series) -> pd.Series:
        return pd.Series(may_hold(held.value, hashes.to_numpy(dtype=np.int64)))

    marked = df.withColumn("_maybe", inside(F.col(key)))
    return marked.where("_maybe").drop("_maybe"), marked.where("NOT _maybe").drop("_maybe")


#: A key with more than a MOST_HOT-th of the rows is hot, so there are fewer than that.
MOST_HOT = 1000
SALTS = 32


def hot_keys(rows: DataFrame, key: list[str], least: int = 1000) -> DataFrame:
    """The keys of a stored table that hold more than 1 / MOST_HOT of its rows (and more
    than least): at most MOST_HOT rows, so they may be broadcast."""
    n = rows.count()
    return rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(least, n // MOST_HOT)).select(*key)


def spread_join(rows: DataFrame, facts: DataFrame, key: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to facts, which has few rows for a key; rows of hot keys are dealt to
    SALTS tasks and the facts of these keys are sent to each of them."""
    if not hot.limit(1).count():
        return rows.join(facts, key, how)
    flag = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    deal = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = rows.join(flag, key, "left").withColumn("_salt", deal).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = facts.join(flag, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def labelled_texts(documents: DataFrame, picked: DataFrame, most_chars: int) -> list:
    """Rows of documents (doc_id, text and few others) that have a text, joined to picked,
    at most most_chars characters in all.

    picked is a bounded list of doc_ids with labels.  Texts are taken in the order of a
    hash of doc_id and text as long as they fit, those that don't being passed over;
    repeated rows count once.  Only lengths come to the driver before that, and only of
    as many rows as there could be room for.
    """
    found = documents.select("*", *row_keys("doc_id", "text")).where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    lengths = found.groupBy("row_a", "row_b").agg(F.max(F.length("text")).alias("n"))
    room, taken = most_chars, []
    for row in lengths.where(F.col("n") <= most_chars).orderBy("row_a", "row_b").limit(20 * picked.count() + 1000).collect():
        if row.n <= room:
            room -= row.n
            taken.append((row.row_a, row.row_b))
    if not taken:
        return []
    chosen = documents.sparkSession.createDataFrame(taken, "row_a long, row_b long")
    rows = found.join(F.broadcast(chosen), ["row_a", "row_b"]).dropDuplicates([c for c in found.columns if c != "text"]).drop("row_a", "row_b").collect()
    return sorted(rows, key=lambda r: [str(r[c]) for c in sorted(r.__fields__)])
