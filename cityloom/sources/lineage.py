"""Working tables in the cluster's shared folder, which cut long lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # names only: kernels that travel by value may refer to this module


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path under spark.checkpoint.dir; it goes when the driver ends.

    A cluster without that setting raises ValueError; only a local session gets a folder
    of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cityloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/cityloom/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet under spark.checkpoint.dir and reads it back."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast value whose classes travel with it, as those of kernels do.

    Spark pickles what it broadcasts by reference, so executors without this package
    couldn't load a class of it.  Here the broadcast is bytes, pickled by value once; a
    task loads them at its first use of value.
    """

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.loaded = None

    def __getstate__(self):
        return {"held": self.held, "loaded": None}

    @property
    def value(self):
        if self.loaded is None:
            self.loaded = (cloudpickle.loads(self.held.value),)
        return self.loaded[0]

    def destroy(self) -> None:
        self.held.destroy()


@atexit.register
def _clean() -> None:
    context = SparkContext._active_spark_context
    for path in _made if context else []:
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            return
