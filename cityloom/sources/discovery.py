"""Where inputs lie: projects, manifests, configurations and sources of roads."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources import readers


def require_columns(df: DataFrame, names: list[str], what: str = "the table") -> DataFrame:
    """df, if it has all the columns; else an error that names those it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def one_manifest(spark: SparkSession, folder: str, pattern: str = "*manifest*.json") -> str:
    """Path of the only manifest below a folder; none or several are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    found = [r.path for r in files.select("path").orderBy("path").limit(5).collect()]
    if len(found) != 1:
        raise ValueError(f"{folder} holds {len(found) or 'no'} manifests" + (": " + ", ".join(found) if found else ""))
    return found[0]


def manifest_content(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


@dataclass(frozen=True)
class HotspotConfig:
    n_clusters: int = 1000
    quantile: float = 0.5
    window: int = 3
    seed: int = 42


@dataclass(frozen=True)
class NetworkConfig:
    """How roads are asked for and how hotspots are made."""

    network_type: str = "drive"
    simplify: bool = True
    retain_all: bool = False
    truncate_by_edge: bool = True
    snap_cell: float = 250.0
    hotspots: HotspotConfig = field(default_factory=HotspotConfig)

    def to_dict(self) -> dict:
        return asdict(self)


class RoadSource(Protocol):
    """Where the roads of a city come from; a downloader may be one."""

    def load(self, spark: SparkSession, city: str) -> tuple[DataFrame, DataFrame]:
        """nodes (node_id, x, y) and raw edges (u, v, edge_key, length_m, highway, lanes)."""


@dataclass(frozen=True)
class ParquetRoads:
    """Roads as Parquet: nodes and edges below a folder for each city."""

    folder: str

    def load(self, spark: SparkSession, city: str) -> tuple[DataFrame, DataFrame]:
        base = f"{self.folder.rstrip('/')}/{city}"
        nodes = require_columns(spark.read.parquet(f"{base}/nodes"), ["node_id", "x", "y"], "nodes")
        return nodes, require_columns(spark.read.parquet(f"{base}/edges"), ["u", "v", "edge_key", "length_m", "highway", "lanes"], "edges")


@dataclass(frozen=True)
class GraphmlRoads:
    """Roads as a GraphML file for each city; names of keys come from its head."""

    folder: str

    def load(self, spark: SparkSession, city: str) -> tuple[DataFrame, DataFrame]:
        path = f"{self.folder.rstrip('/')}/{city}.graphml"
        keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
        name = {(r[2], r[1]): r[0] for r in keys.collect()}  # a key a column
        nodes, edges = readers.graphml(spark, path)
        of = lambda kind, key: F.element_at("data", name[kind, key]) if (kind, key) in name else F.lit(None).cast("string")
        points = nodes.select(F.col("id").cast("long").alias("node_id"), of("node", "x").cast("double").alias("x"), of("node", "y").cast("double").alias("y"))
        length = F.coalesce(of("edge", "length"), of("edge", "length_m")).cast("double")
        rows = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.monotonically_increasing_id().alias("edge_key"), length.alias("length_m"), of("edge", "highway").alias("highway"), of("edge", "lanes").alias("lanes"))
        if not points.limit(1).count():
            raise ValueError(f"{city} has no roads")
        return points, rows
