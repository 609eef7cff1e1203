"""Queries where executors don't have this package: Python workers with another path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://{shared}").config("spark.sql.session.timeZone", "UTC").getOrCreate())
def absent(_):
    import importlib.util
    return [importlib.util.find_spec("cityloom") is None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [True], "workers find the package"
import __spark_entry__
found = __spark_entry__.queries()
for name in {names!r}:
    f = found[name]
    n = f(spark, "/root/testdata/sf0.001").count()
    print("rows", name, n, flush=True)
"""


def run_apart(names, tmp_path):
    """Rows of each query, run in a session of its own whose workers don't have the package."""
    empty, shared = tmp_path / "empty", tmp_path / "shared"
    empty.mkdir()
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, shared=shared, names=names)], cwd=empty, env=env, capture_output=True, text=True, timeout=1500)
    assert done.returncode == 0, done.stderr[-3000:]
    return {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("rows ")}


def test_queries_run_where_executors_lack_the_package(tmp_path):
    names = ["local_mean", "shortest_paths", "largest_scc", "snap_nearest", "forecast_recurrent", "forecast_halo", "warp_exact", "simulate"]
    sys.path.insert(0, REPO)
    import __spark_entry__

    names = [n for n in names if n in __spark_entry__.queries()]
    assert all(n > 0 for n in run_apart(names, tmp_path).values()) and len(names) >= 7
