"""The training-data queries where executors don't have this package."""

import sys

from tests.test_executors import REPO, run_apart


def test_queries_and_pipeline_run_where_executors_lack_the_package(tmp_path):
    sys.path.insert(0, REPO)
    import __spark_entry__

    names = sorted(n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline")
    assert len(names) >= 13
    got = run_apart(names, tmp_path)
    assert set(got) == set(names) and all(n > 0 for n in got.values())
