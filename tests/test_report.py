from cityloom.operators import report
from cityloom.plans import registry
from cityloom.plans.fixtures import view
from cityloom.operators import flow
from cityloom.operators.simulation import Config

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_render_tables(spark):
    edges = registry._edges(spark, DATA)
    used = flow.utilisation(view(spark, DATA, "edge_history"), edges)
    heat = report.corridor_heatmap(used, 240, 3)
    assert heat.count() == 240 * min(3, used.select("u", "v").distinct().count())
    frames = report.animation_frames(used, edges, 0, 20, 10, major_only=False)
    assert frames.count() == 3 * edges.count()
    series = report.timeseries({"baseline": registry._metrics(spark, DATA)})
    assert series.select("metric").distinct().count() == 6


def test_config_is_checked():
    with pytest.raises(ValueError):
        Config(n_agents=0)


def test_command_line(spark, tmp_path):
    from cityloom.__main__ import main

    for n in "ab":
        spark.createDataFrame([(i, j, float(i * j + 1)) for i in range(6) for j in range(6)], "row_i long, col_i long, value double").write.parquet(str(tmp_path / n))
    main(["baseline", str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "fused")])
    assert spark.read.parquet(str(tmp_path / "fused")).count() == 36
    main(["hotspots", str(tmp_path / "fused"), str(tmp_path / "clusters"), "--clusters", "3"])
    assert spark.read.parquet(str(tmp_path / "clusters")).count() <= 3
