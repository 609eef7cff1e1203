"""Inspection without building."""

from cityloom import __main__ as command
from cityloom.operators import inspect


def test_products_and_commands(spark, tmp_path, capfd):
    (tmp_path / "roi").mkdir()
    (tmp_path / "roi" / "roi_manifest.json").write_text("{}")
    (tmp_path / "animation").mkdir()
    (tmp_path / "animation" / "b.gif").write_bytes(b"")
    (tmp_path / "animation" / "a.gif").write_bytes(b"")
    got = {r["product"]: (r.exists, r.path and r.path.rsplit("/", 1)[-1]) for r in inspect.overlay_products(spark, f"file://{tmp_path}").collect()}
    assert got == {"roi_manifest": (True, "roi_manifest.json"), "network_manifest": (False, None), "basemap": (False, None), "animation": (True, "a.gif")}
    cells = spark.createDataFrame([(r, c, float(r * 7 + c)) for r in range(8) for c in range(8)], "row_i long, col_i long, value double")
    cells.write.parquet(f"{tmp_path}/a")
    cells.withColumn("value", cells.value + 1).write.parquet(f"{tmp_path}/b")
    row = inspect.hotspot_input(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"), clusters=5, quantile=0.5).first()
    assert (row.cells_a, row.cells_b, row.cluster_count) == (64, 64, 5) and row.candidate_count == 32
    ring = [{"x": x, "y": -y} for x, y in ((1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0))]
    spark.createDataFrame([(1, "A", ring), (2, "B", ring), (3, "B", ring)], "city_id long, city_name string, ring array<struct<x: double, y: double>>").write.parquet(f"{tmp_path}/polygons")
    spark.createDataFrame([("A",), ("B",), ("C",)], "requested_name string").write.parquet(f"{tmp_path}/asked")
    found = {r.requested_name: (r.status, r.city_id, r.cells) for r in inspect.requested_regions(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/polygons"), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)).collect()}
    assert found == {"A": ("matched", 1, 12), "B": ("ambiguous", None, None), "C": ("unresolved", None, None)}
    command.main(["inspect-roi", f"{tmp_path}/asked", f"{tmp_path}/polygons"])
    command.main(["inspect-overlay", f"file://{tmp_path}"])
    command.main(["inspect-network", f"{tmp_path}/a", f"{tmp_path}/b"])
    out = capfd.readouterr().out
    assert "unresolved" in out and "roi_manifest.json" in out and "candidate_count" in out
