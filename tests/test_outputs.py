"""Files written and read back, bundles, basemaps and pictures."""

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.operators import basemap, regions, report
from cityloom.sources import outputs, readers

UNIT = (10.0, 0.0, 500.0, 0.0, -10.0, 900.0)


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    bands = rng.integers(-5, 50, (2, 300, 70)).astype("float32")
    content = outputs.encode_geotiff(bands, UNIT, -9999.0)
    for n in (1, 2):
        band, info = readers.geotiff(content, n)
        assert (band == bands[n - 1]).all()
    assert info == {"width": 70, "height": 300, "bands": 2, "nodata": -9999.0, "transform": UNIT}
    with pytest.raises(ValueError):
        readers.geotiff(content, 3)
    cells = spark.createDataFrame([(r, c, float(r * 9 + c), "a", t) for r in range(3) for c in range(4) for t in (0, 5)] + [(0, 0, 7.0, "b", 2), (2, 1, None, "b", 2)], "row_i long, col_i long, value double, name string, tick long")
    made = outputs.geotiffs(cells, f"file://{tmp_path}/t", UNIT, 3, 4, "name", band="tick", nodata=-1.0)
    assert {(r.file.rsplit("/", 1)[1], r.bands, r.samples) for r in made.collect()} == {("a.tif", 2, 24), ("b.tif", 1, 1)}
    rows = {(r.raster_id, r.row_i, r.col_i): r.value for r in readers.raster_tables(spark, f"file://{tmp_path}/t/*.tif").collect()}
    assert rows == {**{("a.tif", r, c): float(r * 9 + c) for r in range(3) for c in range(4)}, ("b.tif", 0, 0): 7.0}
    grid = {r.raster_id: r for r in readers.raster_grids(spark, f"file://{tmp_path}/t/*.tif").collect()}
    assert (grid["a.tif"].bands, grid["a.tif"].nodata, tuple(grid["a.tif"].transform)) == (2, -1.0, UNIT)


def test_interleaved_bands(spark):
    band = np.arange(12, dtype="<u2").reshape(3, 4)
    raw = np.stack([band, band + 100], axis=2).tobytes()
    tags = [(256, 3, [4]), (257, 3, [3]), (258, 3, [16]), (259, 3, [1]), (273, 4, [8]), (277, 3, [2]), (278, 3, [3]), (279, 4, [len(raw)])]
    directory = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, len(v)) + struct.pack("<H" if k == 3 else "<I", *v).ljust(4, b"\0") for t, k, v in tags) + b"\0" * 4
    content = struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + directory
    assert (readers.geotiff(content, 1)[0] == band).all() and (readers.geotiff(content, 2)[0] == band + 100).all()


def test_geopackage_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]), (2, None, [(1.0, 1.0), (2.0, 1.0), (2.0, 5.0)])], "id long, name string, points array<struct<x:double,y:double>>")
    path = f"file://{tmp_path}/x/y.gpkg"
    outputs.geopackage({"areas": (rows, "polygon"), "spots": (rows.withColumn("points", F.slice("points", 1, 1)), "point")}, path)
    got = {r.id: (r.name, [(p.x, p.y) for p in r.rings[0]]) for r in readers.gpkg_layer(spark, path, "areas", ["id", "name"]).collect()}
    assert got == {"1": ("a", [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]), "2": (None, [(1.0, 1.0), (2.0, 1.0), (2.0, 5.0), (1.0, 1.0)])}
    con = sqlite3.connect(tmp_path / "x" / "y.gpkg")
    assert con.execute("SELECT table_name, min_x, max_y FROM gpkg_contents ORDER BY 1").fetchall() == [("areas", 0.0, 5.0), ("spots", 0.0, 1.0)]


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.5, "a & <b>"), (2, 1.5, None)], "node_id long, x double, name string")
    edges = spark.createDataFrame([(1, 2, 7.0)], "u long, v long, length double")
    outputs.graphml(nodes, edges, f"file://{tmp_path}/g.graphml")
    n, e = readers.graphml(spark, f"file://{tmp_path}/g.graphml")
    assert {r.id: sorted(r.data.values()) for r in n.collect()} == {"1": ["0.5", "a & <b>"], "2": ["1.5"]}
    assert [(r.u, r.v, list(r.data.values())) for r in e.collect()] == [("1", "2", ["7.0"])]


def test_pictures(spark, tmp_path):
    image = outputs.encode_png(np.arange(24, dtype=np.uint8).reshape(2, 4, 3))
    at = image.index(b"IDAT")
    raw = zlib.decompress(image[at + 4 : at + 4 + struct.unpack(">I", image[at - 4 : at])[0]])
    assert raw == b"\0" + bytes(range(12)) + b"\0" + bytes(range(12, 24))
    gif = outputs.encode_gif([np.full((3, 5), 255, np.uint8), np.zeros((3, 5), np.uint8)])
    assert gif[:6] == b"GIF89a" and struct.unpack("<HH", gif[6:10]) == (5, 3) and gif.count(b"\x21\xf9\x04") == 2 and gif[-1:] == b";"
    cells = spark.createDataFrame([(0, 1, 2.0, 3), (1, 0, 4.0, 1)], "row_i long, col_i long, value double, tick long")
    assert sorted(r.file.rsplit("/", 1)[1] for r in outputs.heat_pngs(cells, f"file://{tmp_path}/p", 2, 2, "tick", 4.0).collect()) == ["1.png", "3.png"]
    outputs.heat_gif(cells, f"file://{tmp_path}/a.gif", 2, 2, "tick", 4.0)
    assert (tmp_path / "a.gif").read_bytes()[:6] == b"GIF89a" and (tmp_path / "p" / "1.png").exists()


def test_bundles_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/net"
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 5.0)], "u long, v long, length_m double")
    snapped = spark.createDataFrame([(7, 1.0, 1.0, 1, 0.0, 0.0, 1.414)], "cluster_id long, x double, y double, node_id long, node_x double, node_y double, snap_distance_m double")
    demand = spark.createDataFrame([(1, 1, 4.0)], "node_id long, hotspot_count long, sum_weight double")
    grid = spark.createDataFrame([(3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "cell_id long, points array<struct<x:double,y:double>>")
    outputs.network_bundle(spark, folder, "Rome", grid, nodes, edges, snapped, demand, snapped.select("cluster_id"), {"graph_crs": "x"})
    back = outputs.city_bundle(spark, folder, "Rome")
    assert back["manifest"]["graph_node_count"] == 2 and [tuple(r) for r in back["node_hotspot_demand"].collect()] == [(1, 1, 4.0)]
    assert readers.graphml(spark, f"{folder}/network.graphml")[0].count() == 2
    with pytest.raises(KeyError):
        outputs.city_bundle(spark, folder, "Oslo")
    for city in ("a", "b"):
        outputs.hotspot_bundle(spark, f"file://{tmp_path}/hot", city, snapped.select("cluster_id", "x", "y"), snapped.select("cluster_id"), {"k": 1})
    assert set(json.loads((tmp_path / "hot" / "manifest.json").read_text())["hotspots"]) == {"a", "b"}


def test_region_bundle(spark, tmp_path):
    grid = (1.0, 0.0, 0.0, 0.0, -1.0, 20.0)
    cells = spark.createDataFrame([(r, c, float(r * 100 + c)) for r in range(20) for c in range(20) if (r + c) % 3], "row_i long, col_i long, value double")
    vertices = spark.createDataFrame([(4, "Île X", i, x, y) for i, (x, y) in enumerate([(2.2, 3.0), (9.0, 2.0), (8.0, 9.5), (3.0, 8.0)])], "city_id long, city_name string, seq long, x double, y double")
    polygons = regions.polygons_of(vertices)
    record = outputs.roi_bundle(spark, f"file://{tmp_path}/roi", cells, polygons, grid, 1.5).first()
    baseline, info = readers.geotiff(open(record.baseline_path[7:], "rb").read())
    mask, _ = readers.geotiff(open(record.mask_path[7:], "rb").read())
    assert baseline.shape == mask.shape == (record.height, record.width) and "04_le_x" in record.baseline_path
    assert mask.sum() == record.pixel_count_inside_mask and (baseline != -9999).sum() == record.valid_baseline_pixels
    assert baseline[baseline != -9999].sum() == pytest.approx(record.baseline_sum) and list(record.bounds)[::3] == [info["transform"][2], info["transform"][5]]
    ring = [(2.2, 3.0), (9.0, 2.0), (8.0, 9.5), (3.0, 8.0)]

    def covered(x, y):
        inside, far = False, 1e9
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            far = min(far, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return inside or far <= 1.5

    want = {(r, c) for r in range(-5, 30) for c in range(-5, 30) if covered(c + 0.5, 20 - r - 0.5)}
    top, left = 20 - int(info["transform"][5]), int(info["transform"][2])
    assert {(int(r) + top, int(c) + left) for r, c in zip(*np.nonzero(mask))} == want
    assert json.loads((tmp_path / "roi" / "roi_manifest.json").read_text())["roi_count"] == 1


def test_basemap(spark):
    providers = {"Plain": {"Grey": basemap.Provider("Plain.Grey", "http://tiles/{z}/{x}/{y}.png", 5)}}
    provider = basemap.resolve_provider("Plain.Grey", providers)
    assert provider.url(3, 1, 2) == "http://tiles/3/1/2.png"
    for bad in ("Plain", "Plain.Red", "Plain.Grey.x"):
        with pytest.raises(ValueError):
            basemap.resolve_provider(bad, providers)

    def fetch(provider, zoom, x, y):
        return np.full((256, 256, 3), (40 * x + 7 * y) % 256, dtype=np.uint8).tobytes()

    cells, meta = basemap.build(spark, (900_000.0, 5_000_000.0, 1_300_000.0, 5_200_000.0), provider, fetch, long_side=24)
    rows = cells.collect()
    assert len(rows) == 24 * 12 and {(r.row_i, r.col_i) for r in rows} == {(i, j) for i in range(12) for j in range(24)}
    assert all(r.red == r.green == r.blue for r in rows) and any(r.red for r in rows) and 0 <= meta["zoom"] <= 5
    wrapped = spark.range(1).select(*basemap.wrapped_tile(F.lit(2), F.lit(-1), F.lit(3))).first()
    assert tuple(wrapped) == (3, 3)
    with pytest.raises(Exception, match="tile row"):
        spark.range(1).select(basemap.wrapped_tile(F.lit(2), F.lit(0), F.lit(4))[1]).collect()


def test_sources_and_peaks(spark):
    a = spark.createDataFrame([(1, 2)], "tick long, cell long")
    assert {(r.source_id, r.tick) for r in report.with_source({"x": a, "y": a}).collect()} == {("x", 1), ("y", 1)}
    positions = spark.createDataFrame([(0, 1), (4, 1), (4, 2)], "tick long, agent_id long")
    metrics = spark.createDataFrame([(0, 0.1), (3, 0.9), (9, 0.2)], "tick long, max_utilization double")
    assert {(r.tick, r.agent_id) for r in report.positions_at_peak(positions, metrics).collect()} == {(4, 1), (4, 2)}


def test_discovery_and_sources(spark, tmp_path):
    from cityloom.functions import catalog, geo
    from cityloom.sources import discovery, writers

    with pytest.raises(ValueError):
        discovery.require_columns(spark.range(1), ["id", "x"])
    folder = f"file://{tmp_path}/p"
    writers.manifest(spark, f"{folder}/a_manifest.json", {"rois": {"x": 1}})
    writers.manifest(spark, f"{folder}/a_manifest.json", {"rois": {"y": 2}}, merge=("rois",))
    path = discovery.one_manifest(spark, folder)
    assert discovery.manifest_content(spark, path) == {"rois": {"x": 1, "y": 2}}
    writers.manifest(spark, f"{folder}/b/other_manifest.json", {})
    with pytest.raises(ValueError):
        discovery.one_manifest(spark, folder)
    assert discovery.NetworkConfig().to_dict()["hotspots"]["n_clusters"] == 1000
    nodes = spark.createDataFrame([(1, 0.0, 1.0), (2, 5.0, 0.0)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 5.0, "primary")], "u long, v long, length double, highway string")
    outputs.graphml(nodes, edges, f"file://{tmp_path}/Rome.graphml")
    n, e = discovery.GraphmlRoads(f"file://{tmp_path}").load(spark, "Rome")
    assert {tuple(r) for r in n.collect()} == {(1, 0.0, 1.0), (2, 5.0, 0.0)} and [(r.u, r.v, r.length_m, r.highway, r.lanes) for r in e.collect()] == [(1, 2, 5.0, "primary", None)]
    n.write.parquet(f"file://{tmp_path}/q/Rome/nodes")
    e.write.parquet(f"file://{tmp_path}/q/Rome/edges")
    assert discovery.ParquetRoads(f"file://{tmp_path}/q").load(spark, "Rome")[0].count() == 2
    assert set(catalog.register(spark)) == {"slugify", "saturation", "tile_x", "tile_y", "sample_ticks"}
    assert spark.sql("SELECT slugify('A b!') AS a, tile_x(10D, 4) AS x, tile_y(50D, 4) AS y, saturation(0.9D) AS s").first()[:3] == ("a_b", 8, 5)
    assert [(r.tick, r.hour) for r in spark.sql("SELECT * FROM sample_ticks(0, 20, 10, 6D, 6D)").collect()] == [(0, 6.0), (10, 7.0), (20, 8.0)]
    line = geo.line_between(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0))
    assert tuple(spark.range(1).select(geo.line_centroid(line).alias("c")).first().c) == (2.0, 1.0)
