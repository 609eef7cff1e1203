import json
import sqlite3
import struct

import numpy as np
import pytest

from cityloom.sources import rasters, readers, writers


def _tiff(a, nodata=-9999.0):
    data = a.astype("<f4").tobytes()
    text = str(nodata).encode() + b"\0"
    head = 8 + 2 + 12 * 12 + 4
    extra = struct.pack("<3d", 10.0, 10.0, 0.0) + struct.pack("<6d", 0, 0, 0, 100.0, 900.0, 0) + text
    at = head + len(extra)
    tags = [(256, 4, 1, a.shape[1]), (257, 4, 1, a.shape[0]), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, at), (277, 3, 1, 1), (278, 4, 1, a.shape[0]), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, head), (33922, 12, 6, head + 24), (42113, 2, len(text), head + 72)]
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + extra + data


def test_geotiff(spark, tmp_path):
    a = np.array([[1.5, -9999.0, 3.0], [np.nan, 5.0, 6.0]])
    band, info = readers.geotiff(_tiff(a))
    assert np.array_equal(band, a.astype(np.float32), equal_nan=True)
    assert info["transform"] == (10.0, 0.0, 100.0, 0.0, -10.0, 900.0) and info["nodata"] == -9999.0
    (tmp_path / "a.tif").write_bytes(_tiff(a))
    got = {(r.row_i, r.col_i): r.value for r in readers.raster_tables(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.5, (0, 2): 3.0, (1, 1): 5.0, (1, 2): 6.0}


def test_lzw():
    codes, bits = [256, 65, 66, 258, 260, 257], ""
    for c in codes:
        bits += format(c, "09b")
    bits += "0" * (-len(bits) % 8)
    assert rasters._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"ABABABA"


def test_gpkg(spark, tmp_path):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    file = tmp_path / "x.gpkg"
    con = sqlite3.connect(file)
    con.execute("CREATE TABLE urban (name TEXT, geom BLOB)")
    con.execute("INSERT INTO urban VALUES ('A', ?)", [b"GP\0\1" + struct.pack("<i", 0) + wkb])
    con.commit()
    con.close()
    row = readers.gpkg_layer(spark, str(file), "urban", ["name"]).first()
    assert row.name == "A" and [(p.x, p.y) for p in row.rings[0]] == ring
    with pytest.raises(Exception, match="lacks"):
        readers.gpkg_layer(spark, str(file), "urban", ["area"]).collect()


def test_npy_and_manifest(spark, tmp_path):
    t = spark.createDataFrame([(0, 1, 2.0, 0.5), (4, 3, 1.0, 0.25)], "tick long, cell long, volume double, utilization double")
    writers.tensor_npy(t, str(tmp_path / "t.npy"), [0, 4], 2, 2, ["volume", "utilization"])
    got = {(r.tick, r.channel, r.row_i, r.col_i): r.value for r in readers.npy_tensors(spark, str(tmp_path / "t.npy")).collect()}
    assert got == {(0, 0, 0, 1): 2.0, (0, 1, 0, 1): 0.5, (1, 0, 1, 1): 1.0, (1, 1, 1, 1): 0.25}
    assert [r.volume for r in writers.tensor_frames(t, 2, 2, ["volume"]).orderBy("tick").collect()] == [[0, 2, 0, 0], [0, 0, 0, 1]]
    path = f"file://{tmp_path}/m.json"
    writers.manifest(spark, path, {"scenarios": {"a": 1}, "n": 1}, ("scenarios",))
    writers.manifest(spark, path, {"scenarios": {"b": 2}, "n": 2}, ("scenarios",))
    assert json.loads((tmp_path / "m.json").read_text()) == {"scenarios": {"a": 1, "b": 2}, "n": 2}


def test_graphml_and_manifest_lookup(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="1"><data key="x">5</data></node><node id="2"/><edge source="1" target="2"><data key="length">9.5</data></edge></graph></graphml>')
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.data for r in nodes.collect()} == {"1": {"x": "5"}, "2": {}}
    assert [(r.u, r.v, r.data["length"]) for r in edges.collect()] == [("1", "2", "9.5")]
    (tmp_path / "m.json").write_text(json.dumps({"rois": [{"matched_name": "A", "width": 3}]}))
    assert readers.roi_record(spark, str(tmp_path / "m.json"), "A").first().width == 3
    with pytest.raises(KeyError):
        readers.roi_record(spark, str(tmp_path / "m.json"), "B")
