"""The raster data source and sink: windows, counted bytes, round trips, failures."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityloom.sources import outputs, rasters, readers

UNIT = (10.0, 0.0, 500.0, 0.0, -10.0, 900.0)


def _file(tmp_path, bands, name="a.tif", tile=16, nodata=-9999.0):
    path = tmp_path / name
    path.write_bytes(outputs.encode_geotiff(bands, UNIT, nodata, tile=tile))
    return str(path)


def _cells(array, nodata, rows=slice(None), columns=slice(None)):
    out = {}
    for b, band in enumerate(array):
        for r in range(*rows.indices(band.shape[0])):
            for c in range(*columns.indices(band.shape[1])):
                if band[r, c] != nodata and not np.isnan(band[r, c]):
                    out[b + 1, r, c] = float(band[r, c])
    return out


def test_scan_reads_all_bands_and_windows(spark, tmp_path):
    rng = np.random.default_rng(1)
    array = rng.integers(0, 9, (2, 50, 37)).astype(np.float32)
    array[array == 3] = -9999.0
    array[0, 1, 1] = np.nan
    path = _file(tmp_path, array)
    _file(tmp_path, array[:1, :20, :20] + 100, "b.tif")
    got = rasters.scan(spark, str(tmp_path), run_bytes=2 * 16 * 16 * 4)
    assert got.rdd.getNumPartitions() > 8
    rows = {(r.band, r.row_i, r.col_i): r.value for r in got.where("raster_id = 'a.tif'").collect()}
    assert rows == _cells(array, -9999.0)
    part = rasters.scan(spark, path, 2, (10, 30), (5, 20)).collect()
    assert {(r.band, r.row_i, r.col_i): r.value for r in part} == {k: v for k, v in _cells(array, -9999.0, slice(10, 30), slice(5, 20)).items() if k[0] == 2}
    assert rasters.scan(spark, path, rows=(90, 99)).count() == 0
    with pytest.raises(Exception, match="no band"):
        rasters.scan(spark, path, band=5).count()
    assert {(r.row_i, r.col_i): r.value for r in readers.raster_tables(spark, path).collect()} == {k[1:]: v for k, v in _cells(array[:1], -9999.0).items()}


def test_filters_narrow_the_blocks(spark, tmp_path):
    array = np.arange(64 * 64, dtype=np.float32).reshape(1, 64, 64)
    path = _file(tmp_path, array, nodata=None)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = rasters.scan(spark, path, run_bytes=1).where((F.col("row_i") >= 20) & (F.col("row_i") < 30) & (F.col("col_i") == 40))
        assert got.rdd.getNumPartitions() == 1
        assert sorted(r.value for r in got.collect()) == [float(r * 64 + 40) for r in range(20, 30)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_only_blocks_of_the_window_and_headers_are_read(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    array = rng.standard_normal((1, 512, 512)).astype(np.float32)
    path = _file(tmp_path, array, tile=64)
    size, read = os.path.getsize(path), []
    plain = rasters.ranged

    def counted(p):
        inner = plain(p)

        def f(at, n):
            read.append(n)
            return inner(at, n)

        return f

    monkeypatch.setattr(rasters, "ranged", counted)
    reader = rasters.RasterReader({"path": path, "row_i_from": "70", "row_i_to": "120", "col_i_from": "10", "col_i_to": "60"})
    parts = reader.partitions()
    assert sum(read) < 1000  # the header alone
    rows = [b.num_rows for p in parts for b in reader.read(p)]
    assert sum(rows) == 50 * 50
    assert sum(read) < 1.5 * size / 64 + 2000  # one block of 64


def test_round_trip_of_a_raster_larger_than_its_tasks(spark, tmp_path):
    rows = spark.range(300 * 200, numPartitions=6).select((F.col("id") % 300).alias("row_i"), F.floor(F.col("id") / 300).alias("col_i"))
    cells = rows.withColumn("band", F.explode(F.array(F.lit(1), F.lit(3)))).withColumn("value", (F.col("row_i") * 7 + F.col("col_i") + F.col("band") * 1000) % 997).where("(row_i + col_i) % 3 <> 0")
    for big in (False, True):
        path = f"file://{tmp_path}/out-{big}.tif"
        rasters.write(cells, path, UNIT, 300, 200, bands=3, tile=32, epsg=3857, big=big)
        back = rasters.scan(spark, path)
        assert back.select("band", "row_i", "col_i", "value").exceptAll(cells.selectExpr("cast(band as int)", "row_i", "cast(col_i as long)", "cast(value as double)")).count() == 0
        assert back.count() == cells.count()
        info = rasters.metadata(spark, path).first()
        assert (info.width, info.height, info.bands, info.block_rows, info.nodata, tuple(info.transform)) == (200, 300, 3, 32, -9999.0, UNIT)
        band, tags = readers.geotiff((tmp_path / f"out-{big}.tif").read_bytes(), 2)
        assert (band == -9999.0).all() and tags["transform"] == UNIT  # a band without a cell takes no room
    assert sorted(os.listdir(tmp_path)) == ["out-False.tif", "out-True.tif"]
    rasters.write(cells.limit(0), f"file://{tmp_path}/none.tif", UNIT, 10, 10)
    assert rasters.scan(spark, f"{tmp_path}/none.tif").count() == 0


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (99, 0, 1.0)], "row_i long, col_i long, value double").repartition(2)
    with pytest.raises(Exception, match="outside"):
        rasters.write(cells, f"{tmp_path}/bad.tif", UNIT, 10, 10)
    assert not os.path.exists(tmp_path / "bad.tif") and not [f for f in os.listdir(tmp_path) if "draft" in f]
    with pytest.raises(ValueError):
        rasters.write(cells, f"{tmp_path}/bad.tif", UNIT, 10, 10, tile=10)


def test_predictors_and_rotation():
    rng = np.random.default_rng(3)
    values = rng.standard_normal((8, 5)).astype(np.float32)
    planes = values.astype(">f4").view(np.uint8).reshape(8, 5, 4).transpose(0, 2, 1).reshape(8, 20)
    coded = np.diff(planes, axis=1, prepend=np.zeros((8, 1), np.uint8)).astype(np.uint8)
    found = rasters.Layout("<", "<f4", 5, 8, (8, 5), False, 1, 1, 8, 3, None, None, ((0, 1, "I"), (0, 1, "I")))
    assert (rasters.decoded(zlib.compress(coded.tobytes()), found, 8)[:, :, 0] == values).all()
    whole = rng.integers(0, 1000, (8, 5)).astype(np.uint16)
    coded = np.diff(whole, axis=1, prepend=np.zeros((8, 1), np.uint16)).astype("<u2")
    found = rasters.Layout("<", "<u2", 5, 8, (8, 5), False, 1, 1, 1, 2, None, None, ((0, 1, "I"), (0, 1, "I")))
    assert (rasters.decoded(coded.tobytes(), found, 8)[:, :, 0] == whole).all()
    import struct

    entries = [(256, 4, 1, struct.pack("<I", 2)), (257, 4, 1, struct.pack("<I", 1)), (258, 3, 1, struct.pack("<HH", 8, 0)), (273, 4, 1, struct.pack("<I", 8)), (279, 4, 1, struct.pack("<I", 2))]
    turned = struct.pack("<16d", 0.0, 2.0, 0.0, 5.0, -3.0, 0.0, 0.0, 6.0, *[0.0] * 7, 1.0)
    place = 8 + 2 + 12 * 6 + 4
    body = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 6) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack("<HHII", 34264, 12, 16, place) + struct.pack("<I", 0) + turned
    found = rasters.layout(lambda at, n: body[at : at + n])
    assert found.transform == (0.0, 2.0, 5.0, -3.0, 0.0, 6.0)
