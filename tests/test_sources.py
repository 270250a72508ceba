"""Readers and writers: header rules, pushdown, types, skipping what exists."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rasterloom.session import materialize, scratch_root
from rasterloom.sources import readers as rd, writers as wr


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_labels_by_separator(spark, tmp_path):
    comma = _write(tmp_path / "a.csv", "lat,lon,id,class,discard\n60.5,-150,1,u ,\n61,-151,2,g,y\n")
    tab = _write(tmp_path / "b.csv", "lat\tlon\tid\tclass\tdiscard\n60.5\t-150\t1\tu \t\n61\t-151\t2\tg\ty\n")
    want = [(60.5, -150.0, 1, "u ", None), (61.0, -151.0, 2, "g", "y")]
    for path in (comma, tab):
        df = rd.read_labels(spark, path)
        assert df.dtypes[:3] == [("lat", "double"), ("lon", "double"), ("id", "bigint")]
        assert rows(df) == want
    with pytest.raises(ValueError, match="discard"):
        rd.read_labels(spark, _write(tmp_path / "c.csv", "lat,lon\n1,2\n"))


def test_catalog_short_and_blank_rows(spark, tmp_path):
    head = "\t".join(rd.CATALOG_SCHEMA.fieldNames())
    path = _write(tmp_path / "cat.txt", f"{head}\nndvi\tcontinuous\t-1\t*x*.tif\t/r\t1\n\t\t\nslope\tcontinuous\t1\t*.tif\t/r\t0\t255\told\n")
    got = {r["var_name"]: (r["data_band"], r["nodata"], r["path_filter"]) for r in rd.read_catalog(spark, path).collect()}
    assert got == {"ndvi": (-1, None, None), "slope": (1, 255, "old")}


def test_samples_have_a_fixed_schema(spark, tmp_path):
    path = _write(tmp_path / "s.txt", "obs_id\tx\ty\trow\tcol\tlabel\tv1\n7\t1.5\t2.5\t3\t4\t1\t0.25\n")
    assert rows(rd.read_samples(spark, path, "label", ["v1"])) == [(7, 1.5, 2.5, 3, 4, 1.0, 0.25)]


def test_empty_tile_table_is_an_error(spark, tmp_path):
    path = str(tmp_path / "tiles")
    spark.range(0).withColumnRenamed("id", "tile_id").write.parquet(path)
    with pytest.raises(ValueError, match="no features"):
        rd.read_tiles(spark, path)


def test_strip_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "px")
    spark.range(100).selectExpr("CAST(id / 10 AS INT) AS row", "CAST(id % 10 AS INT) AS col", "id AS b1", "id AS b2", "id AS b3").write.parquet(path)
    plan = rd.scan_strip(spark.read.parquet(path), 2, 5, ["b2"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,2)" in plan and "LessThan(row,5)" in plan
    assert "ReadSchema: struct<row:int,col:int,b2:bigint>" in plan


def test_window_beyond_the_raster_is_nodata(spark):
    px = spark.createDataFrame([(0, 0, 5), (1, 1, 6)], "row int, col int, v int")
    window = spark.createDataFrame([(-1, 1, 0, 1)], "r0 int, r1 int, c0 int, c1 int")
    want = [(-1, 0, -9), (-1, 1, -9), (0, 0, 5), (0, 1, -9), (1, 0, -9), (1, 1, 6)]
    assert rows(rd.scan_window(px, "v", window, -9), "row", "col", "v") == want


@pytest.mark.parametrize(
    "lo,hi,want",
    [(0, 255, "uint8"), (-1, 127, "int8"), (-1, 128, "int16"), (0, 300, "int16"), (0, 40000, "uint16"), (-1, 40000, "int32"), (0, 1.5, "float32")],
)
def test_min_dtype(spark, lo, hi, want):
    df = spark.createDataFrame([(float(lo),), (float(hi),)], "v double")
    assert wr.dtypes_of(df, ["v"]).first()[0] == want


def test_raster_round_trip(spark, tmp_path):
    grid = spark.createDataFrame([(r, c, None if r == c else r * 40) for r in range(6) for c in range(6)], "row int, col int, v int")
    path = str(tmp_path / "r")
    assert wr.write_raster(grid, "v", path, -1, F.floor(F.col("row") / 3)) == "int16"
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["v"] == "smallint" and back.count() == 36
    assert back.filter("v = -1").count() == 6
    plan = back.filter("tile_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_id" in plan


def test_decompose_skips_and_overwrites(spark, tmp_path):
    info = spark.createDataFrame([(1, "yrs"), (2, "fit"), (3, "fit")], "band int, out_type string")
    run = {"seg_index": "nbr", "date_range": "04150715", "n_verts": "07", "processed": "20200101"}

    def stack(value, tiles):
        return spark.createDataFrame([(0, 0, b, value, t) for b in (1, 2, 3) for t in tiles], "row int, col int, band int, value int, tile string")

    path = str(tmp_path / "out")

    def state():
        df = spark.read.schema("value int, tile string, out_type string, name string").parquet(path)
        return rows(df.groupBy("tile", "out_type").agg(F.count(F.lit(1)), F.max("value")))

    wr.decompose(stack(1, ["0001", "0002"]), info, run, path)
    wr.decompose(stack(9, ["0002", "0003"]), info, run, path)
    first = [("0001", "fit", 2, 1), ("0001", "yrs", 1, 1), ("0002", "fit", 2, 1), ("0002", "yrs", 1, 1), ("0003", "fit", 2, 9), ("0003", "yrs", 1, 9)]
    assert state() == first
    wr.decompose(stack(5, ["0002"]), info, run, path, overwrite=True)
    assert [r[3] for r in state()] == [1, 1, 5, 5, 9, 9]
    name = spark.read.schema("name string, tile string, out_type string").parquet(path).filter("tile = '0003' AND out_type = 'yrs'").first()["name"]
    assert name == "LTV3_nbr_04150715_0003_07_20200101_yrs"


def test_last_source_with_data_wins(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, -5)], "row int, col int, v int")
    b = spark.createDataFrame([(0, 0, 2), (0, 1, -5), (0, 2, -5)], "row int, col int, v int")
    assert rows(rd.virtual_mosaic([a, b], "v", -5)) == [(0, 0, 2), (0, 1, 1)]


def test_catalog_lookup_first_and_none(spark):
    cat = spark.createDataFrame([("v", r"^.*_2001\.tif$", "old")], "var_name string, search_re string, path_filter string")
    listing = spark.createDataFrame(
        [("v", "0001", "/r/b_2001.tif"), ("v", "0001", "/r/a_2001.tif"), ("v", "0001", "/r/old/a_2001.tif"), ("v", "0002", "/r/a_2002.tif")],
        "var_name string, tile string, path string",
    )
    got = rows(rd.catalog_lookup(listing.select("var_name", "tile").distinct(), listing, cat), "tile", "path")
    assert got == [("0001", "/r/a_2001.tif"), ("0002", None)]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, 2, None), (3, 4, 5)], "a int, b int, c int")
    kept, dropped = wr.quarantine(df, ["a", "c"])
    assert rows(kept) == [(3, 5)] and rows(dropped) == [(1, None)]


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(10).withColumn("v", F.col("id") * 2), "probe")
    assert df.agg(F.sum("v")).first()[0] == 90
    assert scratch_root(spark) in df.inputFiles()[0]
