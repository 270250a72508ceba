"""Sources, sinks and catalog queries. Files are derived from the given tables and written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions.names import glob_to_regex
from rasterloom.plans.registry import query
from rasterloom.session import scratch_path
from rasterloom.sources import readers as rd, writers as wr


@query("scan_delimited", "label_points", """
SELECT 'comma' AS kind, id, lat, lon, class, discard FROM label_points UNION ALL SELECT 'tab', id, lat, lon, class, discard FROM label_points""")
def scan_delimited(spark, d):
    pts = fx.label_points(spark, d).select("lat", "lon", "id", "class", "discard")
    out = None
    for kind, sep in (("comma", ","), ("tab", "\t")):
        path = scratch_path(spark, f"labels-{kind}")
        (pts.write.option("header", True).option("sep", sep)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        part = rd.read_labels(spark, path).select(F.lit(kind).alias("kind"), "id", "lat", "lon", "class", "discard")
        out = part if out is None else out.unionByName(part)
    return out


@query("scan_samples", "samples", "SELECT obs_pt AS obs_id, x, y, row, col, CAST(target AS DOUBLE) AS target, val FROM samples")
def scan_samples(spark, d):
    path = scratch_path(spark, "samples")
    s = fx.samples(spark, d).select(F.col("obs_pt").alias("obs_id"), "x", "y", "row", "col", "target", "val")
    s.write.option("header", True).option("sep", "\t").csv(path)
    return rd.read_samples(spark, path, "target", ["val"])


@query("scan_catalog", "", """
SELECT 'v' || p_partkey AS var_name, p_size AS data_band, CASE WHEN p_size > 25 THEN 255 END * 1e0 AS nodata,
  CASE WHEN p_size > 40 THEN 'old' END AS path_filter FROM part""")
def scan_catalog(spark, d):
    path = scratch_path(spark, "catalog")
    p = F.col("p_size")
    rows = fx.table(spark, d, "part").select(
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("var_name"), F.lit("continuous").alias("data_type"),
        p.alias("data_band"), F.lit("*.tif").alias("search_str"), F.lit("/r").alias("basepath"), F.lit(1).alias("by_tile"),
        F.when(p > 25, 255).alias("nodata"), F.when(p > 40, "old").alias("path_filter"),
    )
    blank = rows.select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    rows.unionByName(blank).write.option("header", True).option("sep", "\t").csv(path)
    cat = rd.read_catalog(spark, path)
    return cat.select("var_name", "data_band", F.col("nodata").cast("double").alias("nodata"), "path_filter")


@query("scan_window", "samples dem", """
e AS (SELECT -3 AS r0, max(row) - 3 AS r1, -2 AS c0, max(col) + 2 AS c1 FROM samples),
w AS (SELECT r AS row, c AS col FROM e, unnest(generate_series(r0, r1)) AS a(r), unnest(generate_series(c0, c1)) AS b(c))
SELECT CAST(w.row AS INT) AS row, CAST(w.col AS INT) AS col, coalesce(v, -9999) AS v FROM w LEFT JOIN dem p ON p.row = w.row AND p.col = w.col""")
def scan_window(spark, d):
    bounds = fx.samples(spark, d).agg(
        F.lit(-3).alias("r0"), (F.max("row") - 3).alias("r1"), F.lit(-2).alias("c0"), (F.max("col") + 2).alias("c1")
    )
    return rd.scan_window(fx.dem(spark, d), "v", bounds, -9999)


@query("scan_strip", "dem", "SELECT row, col, v, z FROM dem WHERE row >= 10 AND row < 30")
def scan_strip(spark, d):
    return rd.scan_strip(fx.dem(spark, d), 10, 30, ["v", "z"])


@query("catalog_lookup", "", """
WITH l AS (SELECT 'var' || p_partkey % 6 AS var_name, right('000' || p_partkey % 130, 4) AS tile,
  CASE p_size % 3 WHEN 0 THEN 2001 WHEN 1 THEN 2016 ELSE 2019 END AS y, CASE WHEN p_size > 40 THEN 'old' ELSE 'new' END AS f, p_partkey FROM part),
p AS (SELECT *, '/r/' || var_name || '/' || tile || '/' || f || '_' || y || '_' || p_partkey || '.tif' AS path FROM l),
g AS (SELECT var_name, tile, min(path) AS path FROM p WHERE y = 2001 AND (f <> 'old' OR var_name IN ('var0', 'var3')) GROUP BY var_name, tile)
SELECT w.var_name, w.tile, g.path FROM (SELECT DISTINCT var_name, tile FROM l) w LEFT JOIN g ON g.var_name = w.var_name AND g.tile = w.tile""")
def catalog_lookup(spark, d):
    k = F.col("p_partkey")
    year = F.when(F.col("p_size") % 3 == 0, "2001").when(F.col("p_size") % 3 == 1, "2016").otherwise("2019")
    var = F.concat(F.lit("var"), (k % 6).cast("string"))
    tile = F.right(F.concat(F.lit("000"), (k % 130).cast("string")), F.lit(4))
    age = F.when(F.col("p_size") > 40, "old").otherwise("new")
    path = F.concat(F.concat_ws("/", F.lit("/r"), var, tile, F.concat_ws("_", age, year, k.cast("string"))), F.lit(".tif"))
    listing = fx.table(spark, d, "part").select(var.alias("var_name"), tile.alias("tile"), path.alias("path"))
    catalog = listing.select("var_name").distinct().select(
        "var_name", F.lit(glob_to_regex("*_2001_*.tif")).alias("search_re"),
        F.when(~F.col("var_name").isin("var0", "var3"), "old").alias("path_filter"),
    )
    return rd.catalog_lookup(listing.select("var_name", "tile").distinct(), listing, catalog)


@query("band_for_year", "obs", "SELECT obs_id, yr, CASE WHEN b3 = 0 THEN yr - 1990 + 1 ELSE b3 END AS band FROM obs")
def band_for_year(spark, d):
    band = F.when(F.col("b3") == 0, -1).otherwise(F.col("b3"))
    return fx.obs(spark, d).select("obs_id", "yr", rd.band_for_year(band, F.col("yr"), 1990).alias("band"))


@query("geocell_filter", "", """
WITH f AS (SELECT o_orderkey AS id, 'n' || (55 + o_custkey % 12) || 'w' || (140 + o_orderkey % 25) AS cell FROM orders),
c AS (SELECT DISTINCT 'n' || (55 + s_suppkey % 10) || 'w' || (140 + s_suppkey % 23) AS cell FROM supplier)
SELECT id FROM f WHERE cell IN (SELECT cell FROM c)""")
def geocell_filter(spark, d):
    lat, lon = (55 + F.col("o_custkey") % 12).cast("string"), (140 + F.col("o_orderkey") % 25).cast("string")
    n, w = F.when(F.col("o_orderkey") % 2 == 0, "N").otherwise("n"), F.when(F.col("o_orderkey") % 2 == 0, "W").otherwise("w")
    files = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("DSM_"), n, lat, F.lit("_"), w, lon, F.lit("P.tif")).alias("name")
    )
    s = F.col("s_suppkey")
    cells = fx.table(spark, d, "supplier").select(
        F.concat(F.lit("n"), (55 + s % 10).cast("string"), F.lit("w"), (140 + s % 23).cast("string")).alias("cell")
    )
    return rd.geocell_filter(files, cells).select("id")


@query("virtual_mosaic", "obs dem", """
s AS (SELECT row, col, CASE WHEN cls > 40 THEN -10000 ELSE v END AS v, 0 AS i FROM dem
  UNION ALL SELECT row, col, CASE WHEN max(b4) > 900 THEN -10000 ELSE max(b4) END, 1 FROM obs WHERE sensor = 'LE07' GROUP BY row, col
  UNION ALL SELECT row, col, CASE WHEN min(b4) < 300 THEN -10000 ELSE min(b4) END, 2 FROM obs WHERE sensor = 'LC08' GROUP BY row, col),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY i DESC) AS k FROM s WHERE v <> -10000)
SELECT row, col, v FROM r WHERE k = 1""")
def virtual_mosaic(spark, d):
    o = fx.obs(spark, d)
    base = fx.dem(spark, d).withColumn("v", F.when(F.col("cls") > 40, -10000).otherwise(F.col("v")))
    le7 = o.filter("sensor = 'LE07'").groupBy("row", "col").agg(F.max("b4").alias("m"))
    lc8 = o.filter("sensor = 'LC08'").groupBy("row", "col").agg(F.min("b4").alias("m"))
    le7 = le7.withColumn("v", F.when(F.col("m") > 900, -10000).otherwise(F.col("m")))
    lc8 = lc8.withColumn("v", F.when(F.col("m") < 300, -10000).otherwise(F.col("m")))
    return rd.virtual_mosaic([base, le7, lc8], "v", -10000)


@query("manifest_pattern", "task_events", """
SELECT event_id, task_id, state FROM task_events WHERE task_id >= 10 AND task_id NOT BETWEEN 70 AND 79 AND task_id % 10 <> 7
  AND ts > TIMESTAMP '2024-01-05' AND state NOT IN ('FAILED', 'CANCELED')""")
def manifest_pattern(spark, d):
    t = F.col("task_id")
    name = F.concat(F.lit("run_"), F.lpad(t.cast("string"), 3, "0"), F.lit("_"), (t % 10).cast("string"), F.lit(".tif"))
    tasks = fx.task_events(spark, d).withColumn("description", name)
    since = F.lit("2024-01-05").cast("timestamp_ntz")
    out = rd.manifest(tasks, "run_*_*.tif!run_*_7.tif", since)
    out = rd.manifest(out, "*!run_00*", since)
    return rd.manifest(out, "*!run_07*", since).select("event_id", "task_id", "state")


@query("min_dtype", "obs samples", """
SELECT 'uint8' AS b1, 'uint16' AS wide, 'int16' AS signed, CASE WHEN max(b1) - 60 <= 127 THEN 'int8' END AS small, 'int32' AS big, 'float32' AS frac FROM obs""")
def min_dtype(spark, d):
    o = fx.obs(spark, d).select(
        "b1", (F.col("b4") * 60).alias("wide"), (F.col("b4") - 500).alias("signed"), (F.col("b1") - 60).alias("small"),
        (F.col("b4") * -100).alias("big"), (F.col("b4") / 7).alias("frac"),
    )
    return wr.dtypes_of(o, o.columns)


@query("sink_raster", "dem", """
SELECT row, col, CASE WHEN cls = 50 THEN -1 ELSE cls END AS value, CAST(floor(row / 16) AS INT) AS tile_id, 'int8' AS dtype FROM dem""")
def sink_raster(spark, d):
    path = scratch_path(spark, "raster")
    grid = fx.dem(spark, d).select("row", "col", F.nullif(F.col("cls"), F.lit(50)).alias("value"))
    dtype = wr.write_raster(grid, "value", path, -1, F.floor(F.col("row") / 16))
    return spark.read.parquet(path).select("row", "col", F.col("value").cast("int").alias("value"), "tile_id", F.lit(dtype).alias("dtype"))


@query("sink_decomposed", "obs", """
b AS (SELECT row, col, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3 FROM obs GROUP BY row, col),
l AS (SELECT row, col, 1 AS band, b1 AS v FROM b UNION ALL SELECT row, col, 2, b2 FROM b UNION ALL SELECT row, col, 3, b3 FROM b)
SELECT right('000' || CAST(floor(row / 16) AS INT), 4) AS tile, CASE WHEN band = 1 THEN 'vert_yrs' ELSE 'vert_fit' END AS out_type,
  'LTV3_nbr_04150715_' || right('000' || CAST(floor(row / 16) AS INT), 4) || '_07_20200101_' || CASE WHEN band = 1 THEN 'vert_yrs' ELSE 'vert_fit' END AS name,
  count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM l GROUP BY ALL""")
def sink_decomposed(spark, d):
    o = fx.obs(spark, d).groupBy("row", "col").agg(*[F.max(f"b{i}").alias(str(i)) for i in (1, 2, 3)])
    long = o.unpivot(["row", "col"], ["1", "2", "3"], "band", "value")
    tile = F.right(F.concat(F.lit("000"), F.floor(F.col("row") / 16).cast("string")), F.lit(4))
    long = long.withColumns({"band": F.col("band").cast("int"), "tile": tile})
    info = spark.createDataFrame([(1, "vert_yrs"), (2, "vert_fit"), (3, "vert_fit")], "band int, out_type string")
    run = {"seg_index": "nbr", "date_range": "04150715", "n_verts": "07", "processed": "20200101"}
    path = scratch_path(spark, "decomposed")
    wr.decompose(long, info, run, path)
    wr.decompose(long, info, run, path)  # every output exists now: the second run adds nothing
    back = spark.read.schema("row int, value int, name string, tile string, out_type string").parquet(path).groupBy("tile", "out_type", "name")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("quarantine_nulls", "obs", """
SELECT obs_id, b1, b2 * 1e0 AS b2, b3 * 1e0 AS b3, CASE WHEN b2 IS NULL OR b3 IS NULL THEN 'dropped' ELSE 'kept' END AS status
FROM (SELECT obs_id, b1, nullif(b2, 0) AS b2, nullif(b3, 0) AS b3 FROM obs)""")
def quarantine_nulls(spark, d):
    o = fx.obs(spark, d).select("obs_id", "b1", *[F.nullif(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("b2", "b3")])
    kept, dropped = wr.quarantine(o, ["obs_id", "b1", "b2", "b3"])
    return kept.withColumn("status", F.lit("kept")).unionByName(dropped.withColumn("status", F.lit("dropped")))


@query("tile_features", "sets", "SELECT set_id, ul_x, ul_y, lr_x, lr_y, oob_rate FROM sets")
def tile_features(spark, d):
    path = scratch_path(spark, "features")
    fx.sets(spark, d).select("ul_x", "ul_y", "set_id", "lr_x", "lr_y", "oob_rate").write.parquet(path)
    return rd.read_tiles(spark, path, "set_id")
