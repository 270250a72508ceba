"""Readers for label, sample, catalog and tile tables, and windowed pixel scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rasterloom.functions.names import glob_to_regex

LABEL_FIELDS = ["lat", "lon", "value", "id", "class", "image_date", "image_source", "notes", "discard", "reason"]
LABEL_TYPES = {"lat": "double", "lon": "double", "value": "int", "id": "long"}
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("var_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("data_band", T.IntegerType()),
        T.StructField("search_str", T.StringType()),
        T.StructField("basepath", T.StringType()),
        T.StructField("by_tile", T.IntegerType()),
        T.StructField("nodata", T.IntegerType()),
        T.StructField("path_filter", T.StringType()),
    ]
)


def read_labels(spark: SparkSession, path: str, required: str = "discard") -> DataFrame:
    """Label table, comma-separated, or tab-separated where a comma header lacks the required column.

    Only the header decides the separator. Dates stay text; known fields get their type, the rest are strings.
    """
    for sep in (",", "\t"):
        reader = spark.read.option("header", True).option("sep", sep)
        cols = reader.csv(path, inferSchema=False).columns
        if required in cols:
            df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in cols])).csv(path)
            # Blanks around codes are meaningful; CSV keeps them by default.
            return df.select(*[F.col(f"`{c}`").cast(LABEL_TYPES.get(c, "string")).alias(c or "_index") for c in cols])
    raise ValueError(f"no column {required!r} in {path}, neither comma- nor tab-separated")


def read_samples(spark: SparkSession, path: str, target: str, predictors: list[str] = ()) -> DataFrame:
    """Tab-separated sample table keyed by ``obs_id``, with a fixed schema."""
    ids = [("obs_id", T.LongType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("row", T.IntegerType()), ("col", T.IntegerType())]
    rest = [(c, T.DoubleType()) for c in (target, *predictors)]
    schema = T.StructType([T.StructField(n, t) for n, t in ids + rest])
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Predictor catalog; short rows get NULL in the trailing columns, blank rows go."""
    reader = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(CATALOG_SCHEMA).csv(path).dropna(subset=["var_name"])


def read_tiles(spark: SparkSession, path: str, key: str = "tile_id") -> DataFrame:
    """Tile attribute table; an empty one is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no features in {path}")
    return df.select(key, *[c for c in df.columns if c != key])


def scan_window(pixels: DataFrame, value: str, bounds: DataFrame, nodata: int) -> DataFrame:
    """Every cell of the window, nodata where the raster has none.

    ``bounds`` is one row (r0, r1, c0, c1), ends included. The window's cells are generated row by row across tasks.
    """
    b = bounds.select("r0", "r1", "c0", "c1")
    rows = b.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").repartition("row")
    window = rows.select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
    lim = bounds.select(F.struct("r0", "r1", "c0", "c1")).scalar()
    inside = pixels.filter(F.col("row").between(lim["r0"], lim["r1"]) & F.col("col").between(lim["c0"], lim["c1"]))
    out = window.join(inside.select("row", "col", value), ["row", "col"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(nodata)))


def scan_strip(pixels: DataFrame, first: int, end: int, bands: list[str]) -> DataFrame:
    """Rows ``[first, end)`` of the listed bands; both reach a Parquet scan as pushed filter and read schema."""
    return pixels.filter((F.col("row") >= first) & (F.col("row") < end)).select("row", "col", *bands)


def band_for_year(band: Column, year: Column, band_start_year: int) -> Column:
    """A negative band number means one band per year from ``band_start_year`` on."""
    return F.when(band < 0, year - band_start_year + 1).otherwise(band)


def catalog_lookup(wanted: DataFrame, listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """First path (in path order) per variable and tile that matches the search glob and not the filter.

    ``listing`` holds (var_name, tile, path). The first match is an aggregate, so it combines map-side.
    """
    rules = catalog.select("var_name", "search_re", "path_filter")
    found = listing.join(rules, "var_name")
    name = F.element_at(F.split("path", "/"), -1)
    skip = F.col("path_filter").isNotNull() & F.contains("path", "path_filter")
    found = found.filter(F.rlike(name, F.col("search_re")) & ~skip)
    first = found.groupBy("var_name", "tile").agg(F.min("path").alias("path"))
    return wanted.join(first, ["var_name", "tile"], "left")


def geocell_filter(files: DataFrame, cells: DataFrame, name: str = "name", cell: str = "cell") -> DataFrame:
    """Files naming any listed geocell (such as n61w155), whatever the case."""
    parts = F.regexp_extract(F.lower(name), r"([ns]\d{2}).*?([ew]\d{3})", 1), F.regexp_extract(F.lower(name), r"([ns]\d{2}).*?([ew]\d{3})", 2)
    tagged = files.withColumn("_cell", F.concat(*parts))
    return tagged.join(cells.select(F.lower(cell).alias("_cell")), "_cell", "left_semi").drop("_cell")


def virtual_mosaic(sources: list[DataFrame], value: str, nodata: int) -> DataFrame:
    """One grid from many sources: nodata is ignored and the last source with data wins."""
    tagged = [s.select("row", "col", F.col(value).alias("_v")).withColumn("_i", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    top = F.max(F.when(F.col("_v") != nodata, F.struct("_i", "_v")))
    return both.groupBy("row", "col").agg(top.alias("_t")).filter("_t IS NOT NULL").select("row", "col", F.col("_t._v").alias(value))


def manifest(tasks: DataFrame, pattern: str, since) -> DataFrame:
    """Tasks whose description matches ``keep!drop`` wildcards, created after ``since`` and not failed."""
    keep, _, drop = pattern.partition("!")
    rule = F.col("description").rlike(glob_to_regex(keep)) & (F.col("ts") > since) & ~F.col("state").isin("FAILED", "CANCELED")
    if drop:
        rule = rule & ~F.col("description").rlike(glob_to_regex(drop))
    return tasks.filter(rule)
