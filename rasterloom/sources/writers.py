"""Writers: rasters, decomposed stacks, quarantined samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Candidate types in the order they are tried, with their bounds.
INT_TYPES = [("uint8", 0, 255), ("int8", -128, 127), ("int16", -32768, 32767), ("uint16", 0, 65535)]
# Spark has no unsigned types: the next wider signed one holds them.
SPARK_TYPE = {"uint8": "short", "int8": "byte", "int16": "short", "uint16": "int", "int32": "int", "float32": "float"}


def min_dtype(lo: Column, hi: Column) -> Column:
    """Smallest type name that holds [lo, hi]; whole-number types only where the maximum is whole."""
    out = F.when(hi != F.floor(hi), "float32")
    for name, a, b in INT_TYPES:
        out = out.when((lo >= a) & (hi <= b), name)
    return out.otherwise("int32")


def dtypes_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """Smallest type per column, all columns in one pass."""
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    return ends.select(*[min_dtype(F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) for c in cols])


def write_raster(df: DataFrame, value: str, path: str, nodata: int, tile: Column) -> str:
    """Write a grid by tile with nodata filled in and the smallest type; returns the type name."""
    filled = df.withColumn(value, F.coalesce(value, F.lit(nodata)))
    dtype = dtypes_of(filled, [value]).first()[0]
    out = filled.withColumns({value: F.col(value).cast(SPARK_TYPE[dtype]), "tile_id": tile})
    # Sorted inside each file so that row and column statistics prune windowed reads.
    out.repartition("tile_id", F.floor(F.col("row") / 256)).sortWithinPartitions("row", "col").write.partitionBy("tile_id").parquet(path)
    return dtype


def output_name(run: dict, tile: Column, out_type: Column) -> Column:
    head = f"LTV3_{run['seg_index']}_{run['date_range']}_"
    return F.concat(F.lit(head), tile, F.lit(f"_{run['n_verts']}_{run['processed']}_"), out_type)


KEYS = ["seg_index", "date_range", "tile", "out_type"]


def decompose(stack: DataFrame, band_info: DataFrame, run: dict, path: str, overwrite: bool = False) -> None:
    """Split a long band stack into one partition per tile and output type.

    Outputs already present are skipped before anything is computed for them, unless overwriting.
    """
    spark = stack.sparkSession
    out = stack.join(band_info, "band").withColumns({"seg_index": F.lit(run["seg_index"]), "date_range": F.lit(run["date_range"])})
    out = out.withColumn("name", output_name(run, F.col("tile"), F.col("out_type")))
    if not overwrite and path_exists(spark, path):
        # Typed as text: inference would turn tile 0007 into 7.
        done = spark.read.schema(", ".join(f"{k} string" for k in KEYS)).parquet(path).distinct()
        out = out.join(done, KEYS, "left_anti")
    mode = "overwrite" if overwrite else "append"
    writer = out.repartition(*KEYS, F.floor(F.col("row") / 256)).write.mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def path_exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def quarantine(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without gaps, and the rows any NULL keeps out."""
    gap = F.lit(False)
    for c in df.columns:
        gap = gap | F.col(c).isNull()
    return df.filter(~gap).select(*cols), df.filter(gap).select(*cols)
