"""Zone, band and year summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.functions.registry import stat


def zonal_stats(burnt: DataFrame, zone: str, value: str, stats: list[str], source: str, nodata: int = 255) -> DataFrame:
    """Statistics per zone over its pixels with data; columns are prefixed with the source name."""
    kept = burnt.withColumn("_v", F.nullif(F.col(value), F.lit(nodata)))
    # A count of pixels with data, unlike the registry's plain row count.
    build = {"count": lambda v: F.count(v), "majority": stat("mode")}
    aggs = [build.get(s, stat(s) if s not in build else None)(F.col("_v")).alias(f"{source}_{s}") for s in stats]
    return kept.groupBy(zone).agg(*aggs)


def elevation_band(cells: DataFrame, by: list[str], step: int = 250) -> DataFrame:
    """Adds ``lower_bound`` per cell; bands start at the region's lowest elevation (not below 0).

    A cell at the region maximum falls in no band when the range is a multiple of the step.
    """
    ends = cells.groupBy(*by).agg(F.min("z").cast("int").alias("_lo"), F.max("z").cast("int").alias("_hi"))
    ends = ends.withColumn("_lo", F.greatest("_lo", F.lit(0)))
    out = cells.join(ends, by).filter(F.col("z") >= F.col("_lo"))
    low = F.col("_lo") + (F.floor((F.col("z") - F.col("_lo")) / step) * step).cast("int")
    return out.withColumn("lower_bound", low).filter(F.col("lower_bound") < F.col("_hi")).drop("_lo", "_hi")


def band_means(values: DataFrame, by: list[str], first: str, last: str, step: int = 250) -> DataFrame:
    """Mean of non-zero first and last values per key and band."""
    def mean(c: str) -> Column:
        return F.avg(F.nullif(F.col(c), F.lit(0)))

    out = values.groupBy(*by, "lower_bound").agg(mean(first).alias("first_day_mean"), mean(last).alias("last_day_mean"))
    return out.withColumn("upper_bound", F.col("lower_bound") + step)


def change_between(start: DataFrame, end: DataFrame, zone: str, res: float = 30.0) -> DataFrame:
    """Percent change relative to the end value, and area change in square kilometres, of two tables."""
    return change(start.join(end, zone), zone, res)


def change(both: DataFrame, zone: str, res: float = 30.0) -> DataFrame:
    """As ``change_between``, from one table with ``start_sum`` and ``end_sum``."""
    gap = F.col("end_sum") - F.col("start_sum")
    return both.select(
        zone,
        (F.try_divide(gap, F.col("end_sum")) * 100).alias("pct_change"),
        (gap * F.lit(res) * F.lit(res) / F.lit(1e6)).alias("area_change"),
    )


def percent_error(mapped: DataFrame, reference: DataFrame, zone: str) -> DataFrame:
    """Percent error against a reference count of two tables; zones without a finite value are dropped."""
    return error(mapped.join(reference, zone), zone)


def error(both: DataFrame, zone: str) -> DataFrame:
    """As ``percent_error``, from one table with ``map_count`` and ``ref_count``."""
    err = F.try_divide(F.col("map_count") - F.col("ref_count"), F.col("ref_count")) * 100
    return both.select(zone, err.alias("pct_err")).dropna()


def area_table(counts: DataFrame, unit: str, levels: list[str], res: float = 30.0) -> DataFrame:
    """Areas per year and unit, one column per certainty level, with a ``total`` row per year."""
    km2 = F.sum("pixels") * F.lit(res * res) / F.lit(1e6)
    per = counts.groupBy("yr", unit).pivot("level", levels).agg(km2).na.fill(0.0)
    sums = [F.sum(v).alias(v) for v in levels]
    total = per.groupBy("yr").agg(*sums).withColumn(unit, F.lit("total"))
    return per.unionByName(total)
