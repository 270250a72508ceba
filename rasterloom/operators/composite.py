"""Annual compositing of dated observations, one row per pixel and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.functions.spectral import BANDS
from rasterloom.operators.skew import ROWS_PER_TASK, salted, split_hot

KEYS = ["row", "col", "yr"]


def season(obs: DataFrame, sensors: list[str], year: int | None, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Observations of the listed sensors inside a month-day window; the end day is excluded."""
    md = F.month("ts") * 100 + F.dayofmonth("ts")
    lo, hi = start[0] * 100 + start[1], end[0] * 100 + end[1]
    keep = F.col("sensor").isin(sensors) & (md >= lo) & (md < hi)
    return obs.filter(keep if year is None else keep & (F.col("yr") == year))


def _distance(bands: list[str], centre: dict[str, Column]) -> Column:
    dist = F.lit(0.0)
    for b in bands:
        d = F.col(b) - centre[b]
        dist = dist + d * d
    return dist


def _closest(df: DataFrame, dist: Column, bands: list[str], ties: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*bands), F.struct(dist.alias("d"), *ties, *bands))
    return df.groupBy(*KEYS).agg(best.alias("_best")).select(*KEYS, *[F.col(f"_best.{b}").alias(b) for b in bands])


def medoid(obs: DataFrame, bands: list[str] = BANDS, ties: list[str] = ("ts",), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The observation closest to the per-band medians of its pixel and year; ties go to the smallest (ties, bands).

    Ordinary pixels: one shuffle brings a pixel-year together, and medians, distances and the pick all use that
    partitioning. A pixel-year observed so often that it would swamp a task goes another way: its medians are a map-side
    combined aggregate and its observations are spread over salts to meet them.
    """
    obs = obs.select(*KEYS, *ties, *bands)
    usual, hot = split_hot(obs, KEYS, rows_per_task)
    group = W.partitionBy(*KEYS)
    near = usual.withColumns({f"_m_{b}": F.median(b).over(group) for b in bands})
    picked = _closest(near, _distance(bands, {b: F.col(f"_m_{b}") for b in bands}), bands, ties)

    mids = hot.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_obs"), *[F.median(b).alias(f"_m_{b}") for b in bands])
    spread = salted(hot, mids, KEYS, "_obs", rows_per_task)
    return picked.unionByName(_closest(spread, _distance(bands, {b: F.col(f"_m_{b}") for b in bands}), bands, ties))


def target_day(obs: DataFrame, day: int, bands: list[str] = BANDS, ties: list[str] = ("ts",)) -> DataFrame:
    """The observation nearest a day of year; one aggregation."""
    gap = F.abs(F.col("doy") - day)
    best = F.min_by(F.struct(*bands), F.struct(gap.alias("gap"), *ties, *bands))
    return obs.groupBy(*KEYS).agg(best.alias("_best")).select(*KEYS, *[F.col(f"_best.{b}").alias(b) for b in bands])


def annual_series(composites: DataFrame, pixels: DataFrame, first: int, last: int) -> DataFrame:
    """One row per pixel and year, stamped 1 August; years without data carry NULL bands."""
    years = pixels.select("row", "col", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("yr"))
    return years.join(composites, KEYS, "left").withColumn("stamp", F.make_date("yr", F.lit(8), F.lit(1)))


def fit_between_vertices(series: DataFrame, value: str, is_vertex: str) -> DataFrame:
    """Linear interpolation between vertex years, rounded half-even; flat outside the outermost vertices.

    Windows run over one pixel's annual series, which the compositing step bounds to one row per year.
    """
    w = W.partitionBy("row", "col").orderBy("yr")
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    mark = F.when(F.col(is_vertex), F.struct(F.col("yr").alias("y"), F.col(value).cast("double").alias("v")))
    s = series.withColumns(
        {"_a": F.last(mark, ignorenulls=True).over(back), "_b": F.first(mark, ignorenulls=True).over(ahead)}
    )
    a, b = F.col("_a"), F.col("_b")
    step = F.try_divide((b["v"] - a["v"]) * (F.col("yr") - a["y"]), (b["y"] - a["y"]).cast("double"))
    fitted = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + F.coalesce(step, F.lit(0.0)))
    return s.withColumn("fitted", F.bround(fitted).cast("short")).drop("_a", "_b")


def vertex_stack(series: DataFrame, max_segments: int, flip: int = 1) -> DataFrame:
    """Vertex years in order, padded with zeros to ``max_segments + 1`` slots of year, raw and fitted."""
    # Sized by the number of years per pixel.
    marks = F.sort_array(F.collect_list(F.when(F.col("is_vertex"), F.struct("yr", "raw", "ftv"))))
    per = series.groupBy("row", "col").agg(marks.alias("_v"))

    def slot(i: int, field: str, sign: int) -> Column:
        return F.coalesce(F.get("_v", F.lit(i))[field] * sign, F.lit(0))

    cols = []
    for label, field, sign in (("year_vert", "yr", 1), ("raw_vert", "raw", flip), ("ftv_vert", "ftv", flip)):
        cols += [slot(i, field, sign).cast("int").alias(f"{label}{i + 1}") for i in range(max_segments + 1)]
    return per.select("row", "col", *cols)
