"""Coordinates, sentinels and per-pixel recodes, all as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Affine(NamedTuple):
    """North-up grid: upper-left corner and signed pixel sizes."""

    ul_x: float
    x_res: float
    ul_y: float
    y_res: float


def row_of(y: Column, tx: Affine) -> Column:
    """Row index, truncated toward zero (a double to int cast truncates)."""
    return ((y - tx.ul_y) / F.lit(tx.y_res)).cast("int")


def col_of(x: Column, tx: Affine) -> Column:
    return ((x - tx.ul_x) / F.lit(tx.x_res)).cast("int")


def x_of(col: Column, tx: Affine) -> Column:
    return (F.lit(tx.ul_x) + col * F.lit(tx.x_res)).cast("int")


def y_of(row: Column, tx: Affine) -> Column:
    return (F.lit(tx.ul_y) + row * F.lit(tx.y_res)).cast("int")


def floor_mod(a: Column, b: Column) -> Column:
    """Modulo with the sign of the divisor; SQL ``%`` takes the dividend's."""
    return a - b * F.floor(a / b)


def snap(coord: Column, anchor: float, res: float) -> Column:
    """Shift a coordinate onto the pixel lattice through ``anchor``."""
    r = F.lit(float(res))
    return coord + (floor_mod(F.lit(float(anchor)), r) - floor_mod(coord, r))


def affine_from_extent(rects: DataFrame, x_res: float, y_res: float, anchor=None) -> DataFrame:
    """One-row grid definition covering a rectangle table."""
    e = extent(rects)
    ul_x = F.col("min_x") if x_res > 0 else F.col("max_x")
    ul_y = F.col("min_y") if y_res > 0 else F.col("max_y")
    if anchor:
        ul_x, ul_y = snap(ul_x, anchor[0], x_res), snap(ul_y, anchor[1], y_res)
    return e.select(
        ul_x.alias("ul_x"), F.lit(float(x_res)).alias("x_res"), ul_y.alias("ul_y"), F.lit(float(y_res)).alias("y_res"),
        "min_x", "max_x", "min_y", "max_y",
    )


def extent(rects: DataFrame, by: list[str] = ()) -> DataFrame:
    """Bounding box of a rectangle table, overall or per key."""
    return rects.groupBy(*by).agg(
        F.min(F.least("ul_x", "lr_x")).alias("min_x"),
        F.max(F.greatest("ul_x", "lr_x")).alias("max_x"),
        F.min(F.least("ul_y", "lr_y")).alias("min_y"),
        F.max(F.greatest("ul_y", "lr_y")).alias("max_y"),
    )


def to_null(v: Column, nodata) -> Column:
    return F.nullif(v, F.lit(nodata))


def from_null(v: Column, nodata) -> Column:
    return F.coalesce(v, F.lit(nodata))


def valid_pixels(df: DataFrame, predictors: list[str]) -> DataFrame:
    """Pixels where every predictor has data."""
    return df.dropna(how="any", subset=predictors)


def clamp_negative(v: Column) -> Column:
    """Keep values >= 0; negatives, NULL and NaN become 0."""
    return F.when((v >= 0) & ~F.isnan(v.cast("double")), v).otherwise(F.lit(0))


def is_class(v: Column, cls: int) -> Column:
    return F.when(v == cls, 1).otherwise(0)


def in_open_range(v: Column, lo: int, hi: int = 10) -> Column:
    return F.when((v > lo) & (v < hi), 1).otherwise(0)


def only_ones(v: Column) -> Column:
    return F.when(v == 1, 1).otherwise(0)


# Legacy land-cover code -> compact code.
COVER_CODES = {
    0: 0, 11: 7, 12: 9, 22: 18, 23: 16, 31: 27, 41: 36, 42: 38, 43: 46, 51: 48, 52: 56, 71: 67, 72: 78, 90: 87, 95: 92,
}


def parse_recode(text: str) -> dict[int, int]:
    """``"k:v,k:v"`` as an ordered mapping."""
    try:
        return {int(k): int(v) for k, v in (p.strip().split(":") for p in text.split(","))}
    except ValueError as e:
        raise ValueError(f"expected key:value,key:value but got {text!r}") from e


def recode(v: Column, mapping: dict[int, int]) -> Column:
    """Apply key -> value steps one after another, so a later key may re-map an earlier result.

    The chain is folded into one lookup, which keeps the expression linear in the number of keys.
    """
    final = {}
    for start in mapping:
        now = start
        for k, to in mapping.items():
            now = to if now == k else now
        final[start] = now
    out = F.when(F.lit(False), v)
    for k, to in final.items():
        out = out.when(v == k, F.lit(to))
    return out.otherwise(v)


def reclassify(v: Column, mode: str, arg=None) -> Column:
    if mode == "old":
        return recode(v, COVER_CODES)
    if mode == "new":
        return recode(v, {b: a for a, b in COVER_CODES.items()})
    if mode == "binary":
        return recode(v, {1: int(arg)})
    if mode == "user":
        return recode(v, parse_recode(arg))
    raise ValueError(f"unknown reclassify mode {mode!r}; use old, new, binary or user")


def pad_tile_id(tile: Column) -> Column:
    """Left-pad to four characters, keeping the last four of a longer id."""
    return F.right(F.concat(F.lit("000"), tile.cast("string")), F.lit(4))


def aspect_intensity(slope: Column, aspect: Column, facing: str, compat: bool = False) -> Column:
    """sin(slope) * cos(aspect - focal aspect); ``compat`` subtracts 180 from radians."""
    if facing not in ("north", "south"):
        raise ValueError("facing must be north or south")
    focal = 0.0 if facing == "north" else (180.0 if compat else 3.141592653589793)
    return F.sin(slope) * F.cos(aspect / F.lit(57.29578) - F.lit(focal))


def area_km2(pixels: Column, res: float = 30.0) -> Column:
    return pixels * F.lit(float(res)) * F.lit(float(res)) / F.lit(1e6)
