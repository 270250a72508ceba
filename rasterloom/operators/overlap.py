"""Point-in-rectangle and rectangle-overlap joins as equi-joins on grid cells.

A range predicate alone plans as a nested-loop join. Here every rectangle is filed under the cells it
touches on a lattice whose cell is at least as long as the rectangle, so it touches four cells at
most however large it is. A pair meets on the coarser of the two lattices, in exactly one cell (the one holding the
lower corner of the shared box), so no duplicates arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _level(df: DataFrame, cell: float) -> Column:
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side / F.lit(float(cell)), F.lit(1.0))))).cast("int")


def _boxed(df: DataFrame, prefix: str, bounds: tuple, cell: float) -> DataFrame:
    x0, x1, y0, y1 = bounds
    own = df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns] + [
        F.least(x0, x1).alias("_x0"), F.greatest(x0, x1).alias("_x1"),
        F.least(y0, y1).alias("_y0"), F.greatest(y0, y1).alias("_y1"),
    ])
    return own.withColumn("_lv", _level(own, cell))


def _file(df: DataFrame, levels: Column, cell: float, tag: str) -> DataFrame:
    """Copy each rectangle to the cells it touches, on its own and every coarser lattice in use."""
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_k"))
    spread = df.withColumn("_k", F.explode(levels)).filter(F.col("_k") >= F.col("_lv"))
    for axis in "xy":
        lo, hi = F.floor(F.col(f"_{axis}0") / size), F.floor(F.col(f"_{axis}1") / size)
        spread = spread.withColumn(f"_c{axis}", F.explode(F.sequence(lo, hi)))
    return spread.select(
        *[c for c in df.columns if not c.startswith("_")], "_k", "_cx", "_cy",
        *[F.col(f"_{n}").alias(f"_{tag}{n}") for n in ("x0", "x1", "y0", "y1", "lv")],
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_bounds: tuple,
    right_bounds: tuple,
    condition: Column,
    cell: float,
    prefixes: tuple[str, str] = ("l_", "r_"),
) -> DataFrame:
    """Pairs of rows whose closed boxes meet and that satisfy ``condition`` on prefixed columns.

    Bounds are (x, x, y, y) columns of the unprefixed side; equal ends make a point.
    """
    l_own = _boxed(left, prefixes[0], left_bounds, cell)
    r_own = _boxed(right, prefixes[1], right_bounds, cell)
    # Points are on the finest lattice by definition: only rectangles are measured.
    sized = [own.select("_lv") for own, b in ((l_own, left_bounds), (r_own, right_bounds)) if b[0] != b[1] or b[2] != b[3]]
    both_sides = sized[0] if len(sized) == 1 else sized[0].union(sized[1])
    # At most about 1100 lattice sizes fit between a cell and the largest double, in practice a handful.
    levels = both_sides.agg(F.sort_array(F.collect_set("_lv"))).scalar()
    a, b = _file(l_own, levels, cell, "a"), _file(r_own, levels, cell, "b")
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_k"))
    lo_x, lo_y = F.greatest("_ax0", "_bx0"), F.greatest("_ay0", "_by0")
    meets = (
        (F.col("_k") == F.greatest("_alv", "_blv"))
        & (lo_x <= F.least("_ax1", "_bx1"))
        & (lo_y <= F.least("_ay1", "_by1"))
        & (F.floor(lo_x / size) == F.col("_cx"))
        & (F.floor(lo_y / size) == F.col("_cy"))
    )
    both = a.join(b, ["_k", "_cx", "_cy"]).filter(meets & condition)
    return both.select(*[c for c in both.columns if not c.startswith("_")])


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, closed: str = "half") -> DataFrame:
    """Points (x, y) with the boxes that hold them; columns keep ``p_`` and ``b_`` prefixes.

    ``half``: x >= min, x < max, y > min, y <= max, so a shared edge belongs to one box.
    ``open``: strictly inside.
    """
    x, y = F.col("p_x"), F.col("p_y")
    x0, x1 = F.least("b_ul_x", "b_lr_x"), F.greatest("b_ul_x", "b_lr_x")
    y0, y1 = F.least("b_ul_y", "b_lr_y"), F.greatest("b_ul_y", "b_lr_y")
    if closed == "half":
        rule = (x >= x0) & (x < x1) & (y > y0) & (y <= y1)
    elif closed == "open":
        rule = (x > x0) & (x < x1) & (y > y0) & (y < y1)
    else:
        raise ValueError("closed must be half or open")
    return overlap_join(points, boxes, ("x", "x", "y", "y"), ("ul_x", "lr_x", "ul_y", "lr_y"), rule, cell, ("p_", "b_"))


def boxes_overlap(left: DataFrame, right: DataFrame, cell: float, touching: bool = False) -> DataFrame:
    """Rectangle pairs sharing area, or (``touching``) at least a boundary point."""
    lo_x = F.greatest(F.least("l_ul_x", "l_lr_x"), F.least("r_ul_x", "r_lr_x"))
    hi_x = F.least(F.greatest("l_ul_x", "l_lr_x"), F.greatest("r_ul_x", "r_lr_x"))
    lo_y = F.greatest(F.least("l_ul_y", "l_lr_y"), F.least("r_ul_y", "r_lr_y"))
    hi_y = F.least(F.greatest("l_ul_y", "l_lr_y"), F.greatest("r_ul_y", "r_lr_y"))
    rule = F.lit(True) if touching else (lo_x < hi_x) & (lo_y < hi_y)
    bounds = ("ul_x", "lr_x", "ul_y", "lr_y")
    return overlap_join(left, right, bounds, bounds, rule, cell)


def ring_edges(ring: Column) -> Column:
    """Edges of a ring given as an open array of (x, y) structs; the last vertex joins the first."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, (i + 1) % F.size(ring) + 1).alias("b")))
