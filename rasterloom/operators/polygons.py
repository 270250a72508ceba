"""Points in polygons by an index of edges: no ring travels with a candidate pair.

A polygon is any number of rings, taken by the even-odd rule, so holes and separate parts need no mark. Each polygon gets a lattice of its own
scale: about one strip of y for every ``EDGES_PER_STRIP`` edges, and ``COLUMNS`` columns of x. Sizes are powers of two, so a point's cell
is exact and points need filing once per scale in use, not per polygon.

A ray from a point to the right crosses the edges that span its y. Seen from one cell, an edge that spans the whole strip and lies right of
the cell is crossed by every ray: it only counts. Edges that pass through the cell, or that end within the strip to the right of it, are
listed as rows. A cell without such rows lies wholly inside or outside, by the parity of its count, and its points need no test. All others
meet the listed edges by an equi-join on the cell, and an aggregate over (point, polygon) adds up the crossings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators.overlap import ring_edges
from rasterloom.session import materialize

EDGES_PER_STRIP, COLUMNS = 4, 8
#: Part of a cell by which edges are filed wider, so that rounding does not hide one from a cell at whose border it passes.
PAD = 1e-6
CELL = ["_kx", "_ky", "_s", "_c"]


def edges(polygons: DataFrame) -> DataFrame:
    """(polygon, x1, y1, x2, y2): one row per edge; ``polygon`` holds all columns but ``ring``, equal ones make one polygon."""
    names = [F.col(f"`{c}`").alias(c) for c in polygons.columns if c != "ring"]
    each = polygons.filter("ring IS NOT NULL").select(F.struct(*names).alias("polygon"), F.explode(ring_edges(F.col("ring"))).alias("e"))
    return each.select("polygon", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _power(extent: Column, parts: Column) -> Column:
    """Exponent of the power of two at which at most about ``parts`` cells cover the extent."""
    return F.ceil(F.log2(F.greatest(extent / parts, F.lit(1e-9)))).cast("int")


def edge_index(polygons: DataFrame) -> DataFrame:
    """Rows by cell: an edge to be tested, or (edge NULL) the number of crossings that hold for the whole cell.

    Columns: the cell, polygon, x1, y1, x2, y2, n, n_edges of the cell.
    """
    each = edges(polygons)
    x_min, x_max = F.least("x1", "x2"), F.greatest("x1", "x2")
    y_min, y_max = F.least("y1", "y2"), F.greatest("y1", "y2")
    size = each.groupBy("polygon").agg(
        F.min(x_min).alias("_x0"), (F.max(x_max) - F.min(x_min)).alias("_w"), (F.max(y_max) - F.min(y_min)).alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    scale = size.select(
        "polygon", "_x0", _power(F.col("_w"), F.lit(float(COLUMNS))).alias("_kx"),
        _power(F.col("_h"), F.greatest(F.col("_n") / EDGES_PER_STRIP, F.lit(1.0))).alias("_ky"),
    )
    w, h = F.pow(F.lit(2.0), F.col("_kx")), F.pow(F.lit(2.0), F.col("_ky"))
    spread = each.join(scale, "polygon").withColumns({"_wide": w, "_high": h})
    w, h, pad_x, pad_y = F.col("_wide"), F.col("_high"), F.col("_wide") * PAD, F.col("_high") * PAD
    spread = spread.withColumn("_s", F.explode(F.sequence(F.floor((y_min - pad_y) / h), F.floor((y_max + pad_y) / h))))
    low, high = F.col("_s") * h, (F.col("_s") + 1) * h

    def x_at(y: Column) -> Column:
        return F.col("x1") + F.try_divide(F.least(F.greatest(y, y_min), y_max) - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))

    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, x_min).otherwise(F.least(x_at(low), x_at(high)))
    right = F.when(flat, x_max).otherwise(F.greatest(x_at(low), x_at(high)))
    spread = spread.withColumns({
        "_from": F.floor((left - pad_x) / w), "_to": F.floor((right + pad_x) / w), "_first": F.floor((F.col("_x0") - pad_x) / w),
        "_spans": (y_min < low) & (y_max >= high), "_flat": flat,
    })
    spread = spread.withColumn("_c", F.explode(F.sequence(F.when(F.col("_flat"), F.col("_from")).otherwise(F.col("_first")), F.col("_to"))))
    always = F.col("_spans") & (F.col("_c") < F.col("_from"))
    spread = materialize(spread.select(*CELL, "polygon", "x1", "y1", "x2", "y2", always.alias("always")), "edges")
    cells = spread.groupBy(*CELL, "polygon").agg(F.count_if("always").alias("n"), F.count_if(~F.col("always")).alias("n_edges"))
    none = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    # a cell that no edge is tested in and that an even number of edges lies right of is outside
    base = cells.filter("n_edges > 0 OR n % 2 = 1").select(*CELL, "polygon", *none, "n", "n_edges")
    tested = spread.filter(~F.col("always")).select(*CELL, "polygon", "x1", "y1", "x2", "y2", F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("n_edges"))
    return materialize(base.unionByName(tested), "edge-index")


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (x, y, ...) with each polygon that holds them, columns prefixed ``p_`` and ``b_``; a point on an edge or vertex is inside.

    ``polygons`` has a column ``ring`` (an open array of x and y) and columns that name the polygon. NULL coordinates are nowhere.
    """
    index = edge_index(polygons)
    scales = index.select("_kx", "_ky").distinct().agg(F.collect_list(F.struct("_kx", "_ky"))).scalar()
    own = points.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in points.columns]).alias("point"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    filed = own.filter("_x IS NOT NULL AND _y IS NOT NULL").withColumn("_k", F.explode(scales)).select("point", "_x", "_y", "_k._kx", "_k._ky")
    cell = lambda v, k: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col(k)))
    met = filed.withColumns({"_s": cell("_y", "_ky"), "_c": cell("_x", "_kx")}).join(index, CELL)
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("_x", "_y", "x1", "y1", "x2", "y2"))
    at = F.try_divide((y - y1) * (x2 - x1), y2 - y1) + x1
    crosses = (y > F.least(y1, y2)) & (y <= F.greatest(y1, y2)) & (x < F.greatest(x1, x2)) & (y1 != y2) & ((x1 == x2) | (x < at))
    length = lambda ax, ay, bx, by: F.sqrt((ay - by) * (ay - by) + (ax - bx) * (ax - bx))
    on = length(x1, y1, x, y) + length(x2, y2, x, y) == length(x1, y1, x2, y2)
    whole = F.col("x1").isNull() & (F.col("n_edges") == 0)
    sure = met.filter(whole).select("point", "polygon")
    # repeated points repeat their base row, which tells how many there are
    copies = F.count_if(F.col("x1").isNull())
    tested = met.filter(~whole).groupBy("point", "polygon").agg(
        (F.sum(F.col("n") + F.coalesce(crosses, F.lit(False)).cast("bigint")) / copies).cast("bigint").alias("_n"),
        F.max(F.coalesce(on, F.lit(False))).alias("_on"), copies.cast("int").alias("_copies"),
    )
    tested = tested.filter("_on OR _n % 2 = 1").select("point", "polygon", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("point", "polygon")
    names = [f"p_{c}" for c in points.columns], [f"b_{c}" for c in polygons.columns if c != "ring"]
    out = sure.unionByName(tested)
    return out.select(*[F.col("point")[n[2:]].alias(n) for n in names[0]], *[F.col("polygon")[n[2:]].alias(n) for n in names[1]])
