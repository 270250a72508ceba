"""Terrain derivatives, resampling, flow directions and nearest streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators.joins import KERNEL, stencil
from rasterloom.session import materialize


def derivatives(dem: DataFrame, res: float, z: str = "z") -> DataFrame:
    """Slope and aspect in degrees (Horn) and curvature (Zevenbergen-Thorne); NULL where a neighbour is missing.

    Rows run southward. Flat cells have no aspect.
    """
    s = stencil(dem, z)
    k = {i: F.col(f"k{i}") for i in range(1, 10)}
    full = k[1].isNotNull()
    for i in range(2, 10):
        full = full & k[i].isNotNull()
    r = F.lit(float(res))
    dx = ((k[3] + 2 * k[6] + k[9]) - (k[1] + 2 * k[4] + k[7])) / (8 * r)
    dy = ((k[7] + 2 * k[8] + k[9]) - (k[1] + 2 * k[2] + k[3])) / (8 * r)
    turn = F.degrees(F.atan2(dy, -dx))
    aspect = F.when(turn > 90, 450 - turn).otherwise(90 - turn)
    d = ((k[4] + k[6]) / 2 - k[5]) / (r * r)
    e = ((k[2] + k[8]) / 2 - k[5]) / (r * r)
    return s.select(
        "row", "col",
        F.when(full, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).alias("slope"),
        F.when(full & ((dx != 0) | (dy != 0)), aspect).alias("aspect"),
        F.when(full, -2 * (d + e) * 100).alias("curvature"),
    )


# Direction codes clockwise from north, with their (row, column) steps.
D8 = [(64, -1, 0), (128, -1, 1), (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1)]


def flow_direction(dem: DataFrame, z: str = "z") -> DataFrame:
    """Code of the steepest downhill neighbour, the first clockwise from north on ties; 0 in pits and flats."""
    s = stencil(dem, z)
    slot = {(r, c): F.col(f"k{i + 1}") for i, (r, c) in enumerate(KERNEL)}
    steps = []
    for i, (code, r, c) in enumerate(D8):
        drop = (F.col("k5") - slot[(r, c)]) / F.lit(1.0 if r == 0 or c == 0 else 2.0**0.5)
        steps.append(F.when(drop > 0, F.struct(drop.alias("drop"), F.lit(-i).alias("rank"), F.lit(code).alias("code"))))
    best = F.array_max(F.array_compact(F.array(*steps)))
    return s.select("row", "col", F.coalesce(best["code"], F.lit(0)).alias("direction"))


def downstream(directions: DataFrame) -> DataFrame:
    """Cells with the cell they drain to (themselves in pits)."""
    dr = dc = F.lit(0)
    for code, r, c in D8:
        dr = F.when(F.col("direction") == code, r).otherwise(dr)
        dc = F.when(F.col("direction") == code, c).otherwise(dc)
    return directions.select("row", "col", (F.col("row") + dr).alias("to_row"), (F.col("col") + dc).alias("to_col"))


def watershed(flow: DataFrame, pour: DataFrame) -> DataFrame:
    """Cells draining to each pour point (row, col), which itself is included.

    Drainage paths are cut at pour points and pits, then every unfinished cell's pointer jumps to its target's target:
    a path of length n ends after log2(n) rounds. Cells that reached an end leave the loop.
    """
    ends = pour.select("row", "col").distinct().withColumn("_pour", F.lit(True))
    f = flow.join(ends, ["row", "col"], "left").withColumn("_pour", F.coalesce("_pour", F.lit(False)))
    stop = F.col("_pour") | ((F.col("row") == F.col("to_row")) & (F.col("col") == F.col("to_col")))
    f = f.select(
        "row", "col", F.when(stop, F.col("row")).otherwise(F.col("to_row")).alias("to_row"),
        F.when(stop, F.col("col")).otherwise(F.col("to_col")).alias("to_col"), stop.alias("done"), F.col("_pour").alias("pour"),
    )
    f = materialize(f, "flow")
    while True:
        at = f.select(
            F.col("row").alias("to_row"), F.col("col").alias("to_col"),
            F.col("to_row").alias("_r2"), F.col("to_col").alias("_c2"), F.col("done").alias("_d2"), F.col("pour").alias("_p2"),
        )
        # A pointer off the grid finds nothing and ends there.
        hop = f.filter(~F.col("done")).join(at, ["to_row", "to_col"], "left").select(
            "row", "col", F.coalesce("_r2", "to_row").alias("to_row"), F.coalesce("_c2", "to_col").alias("to_col"),
            F.coalesce("_d2", F.lit(True)).alias("done"), F.coalesce("_p2", F.lit(False)).alias("pour"),
        )
        f = materialize(f.filter("done").unionByName(hop), "flow")
        if f.filter(~F.col("done")).isEmpty():
            break
    return f.filter("pour").select("row", "col", F.col("to_row").alias("pour_row"), F.col("to_col").alias("pour_col"))


def resample_mean(df: DataFrame, value: str, factor: int) -> DataFrame:
    """Coarser grid: mean of each factor x factor block."""
    key = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return df.groupBy(*key).agg(F.avg(value).alias(value))


def _cubic(t: Column) -> Column:
    """Cubic convolution kernel with a = -0.5."""
    x = F.abs(t)
    near = (1.5 * x - 2.5) * x * x + 1
    far = ((-0.5 * x + 2.5) * x - 4) * x + 2
    return F.when(x < 1, near).when(x < 2, far).otherwise(F.lit(0.0))


def resample_cubic(df: DataFrame, value: str, scale: float) -> DataFrame:
    """Grid at ``scale`` source pixels per target pixel by 16-neighbour cubic convolution.

    Each source cell offers its value to the target cells within two source pixels, so no target grid has to be built
    beforehand. Weights are normalised over the neighbours that exist; targets cover the source cells' area.
    """
    s = F.lit(float(scale))

    def reach(axis: str) -> Column:
        # Target centre (t + 0.5) * s - 0.5 in source index units lies within 2 of the cell.
        lo = F.floor((F.col(axis) - 2 + 0.5) / s - 0.5) + 1
        hi = F.ceil((F.col(axis) + 2 + 0.5) / s - 0.5) - 1
        return F.when(hi >= lo, F.sequence(lo, hi))

    def centre(t: str) -> Column:
        return (F.col(t) + 0.5) * s - 0.5

    offers = df.withColumn("_tr", F.explode(reach("row"))).withColumn("_tc", F.explode(reach("col")))
    w = _cubic(centre("_tr") - F.col("row")) * _cubic(centre("_tc") - F.col("col"))
    # The target belongs to the output only where its centre falls on an existing source cell.
    own = (F.floor(centre("_tr") + 0.5) == F.col("row")) & (F.floor(centre("_tc") + 0.5) == F.col("col"))
    out = offers.groupBy(F.col("_tr").alias("row"), F.col("_tc").alias("col")).agg(
        F.sum(w * F.col(value)).alias("_wv"), F.sum(w).alias("_w"), F.max(own).alias("_own")
    )
    return out.filter("_own").select("row", "col", F.try_divide("_wv", "_w").alias(value))


def nearest_stream(cells: DataFrame, streams: DataFrame, first_radius: int = 4) -> DataFrame:
    """Nearest stream cell per cell (ties: smallest row, then column), by exact Euclidean distance.

    Search radius doubles. In a round, cells meet the streams of their own and the eight surrounding squares
    of side ``radius``; a hit within the radius is final, because every closer stream is in those squares.
    Before the wide rounds, streams that can no longer be nearest to any unresolved cell are dropped.
    """
    spark = cells.sparkSession
    st = streams.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), F.col("z").alias("s_z"))
    left, done, radius = cells.select("row", "col", "z"), [], first_radius
    if st.isEmpty():
        raise ValueError("no stream cells")
    while True:
        r = F.lit(radius)
        around = F.sequence(F.lit(-1), F.lit(1))
        home = left.withColumns({"_br": F.floor(F.col("row") / r), "_bc": F.floor(F.col("col") / r)})
        spread = st.withColumn("_dr", F.explode(around)).withColumn("_dc", F.explode(around)).select(
            "s_row", "s_col", "s_z", (F.floor(F.col("s_row") / r) + F.col("_dr")).alias("_br"), (F.floor(F.col("s_col") / r) + F.col("_dc")).alias("_bc")
        )
        dr, dc = F.col("row") - F.col("s_row"), F.col("col") - F.col("s_col")
        near = home.join(spread, ["_br", "_bc"]).withColumn("d2", dr * dr + dc * dc).filter(F.col("d2") <= radius * radius)
        hit = near.groupBy("row", "col").agg(
            F.first("z").alias("z"), F.min(F.struct("d2", "s_row", "s_col", "s_z")).alias("_s")
        )
        found = materialize(hit.select("row", "col", "z", "_s.*"), "stream")
        done.append(found)
        left = materialize(left.join(found.select("row", "col"), ["row", "col"], "left_anti"), "left")
        if left.isEmpty():
            break
        radius *= 2
        if radius >= 4 * first_radius:
            st = materialize(_row_ends(st, left, radius), "ends")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _row_ends(st: DataFrame, left: DataFrame, side: int) -> DataFrame:
    """Keep only the first and last stream of each row inside column strips without unresolved cells.

    Seen from a cell left or right of the strip, distance along one row is monotone, so an end is nearest.
    """
    strip = F.floor(F.col("s_col") / side)
    busy = left.select(F.floor(F.col("col") / side).alias("_b")).distinct()
    tagged = st.withColumn("_b", strip)
    keep = tagged.join(busy, "_b", "left_semi")
    quiet = tagged.join(busy, "_b", "left_anti").groupBy("s_row", "_b").agg(
        F.min(F.struct("s_col", "s_z")).alias("a"), F.max(F.struct("s_col", "s_z")).alias("b")
    )
    ends = quiet.select("s_row", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("s_row", "e.s_col", "e.s_z")
    return keep.select("s_row", "s_col", "s_z").unionByName(ends)
