"""Grid and support-set generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.functions.grid import floor_mod
from rasterloom.operators.ranking import hash_key


def _spread(df: DataFrame, outer: Column, inner: Column, names=("c", "r")) -> DataFrame:
    """Two-step explode: the outer sequence is spread over tasks before the inner one is expanded."""
    first = df.withColumn(names[0], F.explode(outer))
    return first.repartition(names[0]).withColumn(names[1], F.explode(inner))


def fishnet(extent: DataFrame, width: float, height: float) -> DataFrame:
    """Rectangles covering the extent from its top-left corner, numbered column by column."""
    w, h = F.lit(float(width)), F.lit(float(height))
    e = extent.withColumns(
        {
            "n_rows": F.ceil((F.col("max_y") - F.col("min_y")) / h).cast("long"),
            "n_cols": F.ceil((F.col("max_x") - F.col("min_x")) / w).cast("long"),
        }
    ).filter("n_rows > 0 AND n_cols > 0")
    cells = _spread(e, F.sequence(F.lit(0), F.col("n_cols") - 1), F.sequence(F.lit(0), F.col("n_rows") - 1))
    ul_x, ul_y = F.col("min_x") + F.col("c") * w, F.col("max_y") - F.col("r") * h
    return cells.select(
        (F.col("c") * F.col("n_rows") + F.col("r")).alias("cell_id"),
        ul_x.alias("ul_x"), ul_y.alias("ul_y"), (ul_x + w).alias("lr_x"), (ul_y - h).alias("lr_y"),
    )


def tile_grid(extent: DataFrame, n_rows: int, n_cols: int, res: float = 30.0, compat: bool = False) -> DataFrame:
    """``n_rows`` x ``n_cols`` tiles of whole pixels, numbered column by column.

    The remainder goes to the last row and column of tiles; ``compat`` gives it to the very last tile only.
    """
    r = F.lit(float(res))
    e = extent.withColumns(
        {
            "xs": F.floor((F.col("max_x") - F.col("min_x")) / r),
            "ys": F.floor((F.col("max_y") - F.col("min_y")) / r),
        }
    ).withColumns({"tr": F.floor(F.col("ys") / n_rows), "tc": F.floor(F.col("xs") / n_cols)})
    t = _spread(e, F.sequence(F.lit(0), F.lit(n_cols - 1)), F.sequence(F.lit(0), F.lit(n_rows - 1)))
    last_r, last_c = F.col("r") == n_rows - 1, F.col("c") == n_cols - 1
    if compat:
        last_r = last_c = last_r & last_c
    ul_r, ul_c = F.col("r") * F.col("tr"), F.col("c") * F.col("tc")
    lr_r = F.when(last_r, F.col("ys")).otherwise(ul_r + F.col("tr"))
    lr_c = F.when(last_c, F.col("xs")).otherwise(ul_c + F.col("tc"))

    def px(c: Column) -> Column:
        return F.floor(c * r + F.col("min_x"))

    def py(c: Column) -> Column:
        return F.floor(c * -r + F.col("max_y"))

    return t.select(
        (F.col("c") * n_rows + F.col("r")).cast("int").alias("tile_id"),
        px(ul_c).alias("ul_x"), py(ul_r).alias("ul_y"), px(lr_c).alias("lr_x"), py(lr_r).alias("lr_y"),
        px(ul_c + F.floor(F.col("tc") / 2)).alias("ctr_x"), py(ul_r + F.floor(F.col("tr") / 2)).alias("ctr_y"),
    )


def anchored_grid(extent: DataFrame, x_size: int, y_size: int, seed_x: Column, seed_y: Column) -> DataFrame:
    """Cells of a lattice through a seed point, covering the extent; y runs downward from each upper-left corner."""
    e = extent.withColumns({"sx": seed_x, "sy": seed_y})

    def count(a: Column, size: int, extra: int) -> Column:
        return (a / F.lit(float(size)) + extra).cast("int")

    e = e.withColumns(
        {
            "lx": count(F.col("sx") - F.col("min_x"), x_size, 1),
            "mx": count(F.col("max_x") - F.col("sx"), x_size, 0),
            "ly": count(F.col("sy") - F.col("min_y"), y_size, 0),
            "my": count(F.col("max_y") - F.col("sy"), y_size, 1),
        }
    )
    cells = _spread(e, F.sequence(-F.col("lx"), F.col("mx")), F.sequence(-F.col("ly"), F.col("my")), ("i", "j"))
    ul_x, ul_y = F.col("sx") + F.col("i") * x_size, F.col("sy") + F.col("j") * y_size
    return cells.select("i", "j", ul_x.alias("ul_x"), ul_y.alias("ul_y"), (ul_x + x_size).alias("lr_x"), (ul_y - y_size).alias("lr_y"))


def hash_int(lo: Column, hi: Column, seed: str, *key: str) -> Column:
    """Reproducible integer in [lo, hi] from the key's hash."""
    h = F.conv(F.substring(hash_key(seed, *key), 1, 8), 16, 10).cast("long")
    return lo + h % (hi - lo + 1)


def support_sets(cells: DataFrame, per_cell: int, size: int, res: int, anchor: tuple[float, float], seed: str) -> DataFrame:
    """``per_cell`` fixed-size squares per cell around hashed centres snapped to the pixel lattice."""
    many = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_cell))))
    bounds = {
        "x": (F.least("ul_x", "lr_x"), F.greatest("ul_x", "lr_x"), float(res), anchor[0]),
        "y": (F.least("ul_y", "lr_y"), F.greatest("ul_y", "lr_y"), float(-res), anchor[1]),
    }
    for axis, (lo, hi, step, at) in bounds.items():
        s = F.lit(step)
        raw = hash_int(lo.cast("long"), hi.cast("long"), f"{seed}{axis}", "i", "j", "k")
        many = many.withColumn(f"ctr_{axis}", (raw / s).cast("long") * s - floor_mod(F.lit(float(at)), s))
    half = size / 2
    rem_x, rem_y = floor_mod(F.lit(half), F.lit(float(res))), floor_mod(F.lit(half), F.lit(float(-res)))
    x, y = F.col("ctr_x"), F.col("ctr_y")
    return many.select(
        "i", "j", "k", "ctr_x", "ctr_y",
        F.bround(x - (half + rem_x)).cast("long").alias("ul_x"), F.bround(y + (half + rem_y)).cast("long").alias("ul_y"),
        F.bround(x + (half - rem_x)).cast("long").alias("lr_x"), F.bround(y - (half - rem_y)).cast("long").alias("lr_y"),
    )


def elevation_bands(cells: DataFrame, by: list[str], step: int = 250) -> DataFrame:
    """Band list per region from max(min, 0) up to, not including, the highest elevation."""
    e = cells.groupBy(*by).agg(F.min("z").cast("int").alias("_lo"), F.max("z").cast("int").alias("_hi"))
    e = e.withColumn("_lo", F.greatest("_lo", F.lit(0))).filter("_hi > _lo")
    # range() leaves its end out, sequence() includes it.
    return e.select(*by, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1, F.lit(step))).alias("lower_bound"))


def rect_ring(df: DataFrame) -> Column:
    """Closed five-vertex ring of a rectangle."""
    corner = [("ul_x", "ul_y"), ("lr_x", "ul_y"), ("lr_x", "lr_y"), ("ul_x", "lr_y"), ("ul_x", "ul_y")]
    return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corner])
