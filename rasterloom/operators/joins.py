"""Lookups and joins between pixels, samples, rectangles and attribute tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.functions.grid import Affine
from rasterloom.operators.overlap import boxes_overlap, points_in_boxes
from rasterloom.operators.polygons import points_in_polygons
from rasterloom.operators.ranking import id_rank
from rasterloom.operators.skew import salted_join
from rasterloom.session import materialize

# Row-major neighbour directions, numbered 1..9.
KERNEL = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def tile_of_points(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    return points_in_boxes(points, boxes, cell, "half")


def polygon_burn(pixels: DataFrame, zones: DataFrame, tx: Affine) -> DataFrame:
    """Pixels whose centre lies in a polygon of ``zones`` (rings, see ``polygons``), with the zone's columns (prefix ``b_``)."""
    hit = points_in_polygons(pixel_centres(pixels, tx), zones)
    return hit.withColumnsRenamed({f"p_{c}": c for c in pixels.columns}).drop("p_x", "p_y")


def set_members(points: DataFrame, sets: DataFrame, cell: float) -> DataFrame:
    """(set_id, obs_pt) for points strictly inside each support set."""
    pairs = points_in_boxes(points.select("obs_pt", "x", "y"), sets.select("set_id", "ul_x", "ul_y", "lr_x", "lr_y"), cell, "open")
    return pairs.select(F.col("b_set_id").alias("set_id"), F.col("p_obs_pt").alias("obs_pt"))


def kept_members(members: DataFrame, min_obs: int, share: float = 0.63) -> DataFrame:
    """Members of the sets whose bag, ``int(share * n)``, reaches ``min_obs``; adds ``n`` and ``n_samples``.

    Counting and filtering both read the members, so the range join behind them runs once and is written.
    """
    members = materialize(members, "members")
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("n_samples", F.floor(F.col("n") * F.lit(share)).cast("int"))
    return salted_join(members, sizes.filter(F.col("n_samples") >= min_obs), ["set_id"], "n")


def last_overlap(storage: DataFrame, processing: DataFrame, key: str, cell: float) -> DataFrame:
    """Each storage rectangle with the highest overlapping processing id; -1 where none overlaps."""
    hits = boxes_overlap(storage.select(key, "ul_x", "ul_y", "lr_x", "lr_y"), processing, cell)
    last = hits.groupBy(F.col(f"l_{key}").alias(key)).agg(F.max("r_tile_id").alias("p_fid"))
    return storage.join(last, key, "left").withColumn("p_fid", F.coalesce("p_fid", F.lit(-1)))


def lookup_pixel(samples: DataFrame, pixels: DataFrame, row_off: int, col_off: int, shape: tuple[int, int]) -> DataFrame:
    """Pixel values at each sample; samples outside the file's window are dropped, missing cells stay NULL."""
    at = samples.withColumns({"row": F.col("row") - row_off, "col": F.col("col") - col_off})
    at = at.filter(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))
    return at.join(pixels, ["row", "col"], "left")


def kernel_values(at: DataFrame, pixels: DataFrame, value: str, offsets: list[tuple[int, int]] = KERNEL) -> DataFrame:
    """(row, col, k, value) for every neighbour of each distinct cell in ``at``; off-grid is NULL.

    Cells are made distinct first, so many samples on one pixel cost one neighbourhood.
    """
    steps = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for i, (r, c) in enumerate(offsets)])
    want = at.select("row", "col").distinct().withColumn("o", F.explode(steps)).select(
        F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("o.k").alias("k"),
        (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"),
    )
    got = want.join(pixels.select("row", "col", value), ["row", "col"], "left")
    return got.select(F.col("_r").alias("row"), F.col("_c").alias("col"), "k", value)


def lookup_kernel(samples: DataFrame, pixels: DataFrame, value: str, nodata: int) -> DataFrame:
    """Samples with ``<value>_1`` .. ``<value>_9`` in row-major neighbour order."""
    long = kernel_values(samples, pixels, value)
    cols = [
        F.coalesce(F.max(F.when(F.col("k") == i, F.col(value))), F.lit(nodata)).alias(f"{value}_{i}") for i in range(1, 10)
    ]
    return samples.join(long.groupBy("row", "col").agg(*cols), ["row", "col"])


def stencil(pixels: DataFrame, value: str, block: int = 64) -> DataFrame:
    """Every cell with its 3 x 3 neighbourhood ``k1`` .. ``k9`` (NULL off the grid) after one shuffle.

    Cells are sent to square blocks together with a one-cell rim (about 6 % more rows at 64). Each cell then
    offers its value to its nine neighbours inside the block; the grouping keeps the block partitioning,
    so nothing else moves.
    """
    b = F.lit(block)

    def blocks(axis: str) -> Column:
        v = F.col(axis)
        return F.array_distinct(F.array(F.floor((v - 1) / b), F.floor(v / b), F.floor((v + 1) / b)))

    spread = pixels.select("row", "col", F.col(value).alias("_v"))
    spread = spread.withColumn("_br", F.explode(blocks("row"))).withColumn("_bc", F.explode(blocks("col")))
    spread = spread.repartition("_br", "_bc")
    # A cell is neighbour k of the cell that lies the opposite way.
    steps = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(-r).alias("r"), F.lit(-c).alias("c")) for i, (r, c) in enumerate(KERNEL)])
    offers = spread.withColumn("_o", F.explode(steps)).select(
        "_br", "_bc", (F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"), "_o.k", "_v"
    )
    own = (F.floor(F.col("row") / b) == F.col("_br")) & (F.floor(F.col("col") / b) == F.col("_bc"))
    slots = [F.max(F.when(F.col("k") == i, F.col("_v"))).alias(f"k{i}") for i in range(1, 10)]
    is_cell = F.max(F.when(F.col("k") == 5, True)).alias("_cell")
    out = offers.filter(own).groupBy("_br", "_bc", "row", "col").agg(is_cell, *slots)
    return out.filter("_cell").drop("_br", "_bc", "_cell").withColumn(value, F.col("k5"))


def point_tile(samples: DataFrame, tile_grid: DataFrame, value: str) -> DataFrame:
    """Padded tile id under each sample; the first row and column of the grid do not count."""
    hit = F.when((F.col("row") > 0) & (F.col("col") > 0), F.right(F.concat(F.lit("000"), F.col(value).cast("string")), F.lit(4)))
    return samples.join(tile_grid, ["row", "col"], "left").withColumn("tile", hit)


def mosaic_fill(tile_grid: DataFrame, data: DataFrame, nodata: int) -> DataFrame:
    """Replace each tile id by that tile's own value for the cell."""
    out = tile_grid.join(data, ["row", "col", "tile"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(nodata)))


def pixel_centres(pixels: DataFrame, tx: Affine) -> DataFrame:
    return pixels.withColumns(
        {
            "x": F.lit(tx.ul_x) + (F.col("col") + 0.5) * F.lit(tx.x_res),
            "y": F.lit(tx.ul_y) + (F.col("row") + 0.5) * F.lit(tx.y_res),
        }
    )


def zone_burn(pixels: DataFrame, zones: DataFrame, tx: Affine, cell: float) -> DataFrame:
    """Pixels whose centre lies in a zone, with the zone's columns (prefix ``b_``)."""
    hit = points_in_boxes(pixel_centres(pixels, tx), zones, cell, "half")
    return hit.withColumnsRenamed({f"p_{c}": c for c in pixels.columns}).drop("p_x", "p_y")


def pixel_sets(pixels: DataFrame, sets: DataFrame, tx: Affine, cell: float) -> DataFrame:
    """(row, col) with the support sets covering the pixel centre."""
    return zone_burn(pixels.select("row", "col"), sets, tx, cell)


def set_positions(covered: DataFrame) -> DataFrame:
    """Position of each set in its pixel's ascending list, without building the list."""
    return id_rank(covered, "set_id", ["row", "col"], "pos", "n_sets", width=1 << 20)


def set_combination(covered: DataFrame) -> DataFrame:
    """Order-free fingerprint of each pixel's set list: three 64-bit sums and the count.

    Sums merge map-side, so no list is collected however many sets cover a pixel.
    """
    parts = [F.sum(F.xxhash64(F.lit(i), "set_id").cast("decimal(20,0)")).alias(f"_f{i}") for i in range(3)]
    return covered.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n_sets"), *parts)


def nearest_value(left: DataFrame, value: str, right: DataFrame, coord: str, width: float) -> DataFrame:
    """Nearest right-side coordinate for each left value, ties to the smaller one.

    Values meet the coordinates of their own bucket, plus the closest ones of the buckets below and above, which
    come from one running pass over bucket minima and maxima.
    """
    b = F.floor(F.col("_v") / F.lit(float(width)))
    rights = right.select(F.col(coord).alias("_v")).distinct().withColumn("_b", b)
    lefts = left.withColumn("_v", F.col(value)).withColumn("_b", b)
    ends = rights.groupBy("_b").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    every = ends.select("_b").union(lefts.select("_b")).distinct().join(ends, "_b", "left")
    order = W.orderBy("_b")
    around = every.select(
        "_b",
        F.last("_hi", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_below"),
        F.first("_lo", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_above"),
    )
    distinct_values = lefts.select("_v", "_b").distinct()
    same = distinct_values.join(rights.withColumnRenamed("_v", "_c"), "_b").select("_v", "_c")
    outer = distinct_values.join(around, "_b").select("_v", F.explode(F.array("_below", "_above")).alias("_c"))
    best = same.union(outer.dropna()).groupBy("_v").agg(
        F.min_by("_c", F.struct(F.abs(F.col("_c") - F.col("_v")), F.col("_c"))).alias(f"{value}_snapped")
    )
    return lefts.join(best, "_v", "left").drop("_v", "_b")
