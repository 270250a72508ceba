"""Spatial joins, lookups and grid generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions import grid as g, names as nm
from rasterloom.operators import grids, joins as j, polygons as pg
from rasterloom.operators.overlap import boxes_overlap, points_in_boxes
from rasterloom.operators.ranking import id_rank, ordered_rank, quantile_bucket
from rasterloom.plans.registry import query
from rasterloom.session import materialize
from rasterloom.plans.scalars import TX, _SCENE_SQL, _scenes

TILE, SET = 150.0, 450.0

HALF = "s.x >= t.ul_x AND s.x < t.lr_x AND s.y > t.lr_y AND s.y <= t.ul_y"
AREA = """greatest(least(s.ul_x, s.lr_x), least(t.ul_x, t.lr_x)) < least(greatest(s.ul_x, s.lr_x), greatest(t.ul_x, t.lr_x))
  AND greatest(least(s.ul_y, s.lr_y), least(t.ul_y, t.lr_y)) < least(greatest(s.ul_y, s.lr_y), greatest(t.ul_y, t.lr_y))"""
#: Polygon zones: parity of the edges that a ray to the right crosses, or a hit on an edge. Needs ``px``; gives ``zp`` (row, col, tile_id, region_id).
IN_ZONE = """zp AS (SELECT row, col, tile_id, region_id FROM (SELECT row, col, tile_id, region_id,
  bool_or(sqrt((y1 - y) * (y1 - y) + (x1 - x) * (x1 - x)) + sqrt((y2 - y) * (y2 - y) + (x2 - x) * (x2 - x)) = sqrt((y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2))) AS edge,
  count(*) FILTER (y > least(y1, y2) AND y <= greatest(y1, y2) AND x < greatest(x1, x2) AND y1 <> y2 AND (x1 = x2 OR x < (y - y1) * (x2 - x1) / (y2 - y1) + x1)) AS n
  FROM px, zone_edges GROUP BY ALL) WHERE edge OR n % 2 = 1)"""
CENTRE = "px AS (SELECT *, 1e6 + (col + 0.5e0) * 30 AS x, 1200000e0 - (row + 0.5e0) * 30 AS y FROM dem)"


@query("join_point_box", "samples tiles", f"SELECT obs_pt, tile_id FROM samples s JOIN tiles t ON {HALF}")
def join_point_box(spark, d):
    hit = j.tile_of_points(fx.samples(spark, d).select("obs_pt", "x", "y"), fx.tiles(spark, d), TILE)
    return hit.select(F.col("p_obs_pt").alias("obs_pt"), F.col("b_tile_id").alias("tile_id"))


_RING = [("ul_x", 0, "ul_y", -100), ("ul_x", 100, "ul_y", 0), ("lr_x", -60, "ul_y", 0), ("lr_x", 0, "ul_y", -90), ("lr_x", -30, "lr_y", 0), ("ul_x", 83, "lr_y", 0)]
_RING_SQL = " UNION ALL ".join(
    f"SELECT set_id, {i} AS i, {x} + {dx} AS x1, {y} + {dy} AS y1, {nx} + {ndx} AS x2, {ny} + {ndy} AS y2 FROM sets"
    for i, ((x, dx, y, dy), (nx, ndx, ny, ndy)) in enumerate(zip(_RING, _RING[1:] + _RING[:1]))
)


@query("join_point_polygon", "samples sets", f"""
e AS ({_RING_SQL}),
t AS (SELECT obs_pt, set_id,
  bool_or(sqrt((y1 - y) * (y1 - y) + (x1 - x) * (x1 - x)) + sqrt((y2 - y) * (y2 - y) + (x2 - x) * (x2 - x))
    = sqrt((y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2))) AS edge,
  count(*) FILTER (y > least(y1, y2) AND y <= greatest(y1, y2) AND x < greatest(x1, x2) AND y1 <> y2
    AND (x1 = x2 OR x < (y - y1) * (x2 - x1) / (y2 - y1) + x1)) AS n
  FROM samples, e GROUP BY obs_pt, set_id)
SELECT obs_pt, set_id FROM t WHERE edge OR n % 2 = 1""")
def join_point_polygon(spark, d):
    s = fx.sets(spark, d)
    ring = F.array(*[F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y")) for x, dx, y, dy in _RING])
    hit = pg.points_in_polygons(fx.samples(spark, d).select("obs_pt", "x", "y"), s.select("set_id", ring.alias("ring")))
    return hit.select(F.col("p_obs_pt").alias("obs_pt"), F.col("b_set_id").alias("set_id"))


STRICT = "s.x > t.ul_x AND s.x < t.lr_x AND s.y > t.lr_y AND s.y < t.ul_y"
MEMBERS = f"members AS (SELECT t.set_id, s.obs_pt FROM samples s JOIN sets t ON {STRICT})"


@query("join_set_members", "samples sets", f"""{MEMBERS},
n AS (SELECT set_id, CAST(floor(count(*) * 0.63e0) AS INT) AS n_samples FROM members GROUP BY set_id)
SELECT m.set_id, obs_pt, n_samples FROM members m JOIN n ON n.set_id = m.set_id WHERE n_samples >= 130""")
def join_set_members(spark, d):
    m = j.set_members(fx.samples(spark, d), fx.sets(spark, d), SET)
    return j.kept_members(m, 130).select("set_id", "obs_pt", "n_samples")


@query("join_rect_overlap", "sets tiles", f"SELECT s.set_id, t.tile_id FROM sets s JOIN tiles t ON {AREA}")
def join_rect_overlap(spark, d):
    hit = boxes_overlap(fx.sets(spark, d), fx.tiles(spark, d), TILE)
    return hit.select(F.col("l_set_id").alias("set_id"), F.col("r_tile_id").alias("tile_id"))


def _grid_sql(rows: int, cols: int) -> str:
    """Oracle text of a pixel-aligned tile grid over the support sets."""
    return f"""ext AS (SELECT min(ul_x) AS x0, max(lr_x) AS x1, min(lr_y) AS y0, max(ul_y) AS y1 FROM sets),
dims AS (SELECT *, floor((x1 - x0) / 30) AS xs, floor((y1 - y0) / 30) AS ys FROM ext),
cells AS (SELECT *, floor(ys / {rows}) AS tr, floor(xs / {cols}) AS tc FROM dims, unnest(generate_series(0, {cols - 1})) AS a(c),
  unnest(generate_series(0, {rows - 1})) AS b(r)),
grid AS (SELECT CAST(c * {rows} + r AS INT) AS tile_id, floor(x0 + c * tc * 30) AS ul_x, floor(y1 - r * tr * 30) AS ul_y,
  floor(x0 + (CASE WHEN c = {cols - 1} THEN xs ELSE c * tc + tc END) * 30) AS lr_x,
  floor(y1 - (CASE WHEN r = {rows - 1} THEN ys ELSE r * tr + tr END) * 30) AS lr_y,
  floor(x0 + (c * tc + floor(tc / 2)) * 30) AS ctr_x, floor(y1 - (r * tr + floor(tr / 2)) * 30) AS ctr_y FROM cells)"""


@query("tile_grid", "sets", f"""{_grid_sql(4, 7)}
SELECT tile_id, CAST(ul_x AS BIGINT) AS ul_x, CAST(ul_y AS BIGINT) AS ul_y, CAST(lr_x AS BIGINT) AS lr_x,
  CAST(lr_y AS BIGINT) AS lr_y, CAST(ctr_x AS BIGINT) AS ctr_x, CAST(ctr_y AS BIGINT) AS ctr_y FROM grid""")
def tile_grid(spark, d):
    return grids.tile_grid(g.extent(fx.sets(spark, d)), 4, 7)


@query("assign_processing_tile", "sets", f"""{_grid_sql(3, 4)},
far AS (SELECT set_id, ul_x + 3000 * (set_id % 3 // 2) AS ul_x, ul_y, lr_x + 3000 * (set_id % 3 // 2) AS lr_x, lr_y FROM sets),
hit AS (SELECT s.set_id, max(t.tile_id) AS p FROM far s JOIN grid t ON {AREA} GROUP BY s.set_id)
SELECT f.set_id, coalesce(p, -1) AS p_fid FROM far f LEFT JOIN hit h ON h.set_id = f.set_id""")
def assign_processing_tile(spark, d):
    s = fx.sets(spark, d)
    proc = grids.tile_grid(g.extent(s), 3, 4).select("tile_id", "ul_x", "ul_y", "lr_x", "lr_y")
    shift = F.when(F.col("set_id") % 3 == 2, 3000).otherwise(0)
    far = s.select("set_id", (F.col("ul_x") + shift).alias("ul_x"), "ul_y", (F.col("lr_x") + shift).alias("lr_x"), "lr_y")
    return j.last_overlap(far, proc, "set_id", SET).select("set_id", "p_fid")


@query("join_grid_intersects", "sets tiles", """
hit AS (SELECT s.set_id, t.tile_id FROM sets s JOIN tiles t ON greatest(s.ul_x, t.ul_x) <= least(s.lr_x, t.lr_x)
  AND greatest(s.lr_y, t.lr_y) <= least(s.ul_y, t.ul_y))
SELECT row_number() OVER (ORDER BY set_id, tile_id) - 1 AS new_id, set_id, tile_id FROM hit""")
def join_grid_intersects(spark, d):
    hit = boxes_overlap(fx.sets(spark, d), fx.tiles(spark, d), TILE, touching=True)
    hit = hit.select(F.col("l_set_id").alias("set_id"), F.col("r_tile_id").alias("tile_id"))
    hit = materialize(hit, "intersections")
    ranked = ordered_rank(hit, quantile_bucket(hit, "set_id"), [F.col("set_id"), F.col("tile_id")], rank="new_id")
    return ranked.withColumn("new_id", F.col("new_id") - 1)


_YEARS = list(range(1995, 2002))
_PIVOT = ", ".join(f"coalesce(max(CASE WHEN yr = {y} THEN b4 END), -9999) AS b4_{y}" for y in _YEARS)


@query("lookup_pixel", "samples obs dem", f"""
px AS (SELECT row, col, {_PIVOT} FROM obs GROUP BY row, col)
SELECT obs_pt, {", ".join(f"coalesce(b4_{y}, -9999) AS b4_{y}" for y in _YEARS)}
FROM samples s LEFT JOIN px ON px.row = s.row - 2 AND px.col = s.col - 3
WHERE s.row - 2 BETWEEN 0 AND (SELECT max(row) FROM dem) AND s.col - 3 BETWEEN 0 AND 49""")
def lookup_pixel(spark, d):
    px = fx.obs(spark, d).groupBy("row", "col").pivot("yr", _YEARS).agg(F.max("b4"))
    px = px.withColumnsRenamed({str(y): f"b4_{y}" for y in _YEARS})
    rows = fx.dem(spark, d).agg(F.max("row") + 1).first()[0] or 0
    out = j.lookup_pixel(fx.samples(spark, d).select("obs_pt", "row", "col"), px, 2, 3, (rows, 50))
    return out.select("obs_pt", *[F.coalesce(f"b4_{y}", F.lit(-9999)).alias(f"b4_{y}") for y in _YEARS])


_K9 = ", ".join(
    f"CAST(coalesce(max(CASE WHEN p.row = s.row + ({r}) AND p.col = s.col + ({c}) THEN p.v END), -9999) AS INT) AS v_{i + 1}"
    for i, (r, c) in enumerate(j.KERNEL)
)


@query("lookup_kernel", "samples dem", f"""
SELECT obs_pt, {_K9} FROM samples s LEFT JOIN dem p
  ON p.row BETWEEN s.row - 1 AND s.row + 1 AND p.col BETWEEN s.col - 1 AND s.col + 1 GROUP BY obs_pt""")
def lookup_kernel(spark, d):
    out = j.lookup_kernel(fx.samples(spark, d).select("obs_pt", "row", "col"), fx.dem(spark, d), "v", -9999)
    return out.drop("row", "col")


@query("point_tile_lookup", "samples dem", """
SELECT obs_pt, CASE WHEN s.row > 0 AND s.col > 0 THEN right('000' || v, 4) END AS tile
FROM samples s LEFT JOIN dem p ON p.row = s.row AND p.col = s.col""")
def point_tile_lookup(spark, d):
    return j.point_tile(fx.samples(spark, d), fx.dem(spark, d).select("row", "col", "v"), "v").select("obs_pt", "tile")


@query("mosaic_fill", "dem obs", """
data AS (SELECT row, col, qa % 5 AS tile, max(b4) AS value FROM obs GROUP BY row, col, qa % 5)
SELECT p.row, p.col, v % 5 AS tile, coalesce(value, -9999) AS value
FROM dem p LEFT JOIN data q ON q.row = p.row AND q.col = p.col AND q.tile = v % 5""")
def mosaic_fill(spark, d):
    ids = fx.dem(spark, d).select("row", "col", (F.col("v") % 5).alias("tile"))
    data = fx.obs(spark, d).groupBy("row", "col", (F.col("qa") % 5).alias("tile")).agg(F.max("b4").alias("value"))
    return j.mosaic_fill(ids, data, -9999)


@query("zone_burn", "dem tiles zone_edges", f"""{CENTRE},
{IN_ZONE}
SELECT s.row, s.col, coalesce(t.tile_id, 255) AS zone, CASE WHEN t.tile_id IS NULL THEN 0 ELSE 1 END AS mask
FROM px s LEFT JOIN zp t ON t.row = s.row AND t.col = s.col""")
def zone_burn(spark, d):
    px = fx.dem(spark, d).select("row", "col")
    burnt = j.polygon_burn(px, fx.zones(spark, d), TX).select("row", "col", F.col("b_tile_id").alias("zone"))
    out = px.join(burnt, ["row", "col"], "left")
    return out.select("row", "col", F.coalesce("zone", F.lit(255)).alias("zone"), F.col("zone").isNotNull().cast("int").alias("mask"))


@query("clip_to_zone", "dem tiles zone_edges", f"""{CENTRE},
{IN_ZONE}
SELECT s.row, s.col, s.v FROM px s WHERE EXISTS (SELECT 1 FROM zp t WHERE t.region_id = 1 AND t.row = s.row AND t.col = s.col)""")
def clip_to_zone(spark, d):
    px, zones = fx.dem(spark, d).select("row", "col", "v"), fx.zones(spark, d).filter("region_id = 1")
    inside = j.polygon_burn(px.select("row", "col"), zones, TX).select("row", "col")
    return px.join(inside, ["row", "col"], "left_semi")


@query("stack_predictors", "dem obs", """
o AS (SELECT row, col, max(b1) AS b1, min(b5) AS b5 FROM obs GROUP BY row, col)
SELECT p.row, p.col, 2001 AS YEAR, b1, b5, p.v, p.z FROM dem p JOIN o ON o.row = p.row AND o.col = p.col""")
def stack_predictors(spark, d):
    o = fx.obs(spark, d).groupBy("row", "col").agg(F.max("b1").alias("b1"), F.min("b5").alias("b5"))
    constants = {"YEAR": 2001}
    stack = fx.dem(spark, d).select("row", "col", "v", "z").join(o, ["row", "col"])
    stack = stack.withColumns({k: F.lit(v) for k, v in sorted(constants.items())})
    return stack.select("row", "col", *sorted(c for c in stack.columns if c not in ("row", "col")))


YEARLY = "maps AS (SELECT row, col, yr, max(b1) AS cls FROM obs GROUP BY row, col, yr)"


def yearly_maps(spark, d):
    """One class map per year: the largest band-1 value of each pixel and year."""
    return fx.obs(spark, d).groupBy("row", "col", "yr").agg(F.max("b1").alias("cls"))


@query("mask_multiply", "dem obs", f"""{YEARLY}
SELECT m.row, m.col, m.yr, (CASE WHEN m.cls > 40 THEN 1 ELSE 0 END) * (CASE WHEN p.cls >= 1 AND z > 600 THEN 1 ELSE 0 END) AS v,
  (CASE WHEN m.cls > 40 OR m.cls = 1 THEN 1 ELSE 0 END) * (CASE WHEN p.cls >= 1 AND z > 600 THEN 1 ELSE 0 END) AS v_compat
FROM maps m JOIN dem p ON p.row = m.row AND p.col = m.col""")
def mask_multiply(spark, d):
    mask = fx.dem(spark, d).select("row", "col", F.when(F.col("z") > 600, 1).otherwise(0).alias("m"))
    both = yearly_maps(spark, d).join(mask, ["row", "col"])
    on = F.col("cls") > 40
    return both.select(
        "row", "col", "yr",
        (F.when(on, 1).otherwise(0) * F.col("m")).alias("v"),
        (F.when(on | (F.col("cls") == 1), 1).otherwise(0) * F.col("m")).alias("v_compat"),
    )


@query("align_pad", "dem samples", """
SELECT coalesce(s.row, p.row) AS row, coalesce(s.col, p.col) AS col, coalesce(s.target, 0) * coalesce(p.v, 0) AS v
FROM samples s FULL OUTER JOIN dem p ON p.row = s.row AND p.col = s.col""")
def align_pad(spark, d):
    a = fx.samples(spark, d).select("row", "col", "target")
    both = a.join(fx.dem(spark, d).select("row", "col", "v"), ["row", "col"], "full_outer").na.fill(0, ["target", "v"])
    return both.select("row", "col", (F.col("target") * F.col("v")).alias("v"))


COVER = f"""{CENTRE},
cover AS (SELECT s.row, s.col, t.set_id, t.oob_rate, t.imp_0, t.imp_1, t.imp_2 FROM px s JOIN sets t ON {HALF})"""


def cover(spark, d, keep=("set_id",)):
    """Pixels with every support set covering them."""
    s = fx.sets(spark, d).select("ul_x", "ul_y", "lr_x", "lr_y", *keep)
    hit = j.pixel_sets(fx.dem(spark, d), s, TX, SET)
    return hit.select("row", "col", *[F.col(f"b_{c}").alias(c) for c in keep])


@query("pixel_set_stack", "dem sets", f"""{COVER}
SELECT row, col, set_id, row_number() OVER (PARTITION BY row, col ORDER BY set_id) AS pos,
  count(*) OVER (PARTITION BY row, col) AS n_sets FROM cover""")
def pixel_set_stack(spark, d):
    return j.set_positions(cover(spark, d))


@query("unique_combos", "dem sets", f"""{COVER},
stack AS (SELECT row, col, count(*) AS n_sets, string_agg(set_id, ',' ORDER BY set_id) AS combo FROM cover GROUP BY row, col),
firsts AS (SELECT combo, min(row * 100000 + col) AS f FROM stack GROUP BY combo)
SELECT s.row, s.col, n_sets, (SELECT count(*) FROM firsts o WHERE o.f < x.f) AS combo_id
FROM stack s JOIN firsts x ON x.combo = s.combo""")
def unique_combos(spark, d):
    prints = materialize(j.set_combination(cover(spark, d)), "combos")
    key = ["n_sets", "_f0", "_f1", "_f2"]
    firsts = prints.groupBy(*key).agg(F.min(F.struct("row", "col")).alias("first"))
    firsts = firsts.select(*key, F.col("first.row").alias("fr"), F.col("first.col").alias("fc"))
    ids = ordered_rank(firsts, F.col("fr"), [F.col("fr"), F.col("fc")], rank="combo_id")
    return prints.join(ids, key).select("row", "col", "n_sets", (F.col("combo_id") - 1).alias("combo_id"))


@query("attr_join", "samples", """
a AS (SELECT o_custkey AS id, count(*) AS n_orders, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT obs_pt, segment, coalesce(n_orders, 0) AS n_orders, coalesce(top, -1) AS top FROM samples LEFT JOIN a ON a.id = obs_pt""")
def attr_join(spark, d):
    a = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_pt"))
    a = a.agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top"))
    out = fx.samples(spark, d).select("obs_pt", "segment").join(a, "obs_pt", "left")
    return out.na.fill({"n_orders": 0, "top": -1.0})


@query("clip_tiles_to_region", "sets tiles", f"""{_grid_sql(4, 7)},
hit AS (SELECT t.tile_id, greatest(t.ul_x, min(s.ul_x)) AS ul_x, least(t.ul_y, max(s.ul_y)) AS ul_y,
  least(t.lr_x, max(s.lr_x)) AS lr_x, greatest(t.lr_y, min(s.lr_y)) AS lr_y
  FROM grid t JOIN sets s ON {AREA} WHERE s.oob_rate > 60 GROUP BY t.tile_id, t.ul_x, t.ul_y, t.lr_x, t.lr_y)
SELECT * FROM hit""")
def clip_tiles_to_region(spark, d):
    s = fx.sets(spark, d)
    tiles = grids.tile_grid(g.extent(s), 4, 7).select("tile_id", *[F.col(c).cast("double").alias(c) for c in ("ul_x", "ul_y", "lr_x", "lr_y")])
    hit = boxes_overlap(tiles, s.filter("oob_rate > 60").select("ul_x", "ul_y", "lr_x", "lr_y"), SET)
    keys = [F.col(f"l_{c}").alias(c) for c in ("tile_id", "ul_x", "ul_y", "lr_x", "lr_y")]
    box = hit.groupBy(*keys).agg(F.min("r_ul_x").alias("a"), F.max("r_ul_y").alias("b"), F.max("r_lr_x").alias("c"), F.min("r_lr_y").alias("e"))
    return box.select(
        "tile_id", F.greatest("ul_x", "a").alias("ul_x"), F.least("ul_y", "b").alias("ul_y"),
        F.least("lr_x", "c").alias("lr_x"), F.greatest("lr_y", "e").alias("lr_y"),
    )


@query("tile_bounds", "sets", """
SELECT right('000' || set_id, 4) AS tile, ul_x AS xmin, ul_y AS ymax, lr_x AS xmax, lr_y AS ymin FROM sets""")
def tile_bounds(spark, d):
    return fx.sets(spark, d).select(
        g.pad_tile_id(F.col("set_id")).alias("tile"), F.least("ul_x", "lr_x").alias("xmin"), F.greatest("ul_y", "lr_y").alias("ymax"),
        F.greatest("ul_x", "lr_x").alias("xmax"), F.least("ul_y", "lr_y").alias("ymin"),
    )


@query("snap_nearest", "sets samples", """
c AS (SELECT DISTINCT ul_x AS v FROM sets UNION SELECT DISTINCT lr_x FROM sets),
r AS (SELECT obs_pt, x, v, row_number() OVER (PARTITION BY obs_pt ORDER BY abs(v - x), v) AS k FROM samples, c)
SELECT obs_pt, x, v AS x_snapped FROM r WHERE k = 1""")
def snap_nearest(spark, d):
    s = fx.sets(spark, d)
    coords = s.select(F.col("ul_x").alias("v")).union(s.select("lr_x"))
    return j.nearest_value(fx.samples(spark, d).select("obs_pt", "x"), "x", coords, "v", width=60.0)


@query("semi_ids", "", f"""WITH {_SCENE_SQL},
want AS (SELECT DISTINCT (10 + s_suppkey % 60) || '' || (10 + s_suppkey % 30) AS four FROM supplier)
SELECT id, scene FROM raw WHERE p || '' || r IN (SELECT four FROM want)""")
def semi_ids(spark, d):
    k = F.col("s_suppkey")
    want = fx.table(spark, d, "supplier").select(F.concat((10 + k % 60).cast("string"), (10 + k % 30).cast("string")).alias("w"))
    want = want.select(nm.pathrow4(F.col("w")).alias("four"))
    s = _scenes(spark, d).withColumn("four", nm.pathrow4(F.col("scene")))
    return s.join(want, "four", "left_semi").select("id", "scene")


@query("anti_incomplete", "", """
WITH local AS (SELECT l_orderkey AS id, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS size FROM lineitem GROUP BY 1),
remote AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)
SELECT r.id, r.size, coalesce(l.size, -1) AS local_size FROM remote r LEFT JOIN local l ON l.id = r.id
WHERE l.id IS NULL OR r.size - l.size >= 1000""")
def anti_incomplete(spark, d):
    local = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    local = local.agg(F.sum(F.floor("l_extendedprice")).alias("local_size"))
    remote = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("size"))
    both = remote.join(local, "id", "left").withColumn("local_size", F.coalesce("local_size", F.lit(-1)))
    return both.filter((F.col("local_size") < 0) | (F.col("size") - F.col("local_size") >= 1000))


@query("disagreement_rows", "pairs", """
SELECT id, truth, pred, CASE WHEN truth < pred THEN 'FP' ELSE 'FN' END AS kind FROM pairs WHERE truth <> pred""")
def disagreement_rows(spark, d):
    kind = F.when(F.col("truth") < F.col("pred"), "FP").otherwise("FN")
    return fx.pairs(spark, d).filter("truth <> pred").withColumn("kind", kind)


@query("fishnet", "samples", """
e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM samples),
n AS (SELECT *, CAST(ceil((y1 - y0) / 50) AS BIGINT) AS nr, CAST(ceil((x1 - x0) / 70) AS BIGINT) AS nc FROM e)
SELECT c * nr + r AS cell_id, x0 + c * 70 AS ul_x, y1 - r * 50 AS ul_y, x0 + c * 70 + 70 AS lr_x, y1 - r * 50 - 50 AS lr_y
FROM n, unnest(generate_series(0, nc - 1)) AS a(c), unnest(generate_series(0, nr - 1)) AS b(r)""")
def fishnet(spark, d):
    e = fx.samples(spark, d).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )
    return grids.fishnet(e, 70, 50)


_ANCHOR_SQL = """e AS (SELECT CAST(floor(min(x)) AS BIGINT) AS x0, CAST(floor(max(x)) AS BIGINT) AS x1,
  CAST(floor(min(y)) AS BIGINT) AS y0, CAST(floor(max(y)) AS BIGINT) AS y1 FROM samples),
sd AS (SELECT *, x0 + CAST('0x' || substr(md5('gx|7'), 1, 8) AS BIGINT) % (x1 - x0 + 1) AS sx,
  y0 + CAST('0x' || substr(md5('gy|7'), 1, 8) AS BIGINT) % (y1 - y0 + 1) AS sy FROM e),
cells AS (SELECT i, j, sx + i * 200 AS ul_x, sy + j * 150 AS ul_y, sx + i * 200 + 200 AS lr_x, sy + j * 150 - 150 AS lr_y FROM sd,
  unnest(generate_series(-CAST(trunc((sx - x0) / 200 + 1) AS BIGINT), CAST(trunc((x1 - sx) / 200) AS BIGINT))) AS a(i),
  unnest(generate_series(-CAST(trunc((sy - y0) / 150) AS BIGINT), CAST(trunc((y1 - sy) / 150 + 1) AS BIGINT))) AS b(j))"""


def _anchored(spark, d):
    s = fx.samples(spark, d)
    e = s.agg(*[F.floor(f(c)).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    e = e.withColumn("seed", F.lit(7))
    return grids.anchored_grid(
        e, 200, 150,
        grids.hash_int(F.col("min_x"), F.col("max_x"), "gx", "seed"), grids.hash_int(F.col("min_y"), F.col("max_y"), "gy", "seed"),
    )


@query("gsrd_grid", "samples", f"{_ANCHOR_SQL} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, ul_x, ul_y, lr_x, lr_y FROM cells")
def gsrd_grid(spark, d):
    return _anchored(spark, d)


def _ctr(axis: str, step: str, anchor: str) -> str:
    lo, hi = f"least(ul_{axis}, lr_{axis})", f"greatest(ul_{axis}, lr_{axis})"
    raw = f"({lo} + CAST('0x' || substr(md5('s{axis}|' || i || '|' || j || '|' || k), 1, 8) AS BIGINT) % ({hi} - {lo} + 1))"
    return f"trunc({raw} / {step}) * {step} - ({anchor} - {step} * floor({anchor} / {step})) AS ctr_{axis}"


@query("support_sets", "samples", f"""{_ANCHOR_SQL},
many AS (SELECT *, {_ctr('x', '30e0', '7e0')}, {_ctr('y', '-30e0', '7e0')} FROM cells, unnest(generate_series(1, 4)) AS t(k))
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, ctr_x, ctr_y,
  CAST(round_even(ctr_x - (225e0 + 15), 0) AS BIGINT) AS ul_x, CAST(round_even(ctr_y + (225e0 - 15), 0) AS BIGINT) AS ul_y,
  CAST(round_even(ctr_x + (225e0 - 15), 0) AS BIGINT) AS lr_x, CAST(round_even(ctr_y - (225e0 + 15), 0) AS BIGINT) AS lr_y FROM many""")
def support_sets(spark, d):
    return grids.support_sets(_anchored(spark, d), 4, 450, 30, (7.0, 7.0), "s")


@query("elevation_bands", "dem", """
e AS (SELECT CAST(floor(col / 10) AS BIGINT) AS region, CAST(min(z) - 300 AS INT) AS lo, CAST(max(z) - 300 AS INT) AS hi FROM dem GROUP BY 1)
SELECT region, CAST(b AS INT) AS lower_bound FROM e, unnest(generate_series(greatest(lo, 0), hi - 1, 250)) AS t(b)""")
def elevation_bands(spark, d):
    cells = fx.dem(spark, d).select(F.floor(F.col("col") / 10).alias("region"), (F.col("z") - 300).alias("z"))
    return grids.elevation_bands(cells, ["region"])


@query("rect_polygons", "sets", """
SELECT set_id, 0 AS pos, ul_x AS x, ul_y AS y FROM sets UNION ALL SELECT set_id, 1, lr_x, ul_y FROM sets
UNION ALL SELECT set_id, 2, lr_x, lr_y FROM sets UNION ALL SELECT set_id, 3, ul_x, lr_y FROM sets
UNION ALL SELECT set_id, 4, ul_x, ul_y FROM sets""")
def rect_polygons(spark, d):
    s = fx.sets(spark, d)
    v = s.select("set_id", F.posexplode(grids.rect_ring(s)).alias("pos", "p"))
    return v.select("set_id", "pos", "p.x", "p.y")


@query("extent", "sets", """
SELECT oob_rate, min(ul_x) AS min_x, max(lr_x) AS max_x, min(lr_y) AS min_y, max(ul_y) AS max_y FROM sets GROUP BY oob_rate""")
def extent(spark, d):
    return g.extent(fx.sets(spark, d), ["oob_rate"])


@query("empty_tiles", "dem sets", f"""{CENTRE}
SELECT t.set_id FROM sets t WHERE NOT EXISTS (SELECT 1 FROM px s WHERE s.cls = 50 AND s.v < 930 AND {HALF})""")
def empty_tiles(spark, d):
    mask = fx.dem(spark, d).filter("cls = 50 AND v < 930").select("row", "col")
    full = j.zone_burn(mask, fx.sets(spark, d).select("set_id", "ul_x", "ul_y", "lr_x", "lr_y"), TX, SET)
    return fx.sets(spark, d).select("set_id").join(full.select(F.col("b_set_id").alias("set_id")), "set_id", "left_anti")


@query("dissolve_cells", "sets", """
SELECT oob_rate % 10 AS key, count(*) AS n_cells, min(ul_x) AS min_x, max(lr_x) AS max_x, min(lr_y) AS min_y, max(ul_y) AS max_y
FROM (SELECT DISTINCT oob_rate, ul_x, ul_y, lr_x, lr_y FROM sets) GROUP BY 1""")
def dissolve_cells(spark, d):
    cells = fx.sets(spark, d).select("oob_rate", "ul_x", "ul_y", "lr_x", "lr_y").distinct()
    cells = cells.withColumn("key", F.col("oob_rate") % 10)
    return g.extent(cells, ["key"]).join(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n_cells")), "key")


@query("row_ids", "samples", """
SELECT obs_pt, row_number() OVER (ORDER BY obs_pt) AS id1, row_number() OVER (ORDER BY obs_pt) - 1 AS id0 FROM samples WHERE target = 1""")
def row_ids(spark, d):
    kept = fx.samples(spark, d).filter("target = 1").select("obs_pt")
    return id_rank(kept, "obs_pt", rank="id1").withColumn("id0", F.col("id1") - 1)
