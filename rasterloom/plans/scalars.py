"""Projections, predicates and recodes over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions import grid as g, names as nm, spectral as sp
from rasterloom.plans.registry import query

TX = g.Affine(fx.UL_X, fx.RES, fx.UL_Y, -fx.RES)
# Anchored inside the points so that some offsets are negative: truncation and floor differ there.
TX_IN = g.Affine(1000500.0, 30.0, 1199500.0, -30.0)


@query("xy_to_rowcol", "samples", """
SELECT obs_pt, CAST(trunc((y - 1199500e0) / -30e0) AS INT) AS r, CAST(trunc((x - 1000500e0) / 30e0) AS INT) AS c
FROM samples""")
def xy_to_rowcol(spark, d):
    s = fx.samples(spark, d)
    return s.select("obs_pt", g.row_of(F.col("y"), TX_IN).alias("r"), g.col_of(F.col("x"), TX_IN).alias("c"))


@query("rowcol_to_xy", "obs", """
SELECT obs_id, row, col, CAST(trunc(1e6 + col * 30e0) AS INT) AS x, CAST(trunc(1200000e0 + row * -30e0) AS INT) AS y
FROM obs""")
def rowcol_to_xy(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", "row", "col", g.x_of(F.col("col"), TX).alias("x"), g.y_of(F.col("row"), TX).alias("y"))


@query("snap_coordinate", "samples", """
SELECT obs_pt, x + ((15e0 - 30e0 * floor(15e0 / 30e0)) - (x - 30e0 * floor(x / 30e0))) AS sx,
  y + ((15e0 - -30e0 * floor(15e0 / -30e0)) - (y - -30e0 * floor(y / -30e0))) AS sy FROM samples""")
def snap_coordinate(spark, d):
    s = fx.samples(spark, d)
    return s.select("obs_pt", g.snap(F.col("x"), 15, 30).alias("sx"), g.snap(F.col("y"), 15, -30).alias("sy"))


@query("affine_from_extent", "sets", """
e AS (SELECT min(least(ul_x, lr_x)) AS min_x, max(greatest(ul_x, lr_x)) AS max_x,
  min(least(ul_y, lr_y)) AS min_y, max(greatest(ul_y, lr_y)) AS max_y FROM sets)
SELECT min_x + ((7e0 - 30e0 * floor(7e0 / 30e0)) - (min_x - 30e0 * floor(min_x / 30e0))) AS ul_x, 30e0 AS x_res,
  max_y + ((7e0 - -30e0 * floor(7e0 / -30e0)) - (max_y - -30e0 * floor(max_y / -30e0))) AS ul_y, -30e0 AS y_res,
  min_x, max_x, min_y, max_y FROM e""")
def affine_from_extent(spark, d):
    return g.affine_from_extent(fx.sets(spark, d), 30.0, -30.0, anchor=(7.0, 7.0))


@query("nodata_null", "obs", """
SELECT obs_id, CASE WHEN b1 = 50 THEN -9999 ELSE b1 END AS b1, CASE WHEN b2 = 0 THEN -9999 ELSE b2 END AS b2,
  CASE WHEN b1 = 50 THEN 1 ELSE 0 END + CASE WHEN b2 = 0 THEN 1 ELSE 0 END AS gaps FROM obs""")
def nodata_null(spark, d):
    o = fx.obs(spark, d).withColumns({"n1": g.to_null(F.col("b1"), 50), "n2": g.to_null(F.col("b2"), 0)})
    gaps = F.col("n1").isNull().cast("int") + F.col("n2").isNull().cast("int")
    return o.select(
        "obs_id", g.from_null(F.col("n1"), -9999).alias("b1"), g.from_null(F.col("n2"), -9999).alias("b2"), gaps.alias("gaps")
    )


@query("valid_pixel_filter", "obs", "SELECT obs_id, row, col, b1, b2, b3 FROM obs WHERE b1 <> 50 AND b2 <> 0 AND b3 <> 0")
def valid_pixel_filter(spark, d):
    o = fx.obs(spark, d).withColumns(
        {"b1": g.to_null(F.col("b1"), 50), "b2": g.to_null(F.col("b2"), 0), "b3": g.to_null(F.col("b3"), 0)}
    )
    return g.valid_pixels(o, ["b1", "b2", "b3"]).select("obs_id", "row", "col", "b1", "b2", "b3")


@query("clamp_negative", "samples", "SELECT obs_pt, CASE WHEN val >= 0 THEN val ELSE 0 END AS val FROM samples")
def clamp_negative(spark, d):
    return fx.samples(spark, d).select("obs_pt", g.clamp_negative(F.col("val")).alias("val"))


@query("binarize", "obs", """
SELECT obs_id, CASE WHEN b1 = 12 THEN 1 ELSE 0 END AS eq12, CASE WHEN b1 > 4 AND b1 < 10 THEN 1 ELSE 0 END AS mid,
  CASE WHEN b2 = 1 THEN 1 ELSE 0 END AS ones FROM obs""")
def binarize(spark, d):
    return fx.obs(spark, d).select(
        "obs_id",
        g.is_class(F.col("b1"), 12).alias("eq12"),
        g.in_open_range(F.col("b1"), 4).alias("mid"),
        g.only_ones(F.col("b2")).alias("ones"),
    )


def _chain(column: str, pairs: list[tuple[int, int]], source: str, tag: str) -> str:
    """Oracle: one CTE per recode step, in order."""
    steps, prev = [], source
    for i, (k, v) in enumerate(pairs):
        steps.append(
            f"{tag}{i} AS (SELECT * REPLACE (CASE WHEN {column} = {k} THEN {v} ELSE {column} END AS {column}) FROM {prev})"
        )
        prev = f"{tag}{i}"
    return ",\n".join(steps), prev


_OLD = list(g.COVER_CODES.items())
_c1, _p1 = _chain("o_old", _OLD, "base", "s")
_c2, _p2 = _chain("o_new", [(v, k) for k, v in _OLD], _p1, "t")
_c3, _p3 = _chain("o_user", [(1, 2), (2, 3), (10, 11), (12, 10)], _p2, "u")


@query("reclassify", "obs", f"""
base AS (SELECT obs_id, b4 % 100 AS o_old, b4 % 100 AS o_new, b1 AS o_user, CASE WHEN b2 = 1 THEN 12 ELSE b2 END AS o_bin FROM obs),
{_c1},
{_c2},
{_c3}
SELECT obs_id, o_old, o_new, o_user, o_bin FROM {_p3}""")
def reclassify(spark, d):
    v = F.col("b4") % 100
    return fx.obs(spark, d).select(
        "obs_id",
        g.reclassify(v, "old").alias("o_old"),
        g.reclassify(v, "new").alias("o_new"),
        g.reclassify(F.col("b1"), "user", "1:2,2:3, 10:11,12:10").alias("o_user"),
        g.reclassify(F.col("b2"), "binary", 12).alias("o_bin"),
    )


@query("centerline_clean", "obs", "SELECT obs_id, CASE WHEN b3 = 1 THEN 1 ELSE 0 END AS line FROM obs")
def centerline_clean(spark, d):
    return fx.obs(spark, d).select("obs_id", g.only_ones(F.col("b3")).alias("line"))


@query("tile_id_pad", "", "SELECT c_custkey, right('000' || c_custkey, 4) AS tile FROM customer")
def tile_id_pad(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", g.pad_tile_id(F.col("c_custkey")).alias("tile"))


_SCENE_SQL = """scenes AS (SELECT c_custkey AS id, 10 + c_custkey % 60 AS p, 10 + c_custkey % 30 AS r FROM customer),
raw AS (SELECT id, p, r, CASE id % 4 WHEN 0 THEN p || '' || r WHEN 1 THEN '0' || p || r WHEN 2 THEN p || '0' || r
  ELSE '0' || p || '0' || r END AS scene FROM scenes)"""


def _scenes(spark, d):
    k = F.col("c_custkey")
    p, r = (10 + k % 60).cast("string"), (10 + k % 30).cast("string")
    scene = (
        F.when(k % 4 == 0, F.concat(p, r))
        .when(k % 4 == 1, F.concat(F.lit("0"), p, r))
        .when(k % 4 == 2, F.concat(p, F.lit("0"), r))
        .otherwise(F.concat(F.lit("0"), p, F.lit("0"), r))
    )
    return fx.table(spark, d, "customer").select(k.alias("id"), scene.alias("scene"))


@query("pathrow6", "", f"WITH {_SCENE_SQL} SELECT id, scene, '0' || p || '0' || r AS six FROM raw")
def pathrow6(spark, d):
    return _scenes(spark, d).select("id", "scene", nm.pathrow6(F.col("scene")).alias("six"))


@query("pathrow4", "", f"WITH {_SCENE_SQL} SELECT id, p || '' || r AS four FROM raw")
def pathrow4(spark, d):
    return _scenes(spark, d).select("id", nm.pathrow4(F.col("scene")).alias("four"))


@query("expand_pathrows", "", """
WITH spec AS (SELECT s_suppkey AS id, 40 + s_suppkey % 7 AS p0, 40 + s_suppkey % 7 + s_suppkey % 3 AS p1,
  20 + s_suppkey % 5 AS r0, 20 + s_suppkey % 5 + s_suppkey % 2 AS r1 FROM supplier)
SELECT id, (r - r0) * (p1 - p0 + 1) + (p - p0) AS pos, '0' || p || '0' || r AS scene
FROM spec, unnest(generate_series(p0, p1)) AS tp(p), unnest(generate_series(r0, r1)) AS tr(r)""")
def expand_pathrows(spark, d):
    k = F.col("s_suppkey")

    def span(lo, hi):
        return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))

    p0, r0 = 40 + k % 7, 20 + k % 5
    spec = F.concat_ws("/", span(p0, p0 + k % 3), span(r0, r0 + k % 2))
    s = fx.table(spark, d, "supplier").select(k.alias("id"), spec.alias("spec"))
    return nm.expand_pathrows(s, "spec", ["id"]).withColumn("pos", F.col("pos").cast("long"))


@query("parse_output_name", "", """
SELECT s_suppkey AS id, 'grid' AS key, CAST(s_nationkey AS VARCHAR) AS value, 'nbr' AS index_id,
  CAST(s_suppkey % 10 AS INT) AS n_vert, CAST(1984 + s_suppkey % 5 AS INT) AS start_year, 2019 AS end_year,
  '06150915' AS date_range FROM supplier""")
def parse_output_name(spark, d):
    k = F.col("s_suppkey")
    name = F.concat_ws(
        "-", F.lit("grid"), F.col("s_nationkey").cast("string"), F.lit("NBR"), F.lpad((k % 10).cast("string"), 2, "0"),
        F.concat((1984 + k % 5).cast("string"), F.lit("2019")), F.lit("06150915"), F.lit("extra"),
    )
    s = fx.table(spark, d, "supplier").select(k.alias("id"), name.alias("name"))
    return s.select("id", *[c.alias(n) for n, c in nm.parse_output_name(F.col("name")).items()])


@query("year_from_name", "", """
SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS yr, 'z' || o_custkey % 25 || '_' AS region FROM orders""")
def year_from_name(spark, d):
    o = fx.table(spark, d, "orders")
    name = F.concat(
        F.lit("z"), (F.col("o_custkey") % 25).cast("string"), F.lit("_"), F.year("o_orderdate").cast("string"),
        F.lit("_"), F.col("o_orderkey").cast("string"),
    )
    o = o.select(F.col("o_orderkey").alias("id"), name.alias("name"))
    return o.select("id", nm.year_from_name(F.col("name")).cast("int").alias("yr"), nm.region_from_name(F.col("name")).alias("region"))


_OLI = ", ".join(
    f"CASE WHEN sensor = 'LC08' THEN CAST(trunc(({b} - {i}e0) / {s}e0) AS SMALLINT) ELSE CAST({b} AS SMALLINT) END AS {b}"
    for b, s, i in zip(sp.BANDS, sp.OLI_SLOPE, [f"({v})" for v in (round(10_000 * i, 6) for i in sp.OLI_INTERCEPT)])
).replace(")e0", "e0)")


@query("harmonize_oli", "obs", f"SELECT obs_id, sensor, {_OLI} FROM obs")
def harmonize_oli(spark, d):
    return sp.harmonize_oli(fx.obs(spark, d)).select("obs_id", "sensor", *sp.BANDS)


@query("qa_clear", "obs", """
SELECT obs_id, qa, CASE WHEN bit_count(qa) <= 2 THEN 1 ELSE 0 END AS clear,
  CASE WHEN qa & 56 = 0 THEN 1 ELSE 0 END AS strict FROM obs""")
def qa_clear(spark, d):
    q = F.col("qa")
    return fx.obs(spark, d).select(
        "obs_id", "qa", sp.qa_clear(q).cast("int").alias("clear"), sp.qa_clear(q, True).cast("int").alias("strict")
    )


def _tc(name: str) -> str:
    return "round(" + " + ".join(f"{b} * {k}e0" for b, k in zip(sp.BANDS, sp.TASSELED_CAP[name])).replace("* -", "* -") + ", 4)"


@query("tasseled_cap", "obs", f"SELECT obs_id, {_tc('tcb')} AS tcb, {_tc('tcg')} AS tcg, {_tc('tcw')} AS tcw FROM obs")
def tasseled_cap(spark, d):
    return fx.obs(spark, d).select("obs_id", *[F.round(sp.tasseled_cap(n), 4).alias(n) for n in sp.TASSELED_CAP])


def _nd(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} = 0 THEN NULL ELSE CAST({a} - {b} AS DOUBLE) / ({a} + {b}) * 1000 END"


def _index_query(key: str, a: str, b: str):
    @query(key, "obs", f"SELECT obs_id, round({_nd(a, b)}, 6) AS {key} FROM obs")
    def run(spark, d):
        return fx.obs(spark, d).select("obs_id", F.round(sp.spectral_index(key.upper()), 6).alias(key))

    return run


for _key, _a, _b in (("nbr", "b4", "b7"), ("ndvi", "b4", "b3"), ("ndsi", "b2", "b5")):
    _index_query(_key, _a, _b)


@query("lt_stack", "obs", f"""
SELECT obs_id, round(-1 * ({_nd('b4', 'b7')}), 4) AS idx, round({_nd('b4', 'b7')}, 4) AS ftv_idx,
  {_tc('tcb')} AS ftv_tcb, {_tc('tcg')} AS ftv_tcg, {_tc('tcw')} AS ftv_tcw,
  round({_nd('b4', 'b3')}, 4) AS ftv_ndvi, round({_nd('b2', 'b5')}, 4) AS ftv_ndsi FROM obs""")
def lt_stack(spark, d):
    s = sp.index_stack(fx.obs(spark, d), "NBR", ["obs_id"])
    return s.select("obs_id", *[F.round(c, 4).alias(c) for c in s.columns if c != "obs_id"])


@query("aspect_intensity", "dem", """
SELECT row, col, round(sin(z / 1000) * cos(v / 57.29578e0 - 0e0), 6) AS north,
  round(sin(z / 1000) * cos(v / 57.29578e0 - 3.141592653589793e0), 6) AS south,
  round(sin(z / 1000) * cos(v / 57.29578e0 - 180e0), 6) AS south_compat FROM dem""")
def aspect_intensity(spark, d):
    s, a = F.col("z") / 1000, F.col("v")
    return fx.dem(spark, d).select(
        "row", "col",
        F.round(g.aspect_intensity(s, a, "north"), 6).alias("north"),
        F.round(g.aspect_intensity(s, a, "south"), 6).alias("south"),
        F.round(g.aspect_intensity(s, a, "south", compat=True), 6).alias("south_compat"),
    )


@query("area_km2", "obs", """
SELECT yr, count(*) AS pixels, CAST(count(*) AS DOUBLE) * 30e0 * 30e0 / 1e6 AS km2 FROM obs WHERE b1 = 12 GROUP BY yr""")
def area_km2(spark, d):
    n = fx.obs(spark, d).filter("b1 = 12").groupBy("yr").agg(F.count(F.lit(1)).alias("pixels"))
    return n.withColumn("km2", g.area_km2(F.col("pixels")))


@query("label_recode", "label_points", """
SELECT id, class, lat, lon, CASE WHEN class IN ('g', 'd', 'ha', 'tw', 'sh') THEN 1 ELSE 0 END AS binary
FROM label_points WHERE (discard IS NULL OR discard <> 'y') AND class <> 'u'""")
def label_recode(spark, d):
    return nm.keep_labels(fx.label_points(spark, d)).select("id", "class", "lat", "lon", "binary")


@query("text_normalize", "label_points", "SELECT id, lower(trim(image_source)) AS image_source FROM label_points")
def text_normalize(spark, d):
    return fx.label_points(spark, d).select("id", nm.normalize_text(F.col("image_source")).alias("image_source"))


@query("certainty_from_name", "", """
SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'three' WHEN 3 THEN 'one'
  ELSE 'combined' END AS certainty FROM supplier""")
def certainty_from_name(spark, d):
    k = F.col("s_suppkey")
    tail = (
        F.when(k % 5 == 0, "class_one").when(k % 5 == 1, "class_two_revised").when(k % 5 == 2, "class_three")
        .when(k % 5 == 3, "three_then_one").otherwise("all_classes")
    )
    name = F.concat(F.lit("area_"), k.cast("string"), F.lit("_"), tail)
    return fx.table(spark, d, "supplier").select(k.alias("id"), nm.certainty_from_name(name).alias("certainty"))


_EPOCH_SQL = """
recoded AS (SELECT cnt, tile, epoch_len, start_year, CASE
  WHEN start_year < 1999 AND ((epoch_len = 3 AND idx <= 5) OR (epoch_len = 4 AND idx <= 4) OR (epoch_len = 5 AND idx <= 3)
    OR (epoch_len = 6 AND idx <= 2)) THEN 1983 + epoch_len + epoch_len * idx
  WHEN start_year >= 1999 AND epoch_len = 1 AND idx <= 19 THEN 2000 + idx
  WHEN start_year >= 1999 AND epoch_len = 2 AND idx <= 9 THEN 2001 + 2 * idx
  WHEN start_year >= 1999 AND epoch_len = 3 AND idx <= 6 THEN 2001 + 3 * idx
  WHEN start_year >= 1999 AND epoch_len = 4 AND idx <= 4 THEN 2003 + 4 * idx ELSE idx END AS year FROM composite_counts),
kept AS (SELECT * FROM recoded WHERE year BETWEEN start_year AND CASE WHEN start_year < 1999 THEN 1999 ELSE 2019 END
  AND tile BETWEEN 16 AND 22)
"""


def _epochs(spark, d):
    c = fx.composite_counts(spark, d)
    c = c.withColumn("year", nm.epoch_year(F.col("idx"), F.col("epoch_len"), F.col("start_year")))
    last = F.when(F.col("start_year") < 1999, 1999).otherwise(2019)
    return c.filter(F.col("year").between(F.col("start_year"), last) & F.col("tile").between(16, 22))


@query("epoch_recode", "composite_counts", _EPOCH_SQL + "SELECT year, cnt, tile, epoch_len, start_year FROM kept")
def epoch_recode(spark, d):
    return _epochs(spark, d).select("year", "cnt", "tile", "epoch_len", "start_year")


@query("valid_pixel_counts", "composite_counts", _EPOCH_SQL + """
SELECT epoch_len, year, tile, CAST(sum(cnt) AS BIGINT) AS pixels FROM kept GROUP BY epoch_len, year, tile""")
def valid_pixel_counts(spark, d):
    return _epochs(spark, d).groupBy("epoch_len", "year", "tile").agg(F.sum("cnt").alias("pixels"))


@query("column_select", "obs", """
SELECT CASE WHEN b1 > 25 THEN 1 ELSE 0 END AS class, b2 AS b2_2001, b3 AS b3_2001 FROM obs WHERE b2 <> 0""")
def column_select(spark, d):
    wide = fx.obs(spark, d).select(
        g.in_open_range(F.col("b1"), 25, 1000).alias("class"),
        F.nullif(F.col("b2"), F.lit(0)).alias("b2_2001"),
        F.col("b3").alias("b3_2001"),
        F.col("b4").alias("b4_2016"),
        F.col("obs_id").alias("system:index"),
        F.col("sensor").alias(".geo"),
    )
    return nm.training_columns(wide, 2001)


@query("month_hist", "", "SELECT CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1")
def month_hist(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


_MELT_YEARS = range(1995, 2002)


@query("melt_years", "obs", """
wide AS (SELECT row, yr, count(*) AS n FROM obs GROUP BY row, yr),
grid AS (SELECT row, yr FROM (SELECT DISTINCT row FROM obs), unnest(generate_series(1995, 2001)) AS t(yr))
SELECT g.row, CAST(g.yr AS INT) AS year, coalesce(n, 0) * 900e0 / 1e6 AS area FROM grid g LEFT JOIN wide w ON w.row = g.row AND w.yr = g.yr""")
def melt_years(spark, d):
    wide = fx.obs(spark, d).groupBy("row").pivot("yr", list(_MELT_YEARS)).agg(F.count(F.lit(1))).na.fill(0)
    long = nm.melt_years(wide.withColumn("note", F.lit("x")), ["row"], "pixels")
    return long.select("row", "year", (F.col("pixels") * F.lit(900.0) / F.lit(1e6)).alias("area"))


@query("oob_predicate", "sets", "SELECT set_id, oob_rate FROM sets WHERE oob_rate >= 70")
def oob_predicate(spark, d):
    return fx.sets(spark, d).filter(nm.drop_predicate("oob_rate >= 70", ["oob_rate"])).select("set_id", "oob_rate")


@query("predicate_dsl", "sets", """
SELECT 'gt' AS rule, set_id FROM sets WHERE oob_rate > 70 UNION ALL SELECT 'le', set_id FROM sets WHERE oob_rate <= 10
UNION ALL SELECT 'lt', set_id FROM sets WHERE oob_rate < 10""")
def predicate_dsl(spark, d):
    s = fx.sets(spark, d)
    rules = {"gt": "oob_rate >= 70", "le": "oob_rate <= 10", "lt": "oob_rate < 10", "bad": "oob_rate ~ 3"}
    out = None
    for name, text in rules.items():
        rule = nm.drop_predicate(text, ["oob_rate"], compat=(name == "gt"))
        if rule is None:
            continue
        part = s.filter(rule).select(F.lit(name).alias("rule"), "set_id")
        out = part if out is None else out.unionByName(part)
    return out
