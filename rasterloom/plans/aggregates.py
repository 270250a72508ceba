"""Ensemble, zonal and statistical aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions import grid as g, names as nm
from rasterloom.functions.registry import STATS, all_equal, pct_equal, row_stat, stat
from rasterloom.operators import ensemble as en, joins as j, zonal as z
from rasterloom.plans.registry import query
from rasterloom.plans.scalars import TX
from rasterloom.plans.spatial import CENTRE, IN_ZONE, COVER, HALF, TILE, YEARLY, cover, yearly_maps

_STD = "sqrt(CAST(count(v) * sum(v * v) - sum(v) * sum(v) AS DOUBLE)) / count(v)"
PX = ["row", "col"]


def _std(v: str) -> str:
    return _STD.replace("(v", f"({v}").replace(" * v)", f" * {v})")


@query("zonal_stats", "dem tiles zone_edges", f"""{CENTRE},
{IN_ZONE},
burnt AS (SELECT t.tile_id, CASE WHEN s.cls = 50 THEN NULL ELSE s.cls END AS v FROM px s JOIN zp t ON t.row = s.row AND t.col = s.col),
m AS (SELECT tile_id, v, row_number() OVER (PARTITION BY tile_id ORDER BY count(*) DESC, v) AS k FROM burnt WHERE v IS NOT NULL GROUP BY tile_id, v)
SELECT b.tile_id, CAST(sum(b.v) AS BIGINT) AS map_sum, count(b.v) AS map_count, min(m.v) AS map_majority, round(avg(b.v), 6) AS map_mean
FROM burnt b JOIN m ON m.tile_id = b.tile_id AND m.k = 1 GROUP BY b.tile_id""")
def zonal_stats(spark, d):
    burnt = j.polygon_burn(fx.dem(spark, d).select("row", "col", "cls"), fx.zones(spark, d), TX)
    out = z.zonal_stats(burnt.withColumnRenamed("b_tile_id", "tile_id"), "tile_id", "cls", ["sum", "count", "majority", "mean"], "map", 50)
    return out.withColumn("map_mean", F.round("map_mean", 6))


def _ens(key: str, column: str, sql: str):
    @query(key, "predictions", f"SELECT row, col, {sql} AS {column} FROM predictions GROUP BY row, col")
    def run(spark, d):
        p = fx.predictions(spark, d)
        return p.groupBy(*PX).agg(en.simple_stats(p)[column].alias(column))

    return run


_ens("ens_mean", "mean", "CAST(round_even(avg(pred), 0) AS INT)")
_ens("ens_median", "median", "CAST(round_even(median(pred), 0) AS INT)")
_ens("ens_stdv", "stdv", f"CAST(round_even({_std('pred')}, 0) AS INT)")
_ens("ens_count", "count", "count(*)")

_VOTES = """c AS (SELECT row, col, pred, count(*) AS n FROM predictions GROUP BY row, col, pred),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, pred) AS k, sum(n) OVER (PARTITION BY row, col) AS t FROM c)"""


@query("ens_vote", "predictions", f"{_VOTES} SELECT row, col, pred AS vote FROM r WHERE k = 1")
def ens_vote(spark, d):
    return en.votes(fx.predictions(spark, d)).select(*PX, "vote")


@query("ens_pct_vote", "predictions", f"""{_VOTES}
SELECT row, col, pred AS vote, CAST(round_even(CAST(100 * n AS DOUBLE) / t, 0) AS INT) AS pct_vote, CAST(t AS BIGINT) AS count FROM r WHERE k = 1""")
def ens_pct_vote(spark, d):
    return en.votes(fx.predictions(spark, d))


@query("ens_oob", "predictions sets", """
SELECT row, col, CAST(round_even(avg(oob_rate), 0) AS INT) AS oob FROM predictions p JOIN sets s ON s.set_id = p.set_id GROUP BY row, col""")
def ens_oob(spark, d):
    # Members are counted per pixel and set before the join, then weighted.
    n = fx.predictions(spark, d).groupBy(*PX, "set_id").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(fx.sets(spark, d).select("set_id", "oob_rate"), "set_id")
    mean = F.sum(F.col("n") * F.col("oob_rate")) / F.sum("n")
    return both.groupBy(*PX).agg(F.bround(mean).cast("int").alias("oob"))


@query("tile_aggregate", "predictions", f"""
m AS (SELECT row, col, pred_nd, row_number() OVER (PARTITION BY row, col ORDER BY count(*) DESC, pred_nd) AS k FROM predictions
  WHERE pred_nd IS NOT NULL GROUP BY row, col, pred_nd),
a AS (SELECT row, col, CAST(trunc(avg(pred_nd)) AS INT) AS mean,
  CAST(trunc({_std('pred_nd')}) AS INT) AS stdv, CAST(count(pred_nd) AS INT) AS n FROM predictions GROUP BY row, col)
SELECT a.row, a.col, coalesce(mean, -9999) AS mean, coalesce(stdv, -9999) AS stdv, CASE WHEN n = 0 THEN -9999 ELSE n END AS count,
  coalesce(pred_nd, -9999) AS vote FROM a LEFT JOIN m ON m.row = a.row AND m.col = a.col AND k = 1""")
def tile_aggregate(spark, d):
    return en.aggregate_stored(fx.predictions(spark, d), "pred_nd")


@query("oob_map", "dem sets", f"""{COVER},
m AS (SELECT row, col, CAST(trunc(avg(oob_rate)) AS INT) AS oob, count(*) AS n_sets FROM cover GROUP BY row, col)
SELECT row, col, oob, n_sets, round((SELECT avg(oob) FROM m), 6) AS overall FROM m""")
def oob_map(spark, d):
    m = cover(spark, d, ("set_id", "oob_rate")).groupBy(*PX)
    m = m.agg(F.avg("oob_rate").cast("int").alias("oob"), F.count(F.lit(1)).alias("n_sets"))
    return m.withColumn("overall", F.round(m.agg(F.avg("oob")).scalar(), 6))


_IMP = ["imp_0", "imp_1", "imp_2"]
_ARGMAX = "CASE WHEN imp_0 >= imp_1 AND imp_0 >= imp_2 THEN 0 WHEN imp_1 >= imp_2 THEN 1 ELSE 2 END"


@query("argmax_index", "sets", f"SELECT set_id, {_ARGMAX} AS best FROM sets")
def argmax_index(spark, d):
    return fx.sets(spark, d).select("set_id", en.argmax_index(_IMP).alias("best"))


@query("importance_map", "dem sets", f"""{COVER},
c AS (SELECT row, col, {_ARGMAX} AS best, count(*) AS n FROM cover GROUP BY row, col, best),
r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, best) AS k FROM c)
SELECT row, col, best AS importance FROM r WHERE k = 1""")
def importance_map(spark, d):
    hit = cover(spark, d, ("set_id", *_IMP)).select(*PX, en.argmax_index(_IMP).alias("best"))
    return en.votes(hit, "best").select(*PX, F.col("vote").alias("importance"))


@query("importance_summary", "sets", """
l AS (SELECT 0 AS var, imp_0 AS imp FROM sets UNION ALL SELECT 1, imp_1 FROM sets UNION ALL SELECT 2, imp_2 FROM sets),
m AS (SELECT var, avg(imp) AS mean_imp FROM l GROUP BY var)
SELECT var, round(mean_imp, 6) AS mean_imp, round(mean_imp / (SELECT sum(mean_imp) FROM m), 6) AS share FROM m""")
def importance_summary(spark, d):
    out = en.importance_summary(fx.sets(spark, d), _IMP)
    return out.select("var", F.round("mean_imp", 6).alias("mean_imp"), F.round("share", 6).alias("share"))


@query("class_feature_map", "obs", """
n AS (SELECT b2 AS cls, b7 AS feature, sum(b1) AS s FROM obs GROUP BY b2, b7),
best AS (SELECT cls, feature, row_number() OVER (PARTITION BY cls ORDER BY s DESC, feature) AS k FROM n)
SELECT obs_id, row, col, o.b2 AS cls, best.feature FROM obs o JOIN best ON best.cls = o.b2 AND k = 1""")
def class_feature_map(spark, d):
    o = fx.obs(spark, d)
    nodes = o.select(F.col("b2").alias("cls"), F.col("b7").alias("feature"), F.col("b1").alias("n"))
    return o.select("obs_id", "row", "col", F.col("b2").alias("cls")).join(en.class_feature(nodes), "cls")


@query("gaussian_weighted_mean", "predictions dem", """
SELECT p.row, p.col, CAST(round_even(sum(pred * pow(2.718281828459045e0, -((pred - cls % 7) * (pred - cls % 7)) / 50e0))
  / sum(pow(2.718281828459045e0, -((pred - cls % 7) * (pred - cls % 7)) / 50e0)), 0) AS INT) AS weighted
FROM predictions p JOIN dem q ON q.row = p.row AND q.col = p.col GROUP BY p.row, p.col""")
def gaussian_weighted_mean(spark, d):
    centre = fx.dem(spark, d).select("row", "col", (F.col("cls") % 7).alias("centre"))
    return en.gaussian_mean(fx.predictions(spark, d).join(centre, PX), "pred", "centre")


@query("kernel_stats", "samples dem", f"""
k AS (SELECT obs_pt, v FROM samples s JOIN dem p ON p.row BETWEEN s.row - 1 AND s.row + 1 AND p.col BETWEEN s.col - 1 AND s.col + 1),
m AS (SELECT obs_pt, v, count(*) AS n, row_number() OVER (PARTITION BY obs_pt ORDER BY count(*) DESC, v) AS r FROM k GROUP BY obs_pt, v)
SELECT k.obs_pt, round(avg(k.v), 6) AS v_mean, median(k.v) AS v_median,
  round(CAST(count(k.v) * sum(k.v * k.v) - sum(k.v) * sum(k.v) AS DOUBLE) / (count(k.v) * count(k.v)), 4) AS v_variance,
  round({_std('k.v')}, 6) AS v_stdv, max(k.v) - min(k.v) AS v_range, min(m.v) AS v_mode, min(m.n) AS v_count
FROM k JOIN m ON m.obs_pt = k.obs_pt AND m.r = 1 GROUP BY k.obs_pt""")
def kernel_stats(spark, d):
    s = fx.samples(spark, d).select("obs_pt", "row", "col")
    v = F.col("v")
    long = j.kernel_values(s, fx.dem(spark, d), "v").dropna()
    n, x = F.count(v), v.cast("long")
    var = (n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double") / (n * n)
    mode = stat("mode")(v)
    stats = long.groupBy("row", "col").agg(
        F.round(F.avg(v), 6).alias("v_mean"), F.median(v).alias("v_median"), F.round(var, 4).alias("v_variance"),
        F.round(stat("stdv")(v), 6).alias("v_stdv"), (F.max(v) - F.min(v)).alias("v_range"), mode.alias("v_mode"),
    )
    counts = long.groupBy("row", "col", "v").agg(F.count(F.lit(1)).alias("v_count"))
    stats = stats.join(counts, (stats.row == counts.row) & (stats.col == counts.col) & (stats.v_mode == counts.v)).select(stats["*"], "v_count")
    return s.join(stats, PX).drop("row", "col")


_ROWCOLS = ["b1", "b2", "b3", "b4", "b5"]
_L = "[b1, b2, b3, b4, b5]"


@query("row_metric", "obs", f"""
SELECT obs_id, round(list_avg({_L}), 6) AS mean_b, list_max({_L}) AS max_b, list_min({_L}) AS min_b, list_sort({_L})[3] * 1e0 AS median_b,
  list_sort(list_transform({_L}, lambda x: [-len(list_filter({_L}, lambda y: y = x)), x]))[1][2] AS mode_b,
  (b1 <> 0)::INT + (b2 <> 0)::INT + (b3 <> 0)::INT + (b4 <> 0)::INT + (b5 <> 0)::INT AS num_pix_with_data_b,
  (b1 = 0)::INT + (b2 = 0)::INT + (b3 = 0)::INT + (b4 = 0)::INT + (b5 = 0)::INT AS num_pix_equal_b,
  (b1 BETWEEN 2 AND 9)::INT + (b2 BETWEEN 2 AND 9)::INT + (b3 BETWEEN 2 AND 9)::INT + (b4 BETWEEN 2 AND 9)::INT + (b5 BETWEEN 2 AND 9)::INT AS num_pix_between_b,
  round(sqrt(CAST(5 * (b1 * b1 + b2 * b2 + b3 * b3 + b4 * b4 + b5 * b5) - (b1 + b2 + b3 + b4 + b5) * (b1 + b2 + b3 + b4 + b5) AS DOUBLE)) / 5, 6) AS stdev_b,
  b3 AS mid_pix_b FROM obs""")
def row_metric(spark, d):
    a = F.array(*_ROWCOLS)
    options = {"num_pix_with_data": 0, "num_pix_equal": 0, "num_pix_between": (2, 10)}
    names = ["mean", "max", "min", "median", "mode", *options, "stdev", "mid_pix"]
    cols = {n: row_stat(n, a, options.get(n)) for n in names}
    cols["mean"], cols["stdev"] = F.round(cols["mean"], 6), F.round(cols["stdev"], 6)
    return fx.obs(spark, d).select("obs_id", *[c.alias(f"{n}_b") for n, c in cols.items()])


def row_sums(df, prefixes: list[str], keep: list[str]):
    """Sum same-suffix columns across prefixes; every prefix must have the same suffixes."""
    suffixes = [[c.removeprefix(p) for c in df.columns if c.startswith(p)] for p in prefixes]
    if any(s != suffixes[0] for s in suffixes):
        raise ValueError(f"prefixes {prefixes} do not share their suffixes: {suffixes}")
    name = "SUM_" + "_".join(prefixes)
    return df.select(*keep, *[sum((F.col(p + s) for p in prefixes), F.lit(0)).alias(f"{name}_{s.strip('_')}") for s in suffixes[0]])


@query("row_sum_kernels", "obs", "SELECT obs_id, b1 + b4 AS SUM_A_B_1, b2 + b5 AS SUM_A_B_2, b3 + b7 AS SUM_A_B_3 FROM obs")
def row_sum_kernels(spark, d):
    cols = {"A_1": "b1", "A_2": "b2", "A_3": "b3", "B_1": "b4", "B_2": "b5", "B_3": "b7"}
    wide = fx.obs(spark, d).select("obs_id", *[F.col(v).alias(k) for k, v in cols.items()])
    return row_sums(wide, ["A", "B"], ["obs_id"])


# Values with gaps: NaN where the class is 0.
def _gappy(spark, d):
    v = F.when(F.col("b2") == 0, F.lit(float("nan"))).otherwise(F.col("b2").cast("double"))
    return fx.obs(spark, d).select("row", "col", "yr", v.alias("v"), "b2", "b3", "b4")


_NAN = "CASE WHEN bool_or(b2 = 0) THEN NULL ELSE {} END"
_STAT_SQL = {
    "sum": _NAN.format("CAST(sum(b2) AS DOUBLE)"),
    "mean": _NAN.format("round(avg(b2), 6)"),
    "count": "count(*)",
    "nansum": "CAST(sum(b2) AS DOUBLE)",
    "nanmean": "round(avg(CASE WHEN b2 <> 0 THEN b2 END), 6)",
}


def _stat_query(name: str):
    key = f"stat_{name}"

    @query(key, "obs", f"SELECT row, col, yr, {_STAT_SQL[name]} AS {key} FROM obs GROUP BY row, col, yr")
    def run(spark, d):
        value = stat(name)(F.col("v"))
        if name != "count":
            value = F.round(F.nanvl(value, F.lit(None).cast("double")), 6)
        return _gappy(spark, d).groupBy("row", "col", "yr").agg(value.alias(key))

    return run


for _name in _STAT_SQL:
    _stat_query(_name)


@query("stat_mode_count", "obs", """
c AS (SELECT row, b2, count(*) AS n FROM obs GROUP BY row, b2), r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY n DESC, b2) AS k FROM c)
SELECT row, b2 AS mode, n FROM r WHERE k = 1""")
def stat_mode_count(spark, d):
    per = fx.obs(spark, d).groupBy("row", "b2").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("n"), (-F.col("b2")).alias("v")))
    return per.groupBy("row").agg(top.alias("t")).select("row", (-F.col("t.v")).alias("mode"), F.col("t.n").alias("n"))


@query("stat_pct_nonzero", "obs", """
SELECT row, yr, round(coalesce(100e0 * count(*) FILTER (b2 <> 0 AND b3 <> 0) / nullif(count(*) FILTER (b2 <> 0), 0), 0), 6) AS pct FROM obs GROUP BY row, yr""")
def stat_pct_nonzero(spark, d):
    # NaN where band 2 is empty, else band 3.
    v = F.when(F.isnan("v"), F.col("v")).otherwise(F.col("b3").cast("double"))
    return _gappy(spark, d).groupBy("row", "yr").agg(F.round(stat("pct_nonzero")(v), 6).alias("pct"))


@query("stat_pct_equal", "obs", """
SELECT row, yr, round(100e0 * count(*) FILTER (b3 = 4) / count(*), 6) AS pct FROM obs GROUP BY row, yr""")
def stat_pct_equal(spark, d):
    return fx.obs(spark, d).groupBy("row", "yr").agg(F.round(pct_equal(F.col("b3"), 4), 6).alias("pct"))


@query("stat_all_equal_center", "dem obs", """
SELECT o.row, o.col, o.yr, CAST(coalesce(bool_and(o.b3 = q.cls % 9) FILTER (o.b2 <> 0), true) AS INT) AS same
FROM obs o JOIN dem q ON q.row = o.row AND q.col = o.col GROUP BY o.row, o.col, o.yr""")
def stat_all_equal_center(spark, d):
    centre = fx.dem(spark, d).select("row", "col", (F.col("cls") % 9).cast("double").alias("centre"))
    o = fx.obs(spark, d)
    v = F.when(F.col("b2") == 0, F.lit(float("nan"))).otherwise(F.col("b3").cast("double"))
    return o.join(centre, PX).groupBy(*PX, "yr").agg(all_equal(v, F.col("centre")).alias("same"))


@query("stat_lc_proportion", "obs", "SELECT row, yr, round(100e0 * count(*) FILTER (b3 = 1) / count(*), 6) AS pct FROM obs GROUP BY row, yr")
def stat_lc_proportion(spark, d):
    return fx.obs(spark, d).groupBy("row", "yr").agg(F.round(stat("lc_proportion")(F.col("b3")), 6).alias("pct"))


@query("stat_registry", "obs", """
SELECT yr, CAST(max(b1) AS DOUBLE) AS max, CAST(median(b1) AS DOUBLE) AS median, CAST(min(b1) AS DOUBLE) AS min, CAST(sum(b1) AS DOUBLE) AS sum FROM obs GROUP BY yr""")
def stat_registry(spark, d):
    v = F.col("b1").cast("double")
    return fx.obs(spark, d).groupBy("yr").agg(*[STATS[n](v).alias(n) for n in ("max", "median", "min", "sum")])


@query("value_hist", "obs", "SELECT b3 AS value, count(*) AS n FROM obs WHERE b3 > 0 GROUP BY b3")
def value_hist(spark, d):
    return fx.obs(spark, d).filter("b3 > 0").groupBy(F.col("b3").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("value_counts", "label_points", "SELECT lower(trim(image_source)) AS category, count(*) AS n FROM label_points GROUP BY 1")
def value_counts(spark, d):
    p = fx.label_points(spark, d).groupBy(nm.normalize_text(F.col("image_source")).alias("category"))
    return p.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


@query("class_size", "samples", "SELECT CAST(sum(CASE WHEN val >= 0 THEN floor(val) ELSE 0 END) AS BIGINT) AS size, count(*) AS cells FROM samples")
def class_size(spark, d):
    return fx.samples(spark, d).agg(F.sum(g.clamp_negative(F.floor("val"))).alias("size"), F.count(F.lit(1)).alias("cells"))


@query("zero_cells", "obs", "SELECT row, col FROM obs GROUP BY row, col HAVING min(b3) = 0 AND min(b2) = 0")
def zero_cells(spark, d):
    m = fx.obs(spark, d).groupBy(*PX).agg(F.greatest(F.min("b3"), F.min("b2")).alias("v"))
    return m.filter("v = 0").select("row", "col")


@query("area_by_year", "dem obs", f"""{YEARLY}
SELECT yr, CAST(sum(CASE WHEN m.cls > 40 AND z > 600 THEN 1 ELSE 0 END) AS BIGINT) AS pixels,
  CAST(sum(CASE WHEN m.cls > 40 AND z > 600 THEN 1 ELSE 0 END) AS BIGINT) * 900e0 / 1e6 AS km2
FROM maps m JOIN dem p ON p.row = m.row AND p.col = m.col GROUP BY yr""")
def area_by_year(spark, d):
    # Only mask cells reach the join; every other product is zero.
    mask = fx.dem(spark, d).filter("z > 600").select("row", "col")
    years = yearly_maps(spark, d)
    on = years.withColumn("v", F.when(F.col("cls") > 40, 1).otherwise(0)).join(mask, PX)
    out = on.groupBy("yr").agg(F.sum("v").alias("pixels"))
    return out.withColumn("km2", g.area_km2(F.col("pixels")))


_LEVEL = "CASE WHEN b1 <= 15 THEN 'low' WHEN b1 <= 35 THEN 'medium' ELSE 'high' END"
_AREAS = f"""p AS (SELECT yr, sensor AS unit, {_LEVEL} AS level, count(*) AS pixels FROM obs WHERE yr IN (1995, 2001) GROUP BY ALL),
w AS (SELECT yr, unit, coalesce(sum(pixels) FILTER (level = 'low'), 0) * 900e0 / 1e6 AS low,
  coalesce(sum(pixels) FILTER (level = 'medium'), 0) * 900e0 / 1e6 AS medium, coalesce(sum(pixels) FILTER (level = 'high'), 0) * 900e0 / 1e6 AS high
  FROM p GROUP BY yr, unit)"""


def _areas(spark, d):
    o = fx.obs(spark, d).filter(F.col("yr").isin(1995, 2001))
    per = o.groupBy("yr", F.col("sensor").alias("unit"), F.expr(_LEVEL).alias("level")).agg(F.count(F.lit(1)).alias("pixels"))
    return z.area_table(per, "unit", ["low", "medium", "high"])


@query("area_totals", "obs", f"""{_AREAS}
SELECT yr, unit, round(low, 6) AS low, round(medium, 6) AS medium, round(high, 6) AS high FROM w
UNION ALL SELECT yr, 'total', round(sum(low), 6), round(sum(medium), 6), round(sum(high), 6) FROM w GROUP BY yr""")
def area_totals(spark, d):
    return _areas(spark, d).select("yr", "unit", *[F.round(c, 6).alias(c) for c in ("low", "medium", "high")])


@query("area_share", "obs", f"""{_AREAS}
SELECT yr, unit, round(low / sum(low) OVER (PARTITION BY yr), 6) AS low, round(high / sum(high) OVER (PARTITION BY yr), 6) AS high FROM w""")
def area_share(spark, d):
    a = _areas(spark, d)
    total = a.filter("unit = 'total'").select("yr", F.col("low").alias("tl"), F.col("high").alias("th"))
    both = a.filter("unit <> 'total'").join(total, "yr")
    return both.select("yr", "unit", F.round(F.col("low") / F.col("tl"), 6).alias("low"), F.round(F.col("high") / F.col("th"), 6).alias("high"))


_ZONE_TWO = f"""{YEARLY},
{CENTRE},
{IN_ZONE},
za AS (SELECT tile_id, sum((cls > 40)::INT) FILTER (yr = 1995) AS a, sum((cls > 40)::INT) FILTER (yr = 2000) AS b
  FROM maps m JOIN zp ON zp.row = m.row AND zp.col = m.col GROUP BY tile_id)"""


def _zone_years(spark, d, first: int, last: int):
    """Mapped pixels of two years per zone: the maps are laid side by side by pixel, so that zones are burnt once."""
    m = yearly_maps(spark, d).filter(F.col("yr").isin(first, last))
    mapped = lambda yr: F.sum(F.when(F.col("yr") == yr, (F.col("cls") > 40).cast("int")))
    both = m.groupBy("row", "col").agg(mapped(first).alias("first"), mapped(last).alias("last"))
    burnt = j.polygon_burn(both, fx.zones(spark, d), TX).withColumnRenamed("b_tile_id", "tile_id")
    return burnt.groupBy("tile_id").agg(F.sum("first").alias("first_sum"), F.sum("last").alias("last_sum"))


@query("zone_change", "dem obs tiles zone_edges", f"""{_ZONE_TWO}
SELECT tile_id, round(CAST(b - a AS DOUBLE) / nullif(b, 0) * 100, 6) AS pct_change, round(CAST(b - a AS DOUBLE) * 900 / 1e6, 6) AS area_change FROM za""")
def zone_change(spark, d):
    both = _zone_years(spark, d, 1995, 2000)
    out = z.change(both.withColumnsRenamed({"first_sum": "start_sum", "last_sum": "end_sum"}), "tile_id")
    return out.select("tile_id", F.round("pct_change", 6).alias("pct_change"), F.round("area_change", 6).alias("area_change"))


@query("zone_pct_error", "dem obs tiles zone_edges", f"""{_ZONE_TWO}
SELECT tile_id, round(CAST(a - b AS DOUBLE) / b * 100, 6) AS pct_err FROM za WHERE b > 0 AND a IS NOT NULL""")
def zone_pct_error(spark, d):
    both = _zone_years(spark, d, 1995, 2000)
    out = z.error(both.withColumnsRenamed({"first_sum": "map_count", "last_sum": "ref_count"}), "tile_id")
    return out.withColumn("pct_err", F.round("pct_err", 6))


_SNOW = """snow AS (SELECT row, col, yr, min(b4) AS f, max(b4) AS l FROM obs GROUP BY row, col, yr),
cells AS (SELECT row, col, CAST(floor(col / 10) AS BIGINT) AS region, z - 100 AS z FROM dem),
ends AS (SELECT region, greatest(CAST(min(z) AS INT), 0) AS lo, CAST(max(z) AS INT) AS hi FROM cells GROUP BY region),
banded AS (SELECT c.row, c.col, c.region, CAST(lo + floor((z - lo) / 250) * 250 AS INT) AS lower_bound, hi FROM cells c JOIN ends e ON e.region = c.region WHERE z >= lo),
v AS (SELECT yr, region, lower_bound, b.row, b.col, f, l FROM banded b JOIN snow s ON s.row = b.row AND s.col = b.col WHERE lower_bound < hi),
means AS (SELECT yr, region, lower_bound, avg(nullif(f, 0)) AS fm, avg(nullif(l, 0)) AS lm FROM v GROUP BY yr, region, lower_bound)"""


def _snow(spark, d):
    values = fx.obs(spark, d).groupBy(*PX, "yr").agg(F.min("b4").alias("first"), F.max("b4").alias("last"))
    cells = fx.dem(spark, d).select("row", "col", F.floor(F.col("col") / 10).alias("region"), (F.col("z") - 100).alias("z"))
    return z.elevation_band(cells, ["region"]).select("row", "col", "region", "lower_bound").join(values, PX)


@query("elev_band_means", "dem obs", f"""{_SNOW}
SELECT yr, region, lower_bound, lower_bound + 250 AS upper_bound, round(fm, 6) AS first_day_mean, round(lm, 6) AS last_day_mean FROM means""")
def elev_band_means(spark, d):
    out = z.band_means(_snow(spark, d), ["yr", "region"], "first", "last")
    return out.withColumns({c: F.round(c, 6) for c in ("first_day_mean", "last_day_mean")})


@query("band_mean_raster", "dem obs", f"""{_SNOW}
SELECT v.row, v.col, v.yr, v.region, v.lower_bound, CAST(trunc(fm) AS INT) AS first_day, CAST(trunc(lm) AS INT) AS last_day
FROM v JOIN means m ON m.yr = v.yr AND m.region = v.region AND m.lower_bound = v.lower_bound""")
def band_mean_raster(spark, d):
    cells = _snow(spark, d)
    means = z.band_means(cells, ["yr", "region"], "first", "last")
    # One row per year, region and band: joined back rather than windowed, so a large band is no bottleneck.
    both = cells.select("row", "col", "yr", "region", "lower_bound").join(means, ["yr", "region", "lower_bound"])
    return both.select(
        "row", "col", "yr", "region", "lower_bound",
        F.col("first_day_mean").cast("int").alias("first_day"), F.col("last_day_mean").cast("int").alias("last_day"),
    )


@query("series_order", "dem obs", f"""{_SNOW} SELECT region, yr, lower_bound, round(fm, 6) AS first_day_mean FROM means ORDER BY region, yr, lower_bound""")
def series_order(spark, d):
    out = z.band_means(_snow(spark, d), ["yr", "region"], "first", "last")
    return out.select("region", "yr", "lower_bound", F.round("first_day_mean", 6).alias("first_day_mean")).orderBy("region", "yr", "lower_bound")


@query("stat_limits", "predictions", """
s AS (SELECT row, col, CAST(round_even(avg(pred), 0) AS INT) AS mean, count(*) AS n FROM predictions GROUP BY row, col)
SELECT CAST(floor(row / 10) AS BIGINT) AS tile, min(mean) AS mean_min, max(mean) AS mean_max, min(n) AS count_min, max(n) AS count_max FROM s GROUP BY 1""")
def stat_limits(spark, d):
    p = fx.predictions(spark, d)
    stats = {k: v for k, v in en.simple_stats(p).items() if k in ("mean", "count")}
    per = p.groupBy(*PX).agg(*[v.alias(k) for k, v in stats.items()])
    limits = [f(k).alias(f"{k}_{n}") for k in stats for n, f in (("min", F.min), ("max", F.max))]
    return per.groupBy(F.floor(F.col("row") / 10).alias("tile")).agg(*limits)


@query("pixel_order", "predictions", "SELECT row, col, count(*) AS count FROM predictions GROUP BY row, col ORDER BY row, col")
def pixel_order(spark, d):
    return fx.predictions(spark, d).groupBy(*PX).agg(F.count(F.lit(1)).alias("count")).orderBy("row", "col")


@query("first_per_group", "obs", """
SELECT row, col, ts, b1, b4 FROM (SELECT row, col, strftime(ts, '%Y-%m-%d') AS ts, b1, b4,
  row_number() OVER (PARTITION BY row, col ORDER BY ts, b1, b4) AS k FROM obs) WHERE k = 1""")
def first_per_group(spark, d):
    # The first record by a total order is an aggregate, not a window: it combines map-side.
    first = F.min(F.struct("ts", "b1", "b4"))
    out = fx.obs(spark, d).groupBy(*PX).agg(first.alias("f"))
    return out.select(*PX, F.date_format("f.ts", "yyyy-MM-dd").alias("ts"), "f.b1", "f.b4")


@query("distinct_values", "samples", "SELECT DISTINCT zone, segment FROM samples")
def distinct_values(spark, d):
    return fx.samples(spark, d).select("zone", "segment").distinct()


@query("set_difference", "samples", """
SELECT obs_pt FROM samples WHERE obs_pt NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def set_difference(spark, d):
    taken = fx.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("obs_pt"))
    return fx.samples(spark, d).select("obs_pt").join(taken, "obs_pt", "left_anti")
