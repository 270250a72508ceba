"""Compositing, annual series, segmentation and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions import grid as g, spectral as sp
from rasterloom.operators import composite as cp, joins as j, segmentation as sg
from rasterloom.plans.registry import query
from rasterloom.plans.scalars import TX
from rasterloom.plans.spatial import CENTRE, HALF, TILE

_B = ", ".join(sp.BANDS)


def medoid_sql(source: str) -> str:
    """Oracle CTEs ending in ``medoid(row, col, yr, bands)``."""
    dist = " + ".join(f"(o.{b} - m.m_{b}) * (o.{b} - m.m_{b})" for b in sp.BANDS)
    return f"""mids AS (SELECT row, col, yr, {", ".join(f"median({b}) AS m_{b}" for b in sp.BANDS)} FROM {source} GROUP BY row, col, yr),
ranked AS (SELECT o.row, o.col, o.yr, {", ".join("o." + b for b in sp.BANDS)}, row_number() OVER (PARTITION BY o.row, o.col, o.yr
  ORDER BY {dist}, o.ts, {", ".join("o." + b for b in sp.BANDS)}) AS k FROM {source} o JOIN mids m ON m.row = o.row AND m.col = o.col AND m.yr = o.yr),
medoid AS (SELECT row, col, yr, {_B} FROM ranked WHERE k = 1)"""


CLEAR = "clear AS (SELECT * FROM obs WHERE bit_count(qa) <= 2)"


def clear_obs(spark, d):
    return fx.obs(spark, d).filter(sp.qa_clear(F.col("qa")))


@query("sensor_union", "obs", """
SELECT obs_id, row, col, sensor, yr, doy, b1 FROM obs WHERE sensor IN ('LT05', 'LE07', 'LC08')
  AND month(ts) * 100 + day(ts) >= 415 AND month(ts) * 100 + day(ts) < 915""")
def sensor_union(spark, d):
    s = cp.season(fx.obs(spark, d), ["LT05", "LE07", "LC08"], None, (4, 15), (9, 15))
    return s.select("obs_id", "row", "col", "sensor", "yr", "doy", "b1")


@query("medoid_composite", "obs", f"{CLEAR}, {medoid_sql('clear')} SELECT * FROM medoid")
def medoid_composite(spark, d):
    return cp.medoid(clear_obs(spark, d))


@query("target_day_composite", "obs", f"""
r AS (SELECT *, row_number() OVER (PARTITION BY row, col, yr ORDER BY abs(doy - 200), ts, {_B}) AS k FROM obs)
SELECT row, col, yr, {_B} FROM r WHERE k = 1""")
def target_day_composite(spark, d):
    return cp.target_day(fx.obs(spark, d), 200)


_DOUBLES = ", ".join(f"CAST({b} AS DOUBLE) AS {b}" for b in sp.BANDS)


@query("annual_series", "obs dem", f"""{CLEAR}, {medoid_sql('clear')},
y AS (SELECT p.row, p.col, CAST(t.yr AS INT) AS yr FROM dem p, unnest(generate_series(1995, 2001)) AS t(yr))
SELECT y.row, y.col, y.yr, y.yr || '-08-01' AS stamp, {_DOUBLES} FROM y LEFT JOIN medoid m ON m.row = y.row AND m.col = y.col AND m.yr = y.yr""")
def annual_series(spark, d):
    a = cp.annual_series(cp.medoid(clear_obs(spark, d)), fx.dem(spark, d), 1995, 2001)
    return a.select("row", "col", "yr", F.date_format("stamp", "yyyy-MM-dd").alias("stamp"), *[F.col(b).cast("double").alias(b) for b in sp.BANDS])


# A series with given vertices: first, last and every year whose value is a multiple of four.
_VERT = """s AS (SELECT row, col, yr, CAST(floor(avg(b4)) AS INT) AS raw FROM obs GROUP BY row, col, yr),
v AS (SELECT *, raw + 3 AS ftv, raw % 4 = 0 OR yr = min(yr) OVER (PARTITION BY row, col) OR yr = max(yr) OVER (PARTITION BY row, col) AS is_vertex FROM s)"""


def _vertices(spark, d):
    s = fx.obs(spark, d).groupBy("row", "col", "yr").agg(F.floor(F.avg("b4")).cast("int").alias("raw"))
    ends = s.groupBy("row", "col").agg(F.min("yr").alias("y0"), F.max("yr").alias("y1"))
    s = s.join(ends, ["row", "col"])
    mark = (F.col("raw") % 4 == 0) | (F.col("yr") == F.col("y0")) | (F.col("yr") == F.col("y1"))
    return s.select("row", "col", "yr", "raw", (F.col("raw") + 3).alias("ftv"), mark.alias("is_vertex"))


_SLOTS = ", ".join(
    f"CAST({sign} * coalesce(max(CASE WHEN k = {i} THEN {f} END), 0) AS INT) AS {lab}{i}"
    for lab, f, sign in (("year_vert", "yr", 1), ("raw_vert", "raw", -1), ("ftv_vert", "ftv", -1))
    for i in range(1, 6)
)


@query("vertex_stack", "obs", f"""{_VERT},
o AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY yr) AS k FROM v WHERE is_vertex)
SELECT row, col, {_SLOTS} FROM o GROUP BY row, col""")
def vertex_stack(spark, d):
    return cp.vertex_stack(_vertices(spark, d), 4, flip=-1)


@query("fitted_series", "obs", f"""{_VERT},
f AS (SELECT row, col, yr, raw, last_value(CASE WHEN is_vertex THEN yr END IGNORE NULLS) OVER b AS ya, last_value(CASE WHEN is_vertex THEN ftv END IGNORE NULLS) OVER b AS va,
  first_value(CASE WHEN is_vertex THEN yr END IGNORE NULLS) OVER n AS yb, first_value(CASE WHEN is_vertex THEN ftv END IGNORE NULLS) OVER n AS vb FROM v
  WINDOW b AS (PARTITION BY row, col ORDER BY yr ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY row, col ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT row, col, yr, raw, CAST(round_even(CAST(va AS DOUBLE) + coalesce((CAST(vb AS DOUBLE) - va) * (yr - ya) / nullif(yb - ya, 0), 0), 0) AS SMALLINT) AS fitted FROM f""")
def fitted_series(spark, d):
    out = cp.fit_between_vertices(_vertices(spark, d), "ftv", "is_vertex")
    return out.select("row", "col", "yr", "raw", "fitted")


@query("temporal_segmentation")
def temporal_segmentation(spark, d):
    s = cp.medoid(fx.obs(spark, d)).select("row", "col", "yr", sp.spectral_index("NBR").alias("nbr"))
    out = sg.segment(s, "nbr")
    return out.withColumns({c: F.round(c, 6) for c in ("raw", "fitted")})


@query("flagship_area_by_zone", "obs tiles dem", f"""{CLEAR}, {medoid_sql('clear')}, {CENTRE},
z AS (SELECT s.row, s.col, t.region_id AS zone FROM px s JOIN tiles t ON {HALF}),
hit AS (SELECT z.zone, m.yr, count(*) AS n FROM medoid m JOIN z ON z.row = m.row AND z.col = m.col
  WHERE m.b4 + m.b3 <> 0 AND CAST(m.b4 - m.b3 AS DOUBLE) / (m.b4 + m.b3) * 1000 > 970 GROUP BY z.zone, m.yr)
SELECT zone, yr, n AS pixels, CAST(n AS DOUBLE) * 30e0 * 30e0 / 1e6 AS km2 FROM hit""")
def flagship_area_by_zone(spark, d):
    best = cp.medoid(clear_obs(spark, d)).withColumn("ndvi", sp.spectral_index("NDVI"))
    mapped = best.filter("ndvi > 970").select("row", "col", "yr")
    zones = j.zone_burn(fx.dem(spark, d).select("row", "col"), fx.tiles(spark, d), TX, TILE)
    zones = zones.select("row", "col", F.col("b_region_id").alias("zone"))
    out = mapped.join(zones, ["row", "col"]).groupBy("zone", "yr").agg(F.count(F.lit(1)).alias("pixels"))
    return out.withColumn("km2", g.area_km2(F.col("pixels")))
