"""Stencil, resampling, drainage and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.operators import regions as rg, terrain as tr
from rasterloom.plans.registry import query

# 3 x 3 neighbourhood by self-joins, k1..k9 row-major.
_N = ", ".join(f"max(CASE WHEN q.row - p.row = {r} AND q.col - p.col = {c} THEN q.z END) AS k{i + 1}" for i, (r, c) in enumerate(tr.KERNEL))
NEIGH = f"""nb AS (SELECT p.row, p.col, count(*) AS n, {_N} FROM dem p JOIN dem q
  ON q.row BETWEEN p.row - 1 AND p.row + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY p.row, p.col)"""
_DX = "((k3 + 2 * k6 + k9) - (k1 + 2 * k4 + k7)) / 240"
_DY = "((k7 + 2 * k8 + k9) - (k1 + 2 * k2 + k3)) / 240"


def _derived(spark, d, name: str):
    return tr.derivatives(fx.dem(spark, d), fx.RES).select("row", "col", F.round(name, 6).alias(name))


@query("slope", "dem", f"{NEIGH} SELECT row, col, CASE WHEN n = 9 THEN round(degrees(atan(sqrt({_DX} * {_DX} + {_DY} * {_DY}))), 6) END AS slope FROM nb")
def slope(spark, d):
    return _derived(spark, d, "slope")


@query("aspect", "dem", f"""{NEIGH},
t AS (SELECT row, col, n, {_DX} AS dx, {_DY} AS dy FROM nb), a AS (SELECT *, degrees(atan2(dy, -dx)) AS t FROM t)
SELECT row, col, CASE WHEN n = 9 AND (dx <> 0 OR dy <> 0) THEN round(CASE WHEN t > 90 THEN 450 - t ELSE 90 - t END, 6) END AS aspect FROM a""")
def aspect(spark, d):
    return _derived(spark, d, "aspect")


@query("curvature", "dem", f"""{NEIGH}
SELECT row, col, CASE WHEN n = 9 THEN round(-2 * (((k4 + k6) / 2 - k5) / 900 + ((k2 + k8) / 2 - k5) / 900) * 100, 6) END AS curvature FROM nb""")
def curvature(spark, d):
    return _derived(spark, d, "curvature")


_W = "CASE WHEN {t} < 1 THEN (1.5e0 * {t} - 2.5e0) * {t} * {t} + 1 WHEN {t} < 2 THEN ((-0.5e0 * {t} + 2.5e0) * {t} - 4) * {t} + 2 ELSE 0 END"


@query("resample", "dem", f"""
t AS (SELECT DISTINCT CAST(floor((row + 0.5e0) / 1.5e0) AS BIGINT) + o AS tr, CAST(floor((col + 0.5e0) / 1.5e0) AS BIGINT) + q AS tc
  FROM dem, unnest([-1, 0, 1]) AS a(o), unnest([-1, 0, 1]) AS b(q)),
c AS (SELECT tr, tc, (tr + 0.5e0) * 1.5e0 - 0.5e0 AS y, (tc + 0.5e0) * 1.5e0 - 0.5e0 AS x FROM t),
k AS (SELECT c.* FROM c JOIN dem p ON p.row = floor(y + 0.5e0) AND p.col = floor(x + 0.5e0)),
w AS (SELECT tr, tc, z, ({_W.format(t='abs(y - p.row)')}) * ({_W.format(t='abs(x - p.col)')}) AS w FROM k JOIN dem p
  ON p.row > y - 2 AND p.row < y + 2 AND p.col > x - 2 AND p.col < x + 2)
SELECT tr AS row, tc AS col, round(sum(w * z) / sum(w), 4) AS z FROM w GROUP BY tr, tc""")
def resample(spark, d):
    out = tr.resample_cubic(fx.dem(spark, d).select("row", "col", "z"), "z", 1.5)
    return out.select("row", "col", F.round("z", 4).alias("z"))


@query("resample_mean", "dem", """
SELECT CAST(floor(row / 3) AS INT) AS row, CAST(floor(col / 3) AS INT) AS col, round(avg(z), 6) AS z FROM dem GROUP BY 1, 2""")
def resample_mean(spark, d):
    return tr.resample_mean(fx.dem(spark, d), "z", 3).withColumn("z", F.round("z", 6))


_SLOT = {(r, c): i + 1 for i, (r, c) in enumerate(tr.KERNEL)}
_DROPS = " UNION ALL ".join(
    f"SELECT row, col, {i} AS i, {code} AS code, {r} AS dr, {c} AS dc, (k5 - k{_SLOT[(r, c)]}) / {'1e0' if 0 in (r, c) else 'sqrt(2e0)'} AS d FROM nb"
    for i, (code, r, c) in enumerate(tr.D8)
)
FLOW = f"""{NEIGH}, drops AS ({_DROPS}),
best AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d DESC, i) AS k FROM drops WHERE d > 0),
flow AS (SELECT p.row, p.col, coalesce(b.code, 0) AS direction, p.row + coalesce(dr, 0) AS tr, p.col + coalesce(dc, 0) AS tc
  FROM dem p LEFT JOIN best b ON b.row = p.row AND b.col = p.col AND k = 1)"""


@query("flow_direction", "dem", f"{FLOW} SELECT row, col, direction FROM flow")
def flow_direction(spark, d):
    return tr.flow_direction(fx.dem(spark, d))


@query("watershed", "", f"""
WITH RECURSIVE dem AS ({fx.SQL['dem']}), {FLOW},
pour AS (SELECT row, col FROM dem WHERE cls <= 2 AND v >= 950),
w AS (SELECT row, col, row AS pour_row, col AS pour_col FROM pour
  UNION ALL SELECT f.row, f.col, w.pour_row, w.pour_col FROM w JOIN flow f ON f.tr = w.row AND f.tc = w.col AND NOT (f.row = w.row AND f.col = w.col)
  WHERE NOT EXISTS (SELECT 1 FROM pour p WHERE p.row = f.row AND p.col = f.col))
SELECT * FROM w""")
def watershed(spark, d):
    dem = fx.dem(spark, d)
    flow = tr.downstream(tr.flow_direction(dem))
    return tr.watershed(flow, dem.filter("cls <= 2 AND v >= 950"))


@query("pour_points", "obs", """
l AS (SELECT obs_id, CAST(floor(obs_id / 10) AS BIGINT) AS line, CAST(b7 / 10 AS INT) AS pos, row, col,
  row_number() OVER (PARTITION BY CAST(floor(obs_id / 10) AS BIGINT) ORDER BY b7 DESC, row DESC, col DESC) AS k FROM obs)
SELECT line, pos, row, col FROM l WHERE k = 1""")
def pour_points(spark, d):
    o = fx.obs(spark, d).select(F.floor(F.col("obs_id") / 10).alias("line"), (F.col("b7") / 10).cast("int").alias("pos"), "row", "col")
    # The last vertex of a line by position, as a map-side combined maximum.
    return o.groupBy("line").agg(F.max(F.struct("pos", "row", "col")).alias("v")).select("line", "v.*")


_CLS = "CAST(floor(cls / 26) AS INT)"


@query("polygonize", "", f"""
WITH RECURSIVE dem AS ({fx.SQL['dem']}),
g AS (SELECT row, col, {_CLS} AS v, CAST(row AS BIGINT) * 2147483648 + col AS cell FROM dem),
e AS (SELECT a.cell AS u, b.cell AS w FROM g a JOIN g b ON a.v = b.v AND abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach AS (SELECT cell AS u, cell AS w FROM g UNION SELECT r.u, e.w FROM reach r JOIN e ON e.u = r.w),
root AS (SELECT u, min(w) AS region FROM reach GROUP BY u)
SELECT region, CAST(v AS DOUBLE) AS value, count(*) AS cells, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1
FROM root JOIN g ON g.cell = root.u WHERE v = 1 GROUP BY region, v""")
def polygonize(spark, d):
    grid = fx.dem(spark, d).select("row", "col", F.floor(F.col("cls") / 26).alias("value"))
    ones = grid.filter("value = 1")
    return rg.region_table(rg.regions(ones, "value", block=16), "value")


@query("nearest_stream", "dem", """
s AS (SELECT row AS s_row, col AS s_col, z AS s_z FROM dem WHERE cls <= 1),
d AS (SELECT row, col, z, s_row, s_col, s_z, (row - s_row) * (row - s_row) + (col - s_col) * (col - s_col) AS d2 FROM dem, s),
k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, s_row, s_col) AS r FROM d)
SELECT row, col, z - s_z AS above, d2, s_row, s_col FROM k WHERE r = 1""")
def nearest_stream(spark, d):
    dem = fx.dem(spark, d)
    out = tr.nearest_stream(dem, dem.filter("cls <= 1"))
    return out.select("row", "col", (F.col("z") - F.col("s_z")).alias("above"), "d2", "s_row", "s_col")
