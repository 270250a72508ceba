"""Accuracy assessment, sampling and out-of-bag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.functions import names as nm
from rasterloom.operators import accuracy as ac, sampling as sa
from rasterloom.plans.registry import query

_REPORT = """sides AS (SELECT {by} truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS actual, 0 AS predicted FROM counts
  UNION ALL SELECT {by} pred, 0, 0, n FROM counts),
cls AS (SELECT {by} label, sum(tp) AS tp, sum(actual) AS actual, sum(predicted) AS predicted FROM sides GROUP BY ALL),
pr AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(actual, 0), 0) AS r FROM cls),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr),
a AS (SELECT {by} CAST(sum(tp) AS DOUBLE) / sum(actual) AS acc, sum(actual) AS s, avg(p) AS mp, avg(r) AS mr, avg(f1) AS mf,
  sum(p * actual) / sum(actual) AS wp, sum(r * actual) / sum(actual) AS wr, sum(f1 * actual) / sum(actual) AS wf FROM f GROUP BY ALL),
rep AS (SELECT {fby} CAST(label AS VARCHAR) AS stat, p AS precision, r AS recall, f1 AS f1_score, actual AS support, acc AS model_accuracy FROM f {join}
  UNION ALL SELECT {by} 'accuracy', acc, acc, acc, s, acc FROM a UNION ALL SELECT {by} 'macro avg', mp, mr, mf, s, acc FROM a
  UNION ALL SELECT {by} 'weighted avg', wp, wr, wf, s, acc FROM a)"""
_FLAT = _REPORT.format(by="", fby="", join=", a")
_BY_T = _REPORT.format(by="threshold,", fby="f.threshold,", join="JOIN a ON a.threshold = f.threshold")
_OUT = """round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support,
  round(model_accuracy, 6) AS model_accuracy FROM rep"""


def _rounded(df, *keep):
    return df.select(*keep, "stat", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "model_accuracy")], "support")


@query("confusion_matrix", "pairs", """
SELECT truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM pairs GROUP BY truth""")
def confusion_matrix(spark, d):
    return ac.confusion_matrix(fx.pairs(spark, d), [0, 1])


@query("classification_report", "pairs", f"""
counts AS (SELECT truth, pred, count(*) AS n FROM pairs GROUP BY truth, pred), {_FLAT}
SELECT stat, {_OUT}""")
def classification_report(spark, d):
    return _rounded(ac.classification_report(ac.pair_counts(fx.pairs(spark, d))))


@query("kappa_users_producers", "obs", """
counts AS (SELECT CAST(floor(b1 / 11) AS BIGINT) AS truth, CAST(floor(b5 / 21) AS BIGINT) AS pred, count(*) AS n FROM obs GROUP BY ALL),
t AS (SELECT truth AS label, sum(n) AS actual, sum(n) FILTER (truth = pred) AS tp FROM counts GROUP BY truth),
p AS (SELECT pred AS label, sum(n) AS predicted FROM counts GROUP BY pred),
b AS (SELECT coalesce(t.label, p.label) AS label, coalesce(tp, 0) AS tp, coalesce(actual, 0) AS actual, coalesce(predicted, 0) AS predicted
  FROM t FULL OUTER JOIN p ON p.label = t.label),
o AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(actual) AS po, CAST(sum(actual * predicted) AS DOUBLE) / (CAST(sum(actual) AS DOUBLE) * sum(actual)) AS pe FROM b)
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(actual AS BIGINT) AS actual, CAST(predicted AS BIGINT) AS predicted,
  round(CAST(tp AS DOUBLE) / nullif(predicted, 0), 6) AS users, round(CAST(tp AS DOUBLE) / nullif(actual, 0), 6) AS producers,
  round(po, 6) AS overall, round((po - pe) / (1 - pe), 6) AS kappa FROM b, o""")
def kappa_users_producers(spark, d):
    o = fx.obs(spark, d).select(F.floor(F.col("b1") / 11).alias("truth"), F.floor(F.col("b5") / 21).alias("pred"))
    out = ac.kappa_report(ac.pair_counts(o))
    return out.withColumns({c: F.round(c, 6) for c in ("users", "producers", "overall", "kappa")})


@query("confusion_diff_labels", "", "SELECT lang AS truth, source AS pred, count(*) AS n FROM documents GROUP BY 1, 2")
def confusion_diff_labels(spark, d):
    return ac.pair_counts(fx.table(spark, d, "documents"), "lang", "source")


@query("binned_confusion", "obs", """
b AS (SELECT CASE WHEN b1 > 0 AND b1 <= 10 THEN 0 WHEN b1 > 10 AND b1 <= 30 THEN 1 WHEN b1 > 30 AND b1 <= 50 THEN 2 END AS truth,
  CASE WHEN b5 > 0 AND b5 <= 10 THEN 0 WHEN b5 > 10 AND b5 <= 30 THEN 1 WHEN b5 > 30 AND b5 <= 50 THEN 2 END AS pred FROM obs)
SELECT truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) FILTER (pred = 2) AS pred_2
FROM b WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY truth""")
def binned_confusion(spark, d):
    bins = ac.parse_bins("0:10,10:30,30:50")
    b = fx.obs(spark, d).select(ac.in_bin(F.col("b1"), bins).alias("truth"), ac.in_bin(F.col("b5"), bins).alias("pred"))
    return ac.confusion_matrix(b.dropna(), [0, 1, 2])


@query("threshold_sweep", "probs", f"""
counts AS (SELECT CAST(t AS INT) AS threshold, truth, CASE WHEN prob100 >= t THEN 1 ELSE 0 END AS pred, count(*) AS n
  FROM probs, unnest(generate_series(50, 95, 5)) AS s(t) GROUP BY ALL), {_BY_T}
SELECT threshold, stat, {_OUT}""")
def threshold_sweep(spark, d):
    return _rounded(ac.threshold_sweep(fx.probs(spark, d), "truth", "prob100"), "threshold")


_BY_M = _REPORT.format(by="model,", fby="f.model,", join="JOIN a ON a.model = f.model")


@query("concat_reports", "pairs probs", f"""
counts AS (SELECT 'pairs' AS model, truth, pred, count(*) AS n FROM pairs GROUP BY ALL
  UNION ALL SELECT 'probs', truth, CASE WHEN prob100 >= 50 THEN 1 ELSE 0 END, count(*) FROM probs GROUP BY ALL), {_BY_M}
SELECT model, stat, {_OUT}""")
def concat_reports(spark, d):
    by_model = {
        "pairs": fx.pairs(spark, d),
        "probs": fx.probs(spark, d).withColumn("pred", F.when(F.col("prob100") >= 50, 1).otherwise(0)),
    }
    out = None
    for model, df in by_model.items():
        part = _rounded(ac.classification_report(ac.pair_counts(df))).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


@query("rmse", "probs", "SELECT round(sqrt(avg((prob100 - 100 * truth) * (prob100 - 100 * truth))), 6) AS rmse FROM probs")
def rmse(spark, d):
    return fx.probs(spark, d).agg(F.round(ac.rmse(F.col("prob100"), 100 * F.col("truth")), 6).alias("rmse"))


@query("rmspe", "obs", "SELECT round(sqrt(avg(pow(100 * (b1 - b4) / CAST(b1 AS DOUBLE), 2))), 4) AS rmspe FROM obs")
def rmspe(spark, d):
    return fx.obs(spark, d).agg(F.round(ac.rmspe(F.col("b1"), F.col("b4")), 4).alias("rmspe"))


@query("agree_coef", "obs", """
s AS (SELECT avg(b1) AS mx, avg(b5) AS my, var_pop(b1) AS vx, var_pop(b5) AS vy, covar_pop(b1, b5) AS cv FROM obs),
l AS (SELECT b1 AS x, b5 AS y, mx, my, abs(mx - my) AS dm, sign(cv) * sqrt(vy / vx) AS b FROM obs, s),
q AS (SELECT sum((x - y) * (x - y)) AS ssd, sum((dm + abs(x - mx)) * (dm + abs(y - my))) AS spod,
  sum(abs(x - (y - (my - b * mx)) / b) * abs(y - ((my - b * mx) + b * x))) AS u FROM l)
SELECT round(1 - ssd / spod, 6) AS ac, round(1 - (ssd - u) / spod, 6) AS ac_s, round(1 - u / spod, 6) AS ac_u, CAST(ssd AS DOUBLE) AS ssd, round(spod, 2) AS spod FROM q""")
def agree_coef(spark, d):
    out = ac.agreement(fx.obs(spark, d), "b1", "b5")
    return out.select(*[F.round(c, 6).alias(c) for c in ("ac", "ac_s", "ac_u")], "ssd", F.round("spod", 2).alias("spod"))


@query("rmse_split", "probs", """
SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(sqrt(avg(e * e) FILTER (truth = 1)), 3) AS rmse_true, round(sqrt(avg(e * e) FILTER (truth <> 1)), 3) AS rmse_false,
  round(avg(abs(e)), 3) AS mae, round(avg(abs(e)) FILTER (truth = 1), 3) AS mae_true, round(avg(abs(e)) FILTER (truth <> 1), 3) AS mae_false
FROM (SELECT truth, truth - prob100 / 100e0 AS e FROM probs)""")
def rmse_split(spark, d):
    t, p = F.col("truth"), F.col("prob100") / 100
    default = [c.alias(k) for k, c in ac.rmse_split(t, p).items()]
    compat = [c.alias(k.replace("rmse", "mae")) for k, c in ac.rmse_split(t, p, compat=True).items()]
    return fx.probs(spark, d).agg(*default, *compat)


@query("roc_auc", "probs", """
c AS (SELECT prob100 AS s, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth <> 1) AS n FROM probs GROUP BY 1),
w AS (SELECT a.p * (2 * coalesce((SELECT sum(n) FROM c b WHERE b.s < a.s), 0) + a.n) AS v, a.p, a.n FROM c a)
SELECT round(CAST(sum(v) AS DOUBLE) / 2 / (CAST(sum(p) AS DOUBLE) * sum(n)), 3) AS auc FROM w""")
def roc_auc(spark, d):
    return ac.roc_auc(fx.probs(spark, d), "truth", "prob100")


@query("roc_curve", "probs", """
c AS (SELECT prob100 AS threshold, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth <> 1) AS n FROM probs GROUP BY 1)
SELECT threshold, round(CAST(sum(n) OVER w AS DOUBLE) / (SELECT sum(n) FROM c), 6) AS fpr, round(CAST(sum(p) OVER w AS DOUBLE) / (SELECT sum(p) FROM c), 6) AS tpr
FROM c WINDOW w AS (ORDER BY threshold DESC)""")
def roc_curve(spark, d):
    out = ac.roc_curve(fx.probs(spark, d), "truth", "prob100")
    return out.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("brier", "probs", "SELECT round(avg(pow(truth - prob100 / 100e0, 2)), 6) AS brier FROM probs")
def brier(spark, d):
    e = F.col("truth") - F.col("prob100") / 100
    return fx.probs(spark, d).agg(F.round(F.avg(e * e), 6).alias("brier"))


@query("oob_score", "probs", """
c AS (SELECT set_id, truth, CASE WHEN prob100 >= 70 THEN 1 ELSE 0 END AS pred, count(*) AS n FROM probs GROUP BY ALL),
t AS (SELECT set_id, sum(n) AS n, sum(n) FILTER (truth = pred) AS tp, sum(n) FILTER (truth = 1) AS t1, sum(n) FILTER (pred = 1) AS p1 FROM c GROUP BY set_id),
k AS (SELECT set_id, CAST(coalesce(tp, 0) AS DOUBLE) / n AS po, CAST(coalesce(t1, 0) * coalesce(p1, 0) + (n - coalesce(t1, 0)) * (n - coalesce(p1, 0)) AS DOUBLE) / (CAST(n AS DOUBLE) * n) AS pe FROM t),
r AS (SELECT set_id, count(*) AS n, sum(prob100) AS st, sum(prob100 * prob100) AS stt, sum((prob100 - 100 * truth) * (prob100 - 100 * truth)) AS sse FROM probs GROUP BY set_id)
SELECT k.set_id, CAST(round_even(100 * po, 0) AS INT) AS oob_rate, round((po - pe) / nullif(1 - pe, 0), 6) AS oob_kappa,
  CAST(round_even(100 * (1 - sse / (stt - CAST(st * st AS DOUBLE) / n)), 0) AS INT) AS reg_rate, CAST(round_even(sqrt(CAST(sse AS DOUBLE) / n), 0) AS INT) AS reg_rmse
FROM k JOIN r ON r.set_id = k.set_id""")
def oob_score(spark, d):
    p = fx.probs(spark, d)
    hit = p.withColumn("pred", F.when(F.col("prob100") >= 70, 1).otherwise(0))
    kappa = ac.kappa_report(ac.pair_counts(hit, by=["set_id"]), ["set_id"]).groupBy("set_id").agg(
        F.bround(100 * F.first("overall")).cast("int").alias("oob_rate"), F.round(F.first("kappa"), 6).alias("oob_kappa")
    )
    t, q = F.col("prob100").cast("long"), (100 * F.col("truth")).cast("long")
    reg = ac.oob_regression(p, ["set_id"], t, q).withColumnsRenamed({"oob_rate": "reg_rate", "oob_rmse": "reg_rmse"})
    return kappa.join(reg, "set_id")


@query("drop_low_oob", "sets", "SELECT set_id, oob_rate, CASE WHEN oob_rate < 40 THEN 'dropped' ELSE 'kept' END AS status FROM sets")
def drop_low_oob(spark, d):
    low = nm.drop_predicate("oob_rate < 40", ["oob_rate"])
    return fx.sets(spark, d).select("set_id", "oob_rate", F.when(low, "dropped").otherwise("kept").alias("status"))


@query("stratified_sample", "samples", """
b AS (SELECT obs_pt, row, col, val, CASE WHEN val > -1000 AND val <= 2000 THEN 0 WHEN val > 2000 AND val <= 2100 THEN 1 WHEN val > 2100 AND val <= 9000 THEN 2 END AS bin FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('st|' || obs_pt), obs_pt) AS k, count(*) OVER (PARTITION BY bin) AS n FROM b WHERE bin IS NOT NULL)
SELECT obs_pt, row, col, val, bin, CASE WHEN k <= floor(least(n, 100) * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM r WHERE k <= 100""")
def stratified_sample(spark, d):
    s = fx.samples(spark, d).select("obs_pt", "row", "col", "val")
    return sa.stratified(s, "val", "obs_pt", ac.parse_bins("-1000:2000,2000:2100,2100:9000"), 300, "st", 0.8)


@query("proportional_sample", "samples", """
c AS (SELECT zone, segment, count(*) AS n FROM samples GROUP BY zone, segment),
w AS (SELECT zone, segment, floor(least(greatest(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY zone), 0.1e0), 0.25e0) * 40) AS want FROM c),
r AS (SELECT obs_pt, zone, segment, row_number() OVER (PARTITION BY zone, segment ORDER BY md5('pr|' || obs_pt), obs_pt) AS k FROM samples)
SELECT obs_pt, r.zone, r.segment FROM r JOIN w ON w.zone = r.zone AND w.segment = r.segment WHERE k <= want""")
def proportional_sample(spark, d):
    s = fx.samples(spark, d).select("obs_pt", "zone", "segment")
    return sa.proportional(s, "zone", "segment", "obs_pt", 40, 0.1, 0.25, "pr")


@query("zone_sample", "samples", """
z AS (SELECT zone, row_number() OVER (ORDER BY md5('zsz|' || zone), zone) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT zone FROM samples WHERE zone <> 0)),
zs AS (SELECT zone, CASE WHEN k <= floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS split FROM z),
ng AS (SELECT obs_pt, zone, row_number() OVER (ORDER BY md5('zsn|' || obs_pt), obs_pt) AS k, count(*) OVER () AS n FROM samples WHERE zone = 0),
ps AS (SELECT obs_pt, s.zone, split, row_number() OVER (PARTITION BY split ORDER BY md5('zsp|' || obs_pt), obs_pt) AS k FROM samples s JOIN zs ON zs.zone = s.zone)
SELECT obs_pt, zone, CASE WHEN k <= floor(least(n, 75) * 0.8e0) THEN 'train' ELSE 'test' END AS split, 0 AS value FROM ng WHERE k <= 75
UNION ALL SELECT obs_pt, zone, split, 1 FROM ps WHERE k <= CASE WHEN split = 'train' THEN 40 ELSE 9 END""")
def zone_sample(spark, d):
    s = fx.samples(spark, d).select("obs_pt", "zone")
    return sa.from_zones(s, "zone", "obs_pt", 100, 0, 0.8, 0.7, "zs", inflation=1.5)


@query("random_points", "samples", """
r AS (SELECT obs_pt, x, y, row_number() OVER (ORDER BY md5('rp|' || obs_pt), obs_pt) AS id FROM samples WHERE target = 1)
SELECT obs_pt, x, y, id FROM r WHERE id <= 200""")
def random_points(spark, d):
    s = fx.samples(spark, d).filter("target = 1").select("obs_pt", "x", "y")
    return sa.random_points(s, ["obs_pt"], 200, "rp")


@query("bootstrap_oob", "", """
WITH m AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS obs_pt FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY md5('bag|' || set_id || '|' || obs_pt), obs_pt) AS k, count(*) OVER (PARTITION BY set_id) AS n FROM m)
SELECT set_id, obs_pt, CASE WHEN k <= floor(n * 0.63e0) THEN 1 ELSE 0 END AS in_bag FROM r""")
def bootstrap_oob(spark, d):
    m = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("obs_pt")).distinct()
    return sa.bootstrap(m, "bag")


@query("split_locations", "obs", """
u AS (SELECT row, col, row_number() OVER (ORDER BY md5('loc|' || row || '|' || col), row, col) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT row, col FROM obs))
SELECT obs_id, o.row, o.col, CASE WHEN k <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM obs o JOIN u ON u.row = o.row AND u.col = o.col""")
def split_locations(spark, d):
    return sa.split_locations(fx.obs(spark, d).select("obs_id", "row", "col"), "loc")


@query("holdout_split", "samples", """
SELECT obs_pt, target, CASE WHEN row_number() OVER (ORDER BY md5('ho|' || obs_pt), obs_pt) <= ceil(count(*) OVER () * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM samples""")
def holdout_split(spark, d):
    return sa.holdout(fx.samples(spark, d).select("obs_pt", "target"), "obs_pt", "ho")


@query("kfold", "samples", "SELECT obs_pt, CAST(ntile(3) OVER (ORDER BY obs_pt) AS INT) AS fold FROM samples")
def kfold(spark, d):
    return sa.folds(fx.samples(spark, d).select("obs_pt"), "obs_pt")


@query("stratified_kfold", "samples", """
f AS (SELECT target, ntile(3) OVER (PARTITION BY target ORDER BY obs_pt) AS fold FROM samples)
SELECT CAST(fold AS INT) AS fold, target, count(*) AS n FROM f GROUP BY fold, target""")
def stratified_kfold(spark, d):
    f = sa.folds(fx.samples(spark, d).select("obs_pt", "target"), "obs_pt", by=["target"])
    return f.groupBy("fold", "target").agg(F.count(F.lit(1)).alias("n"))


@query("topk_random", "samples", "SELECT obs_pt, target FROM samples ORDER BY md5('top|' || obs_pt), obs_pt LIMIT 100")
def topk_random(spark, d):
    return sa.top_random(fx.samples(spark, d).select("obs_pt", "target"), ["obs_pt"], 100, "top")
