"""Tree ensembles, forests and their out-of-bag scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import fixtures as fx
from rasterloom.operators import accuracy as ac, ensemble as en, forests as fo, joins as j, sampling as sa, trees as tr
from rasterloom.plans.registry import query
from rasterloom.plans.spatial import MEMBERS, SET
from rasterloom.session import materialize, scratch_path

FEATURES = ["zone", "seg", "col", "bucket"]
MIN_OBS = 130

SEG = "CASE segment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END"
# A coarse, overlapping hint of the target, so that single splits help without deciding it.
BUCKET = "CAST(floor(val / 3000) AS INT) + zone % 3"


def predictors(spark, d):
    """Samples with integer predictors of few distinct values."""
    return fx.samples(spark, d).select(
        "obs_pt", "x", "y", "row", "col", "zone", "target", "val", F.expr(SEG).alias("seg"), F.expr(BUCKET).alias("bucket")
    )


def bags(spark, d):
    """(set_id, obs_pt, in_bag, predictors, target) of every kept support set."""
    s = predictors(spark, d)
    kept = j.kept_members(j.set_members(s, fx.sets(spark, d), SET), MIN_OBS).select("set_id", "obs_pt")
    return sa.bootstrap(kept, "bag").join(s.drop("x", "y"), "obs_pt")


_TREE_BAG = f"""{MEMBERS},
n AS (SELECT set_id, count(*) AS n FROM members GROUP BY set_id HAVING floor(count(*) * 0.63e0) >= {MIN_OBS}),
bag AS (SELECT m.set_id, m.obs_pt, n.n, row_number() OVER (PARTITION BY m.set_id ORDER BY md5('bag|' || m.set_id || '|' || m.obs_pt), m.obs_pt) AS k
  FROM members m JOIN n ON n.set_id = m.set_id),
tp AS (SELECT obs_pt, row, col, target, val, zone, {SEG} AS seg, {BUCKET} AS bucket FROM samples)"""
BAG = f"""{_TREE_BAG},
tb AS (SELECT b.set_id, CAST(target AS DOUBLE) AS y, CAST(floor(n * 0.63e0) AS BIGINT) AS n, val, zone, seg, col, bucket FROM bag b JOIN tp ON tp.obs_pt = b.obs_pt WHERE k <= floor(n * 0.63e0))"""


def _splits(name: str, rows: str, features: list[str], regress: bool, most: int | None = None, seed: str = "tree") -> str:
    """CTEs ending in ``name`` (set_id, node, feature, threshold, gain): every threshold of every feature scored per node of ``rows``."""
    lf = " UNION ALL ".join(f"SELECT set_id, node, y, w, ml, {i} AS feature, CAST({f} AS DOUBLE) AS v FROM {rows}" for i, f in enumerate(features))
    if most is not None:
        lf = f"""SELECT * FROM ({lf}) WHERE list_contains(list_slice(list_sort(list_transform(range({len(features)}),
          lambda f: md5('{seed}|' || set_id || '|' || node || '|' || f))), 1, {most}), md5('{seed}|' || set_id || '|' || node || '|' || feature))"""
    sums = "sum(w * y) AS a, sum(w * y * y) AS b" if regress else "sum(w * (y = 0)::INT) AS a, sum(w * (y = 1)::INT) AS b"
    score = (lambda a, b, n: f"({a}) * ({a}) / ({n})") if regress else (lambda a, b, n: f"(({a}) * ({a}) + ({b}) * ({b})) / ({n})")
    return f"""{name}_h AS (SELECT set_id, node, ml, feature, v, sum(w) AS n, {sums} FROM ({lf}) GROUP BY ALL),
    {name}_c AS (SELECT set_id, node, ml, feature, v, CAST(sum(n) OVER u AS DOUBLE) AS ln, CAST(sum(a) OVER u AS DOUBLE) AS la, CAST(sum(b) OVER u AS DOUBLE) AS lb,
      CAST(sum(n) OVER p AS DOUBLE) AS tn, CAST(sum(a) OVER p AS DOUBLE) AS ta, CAST(sum(b) OVER p AS DOUBLE) AS tb, lead(v) OVER u AS nxt FROM {name}_h
      WINDOW u AS (PARTITION BY set_id, node, feature ORDER BY v), p AS (PARTITION BY set_id, node, feature)),
    {name}_s AS (SELECT *, {score("la", "lb", "ln")} + {score("ta - la", "tb - lb", "tn - ln")} AS score, {score("ta", "tb", "tn")} AS whole FROM {name}_c
      WHERE nxt IS NOT NULL AND ln >= ml AND tn - ln >= ml),
    {name} AS (SELECT set_id, node, feature, (v + nxt) / 2 AS threshold, score - whole AS gain FROM (SELECT *,
      row_number() OVER (PARTITION BY set_id, node ORDER BY score DESC, feature, v) AS r FROM {name}_s WHERE score - whole > 1e-9 * greatest(abs(whole), 1)) WHERE r = 1)"""


def tree_sql(rows: str, features: list[str], regress: bool = False, most: int | None = None, seed: str = "tree", name: str = "tree") -> str:
    """Recursive CTEs for whole trees over ``rows`` (set_id, y, w, ml, predictors): ``name``_r holds the rows of every node, ``name`` the nodes."""
    pick = f"CASE b.feature {' '.join(f'WHEN {i} THEN r.{f}' for i, f in enumerate(features))} END"
    kept = ", ".join(f"r.{f}" for f in features)
    value = "sum(w * y) / CAST(sum(w) AS DOUBLE)" if regress else "CASE WHEN sum(w * (y = 1)::INT) > sum(w * (y = 0)::INT) THEN 1e0 ELSE 0e0 END"
    return f"""{name}_r AS (SELECT set_id, '1' AS node, y, w, ml, {", ".join(features)} FROM {rows}
      UNION ALL (WITH {_splits(f"{name}_i", f"{name}_r", features, regress, most, seed)}
      SELECT r.set_id, r.node || CASE WHEN {pick} > b.threshold THEN '1' ELSE '0' END, r.y, r.w, r.ml, {kept}
      FROM {name}_r r JOIN {name}_i b ON b.set_id = r.set_id AND b.node = r.node)),
    {_splits(f"{name}_b", f"{name}_r", features, regress, most, seed)},
    {name} AS (SELECT s.*, b.feature, b.threshold, coalesce(b.gain, 0) AS gain FROM (SELECT set_id, node, CAST(sum(w) AS BIGINT) AS n, {value} AS prediction
      FROM {name}_r GROUP BY set_id, node) s LEFT JOIN {name}_b b ON b.set_id = s.set_id AND b.node = s.node)"""


def leaf_sql(points: str, features: list[str], tree: str = "tree", name: str = "walk", columns: str = "set_id, obs_pt") -> str:
    """Recursive CTE ``name``_w of pointer steps and ``name`` (``columns``, pred): ``points`` walked down ``tree``."""
    pick = f"CASE t.feature {' '.join(f'WHEN {i} THEN p.{f}' for i, f in enumerate(features))} END"
    named = [c.strip() for c in columns.split(",")]
    own, read = (", ".join(f"p.{c}" for c in cols) for cols in (named, named + [f for f in features if f not in named]))
    return f"""{name}_w AS (SELECT {read}, '1' AS node FROM {points} p
      UNION ALL SELECT {read}, p.node || CASE WHEN {pick} > t.threshold THEN '1' ELSE '0' END
      FROM {name}_w p JOIN {tree} t ON t.set_id = p.set_id AND t.node = p.node WHERE t.feature IS NOT NULL),
    {name} AS (SELECT {own}, t.prediction AS pred FROM {name}_w p JOIN {tree} t ON t.set_id = p.set_id AND t.node = p.node WHERE t.feature IS NULL)"""


_ROWS = "tr AS (SELECT *, 1 AS w, greatest(CAST(ceil(0.005e0 * n) AS BIGINT), 1) AS ml FROM tb)"
RAW = ["val", "zone", "seg", "col"]
_NODES = "SELECT set_id, node AS node_id, CAST(feature AS INT) AS feature, threshold, n, round(prediction, 6) AS prediction, round(gain, 6) AS gain FROM tree"
NODE_SQL = f"RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW)} {_NODES}"


def _nodes_out(nodes):
    return nodes.select("set_id", "node_id", "feature", "threshold", "n", F.round("prediction", 6).alias("prediction"), F.round("gain", 6).alias("gain"))


def _in_bag(spark, d):
    return bags(spark, d).filter("in_bag = 1").withColumn("y", F.col("target"))


def _trees(spark, d, **options):
    return tr.grow(_in_bag(spark, d), RAW, [0, 1], **options)


@query("stem_train", "samples sets", NODE_SQL)
def stem_train(spark, d):
    """Whole trees on raw predictors: no depth cap, leaves of half a percent of the bag or more."""
    return _nodes_out(_trees(spark, d))


@query("stem_train_subset", "samples sets", f"RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW, most=2)} {_NODES}")
def stem_train_subset(spark, d):
    """As ``stem_train``, each node looking at two drawn predictors."""
    return _nodes_out(_trees(spark, d, max_features=2))


@query("stem_train_stump", "samples sets", f"RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', FEATURES)} {_NODES} WHERE node = '1'")
def stem_train_stump(spark, d):
    """Roots of trees on predictors of few values."""
    return _nodes_out(tr.grow(_in_bag(spark, d), FEATURES, [0, 1], max_depth=1)).filter("node_id = '1'")


_IMPORTANCE = ", ".join(f"round(coalesce(sum(gain) FILTER (feature = {i}) / nullif(sum(gain), 0), 0), 6) AS importance_{f}" for i, f in enumerate(RAW))
_OOB = f"""oobp AS (SELECT b.set_id, tp.* FROM bag b JOIN tp ON tp.obs_pt = b.obs_pt WHERE k > floor(n * 0.63e0)),
{leaf_sql("oobp", RAW, columns="set_id, obs_pt, target")},
oob AS (SELECT set_id, count(*) AS n_oob, count(*) FILTER (target = pred) AS hits FROM walk GROUP BY set_id),
oobr AS (SELECT *, CAST(round_even(CAST(100 * hits AS DOUBLE) / n_oob, 0) AS INT) AS oob_rate FROM oob)"""


def _oob(bag, nodes, key=()):
    out = tr.predict(bag.filter("in_bag = 0"), nodes, RAW)
    hit = F.count_if(F.col("target") == F.col("pred"))
    return out.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.bround(100 * hit / F.count(F.lit(1))).cast("int").alias("oob_rate"))


@query("sink_models", "samples sets", f"""RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW)},
{_OOB},
imp AS (SELECT set_id, {_IMPORTANCE}, count(*) AS n_nodes FROM tree GROUP BY set_id)
SELECT imp.*, t.n AS n_samples, o.oob_rate, t.feature AS root_feature, t.threshold AS root_threshold
FROM imp JOIN tree t ON t.set_id = imp.set_id AND t.node = '1' LEFT JOIN oobr o ON o.set_id = imp.set_id""")
def sink_models(spark, d):
    """Trees and their sets (importances, sample counts, out-of-bag rates) written, and read back together."""
    nodes_path, sets_path = scratch_path(spark, "trees"), scratch_path(spark, "sets")
    bag = bags(spark, d)
    tr.grow(bag.filter("in_bag = 1").withColumn("y", F.col("target")), RAW, [0, 1]).write.parquet(nodes_path)
    nodes = spark.read.parquet(nodes_path)
    shares = tr.importances(nodes, RAW).select("set_id", *[F.round(f"importance_{f}", 6).alias(f"importance_{f}") for f in RAW])
    oob = _oob(bag, nodes).select("set_id", "oob_rate")
    fx.sets(spark, d).select("set_id").join(shares, "set_id").join(oob, "set_id", "left").write.parquet(sets_path)
    size = nodes.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    root = nodes.filter("node_id = '1'").select("set_id", F.col("n").alias("n_samples"), F.col("feature").alias("root_feature"), F.col("threshold").alias("root_threshold"))
    return spark.read.parquet(sets_path).join(size, "set_id").join(root, "set_id")


@query("stem_importance", "samples sets", f"RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW)} SELECT set_id, {_IMPORTANCE} FROM tree GROUP BY set_id")
def stem_importance(spark, d):
    return tr.importances(_trees(spark, d), RAW).select("set_id", *[F.round(f"importance_{f}", 6).alias(f"importance_{f}") for f in RAW])


@query("stem_oob", "samples sets", f"""RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW)},
{_OOB} SELECT set_id, n_oob AS n, oob_rate FROM oobr""")
def stem_oob(spark, d):
    bag = bags(spark, d)
    return _oob(bag, tr.grow(bag.filter("in_bag = 1").withColumn("y", F.col("target")), RAW, [0, 1]))


def _pixel_pairs(spark, d):
    """Every pixel with predictors, once per covering set."""
    s = predictors(spark, d)
    covered = j.set_members(s, fx.sets(spark, d), SET)
    return covered.join(s.drop("x", "y"), "obs_pt")


_PIXELS = "pp AS (SELECT m.set_id, tp.* FROM members m JOIN tp ON tp.obs_pt = m.obs_pt)"
_BEST_IMPORTANCE = "CAST(list_position([{0}], list_max([{0}])) - 1 AS INT)".format(", ".join(f"avg(importance_{f})" for f in RAW))


@query("stem_predict", "samples sets", f"""RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW)},
{_OOB},
imp AS (SELECT set_id, {_IMPORTANCE} FROM tree GROUP BY set_id),
{_PIXELS},
{leaf_sql("pp", RAW, name="px", columns="set_id, obs_pt, row, col")},
pc AS (SELECT row, col, CAST(pred AS INT) AS vote, count(*) AS n FROM px GROUP BY ALL),
pv AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, vote) AS r, sum(n) OVER (PARTITION BY row, col) AS t FROM pc),
st AS (SELECT row, col, CAST(round_even(avg(pred), 0) AS INT) AS mean, CAST(round_even(median(pred), 0) AS INT) AS median,
  CAST(round_even(sqrt(CAST(count(*) * sum(pred * pred) - sum(pred) * sum(pred) AS DOUBLE)) / count(*), 0) AS INT) AS stdv,
  CAST(count(*) AS BIGINT) AS count, CAST(round_even(avg(oob_rate), 0) AS INT) AS oob, {_BEST_IMPORTANCE} AS importance
  FROM px JOIN imp USING (set_id) LEFT JOIN oobr USING (set_id) GROUP BY row, col)
SELECT st.*, v.vote, CAST(round_even(CAST(100 * v.n AS DOUBLE) / v.t, 0) AS INT) AS pct_vote FROM st JOIN pv v ON v.row = st.row AND v.col = st.col AND r = 1""")
def stem_predict(spark, d):
    """All eight statistics over the whole trees that cover each pixel."""
    bag = bags(spark, d)
    nodes = materialize(tr.grow(bag.filter("in_bag = 1").withColumn("y", F.col("target")), RAW, [0, 1]), "trees")
    names = [f"importance_{f}" for f in RAW]
    shares = tr.importances(nodes, RAW).select("set_id", *[F.round(c, 6).alias(c) for c in names])
    preds = tr.predict(_pixel_pairs(spark, d).select("set_id", "obs_pt", "row", F.col("col"), "val", "zone", "seg"), nodes, RAW)
    preds = preds.withColumn("pred", F.col("pred").cast("int")).join(shares, "set_id").join(_oob(bag, nodes).select("set_id", "oob_rate"), "set_id", "left")
    return en.aggregate(preds, list(en.AGG_STATS), importances=names)


def _zero_inflated_target():
    """Value with zeros: low balances count as absent."""
    return F.when(F.col("val") < 2000, 0).otherwise(F.floor("val"))


_ZERO = "CASE WHEN val < 2000 THEN 0 ELSE floor(val) END"
_ZFEAT = ["zone", "seg", "col", "bucket"]


@query("zero_inflated_tree", "samples sets", f"""RECURSIVE {BAG},
za AS (SELECT set_id, n, CAST({_ZERO} AS DOUBLE) AS y, zone, seg, col, bucket, 1 AS w, greatest(CAST(ceil(0.005e0 * n) AS BIGINT), 1) AS ml FROM tb),
zc AS (SELECT * REPLACE (CAST((y <> 0)::INT AS DOUBLE) AS y) FROM za),
{tree_sql("zc", _ZFEAT, name="tc")}, {tree_sql("za", _ZFEAT, regress=True, name="tv")},
oobp AS (SELECT b.set_id, tp.*, {_ZERO} AS y FROM bag b JOIN tp ON tp.obs_pt = b.obs_pt WHERE k > floor(n * 0.63e0)),
{leaf_sql("oobp", _ZFEAT, "tc", "wc", "set_id, obs_pt, y")}, {leaf_sql("oobp", _ZFEAT, "tv", "wv", "set_id, obs_pt, y")}
SELECT set_id, obs_pt, CAST(wc.y AS BIGINT) AS y, round(wc.pred * wv.pred, 4) AS pred FROM wc JOIN wv USING (set_id, obs_pt)""")
def zero_inflated_tree(spark, d):
    bag = bags(spark, d).withColumn("y", _zero_inflated_target())
    models = tr.zero_inflated(bag.filter("in_bag = 1"), FEATURES)
    out = tr.predict_zero_inflated(bag.filter("in_bag = 0"), models, FEATURES)
    return out.select("set_id", "obs_pt", F.col("y").cast("bigint").alias("y"), F.round("pred", 4).alias("pred"))


_ONE_BAG = f"""ob AS (SELECT 0 AS set_id, obs_pt, floor(val) AS y, zone, {SEG} AS seg, col, {BUCKET} AS bucket,
  row_number() OVER (ORDER BY md5('bdt|0|' || obs_pt), obs_pt) AS k, count(*) OVER () AS n FROM samples),
oi AS (SELECT CAST(set_id AS BIGINT) AS set_id, y, 1 AS w, 1 AS ml, zone, seg, col, bucket FROM ob WHERE k <= floor(n * 0.63e0)),
oo AS (SELECT * FROM ob WHERE k > floor(n * 0.63e0))"""


@query("bagged_tree", "samples", f"""RECURSIVE {_ONE_BAG}, {tree_sql("oi", _ZFEAT, regress=True)},
{leaf_sql("oo", _ZFEAT, columns="set_id, obs_pt, y")}
SELECT CAST(set_id AS BIGINT) AS set_id, count(*) AS n_oob, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2 FROM walk GROUP BY set_id""")
def bagged_tree(spark, d):
    """One set holding every sample; out-of-bag R-squared of the unlimited regression tree."""
    s = predictors(spark, d).withColumns({"set_id": F.lit(0).cast("long"), "y": F.floor("val")})
    bag = sa.bootstrap(s.select("set_id", "obs_pt"), "bdt").join(s.drop("set_id"), "obs_pt")
    nodes = tr.grow(bag.filter("in_bag = 1"), FEATURES, None, min_leaf=1)
    out = tr.predict(bag.filter("in_bag = 0"), nodes, FEATURES).withColumn("prediction", F.col("pred"))
    y, p = F.col("y").cast("double"), F.col("pred")
    r2 = 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(F.lit(1)))
    return out.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_oob"), F.round(r2, 6).alias("r2"))


_KINDS = "SELECT '{}' AS model_type, set_id, node AS node_id, CAST(feature AS INT) AS feature, threshold, round(prediction, 4) AS prediction, n FROM {}"


@query("model_registry", "samples sets", f"""RECURSIVE {BAG}, {_ROWS},
za AS (SELECT * REPLACE (CAST({_ZERO} AS DOUBLE) AS y) FROM tr),
{tree_sql("tr", _ZFEAT, name="tc")}, {tree_sql("za", _ZFEAT, regress=True, name="tv")}
{_KINDS.format("classifier", "tc")} UNION ALL {_KINDS.format("regressor", "tv")}""")
def model_registry(spark, d):
    bag = bags(spark, d).filter("in_bag = 1")
    classes = tr.trainer("classifier")(bag.withColumn("y", F.col("target")), FEATURES, [0, 1]).withColumn("model_type", F.lit("classifier"))
    values = tr.trainer("regressor")(bag.withColumn("y", _zero_inflated_target()), FEATURES, None).withColumn("model_type", F.lit("regressor"))
    return classes.unionByName(values).select("model_type", "set_id", "node_id", "feature", "threshold", F.round("prediction", 4).alias("prediction"), "n")


#: Trees of a forest by default, of the evaluation, and of the oracle-checked forest.
TREES, MANY, FEW = 50, 500, 3


def _labelled(spark, d, label):
    return predictors(spark, d).withColumn("label", label.cast("double"))


def _with_score(out, label, classes, digits=6):
    """Each row's prediction by all trees and by those that did not see it, with the forest's score on the latter."""
    all_, own = out
    own = own.select("obs_pt", F.round("prediction", digits).alias("oob_prediction"), F.col("n_trees").alias("oob_trees"), F.col("prediction").alias("_p"))
    both = all_.select("obs_pt", label, F.round("prediction", digits).alias("prediction")).join(own, "obs_pt")
    total = fo.score(both.withColumn("prediction", F.col("_p")), label, classes).select(F.round("oob_score", 6).alias("s")).scalar()
    return both.drop("_p").withColumn("oob_score", total)


def _forest(spark, d, label, classes, trees=TREES, **options):
    s = materialize(_labelled(spark, d, label), "labelled")
    nodes = fo.fit(s, "obs_pt", FEATURES, "label", classes, trees, **options)
    return _with_score([fo.apply(nodes, s, "obs_pt", FEATURES, classes, trees, out_of_bag=o) for o in (False, True)], "label", classes)


@query("rf_classifier")
def rf_classifier(spark, d):
    return _forest(spark, d, F.col("target"), [0, 1], max_features=2)


@query("rf_regressor")
def rf_regressor(spark, d):
    return _forest(spark, d, F.floor("val"), None, max_features=2)


_U = "CAST('0x' || substr(md5('forest|' || t.t || '|' || obs_pt), 1, 13) AS UBIGINT) / 4503599627370496e0"
_W = " + ".join(f"({_U} > {step!r})::INT" for step in fo.STEPS)


@query("rf_few_trees", "samples", f"""RECURSIVE fw AS (SELECT CAST(t.t AS BIGINT) AS set_id, obs_pt, CAST(target AS DOUBLE) AS y, {_W} AS w, 1 AS ml, zone, {SEG} AS seg, col, {BUCKET} AS bucket
  FROM samples, range({FEW}) t(t)), fin AS (SELECT * FROM fw WHERE w > 0), fout AS (SELECT * FROM fw WHERE w = 0),
{tree_sql("fin", _ZFEAT, most=2, seed="forest")}, {leaf_sql("fout", _ZFEAT)},
sh AS (SELECT w.set_id, w.obs_pt, CAST(sum(r.w * (r.y = 1)::INT) AS DOUBLE) / sum(r.w) AS p1, CAST(sum(r.w * (r.y = 0)::INT) AS DOUBLE) / sum(r.w) AS p0
  FROM walk_w w JOIN tree t ON t.set_id = w.set_id AND t.node = w.node AND t.feature IS NULL JOIN tree_r r ON r.set_id = w.set_id AND r.node = w.node GROUP BY ALL),
pr AS (SELECT obs_pt, CASE WHEN round(avg(p1), 12) > round(avg(p0), 12) THEN 1e0 ELSE 0e0 END AS prediction, count(*) AS n_trees FROM sh GROUP BY obs_pt)
SELECT s.obs_pt, prediction, coalesce(n_trees, 0) AS n_trees FROM samples s LEFT JOIN pr USING (obs_pt)""")
def rf_few_trees(spark, d):
    """Out-of-bag predictions of a forest small enough to be grown again in SQL."""
    s = _labelled(spark, d, F.col("target"))
    nodes = fo.fit(s, "obs_pt", FEATURES, "label", [0, 1], FEW, max_features=2)
    return fo.apply(nodes, s.select("obs_pt", *FEATURES), "obs_pt", FEATURES, [0, 1], FEW, out_of_bag=True).select("obs_pt", "prediction", "n_trees")


@query("rf_zero_inflated")
def rf_zero_inflated(spark, d):
    s = materialize(_labelled(spark, d, _zero_inflated_target()), "labelled")
    models = fo.fit_zero_inflated(s, "obs_pt", FEATURES, "label", TREES)
    return _with_score([fo.apply_zero_inflated(models, s, "obs_pt", FEATURES, TREES, out_of_bag=o) for o in (False, True)], "label", None, 4)


@query("rf_evaluate")
def rf_evaluate(spark, d):
    s = materialize(sa.holdout(_labelled(spark, d, F.col("target")), "obs_pt", "ho"), "labelled")
    nodes = fo.fit(s.filter("split = 'train'"), "obs_pt", FEATURES, "label", [0, 1], MANY, max_features=4)
    out = fo.apply(nodes, s.filter("split = 'test'"), "obs_pt", FEATURES, [0, 1], MANY)
    report = ac.classification_report(ac.pair_counts(out, "label", "prediction"))
    return report.select("stat", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "model_accuracy")], "support")


@query("grid_search")
def grid_search(spark, d):
    """Two by two pairs of five trees on three folds; see the README for the time of the full grid."""
    folded = sa.folds(_labelled(spark, d, F.col("target")), "obs_pt", by=["target"]).withColumn("fold", F.col("fold") - 1)
    out = fo.grid_search(folded, "obs_pt", FEATURES, "label", [0, 1], "fold", [2, 4], [1, 5], trees=5)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_accuracy", "std_accuracy")})


@query("model_predict", "samples sets", f"""RECURSIVE {BAG}, {_ROWS}, {tree_sql('tr', RAW)}, {_PIXELS},
{leaf_sql("pp", RAW, name="px", columns="set_id, obs_pt, row, col")} SELECT set_id, obs_pt, row, col, pred FROM px""")
def model_predict(spark, d):
    """Stored trees applied to every pixel that their sets cover."""
    path = scratch_path(spark, "trees")
    _trees(spark, d).write.parquet(path)
    pairs = _pixel_pairs(spark, d).select("set_id", "obs_pt", "row", "col", "val", "zone", "seg")
    return tr.predict(pairs, spark.read.parquet(path), RAW).select("set_id", "obs_pt", "row", "col", "pred")
