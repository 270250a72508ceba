"""Level-wise trees against a plain recursive version on small bags."""

import math
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from rasterloom.operators import trees as tr

FEATURES = ["f0", "f1", "f2"]


def _bag(regress=False):
    r = random.Random(8)
    out = []
    for s in range(3):
        for _ in range(60 + 40 * s):
            x = [r.randint(0, 9) for _ in FEATURES]
            y = x[0] * 3 + x[1] if regress else int(x[0] + x[1] > 9) + int(x[2] > 7)
            out.append((s, y, *x))
    return out


def _measure(ys, classes):
    n = len(ys)
    return sum(ys) ** 2 / n if classes is None else sum(sum(y == c for y in ys) ** 2 for c in classes) / n


def _grow(data, classes, depth, leaf, node=1, out=None):
    out = {} if out is None else out
    ys = [d[0] for d in data]
    best = None
    if depth:
        for f in range(len(FEATURES)):
            for b in sorted({d[1 + f] for d in data}):
                left, right = [d for d in data if d[1 + f] <= b], [d for d in data if d[1 + f] > b]
                if len(left) >= leaf and len(right) >= leaf:
                    s = _measure([d[0] for d in left], classes) + _measure([d[0] for d in right], classes)
                    whole = _measure(ys, classes)
                    if s - whole > 1e-9 * max(abs(whole), 1) and (best is None or s > best[0] + 1e-9):
                        best = (s, f, b, left, right)
    pred = sum(ys) / len(ys) if classes is None else float(min(classes, key=lambda c: (-sum(y == c for y in ys), c)))
    out[node] = (best[1] if best else None, best[2] if best else None, round(pred, 6), len(ys))
    if best:
        _grow(best[3], classes, depth - 1, leaf, 2 * node, out)
        _grow(best[4], classes, depth - 1, leaf, 2 * node + 1, out)
    return out


def _frame(spark, data):
    return spark.createDataFrame(data, "set_id long, y int, f0 int, f1 int, f2 int")


def _found(nodes):
    """By set and heap number (a path read as binary): feature, the value below the threshold, prediction, size."""
    return {
        (r["set_id"], int(r["node_id"], 2)): (r["feature"], None if r["threshold"] is None else r["threshold"], round(r["prediction"], 6), r["n"])
        for r in nodes.collect()
    }


def _same(got, want):
    """Thresholds lie halfway to the next value, at or above the last value that goes left."""
    assert got.keys() == want.keys()
    for k, (f, t, p, n) in got.items():
        assert (f, p, n) == (want[k][0], *want[k][2:])
        assert f is None or want[k][1] <= t < want[k][1] + 10


@pytest.mark.parametrize("finish", [200_000, 20, 1])
@pytest.mark.parametrize("classes", [[0, 1, 2], None])
def test_grow_equals_recursive_trees(spark, monkeypatch, classes, finish):
    """Whether a task finishes the trees or aggregations split their top levels or all."""
    monkeypatch.setattr(tr, "FINISH_ROWS", finish)
    data = _bag(regress=classes is None)
    nodes = tr.grow(_frame(spark, data), FEATURES, classes, max_depth=3, min_leaf=0.05)
    want = {}
    for s in range(3):
        part = [d[1:] for d in data if d[0] == s]
        want |= {(s, k): v for k, v in _grow(part, classes, 3, math.ceil(0.05 * len(part))).items()}
    _same(_found(nodes), want)


@pytest.mark.parametrize("classes", [[0, 1], None])
def test_deep_trees_on_continuous_predictors(spark, classes):
    """Depth 12 and no cap, on values that are all different."""
    r = random.Random(3)
    data = [(0, (r.randint(0, 1) if classes else r.randint(0, 900)), *[r.random() for _ in FEATURES]) for _ in range(400)]
    df = spark.createDataFrame(data, "set_id long, y int, f0 double, f1 double, f2 double")
    for depth in (12, 99):
        want = {(0, k): v for k, v in _grow([d[1:] for d in data], classes, depth, 1).items()}
        got = _found(tr.grow(df, FEATURES, classes, max_depth=None if depth == 99 else depth, min_leaf=1))
        _same(got, want)
        values = sorted({d[2 + f] for d in data for f in range(3)})
        assert max(len(bin(k)) for _, k in got) > 12 and len(values) > 1000
    if classes:
        assert all(p in (0.0, 1.0) for f, _, p, _ in got.values() if f is None)


def test_sets_with_nulls_and_weights(spark):
    data = [(0, 1, 1, 1, 1), (0, 0, 2, 2, 2), (1, 1, None, 1, 1), (1, 0, 2, 2, 2), (2, None, 1, 1, 1)]
    assert {r["set_id"] for r in tr.grow(_frame(spark, data), FEATURES, [0, 1]).collect()} == {0}
    rows_w = spark.createDataFrame([(0, 1, 1, 2), (0, 0, 2, 0), (0, 0, 3, 5)], "set_id long, y int, f0 int, w int")
    got = sorted((r["node_id"], r["n"], r["threshold"], r["shares"]) for r in tr.grow(rows_w, ["f0"], [0, 1], min_leaf=1).collect())
    assert got == [("1", 7, 2.0, [5 / 7, 2 / 7]), ("10", 2, None, [0.0, 1.0]), ("11", 5, None, [1.0, 0.0])]
    assert tr.grow(_frame(spark, data).limit(0), FEATURES, None).count() == 0


@pytest.mark.parametrize("finish", [200_000, 30])
def test_drawn_features(spark, monkeypatch, finish):
    """Each node splits on the drawn feature, whichever phase splits it."""
    monkeypatch.setattr(tr, "FINISH_ROWS", finish)
    nodes = tr.grow(_frame(spark, _bag()), FEATURES, [0, 1, 2], max_features=1, seed="s").collect()
    inner = [r for r in nodes if r["feature"] is not None]
    assert inner and all([r["feature"]] == tr.drawn("s", r["set_id"], r["node_id"], 3, 1) for r in inner)
    assert len({r["feature"] for r in inner}) == 3


@pytest.mark.parametrize("held", [2_000_000, 1])
def test_predict_walks_to_the_leaf(spark, monkeypatch, held):
    monkeypatch.setattr(tr, "PREDICT_NODES", held)
    monkeypatch.setattr(tr, "PREDICT_ROWS", 25)
    data = _bag()
    nodes = tr.grow(_frame(spark, data), FEATURES, [0, 1, 2], max_depth=3)
    want = []
    for s in range(3):
        part = [d[1:] for d in data if d[0] == s]
        tree = _grow(part, [0, 1, 2], 3, math.ceil(0.005 * len(part)))
        for d in part:
            k = 1
            while tree[k][0] is not None:
                k = 2 * k + (d[1 + tree[k][0]] > tree[k][1])
            want.append((s, *d, tree[k][2]))
    assert rows(tr.predict(_frame(spark, data), nodes, FEATURES), "set_id", "y", *FEATURES, "pred") == sorted(want)
    odd = _frame(spark, [(0, 1, None, 1, 1), (9, 1, 1, 1, 1)])
    assert [tuple(r) for r in tr.predict(odd, nodes, FEATURES).select("set_id", "pred").collect()] == [(0, None)]


def test_importances_add_up(spark):
    nodes = tr.grow(spark.createDataFrame(_bag(), "set_id long, y int, f0 int, f1 int, f2 int"), FEATURES, [0, 1, 2], max_depth=3)
    imp = tr.importances(nodes, FEATURES)
    assert all(sum(r[1:]) == pytest.approx(1.0) for r in imp.collect())


def test_zero_inflated_is_a_product(spark):
    r = random.Random(9)
    data = [(0, 0 if x < 5 else 100 + x, x, r.randint(0, 9), 0) for x in [r.randint(0, 9) for _ in range(200)]]
    df = spark.createDataFrame(data, "set_id long, y int, f0 int, f1 int, f2 int")
    out = tr.predict_zero_inflated(df, tr.zero_inflated(df, FEATURES, max_depth=4), FEATURES)
    assert out.filter("y = 0 AND pred <> 0").isEmpty()
    assert out.filter("y > 0").select(F.max(F.abs(F.col("y") - F.col("pred")))).first()[0] < 1e-6


def test_trainer_names():
    with pytest.raises(ValueError, match="zero_inflated"):
        tr.trainer("boosted")
