"""Forests against plain recursive ones on small tables with repeated and missing keys, labels and predictors."""

import hashlib
import math
import random
import sys

import pytest

from rasterloom.operators import forests as fo, trees as tr

FEATURES = ["f0", "f1", "f2"]
TREES = 6
#: Rows a task finishes, nodes it walks, rows of a block: as they are, and so small that the other paths run.
SIZES = [(200_000, 2_000_000, 16_384), (12, 1, 20)]


def _table(regress=False, n=150):
    """(k, label, predictors): keys of several lengths, some of them twice or NULL, and labels that are NULL."""
    r = random.Random(11)
    out = []
    for i in range(n):
        x = [r.randint(0, 3), r.randint(0, 4), int(r.random() < 0.1)]
        y = x[0] * 10 + x[1] + r.randint(0, 3) if regress else int(x[0] + x[1] + r.randint(0, 2) > 4) + x[2]
        out.append((None if i % 29 == 7 else i // 2 if i % 10 == 1 else 7 * i, None if i % 31 == 3 else y, *x))
    return out


def _frame(spark, data):
    return spark.createDataFrame(data, "k long, label int, f0 int, f1 int, f2 int")


def _weight(seed, tree, key):
    u = int(hashlib.md5(f"{seed}|{tree}|{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return sum(u > s for s in fo.STEPS)


def _grow(rows, classes, leaf, seed, tree, most, name="1"):
    """Nested (feature, threshold, left, right), leaves are lists of class shares or of the mean."""
    n = sum(w for w, *_ in rows)

    def part(some):
        m = sum(w for w, *_ in some)
        return sum(w * y for w, y, *_ in some) ** 2 / m if classes is None else sum(sum(w for w, y, *_ in some if y == c) ** 2 for c in classes) / m

    best = None
    for f in tr.drawn(seed, tree, name, len(FEATURES), most):
        values = sorted({r[2 + f] for r in rows})
        for a, b in zip(values, values[1:]):
            left, right = [r for r in rows if r[2 + f] <= a], [r for r in rows if r[2 + f] > a]
            if min(sum(r[0] for r in left), sum(r[0] for r in right)) >= leaf:
                gain = part(left) + part(right)
                if gain - part(rows) > 1e-9 * max(abs(part(rows)), 1) and (best is None or gain > best[0]):
                    best = (gain, f, (a + b) / 2, left, right)
    if best is None:
        return [sum(w * y for w, y, *_ in rows) / n] if classes is None else [sum(w for w, y, *_ in rows if y == c) / n for c in classes]
    _, f, cut, left, right = best
    return f, cut, *(_grow(some, classes, leaf, seed, tree, most, name + side) for some, side in ((left, "0"), (right, "1")))


def _leaf(node, x):
    while isinstance(node, tuple):
        node = node[2 + (x[node[0]] > node[1])]
    return node


def _forest(data, classes, leaf=1, seed="forest", most=None):
    """Trees by number; those that saw a row without all predictors are missing."""
    out = {}
    for t in range(TREES):
        bag = [(_weight(seed, t, k), y, *x) for k, y, *x in data if k is not None and y is not None]
        bag = [b for b in bag if b[0]]
        if all(None not in b for b in bag):
            out[t] = _grow(bag, classes, leaf, seed, t, most)
    return out


def _asked(answer, data, out_of_bag, seed="forest"):
    """By key, the mean of ``answer(tree, predictors)`` over rows and trees, and the number of answers."""
    got = {}
    for k, _, *x in data:
        for t in range(TREES if k is not None and None not in x else 0):
            p = None if out_of_bag and _weight(seed, t, k) else answer(t, x)
            if p is not None:
                got.setdefault(k, []).append(p)
    return {k: ([sum(v) / len(ps) for v in zip(*ps)], len(ps)) for k, ps in got.items()}


def _check(out, want, value):
    rows = [(r["k"], r["prediction"], r["n_trees"]) for r in out.collect()]
    for k, p, n in rows:
        if k not in want:
            assert (p, n) == (None, 0)
        else:
            assert n == want[k][1] and p == pytest.approx(value(want[k][0]), abs=1e-9)
    return rows


def _sizes(monkeypatch, sizes):
    monkeypatch.setattr(tr, "FINISH_ROWS", sizes[0])
    monkeypatch.setattr(tr, "PREDICT_NODES", sizes[1])
    monkeypatch.setattr(fo, "BLOCK_ROWS", sizes[2])


def _written(monkeypatch):
    """Rows of each table that growing writes, by name."""
    seen = []
    for module in (tr, fo):

        def noted(df, name="step", real=module.materialize):
            out = real(df, name)
            seen.append((name, out.count()))
            return out

        monkeypatch.setattr(module, "materialize", noted)
    return seen


def test_weights_are_those_of_the_hash():
    for n in (3, 900):
        keys = [str(10**5 + i) for i in range(n)]
        body = fo.np.array([list(k.encode()) for k in keys], fo.np.uint8).T
        assert fo.weights("s", 12, body).tolist() == [_weight("s", 12, k) for k in keys]
    long = "k" * 130  # three blocks of the hash
    assert fo.weights("s", 0, fo.np.array([list(long.encode())] * 500, fo.np.uint8).T).tolist() == [_weight("s", 0, long)] * 500


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("classes", [[0, 1, 2], None])
def test_forest_equals_recursive_trees(spark, monkeypatch, classes, sizes):
    _sizes(monkeypatch, sizes)
    data = _table(regress=classes is None)
    df = _frame(spark, data)
    nodes = fo.fit(df, "k", FEATURES, "label", classes, TREES, max_features=2)
    forest = _forest(data, classes, most=2)
    pick = lambda p: p[0] if classes is None else float(classes[max(range(3), key=lambda i: (round(p[i], 12), -i))])
    for out_of_bag in (False, True):
        out = fo.apply(nodes, df, "k", FEATURES, classes, TREES, out_of_bag=out_of_bag)
        got = _check(out, _asked(lambda t, x: _leaf(forest[t], x), data, out_of_bag), pick)
        assert sorted(k for k, *_ in got if k is not None) == sorted(d[0] for d in data if d[0] is not None)
        assert out.columns == [*df.columns, "prediction", "n_trees"] and len(got) == len(data)


def test_trees_that_saw_a_row_without_a_predictor_are_left_out(spark):
    data = [*_table(), (2, 1, None, 1, 0)]
    df = _frame(spark, data)
    forest = _forest(data, [0, 1, 2])
    assert 0 < len(forest) < TREES
    nodes = fo.fit(df, "k", FEATURES, "label", [0, 1, 2], TREES)
    assert {r[0] for r in nodes.select("set_id").distinct().collect()} == set(forest)
    want = _asked(lambda t, x: _leaf(forest[t], x) if t in forest else None, data, False)
    _check(fo.apply(nodes, df, "k", FEATURES, [0, 1, 2], TREES), want, lambda p: float(max(range(3), key=lambda i: (round(p[i], 12), -i))))
    none = df.limit(0)
    assert fo.fit(none, "k", FEATURES, "label", [0, 1, 2], TREES).count() == 0 == fo.apply(nodes, none, "k", FEATURES, [0, 1, 2], TREES).count()


def test_rows_held_out_are_asked_of_all_trees(spark, monkeypatch):
    """Trees with numbers of one and two digits, on rows that none of them saw; growing writes a row for a tree, not for each of its samples."""
    monkeypatch.setattr(sys.modules[__name__], "TREES", 12)
    seen = _written(monkeypatch)
    train, test = ([d for i, d in enumerate(_table()) if (i % 5 > 0) == side] for side in (True, False))
    nodes = fo.fit(_frame(spark, train), "k", FEATURES, "label", [0, 1, 2], 12, max_features=3)
    assert [n for name, n in seen if name == "bag"] == [12]
    forest = _forest(train, [0, 1, 2])
    got = _check(
        fo.apply(nodes, _frame(spark, test), "k", FEATURES, [0, 1, 2], 12),
        _asked(lambda t, x: _leaf(forest[t], x), test, False),
        lambda p: float(max(range(3), key=lambda i: (round(p[i], 12), -i))),
    )
    assert {n for k, _, n in got if k is not None and sum(d[0] == k for d in test) == 1} == {12}


@pytest.mark.parametrize("sizes", SIZES)
def test_zero_inflated_bags_are_products_tree_by_tree(spark, monkeypatch, sizes):
    _sizes(monkeypatch, sizes)
    data = [(k, None if y is None else max(0, y - 12), *x) for k, y, *x in _table(regress=True)]
    df = _frame(spark, data)
    seen = _written(monkeypatch)
    models = fo.fit_zero_inflated(df, "k", FEATURES, "label", TREES)
    assert sizes != SIZES[0] or [n for name, n in seen if name == "bag"] == [TREES, TREES]
    some, value = _forest([(k, None if y is None else int(y != 0), *x) for k, y, *x in data], [0, 1]), _forest(data, None)
    some_of = lambda p: float(p[1] > p[0])
    for out_of_bag in (False, True):
        want = _asked(lambda t, x: [some_of(_leaf(some[t], x)) * _leaf(value[t], x)[0]], data, out_of_bag)
        _check(fo.apply_zero_inflated(models, df, "k", FEATURES, TREES, out_of_bag=out_of_bag), want, lambda p: p[0])


@pytest.mark.parametrize("classes", [[0, 1, 2], None])
def test_bags_hold_equal_predictors_once(spark, monkeypatch, classes):
    """A row for a tree and block, not for a tree and sample, goes to growing; a crowd of equal rows is dealt to several blocks."""
    seen = _written(monkeypatch)
    df = _frame(spark, _table(regress=classes is None, n=600))
    nodes = fo.fit(df, "k", FEATURES, "label", classes, TREES)
    assert [n for name, n in seen if name == "bag"] == [TREES]
    kept = fo._bags_of(df, "k", FEATURES, "label", classes, TREES, "forest").collect()
    assert max(r["cells"] for r in kept) <= 4 * 5 * 2 and sum(r["weight"] for r in kept) == nodes.filter("node_id = '1'").groupBy().sum("n").first()[0]
    monkeypatch.setattr(fo, "BLOCK_ROWS", 10)
    crowd = _frame(spark, [(i, 1, 0, 0, 0) for i in range(200)])
    sizes = [len(r["keys"]) for r in fo.pack(crowd, "k", FEATURES, 1, "label").collect()]
    assert sum(sizes) == 200 and max(sizes) < 60


def test_regression_nodes_go_out_without_lists(spark):
    """A column of NULL lists takes square time on its way to Python; leaves of a regressor need none."""
    df = _frame(spark, _table(regress=True))
    nodes = fo.fit(df, "k", FEATURES, "label", None, TREES)
    plan = fo.apply(nodes, df, "k", FEATURES, None, TREES)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("FlatMapCoGroups" in step for step in plan)
    assert not [step for step in plan if "shares" in step and "Relation" not in step]


def test_grid_shares_the_bags_of_a_fold(spark, monkeypatch):
    data = [(*d, i % 3) for i, d in enumerate(_table())]
    df = spark.createDataFrame(data, "k long, label int, f0 int, f1 int, f2 int, fold int")
    seen = _written(monkeypatch)
    got = fo.grid_search(df, "k", FEATURES, "label", [0, 1, 2], "fold", [1, 3], [1, 4], trees=TREES).collect()
    assert [name for name, _ in seen].count("bag") == 3
    want = []
    for most in (1, 3):
        for leaf in (1, 4):
            scores = []
            for fold in range(3):
                train, test = ([d[:5] for d in data if (d[5] != fold) == side] for side in (True, False))
                forest = _forest(train, [0, 1, 2], leaf, f"grid{fold}", most)
                asked = _asked(lambda t, x: _leaf(forest[t], x), test, False)
                hits = [y == max(range(3), key=lambda i: (round(asked[k][0][i], 12), -i)) for k, y, *_ in test if k in asked and y is not None]
                scores.append(sum(hits) / len(hits))
            mean = sum(scores) / 3
            want.append((most, leaf, mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / 3)))
    order = sorted(range(4), key=lambda i: (-want[i][2], i))
    assert [r["rank"] for r in got] == [1, 2, 3, 4]
    for r, i in zip(got, order):
        assert tuple(r)[:2] == want[i][:2] and tuple(r)[2:4] == pytest.approx(want[i][2:])
