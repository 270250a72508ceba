"""Compositing and segmentation against brute force and known shapes."""

import math
import random
import statistics

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from rasterloom.operators import composite as cp, segmentation as sg

BANDS = ["b1", "b2"]


def _obs():
    r = random.Random(3)
    out = []
    for i in range(400):
        px = 0 if r.random() < 0.5 else r.randint(1, 5)
        out.append((px, 0, 2000 + r.randint(0, 1), i % 97, r.randint(1, 300), r.randint(0, 20), r.randint(0, 20)))
    return out + out[:40]


def _medoid(data):
    groups = {}
    for row, col, yr, ts, doy, *b in data:
        groups.setdefault((row, col, yr), []).append((ts, *b))
    out = []
    for k, g in groups.items():
        mids = [statistics.median(x[i + 1] for x in g) for i in range(2)]
        best = min(g, key=lambda x: (sum((x[i + 1] - mids[i]) ** 2 for i in range(2)), x[0], *x[1:]))
        out.append((*k, *best[1:]))
    return sorted(out)


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(_obs(), "row int, col int, yr int, ts int, doy int, b1 int, b2 int")


@pytest.mark.parametrize("per_task", [1_000_000, 60, 5])
def test_medoid_with_and_without_hot_pixels(obs, per_task):
    assert rows(cp.medoid(obs, BANDS, rows_per_task=per_task)) == _medoid(_obs())


def test_target_day(obs):
    groups = {}
    for row, col, yr, ts, doy, *b in _obs():
        groups.setdefault((row, col, yr), []).append((abs(doy - 150), ts, *b))
    assert rows(cp.target_day(obs, 150, BANDS)) == sorted((*k, *min(g)[2:]) for k, g in groups.items())


def test_missing_years_are_present(spark):
    comp = spark.createDataFrame([(0, 0, 2001, 5)], "row int, col int, yr int, b1 int")
    px = spark.createDataFrame([(0, 0)], "row int, col int")
    got = rows(cp.annual_series(comp, px, 2000, 2002).withColumn("stamp", F.col("stamp").cast("string")), "yr", "b1", "stamp")
    assert got == [(2000, None, "2000-08-01"), (2001, 5, "2001-08-01"), (2002, None, "2002-08-01")]


def test_fit_between_vertices_rounds_half_even(spark):
    s = spark.createDataFrame([(0, 0, y, v, k) for y, v, k in [(1, 0, True), (2, 9, False), (3, 5, True), (4, 1, False)]], "row int, col int, yr int, v int, k boolean")
    assert rows(cp.fit_between_vertices(s, "v", "k"), "yr", "fitted") == [(1, 0), (2, 2), (3, 5), (4, 5)]


def test_vertex_stack_pads_and_flips(spark):
    s = spark.createDataFrame([(0, 0, 2000, 5, 6, True), (0, 0, 2001, 1, 2, False), (0, 0, 2002, 7, 8, True)], "row int, col int, yr int, raw int, ftv int, is_vertex boolean")
    got = cp.vertex_stack(s, 2, flip=-1).first().asDict()
    assert [got[f"year_vert{i}"] for i in (1, 2, 3)] == [2000, 2002, 0]
    assert [got[f"raw_vert{i}"] for i in (1, 2, 3)] == [-5, -7, 0] and got["ftv_vert2"] == -8


def _series(spark, shapes):
    data = [(i, 0, 1990 + t, float(v)) for i, values in enumerate(shapes) for t, v in enumerate(values)]
    return spark.createDataFrame(data, "row int, col int, yr int, v double")


def test_segmentation_recovers_breaks(spark):
    flat_then_step = [100] * 8 + [500] + [500 - 10 * i for i in range(1, 12)]
    ramp = [5 * i for i in range(20)]
    r = random.Random(4)
    noise = [r.choice([-1, 1]) * r.random() for _ in range(20)]
    short = [1, 2, 3]
    out = sg.segment(_series(spark, [flat_then_step, ramp, noise, short]), "v", sg.Params(max_segments=4))
    got = {k: sorted(r["yr"] - 1990 for r in out.filter((F.col("row") == k) & F.col("is_vertex")).collect()) for k in range(4)}
    assert got[0] == [0, 7, 8, 19]
    assert got[1] == [0, 19]
    assert got[2] == [0, 19] and got[3] == []
    worst = out.filter("row < 2").select(F.max(F.abs(F.col("raw") - F.col("fitted")))).first()[0]
    assert worst < 1e-6
    assert out.filter("row = 2").select(F.count_distinct(F.round("fitted", 9))).first()[0] == 1


def test_one_year_recovery_is_refused(spark):
    # A rise that undoes itself within a year is no recovery segment the method accepts.
    shape = [0.0] * 8 + [300.0, 300.0] + [0.0] * 10
    out = sg.segment(_series(spark, [shape]), "v", sg.Params(max_segments=5))
    years = sorted(r["yr"] - 1990 for r in out.filter("is_vertex").collect())
    assert not ({9, 10} <= set(years))


def test_p_of_f_known_values():
    import pandas as pd

    got = sg._p_of_f(pd.Series([4.964603, 1.0, 0.0, 7.708647]), pd.Series([1.0, 5, 3, 1]), pd.Series([10.0, 5, 9, 4]))
    assert got.tolist() == pytest.approx([0.05, 0.5, 1.0, 0.05], abs=1e-5)


def _plain_segment(years, raw, p):
    """One pixel by loops: the twin of the array kernels."""
    n = len(raw)
    v = list(raw)
    for i in range(1, n - 1):
        size = max(abs(raw[i] - raw[i - 1]), abs(raw[i] - raw[i + 1]))
        if size and 1 - abs(raw[i + 1] - raw[i - 1]) / size > p.spike_threshold:
            v[i] = (raw[i - 1] + raw[i + 1]) / 2

    def line(marks):
        out = list(v)
        for a, b in zip(marks, marks[1:]):
            for i in range(a + 1, b):
                out[i] = v[a] + (v[b] - v[a]) * (years[i] - years[a]) / (years[b] - years[a])
        return out

    marks = [0, n - 1]
    for _ in range(p.max_segments - 1 + p.vertex_overshoot):
        fit = line(marks)
        off = [0 if i in marks else abs(v[i] - fit[i]) for i in range(n)]
        if max(off) <= 0:
            break
        marks = sorted([*marks, off.index(max(off))])
    models, tall, wide = {}, max(max(v) - min(v), 1e-9), years[-1] - years[0]
    while True:
        models[len(marks) - 1] = list(marks)
        if len(marks) == 2:
            break
        slope = lambda a, b: math.atan((v[b] - v[a]) / tall / ((years[b] - years[a]) / wide))
        bends = [abs(slope(b, c) - slope(a, b)) for a, b, c in zip(marks, marks[1:], marks[2:])]
        marks = [m for i, m in enumerate(marks) if i != bends.index(min(bends)) + 1]
    mean, scored = sum(v) / n, {}
    sst = sum((x - mean) ** 2 for x in v)
    for k, marks in models.items():
        if k > p.max_segments or n - k - 1 <= 0:
            continue
        fit, end = [0.0] * n, None
        for a, b in zip(marks, marks[1:]):
            part = range(a, b + 1)
            if end is None:
                mt, mv = sum(years[i] for i in part) / len(part), sum(v[i] for i in part) / len(part)
                slope = sum((years[i] - mt) * (v[i] - mv) for i in part) / sum((years[i] - mt) ** 2 for i in part)
                at = lambda t, mt=mt, mv=mv, slope=slope: mv + slope * (t - mt)
            else:
                slope = sum((years[i] - years[a]) * (v[i] - end) for i in part) / sum((years[i] - years[a]) ** 2 for i in part)
                at = lambda t, t0=years[a], end=end, slope=slope: end + slope * (t - t0)
                part = range(a + 1, b + 1)
            for i in part:
                fit[i] = at(years[i])
            end = at(years[b])
        other = line(marks)
        sse = [sum((x - y) ** 2 for x, y in zip(v, f)) for f in (other, fit)]
        fit, sse = (other, sse[0]) if sse[0] <= sse[1] else (fit, sse[1])
        falls = [(fit[a] - fit[b], years[b] - years[a]) for a, b in zip(marks, marks[1:])]
        bad = max(max(f, 0) / g for f, g in falls) > p.recovery_threshold * (max(v) - min(v)) or p.prevent_one_year_recovery and any(f > 0 and g == 1 for f, g in falls)
        if bad and k > 1:
            continue
        if sse <= 1e-9 * max(sst, 1):
            chance = 0.0 if sst > 0 else 1.0
        else:
            chance = float(sg._p_of_f(np.array([(sst - sse) / k / (sse / (n - k - 1))]), np.array([float(k)]), np.array([float(n - k - 1)]))[0])
        scored[k] = (chance, fit, marks)
    best = min(c for c, _, _ in scored.values())
    good = [k for k, (c, _, _) in scored.items() if c <= (2 - p.best_model_proportion) * best and c <= p.pval_threshold]
    return (scored[max(good)][1], scored[max(good)][2]) if good else ([mean] * n, [0, n - 1])


def test_segmentation_equals_plain_loops(spark):
    """Series of 6 to 20 years with gaps at the method's defaults."""
    r = random.Random(12)
    p, data, want = sg.Params(), [], {}
    for i in range(120):
        years = sorted(r.sample(range(1984, 2012), r.randint(6, 20)))
        level, raw = 500.0, []
        for _ in years:
            level += r.choice([0, 0, 0, 5, -4, 300, -60]) + r.uniform(-3, 3)
            raw.append(round(level, 3))
        data += [(i, 0, y, x) for y, x in zip(years, raw)]
        fit, marks = _plain_segment([float(y) for y in years], raw, p)
        want |= {(i, y): (f, k in marks) for k, (y, f) in enumerate(zip(years, fit))}
    got = {(g["row"], g["yr"]): (g["fitted"], g["is_vertex"]) for g in sg.segment(spark.createDataFrame(data, "row int, col int, yr int, v double"), "v", p).collect()}
    assert got.keys() == want.keys()
    for k, (f, mark) in want.items():
        assert abs(got[k][0] - f) < 1e-6 and got[k][1] == mark, k
