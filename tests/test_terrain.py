"""Stencils, drainage, regions and nearest streams against brute force on small irregular grids."""

import random

from helpers import rows
from pyspark.sql import functions as F

from rasterloom.operators import regions as rg, terrain as tr
from rasterloom.operators.joins import KERNEL, stencil


def _grid(n_rows, n_cols, seed, holes=0.1, values=None):
    r = random.Random(seed)
    return {(i, j): float(r.choice(values)) if values else r.uniform(0, 100) for i in range(n_rows) for j in range(n_cols) if r.random() > holes}


def _df(spark, grid, name="z"):
    return spark.createDataFrame([(i, j, v) for (i, j), v in grid.items()], f"row int, col int, {name} double")


def test_stencil_across_blocks_and_holes(spark):
    grid = _grid(9, 11, 1, holes=0.3)
    got = rows(stencil(_df(spark, grid), "z", block=4), "row", "col", *[f"k{i}" for i in range(1, 10)])
    assert got == sorted((r, c, *[grid.get((r + dr, c + dc)) for dr, dc in KERNEL]) for r, c in grid)


def test_stencil_shuffles_once(spark):
    plan = stencil(_df(spark, _grid(4, 4, 1)), "z")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def _flow(grid):
    out = {}
    for (r, c), z in grid.items():
        best = (0.0, 0, 0)
        for code, dr, dc in tr.D8:
            n = grid.get((r + dr, c + dc))
            if n is not None:
                drop = (z - n) / (1.0 if 0 in (dr, dc) else 2.0**0.5)
                if drop > best[0]:
                    best = (drop, dr, dc)
        out[(r, c)] = (r + best[1], c + best[2])
    return out


def test_watershed(spark):
    grid = _grid(14, 12, 2)
    flow = _flow(grid)
    low = sorted(grid, key=grid.get)[:3]
    want = []
    for cell in grid:
        at, seen = cell, 0
        while at not in low and flow[at] != at:
            at = flow[at]
        if at in low:
            want.append((*cell, *at))
    pour = spark.createDataFrame(low, "row int, col int")
    assert rows(tr.watershed(tr.downstream(tr.flow_direction(_df(spark, grid))), pour)) == sorted(want)


def test_long_path_drains(spark):
    n = 70
    path = {(0, c): float(n - c) for c in range(n)}
    got = tr.watershed(tr.downstream(tr.flow_direction(_df(spark, path))), spark.createDataFrame([(0, n - 1)], "row int, col int"))
    assert got.count() == n


def test_regions_across_blocks(spark):
    grid = _grid(17, 15, 3, holes=0.05, values=[0, 1])
    label, stack = {}, []
    for start in sorted(grid):
        if start in label:
            continue
        stack, label[start] = [start], start
        while stack:
            r, c = stack.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in grid and n not in label and grid[n] == grid[(r, c)]:
                    label[n] = start
                    stack.append(n)
    got = rg.regions(_df(spark, grid, "v"), "v", block=5)
    assert rows(got, "row", "col", "region") == sorted((r, c, a * rg.WIDTH + b) for (r, c), (a, b) in label.items())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1001, 1060)] + [(7, 7)]
    got = rows(rg.connected_components(spark.createDataFrame(edges, "u long, v long")))
    assert got == [(i, 100) for i in range(100, 141)] + [(i, 1000) for i in range(1000, 1060)]


def test_nearest_stream_far_and_near(spark):
    r = random.Random(6)
    cells = {(i, j): float(r.randint(0, 50)) for i in range(30) for j in range(60)}
    # Streams only on the left edge and one in a far corner, so most cells need several rounds.
    streams = [(i, j) for i in range(30) for j in range(4) if r.random() < 0.6] + [(29, 59)]
    want = []
    for r0, c0 in cells:
        d2, sr, sc = min(((r0 - a) ** 2 + (c0 - b) ** 2, a, b) for a, b in streams)
        want.append((r0, c0, d2, sr, sc))
    st = _df(spark, {s: cells[s] for s in streams})
    got = rows(tr.nearest_stream(_df(spark, cells), st, first_radius=2), "row", "col", "d2", "s_row", "s_col")
    assert got == sorted(want)


def test_plane_has_constant_slope_and_no_curvature(spark):
    plane = {(i, j): 3.0 * j for i in range(5) for j in range(5)}
    inner = tr.derivatives(_df(spark, plane), 3.0).filter("slope IS NOT NULL")
    assert rows(inner.select(F.round("slope", 9), F.round("aspect", 9), F.round("curvature", 9)).distinct()) == [(45.0, 270.0, 0.0)]
    assert inner.count() == 9


def test_cubic_reproduces_linear_surface(spark):
    grid = {(i, j): 2.0 * i + j for i in range(12) for j in range(12)}
    out = tr.resample_cubic(_df(spark, grid), "z", 2.0).filter("row BETWEEN 1 AND 4 AND col BETWEEN 1 AND 4")
    bad = out.filter(F.abs(F.col("z") - (2 * (F.col("row") * 2 + 0.5) + F.col("col") * 2 + 0.5)) > 1e-9)
    assert out.count() == 16 and bad.isEmpty()
