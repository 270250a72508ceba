"""Range joins against brute force, including edges and very large rectangles."""

import random

from helpers import rows
from pyspark.sql import functions as F

from rasterloom.operators.joins import last_overlap, nearest_value
from rasterloom.operators.polygons import points_in_polygons
from rasterloom.operators.overlap import boxes_overlap, points_in_boxes

BOX = "id long, ul_x double, ul_y double, lr_x double, lr_y double"


def _boxes(n, seed, big=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(-50, 50), r.randint(-50, 50)
        w, h = (r.choice([5, 10, 40, 3000 if big else 20]), r.choice([5, 10, 30]))
        out.append((i, float(x), float(y + h), float(x + w), float(y)))
    return out


def _points(n, seed):
    r = random.Random(seed)
    return [(i, float(r.randint(-60, 60)), float(r.randint(-60, 60))) for i in range(n)]


def test_points_in_boxes(spark):
    boxes, points = _boxes(40, 1, big=True), _points(200, 2)
    b, p = spark.createDataFrame(boxes, BOX), spark.createDataFrame(points, "pt long, x double, y double")
    for closed, inside in (
        ("half", lambda x, y, b: b[1] <= x < b[3] and b[4] < y <= b[2]),
        ("open", lambda x, y, b: b[1] < x < b[3] and b[4] < y < b[2]),
    ):
        want = sorted((pt, q[0]) for pt, x, y in points for q in boxes if inside(x, y, q))
        assert rows(points_in_boxes(p, b, 10.0, closed), "p_pt", "b_id") == want


def test_shared_edges_belong_to_one_box(spark):
    grid = [(i * 2 + j, i * 10.0, 20.0 - j * 10, i * 10.0 + 10, 10.0 - j * 10) for i in range(2) for j in range(2)]
    pts = [(n, float(x), float(y)) for n, (x, y) in enumerate([(10, 10), (0, 20), (5, 10), (10, 5)])]
    hit = points_in_boxes(spark.createDataFrame(pts, "pt long, x double, y double"), spark.createDataFrame(grid, BOX), 10.0)
    assert [r[0] for r in rows(hit.groupBy("p_pt").count(), "count")] == [1, 1, 1, 1]


def test_boxes_overlap(spark):
    a, b = _boxes(60, 3, big=True), _boxes(50, 4)
    A, B = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    for touching in (False, True):
        def meet(p, q):
            lx, hx, ly, hy = max(p[1], q[1]), min(p[3], q[3]), max(p[4], q[4]), min(p[2], q[2])
            return (lx <= hx and ly <= hy) if touching else (lx < hx and ly < hy)

        want = sorted((p[0], q[0]) for p in a for q in b if meet(p, q))
        assert rows(boxes_overlap(A, B, 7.0, touching), "l_id", "r_id") == want


def test_no_nested_loop_join(spark):
    # Both sides too large for a broadcast must still meet by an equi-join.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit = boxes_overlap(spark.createDataFrame(_boxes(5, 1), BOX), spark.createDataFrame(_boxes(5, 2), BOX), 7.0)
        plan = hit._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_last_overlap_wins(spark):
    storage = spark.createDataFrame([(1, 0.0, 10.0, 10.0, 0.0), (2, 500.0, 510.0, 510.0, 500.0)], BOX)
    proc = spark.createDataFrame([(3, 0.0, 5.0, 5.0, 0.0), (7, 5.0, 5.0, 9.0, 0.0), (9, 10.0, 5.0, 12.0, 0.0)], BOX.replace("id", "tile_id"))
    assert rows(last_overlap(storage, proc, "id", 10.0), "id", "p_fid") == [(1, 7), (2, -1)]


def test_polygon_rules(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]
    poly = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ring])], "id long, ring array<struct<x: double, y: double>>")
    pts = {1: (0, 0), 2: (5, 0), 3: (5, 4), 4: (5, 6), 5: (9, 8), 6: (11, 1), 7: (10, 4), 8: (1, 8)}
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in pts.items()], "pt long, x double, y double")
    # 1 is a vertex, 2 and 7 lie on edges, 4 is in the notch, 6 is outside.
    assert [r[0] for r in rows(points_in_polygons(p, poly), "p_pt")] == [1, 2, 3, 5, 7, 8]


def test_nearest_value_crosses_empty_buckets(spark):
    r = random.Random(5)
    values, coords = [r.uniform(-500, 500) for _ in range(100)] + [15.0], [-400.0, -10.0, 10.0, 20.0, 450.0]
    left = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    right = spark.createDataFrame([(c,) for c in coords], "c double")
    got = {r["i"]: r["v_snapped"] for r in nearest_value(left, "v", right, "c", 25.0).collect()}
    assert got == {i: min(coords, key=lambda c: (abs(c - v), c)) for i, v in enumerate(values)}


def _inside(x, y, rings):
    """Plain ray casting over all rings, edges included."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if min(y1, y2) < y <= max(y1, y2) and x < max(x1, x2) and (x1 == x2 or x < (y - y1) * (x2 - x1) / (y2 - y1) + x1):
                odd = not odd
    return odd


def test_polygons_with_holes_and_parts(spark):
    """Wild rings of very different sizes, holes, parts, a degenerate ring, and repeated points."""
    import math

    r = random.Random(6)
    polygons = {}
    for k, (n, size) in enumerate([(3, 4), (7, 40), (60, 300), (400, 90), (12, 2000)]):
        cx, cy = r.randint(-50, 50), r.randint(-50, 50)
        star = lambda f: [
            (float(round(cx + f * size * r.uniform(0.3, 1) * math.cos(2 * math.pi * i / n))), float(round(cy + f * size * r.uniform(0.3, 1) * math.sin(2 * math.pi * i / n))))
            for i in range(n)
        ]
        polygons[k] = [star(1.0), star(0.25), [(x + 5.5 * size, y) for x, y in star(0.5)]]
    polygons[5] = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], [(3.0, 3.0), (5.0, 3.0), (4.0, 3.0)]]
    rows_in = [(k, [{"x": x, "y": y} for x, y in ring]) for k, rings in polygons.items() for ring in rings] + [(6, None), (7, [])]
    pts = [(float(r.randint(-120, 400)), float(r.randint(-120, 120))) for _ in range(700)] + [(r.uniform(-30, 30), r.uniform(-30, 30)) for _ in range(200)]
    pts += [(4.0, 3.0), (2.0, 2.0), (8.0, 8.0), (4.0, 4.0), (8.0, 4.0)] + [v for rings in polygons.values() for ring in rings for v in ring[:5]]
    pts = [(i, *p) for i, p in enumerate(pts)] + [(3, *pts[3])] * 2
    poly = spark.createDataFrame(rows_in, "id long, ring array<struct<x: double, y: double>>")
    got = rows(points_in_polygons(spark.createDataFrame(pts + [(-1, None, 1.0)], "pt long, x double, y double"), poly), "p_pt", "b_id")
    assert got == sorted((i, k) for i, x, y in pts for k, rings in polygons.items() if _inside(x, y, rings))


def test_candidate_pairs_hold_no_ring(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in [(0, 0), (90, 0), (90, 90), (40, 20)]]
    poly = spark.createDataFrame([(1, ring)], "id long, ring array<struct<x: double, y: double>>")
    hit = points_in_polygons(spark.range(50).select(F.col("id").alias("pt"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y")), poly)
    assert "ring" not in hit._jdf.queryExecution().executedPlan().toString()
