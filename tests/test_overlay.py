"""Noding, overlay and clean-up against plain geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import fit, linework, overlay
from quillmap.plans import control_points

POLYGONS = "k int, rings array<array<struct<x:double,y:double>>>"


def star(rng, n, radius, cx, cy):
    turn = np.sort(rng.random(n)) * 2 * np.pi
    size = radius * (0.3 + 0.7 * rng.random(n))
    return [(float(cx + s * np.cos(t)), float(cy + s * np.sin(t))) for t, s in zip(turn, size, strict=True)]


def inside(polygons, x, y):
    """Whether points lie in any polygon (odd number of its rings around)."""
    out = np.zeros(len(x), bool)
    for rings in polygons:
        odd = np.zeros(len(x), bool)
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                odd ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1 if y2 != y1 else 1))
        out |= odd
    return out


def frame(spark, sheets):
    rows = [(k, [[(x, y) for x, y in ring] for ring in rings]) for k, polygons in sheets for rings in polygons]
    return spark.createDataFrame(rows, POLYGONS)


def test_operations_on_crossing_polygons_equal_a_raster_count(spark):
    rng = np.random.default_rng(5)
    sets = []
    for k in range(2):
        xs = [[star(rng, 9, 30, *rng.integers(20, 80, 2))] for _ in range(4)]
        ring = star(rng, 8, 40, 50, 50)
        xs.append([ring, [(50 + (x - 50) / 3, 50 + (y - 50) / 3) for x, y in ring]])  # with a hole
        ys = [[star(rng, 12, 35, *rng.integers(20, 80, 2))] for _ in range(3)] + [[[(10.0, 10.0), (90.0, 90.0), (90.0, 10.0), (10.0, 90.0)]]]  # crosses itself
        ys.append(xs[0])  # the same ring in both layers
        sets.append((k, xs, ys))
    x, y = frame(spark, [(k, a) for k, a, _ in sets]), frame(spark, [(k, b) for k, _, b in sets])
    px, py = (v.ravel() for v in np.meshgrid(np.arange(0.07, 110, 0.5), np.arange(-10.03, 110, 0.5)))
    edges = overlay.labelled(x.withColumn("layer", F.lit("x")).unionByName(y.withColumn("layer", F.lit("y"))), ["k"], 1e-3).cache()
    for name, rule in (("union", np.logical_or), ("intersection", np.logical_and), ("difference", lambda a, b: a & ~b), ("symmetric_difference", np.logical_xor)):
        got = overlay.outline(edges, ["k"], name, 1e-3)
        areas = {r["k"]: r["area"] for r in overlay.enclosed(got, ["k"]).collect()}
        border = got.collect()
        for k, xs, ys in sets:
            want = rule(inside(xs, px, py), inside(ys, px, py))
            assert abs(areas[k] - want.sum() / 4) < 0.02 * max(100, areas[k])
            odd = np.zeros(len(px), bool)
            for r in border:
                if r["k"] == k:
                    (x1, y1), (x2, y2) = r["a"], r["b"]
                    odd ^= ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / (y2 - y1 if y2 != y1 else 1))
            # But for points within a snap of an edge.
            assert (odd != want).sum() <= 2


def test_pieces_meet_at_ends_only(spark):
    rng = np.random.default_rng(6)
    rows = [(1, [[tuple(map(float, p)) for p in rng.integers(0, 60, (2, 2))]]) for _ in range(120)]
    s = overlay.snapped_segments(spark.createDataFrame(rows, POLYGONS), ["k"], 1.0, closed=False)
    got = {tuple(r) for r in overlay.noded(s, ["k"], cell=7).select(*overlay.EDGE).collect()}
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [((a, b), (c, d)) for a, b, c, d in got]
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            assert not (turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0)
        for p in {p for e in edges for p in e} - {a, b}:
            assert turn(a, b, p) or not (min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]))
    want = {tuple(r) for r in overlay.noded(s, ["k"], cell=1000).select(*overlay.EDGE).collect()}
    assert got == want  # whatever the cells


@pytest.mark.parametrize("rings,area", [([], None), ([[]], None), ([[(0.0, 0.0)]], None), ([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]] * 2, None), ([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]], 16.0)])
def test_odd_rings(spark, rings, area):
    x = spark.createDataFrame([(1, rings)], POLYGONS)
    got = overlay.enclosed(overlay.overlay(x, None, ["k"], "union", 1.0), ["k"]).collect()
    assert [r["area"] for r in got] == ([] if area is None else [area])


def test_coordinates_beyond_the_grid_fail(spark):
    x = spark.createDataFrame([(1, [[(0.0, 0.0), (1e9, 0.0), (0.0, 1.0)]])], POLYGONS)
    with pytest.raises(Exception, match="beyond"):
        overlay.overlay(x, None, ["k"], "union", 1.0).count()


LINES = "k int, line_id int, points array<struct<x:double,y:double>>"


def crossings(lines):
    """Pairs of segments of all lines that meet elsewhere than at a common end."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    segs = [(tuple(a), tuple(b)) for ps in lines for a, b in zip(ps, ps[1:], strict=False)]
    return [(s, t) for i, s in enumerate(segs) for t in segs[:i] if turn(*s, t[0]) * turn(*s, t[1]) < 0 and turn(*t, s[0]) * turn(*t, s[1]) < 0 or {*s} == {*t}]


def test_simplified_lines_do_not_cross(spark):
    # Two arcs between the same ends, the upper one less than a tolerance above the lower, and a spike that reaches in.
    lower, upper = [(0.0, 0.0), (5.0, 1.0), (10.0, 0.0)], [(0.0, 0.0), (5.0, 1.5), (10.0, 0.0)]
    tall, post = [(0.0, 10.0), (5.0, 11.9), (10.0, 10.0)], [(5.0, 20.0), (5.0, 11.0)]
    ring = [(20.0, 20.0), (21.0, 20.0), (21.0, 21.0), (20.0, 20.0)]
    free = [(30.0, 0.0), (35.0, 1.0), (40.0, 0.0)]
    rows = [(1, i, p) for i, p in enumerate([lower, upper, tall, post, ring, free])]
    rows[3] = (1, 3, [(5.0, 20.0), (5.0, 11.95)])  # ends above tall, below what a tall without its middle would leave free
    got = {r["line_id"]: [tuple(p) for p in r["points"]] for r in linework.simplified_apart(spark.createDataFrame(rows, LINES), ["k"], "line_id", 2.0).collect()}
    assert got[5] == [free[0], free[2]] and got[4] == ring
    assert got[0] != got[1] and not crossings(got.values())
    rows[3] = (1, 3, [(5.0, 0.9), (5.0, 0.5)])  # inside the first arc: it may not be cut off
    got = {r["line_id"]: [tuple(p) for p in r["points"]] for r in linework.simplified_apart(spark.createDataFrame(rows[:1] + rows[3:4], LINES), ["k"], "line_id", 2.0).collect()}
    assert got[0] == [lower[0], lower[2]] and got[3] == rows[3][2]


def test_clean_up_of_random_lines_makes_no_crossings(spark):
    rng = np.random.default_rng(8)
    rows = [(1, i, [tuple(map(float, p)) for p in np.cumsum(rng.normal(0, 6, (12, 2)), axis=0) + rng.integers(20, 180, 2)]) for i in range(15)]
    got = [[tuple(p) for p in r["points"]] for r in linework.clean_up(spark.createDataFrame(rows, LINES), ["k"], 200, 200).collect()]
    assert got and not crossings(got)
    assert all(sum(np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:], strict=False)) >= 8 for p in got)
    assert all(0 <= x <= 199 and 0 <= y <= 199 for p in got for x, y in p)


def square(x, y, w, h):
    return [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]]


def test_province_boundaries(spark):
    model = {"order": 1}
    provinces = spark.createDataFrame([(" A ", square(0, 0, 20, 10)), ("B", square(20, 0, 10, 10))], "name string, rings array<array<struct<x:double,y:double>>>")
    prefectures = spark.createDataFrame([("A", "a1", square(0, 0, 8, 10)), ("A ", "a2", square(8, 0, 12, 10)), ("B", "b1", square(20, 0, 10, 10)), ("A", "none", None)], "province string, name string, rings array<array<struct<x:double,y:double>>>")
    shifted = lambda r, dx: F.transform(r, lambda q: F.transform(q, lambda p: F.struct((p["x"] + dx).alias("x"), p["y"].alias("y"))))
    points = spark.createDataFrame([(float(x), float(y), 10.0 * x, 300 - 10.0 * y) for x in range(4) for y in range(4)], "lon double, lat double, pixel_x double, pixel_y double")
    model = fit.plane_fit(points, "lon", "lat", ["pixel_x", "pixel_y"])
    got = {}
    for r in control_points.province_boundaries(provinces, prefectures, "A", model, 1000, 1000, 1.0).collect():
        got.setdefault(r["label"], []).append([(round(p["x"], 1), round(p["y"], 1)) for p in r["points"]])
    # The border between the provinces, each one's own outline, and the one border inside A.
    assert sorted(map(len, got["boundary_1"])) and len(got["boundary_1"]) == 3
    assert [sorted(p) for p in got["boundary_2"]] == [[(80.0, 200.0), (80.0, 300.0)]]
    # Areas are alike, but not the places: 3 x 10 on either side.
    with pytest.raises(ValueError, match="differ by 60"):
        control_points.province_boundaries(provinces, prefectures.withColumn("rings", shifted("rings", F.lit(3.0))), "A", model, 1000, 1000, 1.0)
    with pytest.raises(ValueError, match="no prefectures of C"):
        control_points.province_boundaries(provinces, prefectures, "C", model, 1000, 1000, 1.0)
    with pytest.raises(ValueError, match="2 provinces"):
        control_points.province_boundaries(provinces.unionByName(provinces), prefectures, "A", model, 1000, 1000, 1.0)


def test_mismatch_is_of_places_not_of_areas(spark):
    ring = lambda x: spark.createDataFrame([(square(x, 0, 5, 5)[0],)], "points array<struct<x:double,y:double>>")
    assert linework.mismatch(ring(0), ring(100)) == 50.0
    assert linework.mismatch(ring(0), ring(0)) == 0.0
