"""Work grows with the tables, not with pairs, copies or votes; results equal brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmap.operators import hough, joins, linework, overlay, raster, set_areas, small_sheets
from quillmap.plans import instances, overlay_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_centre_makes_no_pairs(spark):
    rng = random.Random(1)
    values = [(k % 2, k, rng.randint(-300, 300) / 2) for k in range(300)] + [(0, 900, None)]
    centres = [(k % 2, 1000 + k, float(rng.randint(-150, 150))) for k in range(40)] * 2
    v, c = spark.createDataFrame(values, "k int, id int, p double"), spark.createDataFrame(centres, "k int, c int, q double")
    got = joins.nearest_centre(v, c, ["k"], v["p"], "q", "c", ["id"], 7.0)
    assert "Join" not in plan(got)
    want = {}
    for k, i, p in values:
        near = [(abs(p - q), j, q) for n, j, q in centres if n == k and abs(p - q) < 7.0] if p is not None else []
        if near:
            want[k, i] = min(near)
    assert {(r["k"], r["id"]): (r["distance"], r["c"], r["q"]) for r in got.collect()} == want


def test_snap_passes_copies_of_targets_once(spark, monkeypatch):
    pairs, plainly = [], joins.radius_pairs

    def counted(*args, **more):
        out = plainly(*args, **more)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(joins, "radius_pairs", counted)
    rng = random.Random(2)
    points = [(1, k, rng.uniform(0, 60), rng.uniform(0, 60)) for k in range(60)]
    places = [(1, rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(40)]
    p, t = spark.createDataFrame(points, "k int, id int, x double, y double"), spark.createDataFrame(places * 50, "k int, tx double, ty double")
    got = {r["id"]: (r["x"], r["y"]) for r in joins.snap(p, t, ["k"], ["id"], 10.0).collect()}
    for _, i, x, y in points:
        d, tx, ty = min((((x - tx) ** 2 + (y - ty) ** 2) ** 0.5, tx, ty) for _, tx, ty in places)
        assert got[i] == ((tx, ty) if d <= 10.0 else (x, y))
    assert sum(pairs) <= len(points) * len(places)


def test_pairs_within_a_radius_keep_their_tasks(spark):
    few = spark.range(40).selectExpr("1 AS k", "id", "cast(id AS double) AS x", "0.0D AS y")
    got = joins.radius_pairs(few, few.selectExpr("k", "id AS other", "x AS tx", "y AS ty"), ["k"], 1.0, "x", "y", "tx", "ty")
    assert "REPARTITION_BY_NUM" in plan(got)
    assert got.count() == 40 + 2 * 39


def test_close_lines_need_no_grouping_of_pairs(spark):
    rng = random.Random(3)
    lines = [(1, k, *(float(rng.randint(0, 30)) for _ in range(4))) for k in range(60)]
    got = instances.close_lines(spark.createDataFrame(lines, "k int, line int, x1 double, y1 double, x2 double, y2 double"), ["k"], "line", 9.0)
    assert "Aggregate" not in plan(got)
    want = {}
    for _, a, *p in lines:
        for _, b, *q in lines:
            d = min(((x - u) ** 2 + (y - v) ** 2) ** 0.5 for x, y in (p[:2], p[2:]) for u, v in (q[:2], q[2:]))
            if a < b and d < 9.0:
                want[a, b] = d
    rows = [(r["a"], r["b"], r["distance"]) for r in got.collect()]
    assert len(rows) == len(want) and {(a, b): d for a, b, d in rows} == want


def test_votes_move_only_lines_of_enough_votes(spark, monkeypatch):
    rng = random.Random(4)
    pixels = {(k, rng.randint(-20, 40), rng.randint(-20, 40)) for k in (1, 2) for _ in range(60)}
    df = spark.createDataFrame(sorted(pixels), "sheet int, x int, y int")
    want = Counter((k, t, round(x * c + y * s)) for k, x, y in pixels for t, (c, s) in enumerate(hough.directions(12)))
    assert "Generate" not in plan(hough.votes(df, ["sheet"], 12))
    got = lambda **more: {(r["sheet"], r["theta"], r["rho"]): r["votes"] for r in hough.votes(df, ["sheet"], 12, **more).collect()}
    assert got() == want and got(least=4) == {k: n for k, n in want.items() if n >= 4}
    monkeypatch.setattr(hough, "TASK_PIXELS", 16)
    assert got(least=4) == {k: n for k, n in want.items() if n >= 4}


def test_votes_and_peaks_send_no_table_through_the_driver(spark):
    rng = random.Random(6)
    pixels = sorted({(k, rng.randint(0, 30), rng.randint(0, 30)) for k in (1, 2) for _ in range(90)})
    counts = hough.votes(spark.createDataFrame(pixels, "sheet int, x int, y int"), ["sheet"], 12)
    got = hough.peaks(counts, ["sheet"], 3, 12)
    assert "Broadcast" not in plan(counts) and plan(got).count("Join") == plan(counts).count("Join") and "Broadcast" not in plan(got)
    n = {(r["sheet"], r["theta"], r["rho"]): r["votes"] for r in counts.collect() if r["votes"] >= 3}
    rank = lambda k: (n[k], -k[1], -k[2])
    want = set()
    for s, t, r in n:
        # Past the last direction the first comes again with the sign of rho turned.
        place = lambda a, b: (s, a, b) if 0 <= a < 12 else (s, a % 12, -b)  # noqa: B023, E731
        beside = {k for k in n for dt in (-1, 0, 1) for dr in (-1, 0, 1) if (dt or dr) and place(k[1] + dt, k[2] + dr) == (s, t, r) and k[0] == s}
        if all(rank(k) < rank((s, t, r)) for k in beside):
            want.add((s, t, r, n[s, t, r]))
    assert {tuple(r) for r in got.collect()} == want and want


@pytest.mark.parametrize("canvas", [raster.CANVAS, 1])
def test_shapes_are_drawn_in_their_order(spark, monkeypatch, canvas):
    monkeypatch.setattr(raster, "CANVAS", canvas)
    rng = random.Random(5)
    shapes = [(k % 2, k, k * 7, [(rng.uniform(-9, 30), rng.uniform(-9, 30)) for _ in range(rng.randint(0, 4))]) for k in range(30)]
    df = spark.createDataFrame(shapes[::-1], "image_id long, shape_idx int, cls int, points array<struct<x:double,y:double>>")
    for thickness in (1, 3, 5):
        r = (thickness - 1) // 2
        offs = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r + r]
        want = {}
        for sheet, _, cls, points in shapes:
            for (ax, ay), (bx, by) in zip(points, points[1:]):
                n = max(1, math.ceil(max(abs(bx - ax), abs(by - ay)) * (1 if r == 0 else 2)))
                for i in range(n + 1):
                    for ox, oy in offs:
                        want[sheet, round(ax + (bx - ax) * i / n) + ox, round(ay + (by - ay) * i / n) + oy] = cls
        got = raster.rasterised(df, thickness)
        assert "Generate" not in plan(got)
        assert {(r["image_id"], r["x"], r["y"]): r["cls"] for r in got.collect()} == want


def test_copies_of_regions_are_one(spark, tmp_path):
    rows = [(k, 3, 100.0 + 7 * (k % 40)) for k in range(40)]
    for times, folder in ((1, "one"), (3, "three")):
        c = [(k + 1000 * n, nation, value) for n in range(times) for k, nation, value in rows]
        spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/{folder}/customer.parquet")
        s = [(k + 3000 * n, nation, value) for n in range(times) for k, nation, value in rows[:5]]
        spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/{folder}/supplier.parquet")
    one, three = (overlay_queries._diamonds(spark, f"{tmp_path}/{f}") for f in ("one", "three"))
    assert one.count() == three.count() == 45


def test_crossings_are_dealt_to_tasks_and_found_side_by_side(spark, monkeypatch):
    from quillmap.operators import gcp

    point = lambda x, y: {"x": float(x), "y": float(y)}
    v = spark.createDataFrame([(1, 60.0, [point(10 * k, 0), point(10 * k + 5, 100)]) for k in range(3)] + [(1, 61.0, [point(500, 0), point(500, 100)])], "k int, degree double, points array<struct<x:double,y:double>>")
    h = spark.createDataFrame([(1, 20.0, [point(40, 50), point(-5, 30)]), (1, 30.0, [point(0, 20), point(20, 20), point(40, 60)]), (1, None, [])], "k int, degree double, points array<struct<x:double,y:double>>")
    got = gcp.intersections(v, h, ["k"])
    assert "REPARTITION_BY_NUM" in plan(got) and "MapInArrow" in plan(got)
    rows = sorted(got.collect())
    assert [r["lat"] for r in rows].count(30.0) == 3 and len(rows) == 6
    for r in rows:
        want = 30 + (r["pixel_x"] + 5) * 20 / 45 if r["lat"] == 20.0 else 20 + max(0, r["pixel_x"] - 20) * 2
        assert abs(r["pixel_y"] - want) < 0.02
    monkeypatch.setattr(gcp, "SIDE_BY_SIDE", 1)
    assert sorted(gcp.intersections(v, h, ["k"]).collect()) == rows


def test_gaps_send_no_table_through_the_driver(spark):
    from quillmap.operators import topology

    rows = [(1, 1, 1, [(10.0, 20.0), (20.0, 20.0)]), (1, 2, 1, [(22.0, 20.0), (40.0, 20.0)]), (2, 1, 1, [(5.0, 5.0), (6.0, 6.0)])]
    lines = spark.createDataFrame(rows, "image_id long, line_id long, level int, points array<struct<x:double,y:double>>")
    frames = spark.createDataFrame([(1, 0.0, 99.0, 0.0, 74.0)], "image_id long, x_min double, x_max double, y_min double, y_max double")
    got = topology.gaps(lines, frames)
    assert "Broadcast" not in plan(got)
    found = {(r.image_id, r.line_id, r.side): (r.status, r.to_line, r.distance, r.candidates) for r in got.collect()}
    assert len(found) == 6 and found[1, 1, "end"] == ("snappable", 2, 2.0, 1)
    # A sheet without a frame and without another line: ends stay, with no candidate.
    assert found[2, 1, "start"] == found[2, 1, "end"] == ("open", None, None, 0)


def test_components_read_their_links_once_a_round(spark, monkeypatch):
    from quillmap.operators import linework

    tables, plainly = [], linework.materialise

    def counted(df, tag, **more):
        out = plainly(df, tag, **more)
        tables.append((tag, out.count()))
        return out

    monkeypatch.setattr(linework, "materialise", counted)
    rng = random.Random(6)
    pairs = [(f"s{rng.randint(0, 9)}", f"p{rng.randint(0, 300)}") for _ in range(1500)] + [(f"a{k:03d}", f"a{k + 1:03d}") for k in range(200)] + [("z", "z"), ("y", None)]
    near = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, set()).update([y] if x and y else [])
    want = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        want[start] = min(seen) if start else None
    got = [tuple(r) for r in linework.components(spark.createDataFrame(pairs, "a string, b string")).collect()]
    assert len(got) == len(want) and dict(got) == want
    links = [n for tag, n in tables if tag == "edges"]
    # Every round's links are fewer, and the first ones stand there once, not in both directions.
    assert links[0] <= len(set(pairs)) and sum(links) < 2 * links[0] and links[-1] == 0


def test_no_text_of_edges_moves_in_merged(spark, monkeypatch):
    from quillmap.operators import linework

    kinds, plainly = [], linework.materialise
    monkeypatch.setattr(linework, "materialise", lambda df, tag, **more: (kinds.extend(t for _, t in df.dtypes), plainly(df, tag, **more))[1])
    at = lambda *p: [(float(x), float(y)) for x, y in p]
    rows = [(1, *at((0, 0), (1, 0))), (1, *at((2, 0), (1, 0))), (2, *at((1, 0), (0, 0))), (1, *at((5, 5), (6, 5))), (1, *at((6, 5), (6, 6))), (1, *at((6, 6), (5, 5)))]
    edges = spark.createDataFrame(rows, "k int, a struct<x:double,y:double>, b struct<x:double,y:double>")
    got = {(r.k, r.line_id, tuple(map(tuple, r.points))) for r in linework.merged(edges, ["k"]).collect()}
    name = lambda k, *v: " ".join([*(f"{x:.9f}" for x in v), str(k)])
    line, ring = ((0.0, 0.0), (1.0, 0.0), (2.0, 0.0)), ((5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0))
    assert got == {(1, name(1, 0, 0, 1, 0), line), (2, name(2, 0, 0, 1, 0), line[:2]), (1, name(1, 5, 5, 6, 5), ring)}
    assert kinds and "string" not in kinds


def test_seams_and_drawings_need_no_group_for_each(spark):
    from quillmap.plans import queries

    got = queries.QUERIES["window_prediction"](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInArrow" not in plan(got)
    rows = [tuple(r) for r in got.collect()]
    pixels = Counter()
    for sheet, _, n in rows:
        pixels[sheet] += n
    assert pixels and set(pixels.values()) == {7500} and len({r[:2] for r in rows}) == len(rows)


def test_leaders_are_found_without_pairs(spark, monkeypatch):
    tables, plainly = [], instances.materialise

    def counted(df, tag, **more):
        out = plainly(df, tag, **more)
        tables.append(out.count())
        return out

    monkeypatch.setattr(instances, "materialise", counted)
    rng = random.Random(8)
    lines = [(1, k, *(float(rng.randint(0, 60)) for _ in range(4))) for k in range(700)] + [(2, 1, None, 3.0, 1.0, 2.0), (2, 2, 1.0, 2.0, 50.0, 50.0), (2, 3, None, None, None, None), (None, 4, 0.0, 0.0, 0.0, 0.0)]
    got = instances.leading_lines(spark.createDataFrame(lines, "k int, line int, x1 double, y1 double, x2 double, y2 double"), ["k"], "line", 12.0)
    want = []
    for k, a, *p in lines:
        at = [e for e in (p[:2], p[2:]) if None not in e]
        if k is None or all(math.dist(e, f) >= 12.0 for j, _, taken in want if j == k for e in at for f in taken):
            want.append((k, a, at))
    assert sorted((r["k"] or 0, r["line"]) for r in got.collect()) == sorted((k or 0, a) for k, a, _ in want)
    # Of 700 lines a hundred thousand pairs are close.
    assert max(tables) <= 703


def test_greedy_match_of_copies_makes_no_pairs(spark, monkeypatch):
    tables, plainly = [], joins.materialise

    def counted(df, tag, **more):
        out = plainly(df, tag, **more)
        tables.append(out.count())
        return out

    monkeypatch.setattr(joins, "materialise", counted)
    rng = random.Random(9)
    # Copies at the same places, ties on both sides; a key whose ids repeat, and one whose places round to one distance.
    left = [(1, k, float(rng.randint(0, 40))) for k in range(250)] + [(2, 7, 1.0), (2, 8, 5.0), (3, 1, 100.0), (None, 5, 1.0), (1, 999, None)]
    right = [(1, 1000 + k, float(rng.randint(0, 40))) for k in range(200)] + [(2, 1, 2.0), (2, 1, 5.5), (3, 5, 0.1 + 0.2), (3, 4, 0.3)]
    pairs = sorted((abs(p - q), a, b, k) for k, a, p in left for j, b, q in right if k == j and p is not None and abs(p - q) <= 100)
    used, want = set(), set()
    for d, a, b, k in pairs:
        if not used & {("l", k, a), ("r", k, b)}:
            used |= {("l", k, a), ("r", k, b)}
            want.add((k, a, b, d))
    l, r = spark.createDataFrame(left, "k int, l long, p double"), spark.createDataFrame(right, "k int, r long, q double")
    assert {tuple(x) for x in joins.greedy_match(l, r, ["k"], "p", "q", "l", "r", 100.0).collect()} == want
    # Of 450 rows 50,000 pairs are within reach; what the rounds leave may make a few a row.
    assert max(tables) <= joins.ROW_PAIRS * (len(left) + len(right))


def rows_written(monkeypatch, module):
    """Rows of the tables that a module writes from now on, by name."""
    rows, plainly = Counter(), module.materialise

    def counted(df, tag, **more):
        out = plainly(df, tag, **more)
        rows[tag] += out.count()
        return out

    monkeypatch.setattr(module, "materialise", counted)
    return rows


def strokes(spark, n, steps, seed):
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        at = [(rng.uniform(0, 80), rng.uniform(0, 80))]
        for _ in range(steps):
            at.append((at[-1][0] + rng.gauss(0, 2), at[-1][1] + rng.gauss(0, 2)))
        lines.append((i % 2, at))
    return spark.createDataFrame(lines, "k int, points array<struct<x:double,y:double>>")


def test_rounds_of_simplification_pass_over_lines_that_meet_only(spark, monkeypatch):
    arcs = linework.joined_lines(strokes(spark, 30, 30, 1), ["k"]).select("k", F.col("line_id").cast("string").alias("line_id"), "points")
    # Many lines with nothing to simplify.
    far = spark.range(3000).selectExpr("0 AS k", "concat('far', id) AS line_id", "array(named_struct('x', 200.0D + id, 'y', 0.0D), named_struct('x', 200.0D + id, 'y', 9.0D)) AS points")
    lines = arcs.unionByName(far).localCheckpoint()
    own = {(r["k"], r["line_id"]): [tuple(p) for p in r["points"]] for r in lines.collect()}
    rows = rows_written(monkeypatch, linework)
    got = {(r["k"], r["line_id"]): [tuple(p) for p in r["points"]] for r in linework.simplified_apart(lines, ["k"], "line_id", 2.0).collect()}
    forms = {n: [[tuple(q) for q in raster.simplify(raster.np.array(p), t).tolist()] for t in (2.0, 0.5)] + [p] for n, p in own.items()}
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    inside = lambda a, b, p: p not in (a, b) and turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    step, rounds = dict.fromkeys(own, 0), 0
    while True:
        segs = [(n, s) for n in own if "far" not in n[1] for s in zip(forms[n][step[n]], forms[n][step[n]][1:], strict=False)]
        back = {n for n in own if own[n][0] == own[n][-1] and len(forms[n][step[n]]) < 4 <= len(own[n])}
        for i, (n, (a, b)) in enumerate(segs):
            for m, (c, d) in segs[:i]:
                if n[0] == m[0] and ({a, b} == {c, d} or turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 or inside(a, b, c) or inside(a, b, d) or inside(c, d, a) or inside(c, d, b)):
                    back |= {n, m}
        moved = {n for n in back if step[n] < 2}
        if not moved:
            break
        step.update(dict.fromkeys(moved, 2 if rounds else 1))
        rounds += 1
    assert rounds >= 2 and got == {n: forms[n][step[n]] for n in own}
    # A line is written once; what rounds write on top are lines that can change.
    assert rows["lines"] == len(own) and rows["simplified"] + rows["meet"] + rows["steps"] < len(own)


def test_noding_again_passes_over_corners_only(spark, monkeypatch):
    lines = strokes(spark, 24, 20, 2).unionByName(spark.createDataFrame([(0, [(100.0, 0.0), (109.0, 5.0)]), (0, [(106.0, 9.0), (104.0, 2.0)])], "k int, points array<struct<x:double,y:double>>"))
    pieces = overlay.noded(overlay.snapped_segments(lines.select("k", F.array("points").alias("rings")), ["k"], 1.0, closed=False), ["k"]).select("k", *overlay.EDGE, "way").distinct().localCheckpoint()
    # A corner that a piece passes through within a pixel.
    pieces = pieces.unionByName(spark.createDataFrame([(1, 300, 0, 310, 1, 1), (1, 304, -5, 304, 0, 1), (1, 310, 1, 320, 0, 1)], pieces.schema)).localCheckpoint()
    want = sorted(map(tuple, overlay.noded(pieces, ["k"]).collect()))
    rows = rows_written(monkeypatch, overlay)
    assert sorted(map(tuple, overlay.noded(pieces, ["k"], crossing=False).collect())) == want != sorted(map(tuple, pieces.collect()))
    assert 0 < rows["hits"] < len(want) / 4 and not rows["cells"]


def test_edges_that_join_no_other_need_no_task(spark, monkeypatch):
    edges = [((0.0, float(y)), (float(x), -1.0)) for y in range(30) for x in range(1, 31)] + [((50.0, 0.0), (51.0, 0.0)), ((52.0, 0.0), (51.0, 0.0))]
    rows = rows_written(monkeypatch, linework)
    point = "struct<x:double,y:double>"
    got = {tuple(map(tuple, r["points"])) for r in linework.merged(spark.createDataFrame([(1, a, b) for a, b in edges], f"k int, a {point}, b {point}"), ["k"]).collect()}
    assert got == {tuple(sorted(e)) for e in edges[:-2]} | {((50.0, 0.0), (51.0, 0.0), (52.0, 0.0))}
    assert rows["joined"] == 2


@pytest.mark.parametrize("tolerance", [0.0, 0.25, 2.0])
def test_lines_simplified_side_by_side_equal_one_by_one(spark, tolerance):
    rng = random.Random(3)
    rows = [(None,), ([],), ([(1.0, 2.0)],), ([(0.0, 0.0), (4.0, 3.0), (0.0, 0.0)],), ([(1.0, 1.0)] * 4,), ([(0.0, 0.0), (1.0, 2.0), (2.0, 2.0), (3.0, 0.0)],)]
    rows += [([(rng.randint(0, 8192) / 1024, rng.randint(0, 8192) / 1024) for _ in range(rng.randint(0, 40))],) for _ in range(200)]
    lines = spark.createDataFrame([(i, p) for i, (p,) in enumerate(rows)], "id int, points array<struct<x:double,y:double>>")
    got = {r["id"]: r["points"] and [tuple(p) for p in r["points"]] for r in linework.simplified(lines, tolerance).collect()}
    assert got == {i: p and [tuple(q) for q in raster.simplify(raster.np.array(p), tolerance).tolist()] for i, (p,) in enumerate(rows)}


def test_small_sheets_are_cleaned_up_in_their_tasks(spark, monkeypatch):
    ring = [(10.0, 10.0), (14.5, 10.0), (14.5, 14.5), (10.0, 14.5), (10.0, 10.0)]
    odd = [(0, ring), (0, ring[::-1]), (0, [(5.0, 5.0)]), (0, []), (0, None), (0, [(3.0, 3.0), None, (9.0, 3.2), (30.0, 3.0)]), (None, [(0.0, 0.0), (20.0, 0.0)]), (2, [(0.0, 0.0), (40.0, 30.0)]), (2, [(0.0, 0.0), (40.0, 30.0), (60.0, 30.4)])]
    lines = strokes(spark, 30, 30, 4).unionByName(spark.createDataFrame(odd, "k int, points array<struct<x:double,y:double>>")).withColumn("sheet", F.concat(F.lit("a"), F.col("k"))).localCheckpoint()
    found = lambda: sorted((r["k"], r["sheet"], tuple(map(tuple, r["points"]))) for r in linework.clean_up(lines, ["k", "sheet"], 80, 80).collect())
    rows = rows_written(monkeypatch, linework)
    got = found()
    # No table but the segments and their numbers is written, and what joins by cell would write is not.
    assert rows["segments"] > 900 and rows["sizes"] == 3 and set(rows) == {"segments", "sizes"}
    monkeypatch.setattr(linework, "TASK_SQUARES", 1)
    monkeypatch.setattr(small_sheets, "SIDE_BY_SIDE", 1)
    monkeypatch.setattr(linework, "SHEET_SEGMENTS", 455)
    assert found() == got and {k for k, _, _ in got} == {0, 1, 2} and rows["joined"]


def test_areas_need_no_pieces_of_what_others_cover(spark, tmp_path, monkeypatch):
    rng, np = random.Random(9), raster.np
    squares = [("customer", "c_custkey", k, rng.uniform(0, 300)) for k in rng.sample(range(3000), 900)] + [("supplier", "s_suppkey", k, rng.uniform(0, 300)) for k in range(60)]
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.createDataFrame([(k, k % 2, a) for t, _, k, a in squares if t == table], f"{key} long, {table[0]}_nationkey int, {table[0]}_acctbal double").write.parquet(f"{tmp_path}/{table}.parquet")
    rows = rows_written(monkeypatch, overlay)
    got = {r["nation"]: tuple(r)[1:] for r in overlay_queries.region_overlay(spark, str(tmp_path)).collect()}
    assert not rows and len(got) == 2
    for nation in got:
        covered = np.zeros((2, 3200, 3200), bool)
        for t, _, k, a in squares:
            if k % 2 == nation:
                x, y, h = (int(a), k * 7 % 1000, 5 + k % 20) if t == "customer" else (int(a), k * 37 % 1000, 40 + k % 60)
                covered[int(t == "supplier"), x + y - h + 200 : x + y + h + 200, x - y - h + 1400 : x - y + h + 1400] = True
        p, q = covered
        assert got[nation] == tuple(v.sum() / 2 for v in (p | q, p & q, p & ~q, p != q))


@pytest.mark.parametrize(("cell", "crowd"), [(1024, 10**9), (16, 24), (8, 1)])
def test_areas_of_odd_regions_equal_the_overlay(spark, monkeypatch, cell, crowd):
    rng = random.Random(10)
    ring = lambda n: [(float(rng.randint(0, 60)), float(rng.randint(0, 60))) for _ in range(n)]
    square = [(10.0, 10.0), (10.0, 50.0), (50.0, 50.0), (50.0, 10.0)]
    regions = [(k, layer, [ring(rng.randint(3, 7)) for _ in range(rng.randint(1, 2))]) for k in (0, 1) for layer in "xyxy"]
    regions += [(0, "x", [square, [(20.0, 20.0), (40.0, 20.0), (30.0, 40.0)]]), (0, "y", [square]), (1, "x", None), (1, "y", [[(1.0, 1.0)], []]), (2, "x", [square]), (None, "x", [square])]
    df = spark.createDataFrame(regions, "k int, layer string, rings array<array<struct<x:double,y:double>>>")
    edges = overlay.labelled(df, ["k"], 1 / 1024).cache()
    want = {(r["k"], op): r["area"] for op in overlay.OPERATIONS for r in overlay.enclosed(overlay.outline(edges, ["k"], op, 1 / 1024), ["k"]).collect()}
    monkeypatch.setattr(set_areas, "CROWD", crowd)
    # Cells are in units; quartered ones end at a unit.
    got = {(r["k"], op): r[op] for r in set_areas.areas(df, ["k"], 1 / 8, cell=cell).collect() for op in overlay.OPERATIONS}
    assert {k for k, _ in got} == {0, 1, 2}
    for name, area in got.items():
        assert abs(area - want.get(name, 0.0)) < 0.05


def test_nodes_of_overlapping_segments_are_found_once(spark, monkeypatch):
    rng = random.Random(11)
    steps = [(1, 1), (1, -1), (0, 1), (1, 0), (2, 1), (3, -2)]
    segs = set()
    for _ in range(300):
        k, (ex, ey), at, n = rng.randint(0, 1), rng.choice(steps), (rng.randint(0, 12), rng.randint(0, 12)), rng.randint(1, 6)
        segs.add((k, *at, at[0] + n * ex, at[1] + n * ey, 1))
    df = spark.createDataFrame(sorted(segs), "k int, ax long, ay long, bx long, by long, way int").localCheckpoint()
    ends = {(r["k"], *p) for r in overlay.noded(df, ["k"]).collect() for p in ((r["ax"], r["ay"]), (r["bx"], r["by"]))}
    rows = rows_written(monkeypatch, overlay)
    found = [tuple(r) for r in overlay.nodes(df, ["k"]).collect()]
    assert set(found) == ends and len(found) == len(ends)
    line = lambda s: (s[0], (g := math.gcd(s[3] - s[1], s[4] - s[2])) and (s[3] - s[1]) // g, (s[4] - s[2]) // g, ((s[3] - s[1]) * s[2] - (s[4] - s[2]) * s[1]) // g)
    assert rows["joined"] < len(segs) and len({line(s) for s in segs}) <= rows["joined"]
    long = {tuple(r) for r in overlay.joined_along(df, ["k"]).collect()}
    for s in segs:
        over = [t for t in long if line((*t, 1)) == line(s) and t[1:3] <= s[1:3] and s[3:5] <= t[3:5]]
        assert len(over) == 1
    # Pairs of the cells do not go through the driver.
    assert "Broadcast" not in plan(overlay.nodes(df, ["k"]))


def test_noded_corners_cuts_no_segment(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, 1, float(k * 37 % 90)) for k in range(200)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 1, float(k * 5)) for k in range(9)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = rows_written(monkeypatch, overlay)
    got = [tuple(r) for r in overlay_queries.noded_corners(spark, str(tmp_path)).collect()]
    squares = [(int(k * 37 % 90), k * 7 % 1000, 5 + k % 20) for k in range(200)] + [(k * 5, k * 37 % 1000, 40 + k % 60) for k in range(9)]
    up = {(x + y + s * h, v) for x, y, h in squares for s in (-1, 1) for v in range(x - y - h, x - y + h + 1)}
    across = {(u, x - y + s * h) for x, y, h in squares for s in (-1, 1) for u in range(x + y - h, x + y + h + 1)}
    assert sorted(got) == sorted((1, u, v) for u, v in up & across)
    assert not rows["cells"] and not rows["noded"] and not rows["hot"]
