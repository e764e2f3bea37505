"""Map queries without SQL take every row of their tables: brute force on small fixtures."""

from collections import defaultdict

import numpy as np

from quillmap.operators import joins
from quillmap.plans import instances
from quillmap.plans import queries as maps


def test_components_of_all_line_items_equal_union_find(spark, tmp_path):
    # A hub of 200 parts, a path of 60 links, pairs on their own, and order keys of all remainders by 50.
    links = [(1, p) for p in range(1, 201)] + [(100 + i // 2, 1000 + (i + 1) // 2) for i in range(60)] + [(500 + i, 5000 + i) for i in range(30)]
    rows = [(k + 1, s, p) for k, (s, p) in enumerate(links)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = defaultdict(set)
    for s, p in links:
        near[f"s{s}"].add(f"p{p}")
        near[f"p{p}"].add(f"s{s}")
    want = {}
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        want[start] = min(seen)
    assert {r["id"]: r["component"] for r in maps.QUERIES["components_all"](spark, str(tmp_path)).collect()} == want


def test_strokes_take_every_event(spark, tmp_path):
    rows = [(10 * u + k, u, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", float((u * 31 + k * k * 7) % 90)) for u, n in ((1, 9), (2, 150), (3, 1), (4, 4)) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double")
    df.selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    of_user = defaultdict(list)
    for event, user, _, value in rows:
        of_user[user].append((value * 7 % 100, event * 13 % 75 + 0.37))
    want = {}
    for user, points in of_user.items():
        for shape in range(len(points) // 4 + 1):
            if len(part := points[4 * shape : 4 * shape + 5]) >= 2:
                want[user * 1_000_000 + shape // 16, shape % 16] = part
    got = {(r.image_id, r.shape_idx): [tuple(p) for p in r.points] for r in maps._strokes(spark, str(tmp_path)).collect()}
    assert got == want
    assert {p for part in got.values() for p in part} == {p for user, points in of_user.items() for p in points if user != 3}


def test_polynomial_fit_equals_least_squares(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(k, float(rng.integers(1, 50)), float(rng.integers(0, 11)) / 100, float(rng.uniform(900, 9e4)), float(rng.integers(0, 9)) / 100) for k in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_discount double, l_extendedprice double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    order, x, y, u, v = (np.array(c) for c in zip(*rows))
    a, b = (x - x.mean()) / 10, (y - y.mean()) * 10
    terms = np.stack([np.ones_like(a), a, b, a * a, a * b, b * b], axis=1)
    off = np.hypot(*[terms @ np.linalg.lstsq(terms, t, rcond=None)[0] - t for t in (u, v)])
    want = {part: off[order % 10 == part].mean() for part in range(10)}
    got = {r.part: r.residual for r in maps.QUERIES["poly2_fit"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-2 for k in want)


def plain_thin(mask):
    """The thinning rules, one pixel at a time."""
    img = {(y, x) for y, row in enumerate(mask) for x, v in enumerate(row) if v}
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(img)
        for turn in (0, 1):
            gone = set()
            for y, x in img:
                p = [(y + dy, x + dx) in img for dy, dx in ring]
                n, e, s, w = p[0], p[2], p[4], p[6]
                sides = not (n and e and s) and not (e and s and w) if turn == 0 else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1 and sides:
                    gone.add((y, x))
            img -= gone
        if len(img) == before:
            return img


def test_thinning_equals_plain_rules():
    import numpy as np

    from quillmap.operators import raster

    rng = np.random.default_rng(5)
    for _ in range(10):
        mask = raster.dilate(rng.random((30, 40)) < 0.03, raster.box(3, 4))
        want = np.zeros_like(mask)
        for y, x in plain_thin(mask):
            want[y, x] = True
        assert (raster.thin(mask) == raster._without_stairs(np.pad(want, 1))[1:-1, 1:-1]).all()


def test_simplify_equals_plain_recursion():
    import numpy as np

    from quillmap.operators import raster

    def plain(pts, least):
        (ax, ay), (bx, by) = pts[0], pts[-1]
        off = []
        for x, y in pts:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            off.append(np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        k = int(np.argmax(off))
        return [pts[0], pts[-1]] if off[k] <= least else plain(pts[: k + 1], least)[:-1] + plain(pts[k:], least)

    rng = np.random.default_rng(9)
    for _ in range(20):
        path = np.cumsum(rng.integers(-3, 4, (60, 2)), axis=0).tolist()
        path = [tuple(p) for k, p in enumerate(path) if k == 0 or p != path[k - 1]]
        if path[0] != path[-1]:
            assert [tuple(p) for p in raster.simplify(path, 2.0)] == plain(path, 2.0)


def test_greedy_match_equals_the_sorted_pass(spark):
    import random

    from quillmap.operators import joins

    rng = random.Random(4)
    left = [(k % 3, k, float(rng.randint(0, 400))) for k in range(120)]
    right = [(k % 3, 1000 + k, float(rng.randint(0, 400))) for k in range(90)]
    pairs = sorted((abs(p - q), a, b, k) for k, a, p in left for j, b, q in right if k == j and abs(p - q) <= 30)
    used, want = set(), set()
    for d, a, b, k in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((k, a, b, d))
    l, r = spark.createDataFrame(left, "sheet long, l long, p double"), spark.createDataFrame(right, "sheet long, r long, q double")
    got = joins.greedy_match(l, r, ["sheet"], "p", "q", "l", "r", 30.0)
    assert {tuple(x) for x in got.collect()} == want
    assert joins.greedy_match(l.limit(0), r, ["sheet"], "p", "q", "l", "r", 30.0).count() == 0


def test_robust_fit_takes_every_supplier(spark, tmp_path):
    # Supplier s has price = 3000 s * quantity + 7 s on 20 items, and one far off.
    rows = [(k, k % 7, 100 + k, s, 3000.0 * s * (2 * k + 1) + 7 * s + (1e6 if k == 20 else 0), 2.0 * k + 1) for s in range(1, 8) for k in range(21)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_suppkey: (r.slope, r.intercept, r.inliers) for r in maps.QUERIES["robust_fit"](spark, str(tmp_path)).collect()}
    assert got == {s: (3000.0 * s, 7.0 * s, 20) for s in range(1, 8)}


def test_a_long_chain_of_pairs_is_matched_in_bounded_jobs(spark):
    # Every distance is a little over the one before, so each choice waits for the last: thousands of rounds by rounds alone.
    steps = np.cumsum(1 + np.arange(10_000) * 1e-5)
    l, r = [(1, k, float(p)) for k, p in enumerate(steps[::2])], [(1, k, float(p)) for k, p in enumerate(steps[1::2])]
    df = lambda rows: spark.createDataFrame(rows, "sheet int, id int, p double")
    spark.sparkContext.setJobGroup("chain", "a long chain")
    got = {(x["l_id"], x["r_id"]) for x in joins.greedy_match(df(l), df(r), ["sheet"], "p", "p", "id", "id", 1.5).collect()}
    assert got == {(k, k) for k in range(5000)}
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 400
    spark.sparkContext.setJobGroup("tests", "")
    small = {(x["l_id"], x["r_id"]) for x in joins.greedy_match(df(l[:20]), df(r[:20]), ["sheet"], "p", "p", "id", "id", 1.5, most=5).collect()}
    assert small == {(k, k) for k in range(20)}


def test_leaders_of_a_long_chain(spark):
    n = 3000
    lines = spark.createDataFrame([(1, k, 40.0 * k, 0.0, 40.0 * k, 1.0) for k in range(n)] + [(2, k, 0.0, 1000.0 * k, 1.0, 1000.0 * k) for k in range(3)], "sheet int, line int, x1 double, y1 double, x2 double, y2 double")
    got = {(r["sheet"], r["line"]) for r in instances.leading_lines(lines, ["sheet"], "line").collect()}
    assert got == {(1, k) for k in range(0, n, 2)} | {(2, k) for k in range(3)}
    few = {r["line"] for r in instances.leading_lines(lines.where("sheet = 1 and line < 30"), ["sheet"], "line", most=3).collect()}
    assert few == set(range(0, 30, 2))
