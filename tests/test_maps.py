"""Hand-computed cases of the map operators, and properties."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.functions import geometry as g
from quillmap.functions import text as t
from quillmap.operators import cluster, fit, gcp, joins, linework, metrics, ordered, raster, topology
from quillmap.plans import control_points, mask_lines
from quillmap.sources import annotations, pixels, sinks
from quillmap.streaming import gaps


def pts(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def groups(df, key="cluster", value="x"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r[value])
    return sorted(map(sorted, out.values()))


def test_gap_clusters(spark):
    df = frame(spark, [(1, 10.0), (1, 40.0), (1, 71.0)], "k int, x double")
    assert groups(cluster.gap_clusters(df, ["k"], F.col("x"), [], 30)) == [[10, 40], [71]]
    df = frame(spark, [(1, 0.0), (1, 49.0), (1, 99.0)], "k int, x double")
    assert groups(cluster.gap_clusters(df, ["k"], F.col("x"), [], 50, strict=True)) == [[0, 49], [99]]


@pytest.mark.parametrize(("rows", "want"), [([(0, 5), (80, 1), (170, 2)], [0, 170]), ([(0, 1), (80, 5), (170, 2)], [80])])
def test_dedup_fold(spark, rows, want):
    df = frame(spark, [(1, i, float(x), float(s)) for i, (x, s) in enumerate(rows)], "k int, i int, x double, s double")
    once = cluster.dedup_fold(df, ["k"], F.col("x"), F.col("s"), ["i"], 100)
    assert sorted(r.x for r in once.collect()) == want
    assert sorted(r.x for r in cluster.dedup_fold(once, ["k"], F.col("x"), F.col("s"), ["i"], 100).collect()) == want


def test_dedup_fold_equals_a_plain_fold(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), i, float(x), float(s)) for i, (k, x, s) in enumerate(zip(rng.integers(0, 20, 600), rng.integers(0, 3000, 600), rng.integers(0, 9, 600), strict=True))]
    want = []
    for k in range(20):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if not kept or r[2] - kept[-1][2] > 100:
                kept.append(r)
            elif r[3] > kept[-1][3]:
                kept[-1] = r
        want += kept
    got = cluster.dedup_fold(frame(spark, rows, "k int, i int, x double, s double"), ["k"], F.col("x"), F.col("s"), ["i"], 100)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_degrees(spark):
    df = frame(spark, [(1, x) for x in (0, 1, 2, 3)], "k int, x int").withColumn("a", F.lit(None).cast("map<int,double>"))
    got = ordered.assign_degrees(df, ["k"], ["x"], t.anchors(F.lit("v:0=100,2=108;h:1=2"), "v")).orderBy("x").collect()
    assert [(r.degree, r.confirmed) for r in got] == [(100, True), (104, False), (108, True), (112, False)]


def test_intersection(spark):
    v = frame(spark, [(1, pts((100, 0), (100, 1000)), 92.0), (1, pts((300, 0), (300, 1000)), 96.0)], "k int, points array<struct<x:double,y:double>>, degree double")
    h = frame(spark, [(1, pts((0, 500), (200, 500)), 52.0)], "k int, points array<struct<x:double,y:double>>, degree double")
    got = gcp.intersections(v, h, ["k"]).collect()
    assert [(r.lon, r.lat, r.pixel_x, r.pixel_y) for r in got] == [(92.0, 52.0, 100.0, 500.0)]
    assert sinks.control_point_rows(gcp.intersections(v, h, ["k"])).first().sourceY == -500.0


def test_clip(spark):
    rows = [(0, -10.0, 5.0, 20.0, 5.0), (1, 20.0, 20.0, 30.0, 30.0)]
    df = frame(spark, rows, "i int, a double, b double, c double, d double")
    got = [r.c for r in df.select("i", g.clipped(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("c")).orderBy("i").collect()]
    assert tuple(got[0]) == (0, 5, 10, 5) and got[1] is None


def test_clip_property(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(pts(*rng.uniform(-20, 40, (6, 2))),) for _ in range(200)], "p array<struct<x:double,y:double>>")
    pieces = df.select(F.explode(g.clipped_polyline(F.col("p"), F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(15.0))).alias("q")).collect()
    assert pieces and all(-1e-9 <= p.x <= 20 + 1e-9 and -1e-9 <= p.y <= 15 + 1e-9 for r in pieces for p in r.q)


def test_smooth(spark):
    xs = [0, 1, 4, 9, 16, 25, 36]
    df = frame(spark, [(1, i, float(x)) for i, x in enumerate(xs)], "k int, i int, x double")
    assert [r.x_smooth for r in ordered.smooth(df, ["k"], ["i"], ["x"], 5).orderBy("i").collect()] == [0, 1, 6, 11, 18, 25, 36]
    assert [r.x_smooth for r in ordered.smooth(df.where("i < 5"), ["k"], ["i"], ["x"], 5).orderBy("i").collect()] == xs[:5]


def test_metrics(spark):
    df = frame(spark, [(1, 0, 0), (1, 1, 1), (1, 1, 2), (1, 2, 2)], "image int, truth int, pred int")
    got = {(r.image, r.cls): r for r in metrics.scores(metrics.confusion(df, ["image"])).collect()}
    for key in ((1, 1), (None, 1)):
        r = got[key]
        assert (r.precision, r.recall, r.iou, round(r.dice, 6)) == (1, 0.5, 0.5, round(2 / 3, 6))
    assert (got[1, 2].precision, got[1, 2].recall) == (0.5, 1)


def test_consensus(spark):
    df = frame(spark, [(1, 0, 100.0), (1, 1, 104.0), (1, 2, 108.0), (1, 3, 113.0), (2, 5, 7.0)], "k int, i int, d double")
    got = fit.progression_consensus(df, ["k"], "i", "d", 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 100.0), (1, 1, 104.0), (1, 2, 108.0), (2, 5, 7.0)]


def test_ocr_text(spark):
    df = frame(spark, [("1O，I b 。x",), ("a12.5b7.",), ("59 60 150 151",)], "s string")
    got = df.select(t.repaired(F.col("s")).alias("r"), t.numbers(F.col("s")).alias("n"), t.degree_candidates(F.translate("s", " ", "x"), "lon").alias("lon")).collect()
    assert got[0].r == "10.16.x" and got[1].n == [12.5, 7.0] and got[2].lon == [60.0, 150.0]


def test_tiles(spark):
    df = frame(spark, [(h, 512, h) for h in (256, 257, 512, 513, 768)], "id int, width int, height int")
    count = lambda guarded: {r.id: r.n for r in metrics.tile_grid(df, guarded=guarded).groupBy("id").agg(F.countDistinct("row").alias("n")).collect()}
    assert count(False) == {257: 1, 512: 1, 513: 2, 768: 2} and count(True) == {256: 1, 257: 1, 512: 1, 513: 2, 768: 2}


def test_blend_weight(spark):
    df = frame(spark, [(0, 0), (0, 1), (0, 3), (3, 3)], "r int, c int")
    assert [round(r[0], 9) for r in df.select(metrics.linear_weight(F.col("r"), F.col("c"), 8)).collect()] == [round(v, 9) for v in (1 / 3, 2 / 3, 1 / 3, 1)]


def test_insets(spark):
    box = frame(spark, [(1, 0.0, 100.0, 0.0, 100.0)], "k int, x_min double, x_max double, y_min double, y_max double")
    lines = frame(spark, [("a", 1, 50.0, 50.0, 0.0, 90.0), ("b", 1, 40.0, 60.0, 0.0, 90.0)], "n string, k int, x_min double, x_max double, y_min double, y_max double")
    assert [r.n for r in joins.inset_anti(lines, box, ["k"]).collect()] == ["a"]


def test_half_even(spark):
    assert tuple(spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(0.25), 1)).first()) == (2.0, 0.2)


def test_shape_order(spark):
    rows = [("i", 0, "b2", pts((0, 1))), ("i", 1, "b1", pts((0, 9))), ("i", 2, "other", pts((0, 0))), ("i", 3, "b1", pts((0, 3)))]
    df = frame(spark, rows, "image_id string, shape_idx int, label string, points array<struct<x:double,y:double>>")
    got = sinks.sorted_shapes(df, {"b1": 0, "b2": 1}).orderBy("shape_idx").collect()
    assert [(r.label, r.points[0].y) for r in got] == [("b1", 3), ("b1", 9), ("b2", 1), ("other", 0)] and all(r.changed for r in got)


def test_bucket_joins_make_no_nested_loops(spark):
    a = spark.range(100).select(F.lit(1).alias("k"), "id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    b = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("rid"), (F.col("id") + 0.4).alias("tx"), F.lit(0.0).alias("ty"))
    out = joins.radius_pairs(a, b, ["k"], 1.5, "x", "y", "tx", "ty")
    assert out.count() == sum(abs(i - j - 0.4) <= 1.5 for i in range(100) for j in range(100))
    for df in (out, joins.interval_overlap(a.withColumn("z", F.col("x") + 3), b.withColumn("tz", F.col("tx") + 2), ["k"], "x", "z", "tx", "tz", 10.0)):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_facing_ends_and_topology(spark):
    lines = frame(spark, [(1, 1, 1, pts((0, 0), (10, 0))), (1, 2, 1, pts((13, 0), (30, 0))), (1, 3, 1, pts((100, 100), (120, 100)))], "image_id int, line_id int, level int, points array<struct<x:double,y:double>>")
    frames = frame(spark, [(1, -0.5, 400.0, -300.0, 300.0)], "image_id int, x_min double, x_max double, y_min double, y_max double")
    got = {(r.line_id, r.side): r.status for r in topology.gaps(lines, frames).collect()}
    assert got == {(1, "start"): "connected", (1, "end"): "snappable", (2, "start"): "snappable", (2, "end"): "open", (3, "start"): "open", (3, "end"): "open"}
    near = joins.facing_ends(topology.end_points(lines), ["image_id"], 15.0, 90.0).collect()
    assert {(r.line_id, r.side, r.o_line_id) for r in near} == {(1, "end", 2), (2, "start", 1)}


def test_plane_fit_and_order(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in rng.uniform(60, 120, (40, 2))]
    df = frame(spark, rows, "lon double, lat double").withColumns({"pixel_x": 3 + 2 * F.col("lon") - F.col("lat") + 0.01 * F.col("lon") * F.col("lat"), "pixel_y": 5 - F.col("lat") ** 2 * 0.02})
    model = fit.plane_fit(df)
    assert fit.plane_residuals(df, model).agg(F.max("residual")).first()[0] < 1e-6
    bent = df.withColumn("pixel_x", F.col("pixel_x") + F.sin("lon") * 3)
    saved = fit.plane_residuals(bent, fit.plane_fit(bent)).withColumnRenamed("residual", "saved_residual").cache()
    assert fit.detect_order(saved) == 2
    with pytest.raises(ValueError):
        fit.plane_fit(df.limit(5))
    with pytest.raises(ValueError):
        fit.detect_order(df.withColumn("saved_residual", F.lit(0.0)))


def test_dissolve_and_two_levels(spark):
    ring = lambda x: pts((x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0))
    df = frame(spark, [("g1", ring(0)), ("g1", ring(1)), ("g2", ring(2))], "g string, points array<struct<x:double,y:double>>")
    outer, inner = linework.two_levels(linework.canonical_edges(df, ["g"]), "g")
    assert outer.count() == 8 and [(r.a.x, r.b.x) for r in inner.collect()] == [(2.0, 2.0)]
    assert df.select(linework.ring_area()).first()[0] == 1.0


def test_components(spark):
    got = {r.id: r.component for r in linework.components(frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0


def test_annotation_round_trip(spark, tmp_path):
    doc = {"version": "5", "flags": {}, "imagePath": "a.png", "imageData": None, "imageHeight": 10, "imageWidth": 20, "shapes": [{"label": "vertical_line", "points": [[5, 9], [5, 0]], "group_id": None, "shape_type": "line", "flags": {}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "._a.json").write_text("x")
    images, shapes, rejected = annotations.read_annotations(spark, str(tmp_path))
    assert [r.image_id for r in rejected.collect()] == ["bad"]
    line = gcp.grid_lines(shapes).first()
    assert line.kind == "v" and line.points[0].y == 0 and line.span == 9
    out = json.loads(sinks.annotation_documents(images, shapes).first().json)
    assert out["imageHeight"] == 10 and out["shapes"][0]["points"] == [[5.0, 9.0], [5.0, 0.0]] and out["imageData"] is None
    assert sinks.yolo_lines(shapes, images, {"vertical_line": 0}).first().value == "0 0.250000 0.900000 0.250000 0.000000"


def test_control_point_files(spark, tmp_path):
    points = frame(spark, [("i", 60.0 + k, 30.0 + k % 3, 10.0 * k, 20.0 * k) for k in range(7)], "image_id string, lon double, lat double, pixel_x double, pixel_y double")
    sinks.write_control_points(points, str(tmp_path / "p"))
    back = annotations.read_control_points(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r)[1:] for r in points.collect())
    with pytest.raises(ValueError):
        annotations.read_control_points(spark, str(tmp_path / "p"), least=8)


def test_images(spark, tmp_path):
    img = np.zeros((6, 8, 3), np.uint8)
    img[1, 2], img[3, 4], img[5, 7] = (255, 0, 0), (0, 255, 0), (255, 165, 0)
    (tmp_path / "m.png").write_bytes(pixels.write_png(img))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "g.pgm").write_bytes(b"P5 2 1 255\n\x00\x05")
    got = annotations.read_images(spark, str(tmp_path))
    assert {r.image_id: (r.width, r.height, r.channels) for r in got.collect()} == {"m": (8, 6, 3), "g": (2, 1, 1)}
    px = annotations.mask_pixels(got.where("image_id = 'm'")).collect()
    assert {(r.x, r.y, r.cls) for r in px} == {(2, 1, 1), (4, 3, 2), (7, 5, 3)}
    assert annotations.list_images(spark, str(tmp_path)).count() == 2
    assert (pixels.read_png(pixels.write_png(img)) == img).all()


def test_features(spark, tmp_path):
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}}, {"type": "Feature", "properties": {}, "geometry": None}]}))
    r = annotations.read_features(spark, str(tmp_path)).collect()
    assert len(r) == 1 and len(r[0].rings) == 2 and r[0].properties["NAME"] == "x" and r[0].rings[1][0].x == 5


def grid_mask(w=600, h=500):
    v = [[(100 + 120 * i + 4 * i, 20), (100 + 120 * i - 4 * i, 480)] for i in range(4)]
    h_ = [[(40 + 26 * k, 90 + 110 * i + 0.0004 * (40 + 26 * k - 300) ** 2) for k in range(20)] for i in range(3)]
    return w, h, v, h_


def test_lines_from_masks(spark):
    w, h, v, arcs = grid_mask()
    canvas = raster.rasterise([(np.array(p), 1) for p in v], h, w)
    ys, xs = np.nonzero(canvas)
    images = frame(spark, [("i", 0, w, h)], "image_id string, group_id int, width int, height int")
    px = frame(spark, [("i", 0, int(x), int(y)) for x, y in zip(xs, ys, strict=True)], "image_id string, group_id int, x int, y int")
    got = sorted((r.points for r in mask_lines.meridians(px, images).collect()), key=lambda p: p[0].x)
    assert len(got) == 4 and all(abs(p[0].x - q[0][0]) < 4 and abs(p[1].x - q[1][0]) < 4 for p, q in zip(got, v, strict=True))
    canvas = raster.rasterise([(np.array(p), 2) for p in arcs], h, w)
    ys, xs = np.nonzero(canvas)
    px = frame(spark, [("i", 0, int(x), int(y)) for x, y in zip(xs, ys, strict=True)], "image_id string, group_id int, x int, y int")
    got = mask_lines.parallels(px, images).orderBy("line_id").collect()
    assert len(got) == 3 and all(len(r.points) == 30 for r in got)
    for i, r in enumerate(got):
        assert all(abs(p.y - (90 + 110 * i + 0.0004 * (p.x - 300) ** 2)) < 4 for p in r.points)


def test_fragments(spark):
    images = frame(spark, [("i", 400)], "image_id string, height int")
    parts = [pts(*[(100, y) for y in range(0, 200, 10)]), pts(*[(102, y) for y in range(210, 390, 10)]), pts(*[(300, y) for y in range(0, 50, 10)])]
    df = frame(spark, [("i", k, p) for k, p in enumerate(parts)], "image_id string, fragment_id int, points array<struct<x:double,y:double>>")
    assert mask_lines.fragment_meridians(df, images).count() == 1
    parts = [pts(*[(x, 50) for x in range(0, 200, 10)]), pts(*[(x, 60) for x in range(220, 400, 10)]), pts(*[(x, 300) for x in range(0, 300, 10)]), pts(*[(x, 390) for x in range(0, 30, 10)])]
    df = frame(spark, [("i", k, p) for k, p in enumerate(parts)], "image_id string, fragment_id int, points array<struct<x:double,y:double>>")
    got = mask_lines.fragment_parallels(df, images).collect()
    assert len(got) == 2 and all(len(r.points) == 30 for r in got)
    assert mask_lines.fragment_meridians(df.limit(0), images).count() == 0


def test_annotations_to_control_points(spark):
    shapes = [("i", 0, "vertical_line", "line", pts((100, 900), (100, 0))), ("i", 1, "vertical_line", "line", pts((300, 0), (300, 900))), ("i", 2, "vertical_line", "line", pts((305, 0), (305, 500))), ("i", 3, "horizontal_arc", "linestrip", pts((0, 200), (400, 210))), ("i", 4, "horizontal_arc", "linestrip", pts((0, 600), (400, 600))), ("i", 5, "horizontal_arc", "line", pts((0, 1), (2, 3)))]
    df = frame(spark, shapes, "image_id string, shape_idx int, label string, shape_type string, points array<struct<x:double,y:double>>")
    got = control_points.control_points(df, annotations.read_anchors(spark, {"i": "v:0=90,1=94;h:0=50,1=46"})).collect()
    assert sorted((r.lon, r.lat, r.pixel_x, r.pixel_y) for r in got) == [(90, 46, 100, 600), (90, 50, 100, 202.5), (94, 46, 300, 600), (94, 50, 300, 207.5)]


def test_ocr_anchors(spark):
    items = frame(spark, [("i", "92°E", 100.0, 5.0, 0.9), ("i", "96", 210.0, 5.0, 0.9), ("i", "1OO", 300.0, 5.0, 0.9), ("i", "77", 305.0, 5.0, 0.2), ("i", "64", 500.0, 5.0, 0.9)], "image_id string, text string, cx double, cy double, conf double")
    lines = frame(spark, [("i", k, 100.0 + 100 * k) for k in range(3)], "image_id string, index int, pos double")
    boxes = frame(spark, [("i", 490.0, 510.0, 0.0, 10.0)], "image_id string, x_min double, x_max double, y_min double, y_max double")
    assert sorted(tuple(r)[1:] for r in control_points.ocr_anchors(items, lines, boxes, "lon").collect()) == [(0, 92.0), (1, 96.0), (2, 100.0)]


def test_gap_sessions_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = gaps.gap_sessions(events, ["user_id"], "ts").count()
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = gaps.gap_sessions(stream, ["user_id"], "ts").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert batch - 200 <= spark.table("sessions").count() <= batch


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25), st.floats(0.5, 6))
def test_simplify_stays_near(path, tolerance):
    p = np.array(path, float)
    s = raster.simplify(p, tolerance)
    assert (s[0] == p[0]).all() and (s[-1] == p[-1]).all()
    for q in p:
        away = min([math.dist(q, s[0])] + [_to_segment(q, a, b) for a, b in zip(s[:-1], s[1:], strict=True)])
        assert away <= tolerance + 1e-6


def _to_segment(q, a, b):
    d = b - a
    n = float(d @ d)
    return math.dist(q, a + max(0.0, min(1.0, float((q - a) @ d) / n)) * d) if n else math.dist(q, a)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_thinning_keeps_components(seed):
    rng = np.random.default_rng(seed)
    m = np.zeros((50, 60), bool)
    for _ in range(4):
        raster.draw(m, tuple(rng.integers(3, 47, 2)), tuple(rng.integers(3, 47, 2)), int(rng.choice([1, 3, 5])))
    sk = raster.thin(m)
    assert raster.label(sk).max() == raster.label(m).max() and not (sk & ~m).any()


def test_raster_kernels():
    m = np.zeros((40, 60), bool)
    m[5:30, 10:50] = True
    assert raster.distance_to_background(m)[17, 30] == 13 and raster.label(m, 4).max() == 1
    assert (raster.opened(m, raster.box(3, 3)) == m).all() and (raster.closed(m, raster.ellipse(5)) == m).all()
    assert raster.edges(np.array([[0, 0, 0], [0, 0, 255], [0, 255, 255]]), "x")[1, 1] == (255 * 3) % 256
    assert [r["area"] for r in raster.regions(400, 400, [np.array([[200, 0], [200, 399]])])] == sorted([r["area"] for r in raster.regions(400, 400, [np.array([[200, 0], [200, 399]])])], reverse=True)
    assert len(raster.regions(400, 400, [np.array([[200, 0], [200, 399]])])) == 2 and raster.regions(10, 10, [])[0]["area"] == 100
    joined = raster.merge_closest([np.array([[0, 0], [10, 0]]), np.array([[30, 0], [12, 0]]), np.array([[900, 900], [901, 900]])])
    assert sorted(map(len, joined)) == [2, 4]
    ends = raster.chain([np.array([[0, 0], [10, 0]]), np.array([[14, 0], [30, 0]]), np.array([[30, 4], [10, 4]])], 6, 90)
    assert sorted(map(len, ends)) == [2, 4]
    assert set(map(tuple, raster.outline(m)[0])) >= {(10, 5), (49, 5), (49, 29), (10, 29)}
    sk = np.zeros((20, 40), bool)
    sk[10, 2:18] = True
    sk[2:18, 24] = True
    assert raster.label(raster.bridge(sk, 15)).max() == 1


def test_colours(spark):
    from quillmap.functions import colour

    df = frame(spark, [(255, 0, 255), (255, 255, 255), (0, 0, 0), (0, 255, 0)], "r int, g int, b int")
    light, a, b = colour.lab(F.col("r"), F.col("g"), F.col("b"))
    got = df.select(F.round(light), F.round(a), F.round(b), colour.is_band(F.col("r"), F.col("g"), F.col("b")).alias("band")).collect()
    assert [tuple(r) for r in got] == [(154.0, 98.0, -61.0, True), (255.0, 0.0, 0.0, False), (0.0, 0.0, 0.0, False), (224.0, -86.0, 83.0, False)]


def test_more_kernels(spark):
    m = np.zeros((120, 200), bool)
    raster.draw(m, (10, 30), (190, 30), 15)
    raster.draw(m, (10, 80), (190, 80), 3)
    thick, thin_, level = raster.split_by_width(m)
    assert thick[20:40].any() and not (thick & thin_).any() and (thick | thin_).any() and 1 < level < 8
    assert raster.band_region(m, least=500).any() and not raster.band_region(np.zeros((30, 30), bool)).any()
    grey = np.full((300, 400), 255)
    grey[150:153, 40:390] = 0
    assert [s["orientation"] for s in raster.straight_splitters(grey)] == ["horizontal"]
    assert len(raster.mask_polygons(m)) == 2 and len(raster.splitter_lines(m)) >= 1 and raster.splitter_lines(np.zeros((9, 9), bool)) == []
    light = np.full((10, 10), 200)
    light[5] = 20
    assert raster.dark_pixels(light, np.ones((10, 10), bool)).sum() in (0, 10)
    px = frame(spark, [("i", x, 5) for x in range(30)], "image_id string, x int, y int")
    tiles = frame(spark, [("i", 0, 0, 0, 0), ("i", 0, 1, 16, 0), ("i", 5, 5, 80, 80)], "image_id string, row int, col int, x0 int, y0 int")
    assert sorted(r.col for r in metrics.informative_tiles(px, tiles, ["image_id"], 32, 14).collect()) == [0, 1]


def test_paths_are_joined_in_order():
    # The second is in reach of the first, the third, which is closer to the second, only of both together.
    paths = [np.array([[0, 0], [10, 0]]), np.array([[100, 0], [15, 0]]), np.array([[101, 0], [120, 0]]), np.array([[300, 5], [302, 5]]), np.array([[-4, 0], [-9, 0]])]
    got = raster.merge_closest(paths, 6.0)
    assert [p[:, 0].tolist() for p in got] == [[120, 101, 100, 15, 10, 0, -4, -9], [300, 302]]
    assert raster.merge_closest([], 6.0) == []


def test_patches_lie_around_foreground_half_the_time(spark):
    px = spark.createDataFrame([(1, 500, 300), (1, 500, 300), (1, 501, 301)], "image_id int, x int, y int")
    images = spark.createDataFrame([(1, 1000, 800), (2, 1000, 800), (3, 20, 30)], "image_id int, width int, height int")
    got = metrics.biased_patches(px, images, ["image_id"], 64, 200).collect()
    near = [r for r in got if r.image_id == 1 and r.x0 in (468, 469) and r.y0 in (268, 269)]
    assert 70 < len(near) < 130 and len({(r.x0, r.y0) for r in near}) == 2
    assert len({r.x0 for r in got if r.image_id == 2}) > 150 and all(0 <= r.x0 < 936 and 0 <= r.y0 < 736 for r in got if r.image_id == 2)
    assert {(r.x0, r.y0) for r in got if r.image_id == 3} == {(0, 0)} and len(got) == 600
