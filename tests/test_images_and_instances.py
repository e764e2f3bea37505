"""Scans through Spark's image source, sliding windows, instance masks and merged lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.functions import ocr
from quillmap.operators import linework
from quillmap.plans import inference, instances
from quillmap.sources import annotations
from quillmap.sources.pixels import write_png


def test_jpeg_tiff_and_bmp_are_read(spark, tmp_path):
    jvm = spark._jvm
    img = jvm.java.awt.image.BufferedImage(8, 4, 1)
    for y in range(4):
        for x in range(8):
            img.setRGB(x, y, 0xC81E0A)
    for ending, kind in (("JPG", "jpg"), ("tif", "tiff"), ("bmp", "bmp")):
        assert jvm.javax.imageio.ImageIO.write(img, kind, jvm.java.io.File(f"{tmp_path}/a_{kind}.{ending}"))
    (tmp_path / "p.png").write_bytes(write_png(np.full((2, 3, 3), 7)))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    got = {r.image_id: r for r in annotations.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a_jpg", "a_tiff", "a_bmp", "p"}
    for name in ("a_tiff", "a_bmp"):
        assert (got[name].width, got[name].height, got[name].channels) == (8, 4, 3) and bytes(got[name].data[:3]) == b"\xc8\x1e\x0a"
    assert abs(int(got["a_jpg"].data[0]) - 0xC8) < 8
    with pytest.raises(Exception, match="cannot decode"):
        annotations.read_images(spark, str(tmp_path), strict=True).collect()


def plain_blend(img, model, classes, size, stride):
    h, w = img.shape[:2]
    rows, cols = max(1, -(-(h - size) // stride) + 1), max(1, -(-(w - size) // stride) + 1)
    big = np.empty(((rows - 1) * stride + size, (cols - 1) * stride + size, 3), np.uint8)
    big[:] = inference.FILL
    big[:h, :w] = img
    total, weight, one = np.zeros((*big.shape[:2], classes)), np.zeros(big.shape[:2]), inference.linear_weights(size)
    for r in range(rows):
        for c in range(cols):
            at = np.s_[r * stride : r * stride + size, c * stride : c * stride + size]
            total[at] += model(big[at][None].astype(np.float32) / 255)[0] * one[:, :, None]
            weight[at] += one
    return (total / np.maximum(weight, 1e-6)[:, :, None]).argmax(axis=2)[:h, :w]


def test_sliding_window_equals_whole_image(spark):
    rng = np.random.default_rng(3)
    images = {"a": rng.integers(0, 256, (70, 45, 3), dtype=np.uint8), "b": rng.integers(0, 256, (20, 20, 3), dtype=np.uint8), "c": rng.integers(0, 256, (32, 64, 3), dtype=np.uint8)}
    df = spark.createDataFrame([(k, v.shape[1], v.shape[0], 3, bytearray(v.tobytes())) for k, v in images.items()], "image_id string, width int, height int, channels int, data binary")

    def model():
        # Depends on the place within the tile, so that weights matter.
        return lambda x: np.stack([x[..., 0], x[..., 1] * np.linspace(0.5, 1.5, x.shape[1])[None, :, None], x[..., 2]], axis=-1)

    for band_rows, stride in ((4, 16), (1, 16), (2, 8)):
        got = {k: np.full(v.shape[:2], 99) for k, v in images.items()}
        for r in inference.sliding_window(df, model, 3, size=32, stride=stride, band_rows=band_rows).collect():
            got[r.image_id][r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
        for k, v in images.items():
            assert (got[k] == plain_blend(v, model(), 3, 32, stride)).all()
    w = inference.linear_weights(16)
    assert (w[0, 0], w[1, 3], w[7, 7], w[0, 7]) == (np.float32(0.2), np.float32(0.8), np.float32(1), np.float32(0.2))


def test_instances_become_lines(spark):
    px, rows = [], []

    def add(k, cls, conf, dots):
        rows.append(("s", k, cls, conf))
        px.extend(("s", k, x + dx, y + dy) for x, y in dots for dx in (0, 1, 2) for dy in (0, 1, 2))

    add(1, 0, 0.9, [(50 + y // 20, y) for y in range(200)])
    add(2, 0, 0.9, [(53 + y // 20, y) for y in range(200)])
    add(3, 0, 0.4, [(150, y) for y in range(200)])
    add(4, 0, 0.9, [(300 + y // 20, y) for y in range(200)])
    add(5, 0, 0.9, [(x, 30) for x in range(100, 180)])
    add(6, 1, 0.9, [(x, 100 + (x - 100) ** 2 // 400) for x in range(20, 180)])
    add(7, 1, 0.9, [(250 + y // 4, y) for y in range(100)])
    pixels = spark.createDataFrame(sorted(set(px)), "image_id string, instance_id int, x int, y int")
    found = spark.createDataFrame(rows, "image_id string, instance_id int, class_id int, confidence double")
    lines, arcs = instances.instance_lines(pixels, found, 400, 220)
    assert sorted(r.instance_id for r in lines.collect()) == [1, 4]
    arc = arcs.collect()
    assert [r.instance_id for r in arc] == [6] and 3 <= len(arc[0].points) < 30


def test_merged_lines_break_at_branchings(spark):
    def edge(a, b, k="x"):
        return (k, tuple(map(float, a)), tuple(map(float, b)))

    ring = [(20, 0), (22, 0), (22, 2), (20, 2)]
    edges = [edge((i, 0), (i + 1, 0)) for i in range(6)] + [edge((3, 0), (3, 1)), edge((3, 1), (3, 2))] + [edge(ring[i], ring[(i + 1) % 4]) for i in range(4)] + [edge((0, 0), (1, 0), "y"), edge((1, 0), (0, 0))]
    df = spark.createDataFrame(edges, "k string, a struct<x:double,y:double>, b struct<x:double,y:double>")
    got = {(r.k, tuple((p.x, p.y) for p in r.points)) for r in linework.merged(df, ["k"]).collect()}
    assert {(k, frozenset(p[:1] + p[-1:]), len(p)) for k, p in got} == {
        ("x", frozenset({(0.0, 0.0), (3.0, 0.0)}), 4), ("x", frozenset({(3.0, 0.0), (6.0, 0.0)}), 4), ("x", frozenset({(3.0, 0.0), (3.0, 2.0)}), 3), ("x", frozenset({(20.0, 0.0)}), 5), ("y", frozenset({(0.0, 0.0), (1.0, 0.0)}), 2),
    }
    assert linework.merged(df.limit(0), ["k"]).count() == 0
    short = linework.clean(linework.merged(df, ["k"]), ["k"], 100, 100, least=3.5).collect()
    assert sorted(len(r.points) for r in short) == [3]
    square = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)],)], "points array<struct<x:double,y:double>>")
    assert linework.mismatch(square, square.limit(0)) == 4.0 and linework.mismatch(square, square) == 0


def test_ocr_items_without_box_or_confidence(spark):
    rows = [("a", 0.9, [0.0, 0.0, 10.0, 4.0], 2.0), (None, None, [0.0, 0.0, 10.0, 1.0, 8.0, 6.0], None), ("low", 0.34, [0.0, 0.0, 1.0, 1.0], 1.0), ("no", 0.9, None, 1.0), ("odd", 0.9, [1.0, 2.0, 3.0], 1.0), ("nil", 0.9, [], 1.0)]
    df = spark.createDataFrame(rows, "text string, conf double, box array<double>, scale double").withColumn("w", F.lit("mine"))
    got = {tuple(r) for r in ocr.normalised_items(df).collect()}
    assert got == {("a", 2.5, 1.0, 5.0, 2.0, 0.9), ("", 5.0, 3.0, 10.0, 6.0, 0.5)}
