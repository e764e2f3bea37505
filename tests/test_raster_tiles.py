"""Raster operators over tiles equal the same operator on the whole sheet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import raster, raster_tiles

SIZE, SHAPE = 32, (150, 170)


def masks():
    rng = np.random.default_rng(7)
    noise = rng.random(SHAPE) < 0.45
    strokes = np.zeros(SHAPE, bool)
    for _ in range(14):
        raster.draw(strokes, tuple(rng.integers(0, 170, 2)), tuple(rng.integers(0, 150, 2)), int(rng.integers(1, 12)))
    blob = np.zeros(SHAPE, bool)
    blob[3:120, 5:160] = True  # wide enough for several rounds
    blob[40:60, 50:52] = False
    ring = np.zeros(SHAPE, bool)
    ring[10:140, 10:160] = True
    ring[20:130, 20:150] = False
    return {1: noise, 2: strokes, 3: blob, 4: ring}


def frame(spark, sheets):
    rows = [(k, int(x), int(y)) for k, m in sheets.items() for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "sheet int, x int, y int")


def dense(df, sheets):
    out = {k: np.zeros(SHAPE, bool) for k in sheets}
    for r in df.collect():
        out[r["sheet"]][r["y"], r["x"]] = True
    return out


@pytest.fixture(scope="module")
def sheets():
    return masks()


@pytest.fixture(scope="module")
def tiles(spark, sheets):
    return raster_tiles.tiled(frame(spark, sheets), ["sheet"], SIZE).cache()


@pytest.fixture(scope="module")
def frames(spark, sheets):
    return spark.createDataFrame([(k, SHAPE[1], SHAPE[0]) for k in sheets], "sheet int, width int, height int")


def test_tiles_hold_the_pixels(sheets, tiles):
    got = dense(raster_tiles.untiled(tiles, ["sheet"], SIZE), sheets)
    assert all((got[k] == m).all() for k, m in sheets.items())


@pytest.mark.parametrize("steps", [2, 8])
def test_thinning_equals_the_whole_sheet(sheets, tiles, steps):
    got = dense(raster_tiles.untiled(raster_tiles.thinned(tiles, ["sheet"], SIZE, steps), ["sheet"], SIZE), sheets)
    assert all((got[k] == raster.thin(m)).all() for k, m in sheets.items())


def test_bridging_equals_the_whole_sheet(spark, sheets):
    thin = {k: raster.thin(m) for k, m in sheets.items()}
    thin[2][:, ::9] = False  # gaps
    tiles = raster_tiles.tiled(frame(spark, thin), ["sheet"], SIZE)
    got = dense(raster_tiles.untiled(raster_tiles.bridged(tiles, ["sheet"], 15, SIZE), ["sheet"], SIZE), sheets)
    assert all((got[k] == raster.bridge(m, 15)).all() for k, m in thin.items())


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_equal_the_whole_sheet(sheets, tiles, connectivity):
    got = {(r["sheet"], r["component"]): tuple(r)[2:] for r in raster_tiles.component_boxes(tiles, ["sheet"], connectivity, SIZE).collect()}
    want = {}
    for k, m in sheets.items():
        numbers = raster.label(m, connectivity)
        for n in range(1, numbers.max() + 1):
            ys, xs = np.nonzero(numbers == n)
            want[k, int(ys[0]) * 2**32 + int(xs[0])] = (len(ys), xs.min(), xs.max(), ys.min(), ys.max(), xs.mean(), ys.mean())
    assert got.keys() == want.keys()
    assert all(np.allclose(got[c], want[c]) for c in want)


def test_regions_equal_the_whole_sheet(spark, frames, sheets):
    wall = np.zeros(SHAPE, bool)
    wall[:, 60] = wall[70, 60:] = True
    wall[100:110, 5] = True
    walls = {1: wall, 2: sheets[2], 3: np.zeros(SHAPE, bool)}
    tiles = raster_tiles.tiled(frame(spark, walls), ["sheet"], SIZE)
    got = {}
    for r in raster_tiles.region_boxes(tiles, frames.where("sheet < 4"), ["sheet"], size=SIZE).collect():
        got.setdefault(r["sheet"], {})[r["group_id"]] = [r[c] for c in ("x_min", "x_max", "y_min", "y_max", "area")]
    for k, m in walls.items():
        free, want = raster.label(~raster.dilate(m, raster.box(5, 5)), 4), []
        for n in range(1, free.max() + 1):
            ys, xs = np.nonzero(free == n)
            want.append([int(v) for v in (xs.min(), xs.max() + 1, ys.min(), ys.max() + 1, (np.ptp(xs) + 1) * (np.ptp(ys) + 1))])
        want = [w for w in want if w[4] >= 0.02 * m.size]
        assert [got[k][i] for i in range(len(got[k]))] == sorted(want, key=lambda w: -w[4])


def test_distances_equal_the_whole_sheet(sheets, tiles, frames):
    rows = raster_tiles.distances(tiles, ["sheet"], frames, SIZE).collect()
    got = {k: np.zeros(SHAPE) for k in sheets}
    for r in rows:
        got[r["sheet"]][r["y"], r["x"]] = np.sqrt(r["square"])
    assert all(np.allclose(got[k], raster.distance_to_background(m)) for k, m in sheets.items())


def test_width_split_equals_the_whole_sheet(spark, sheets, tiles, frames):
    got = raster_tiles.split_by_width(tiles.where("sheet = 2 or sheet = 4"), ["sheet"], frames, size=SIZE).collect()
    for k in (2, 4):
        thick, slim, threshold = raster.split_by_width(sheets[k])
        mine = [r for r in got if r["sheet"] == k]
        assert {r["threshold"] for r in mine} == {threshold}
        assert {(r["y"], r["x"]) for r in mine if r["thick"]} == {tuple(p) for p in np.argwhere(thick).tolist()}
        assert {(r["y"], r["x"]) for r in mine if not r["thick"]} == {tuple(p) for p in np.argwhere(slim).tolist()}


def test_empty_and_full_sheets(spark, frames):
    empty = raster_tiles.tiled(frame(spark, {}), ["sheet"], SIZE)
    assert raster_tiles.component_boxes(empty, ["sheet"], size=SIZE).count() == 0
    assert raster_tiles.untiled(raster_tiles.thinned(empty, ["sheet"], SIZE), ["sheet"], SIZE).count() == 0
    full = raster_tiles.tiled(frame(spark, {1: np.ones(SHAPE, bool)}), ["sheet"], SIZE)
    far = raster_tiles.distances(full, ["sheet"], frames, SIZE).agg(F.min("square"), F.max("square"), F.count("*")).first()
    assert tuple(far) == (320**2, 320**2, 150 * 170)
