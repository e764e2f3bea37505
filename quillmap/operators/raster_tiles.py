"""Raster operators over tiles, so that no sheet, however large, meets in one task.

A mask is a table of tiles (keys, ti, tj, bits): squares of `size` pixels packed eight to a byte; tiles without foreground
have no row. Local operators get a tile with a halo of its neighbours' pixels and keep the tile's own; iterated ones do as
many steps in a round as the halo carries. Components are found in each tile, and joined by the pixels that face each other
across its border. Distances run down bands of columns first, then along bands of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, materialise
from . import raster
from .fit import width_threshold
from .linework import components

SIZE = 256
#: Thinning steps of one round; a step needs two pixels of halo.
STEPS = 8


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _pack(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _unpack(bits: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)


def _rows(table: pa.Table | pa.RecordBatch, keys: Sequence[str], n: int, row: int = 0) -> list[pa.Array]:
    """The keys of a group, or of one row of a batch, n times."""
    return [pa.array([table.column(k)[row].as_py()] * n, table.column(k).type) for k in keys]


def tiled(pixels: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """(keys, ti, tj, bits) of foreground pixels (x, y); a pixel that repeats counts once."""
    keys = list(keys)

    def pack(table: pa.Table) -> pa.Table:
        mask = np.zeros((size, size), bool)
        mask[table.column("y").to_numpy() % size, table.column("x").to_numpy() % size] = True
        return pa.table([*_rows(table, [*keys, "ti", "tj"], 1), pa.array([_pack(mask)])], names=[*keys, "ti", "tj", "bits"])

    at = lambda c: F.floor(F.col(c) / size).cast("int")
    rows = pixels.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), at("y").alias("ti"), at("x").alias("tj"))
    return rows.groupBy(*keys, "ti", "tj").applyInArrow(pack, f"{_kinds(pixels, keys)}, ti int, tj int, bits binary")


def untiled(tiles: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """(keys, x, y) of the foreground."""
    keys = list(keys)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                y, x = np.nonzero(_unpack(batch.column("bits")[k].as_py(), size, size))
                y, x = y + size * batch.column("ti")[k].as_py(), x + size * batch.column("tj")[k].as_py()
                yield pa.RecordBatch.from_arrays([*_rows(batch, keys, len(x), k), pa.array(x, pa.int64()), pa.array(y, pa.int64())], [*keys, "x", "y"])

    return tiles.select(*keys, "ti", "tj", "bits").mapInArrow(spread, f"{_kinds(tiles, keys)}, x long, y long")


def with_halo(tiles: DataFrame, keys: Sequence[str], halo: int, kernel: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]], size: int = SIZE, spreads: bool = False) -> DataFrame:
    """(keys, ti, tj, bits, changed): what a kernel makes of each tile and `halo` pixels around it.

    The kernel takes a window of size + 2 halo pixels, background where there is none, and returns the new window, of which
    the tile's part is kept, and an earlier state or None: changed tells whether the tile differs from that. Only the strips
    that a neighbour needs are sent, and none that are empty. With `spreads`, tiles that were empty get rows if the kernel
    puts foreground there.
    """
    keys, reach, wide = list(keys), -(-halo // size), size + 2 * halo
    kinds = _kinds(tiles, keys)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mask = _unpack(batch.column("bits")[k].as_py(), size, size)
                ti, tj = batch.column("ti")[k].as_py(), batch.column("tj")[k].as_py()
                out = []
                for di in range(-reach, reach + 1):
                    for dj in range(-reach, reach + 1):
                        # The part of this tile that lies in the window of the tile di down and dj right, by that tile's corner.
                        y0, y1 = max(-halo, -di * size), min(size + halo, (1 - di) * size)
                        x0, x1 = max(-halo, -dj * size), min(size + halo, (1 - dj) * size)
                        part = mask[y0 + di * size : y1 + di * size, x0 + dj * size : x1 + dj * size]
                        if part.any() or not (di or dj):
                            out.append((ti + di, tj + dj, y0 + halo, y1 + halo, x0 + halo, x1 + halo, not (di or dj), _pack(part)))
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 6 + [pa.bool_(), pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays([*_rows(batch, keys, len(out), k), *arrays], [*keys, "ti", "tj", "y0", "y1", "x0", "x1", "own", "part"])

    def run(table: pa.Table) -> pa.Table:
        window, own = np.zeros((wide, wide), bool), False
        for r in table.select(["y0", "y1", "x0", "x1", "own", "part"]).to_pylist():
            window[r["y0"] : r["y1"], r["x0"] : r["x1"]] = _unpack(r["part"], r["y1"] - r["y0"], r["x1"] - r["x0"])
            own |= r["own"]
        names, inner = [*keys, "ti", "tj", "bits", "changed"], (slice(halo, halo + size),) * 2
        bits, changed = [], []
        if own or spreads:
            new, before = kernel(window)
            if own or new[inner].any():
                bits, changed = [_pack(new[inner])], [before is not None and bool((new[inner] != before[inner]).any())]
        return pa.table([*_rows(table, [*keys, "ti", "tj"], len(bits)), pa.array(bits, pa.binary()), pa.array(changed, pa.bool_())], names=names)

    sent = tiles.select(*keys, "ti", "tj", "bits").mapInArrow(strips, f"{kinds}, ti int, tj int, y0 int, y1 int, x0 int, x1 int, own boolean, part binary")
    return sent.groupBy(*keys, "ti", "tj").applyInArrow(run, f"{kinds}, ti int, tj int, bits binary, changed boolean")


def thinned(tiles: DataFrame, keys: Sequence[str], size: int = SIZE, steps: int = STEPS) -> DataFrame:
    """Tiles of the skeleton that raster.thin() gives for the whole sheet.

    A round does `steps` steps and is repeated while the last one took anything anywhere; rounds grow with the width of the
    strokes, not with the sheet. The corners of stairs go in one more pass.
    """

    def some(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        img = np.pad(window.astype(np.uint8), 1)
        before = img
        for _ in range(steps):
            before, img = img, raster.thinned_once(img)
        return img[1:-1, 1:-1].astype(bool), before[1:-1, 1:-1].astype(bool)

    while True:
        now = materialise(with_halo(tiles, keys, 2 * steps, some, size), "thinned")
        forget(tiles)
        tiles = now
        if tiles.where("changed").isEmpty():
            return with_halo(tiles, keys, 8, lambda w: (raster._without_stairs(np.pad(w, 1))[1:-1, 1:-1], None), size).drop("changed")


def bridged(tiles: DataFrame, keys: Sequence[str], most: int = 15, size: int = SIZE) -> DataFrame:
    """Tiles of raster.bridge() of the whole sheet: what an end draws and what it looks at lie within `most` + 4 pixels of it,
    or the eight of its walk back."""
    return with_halo(tiles, keys, 2 * max(most + 4, 10), lambda w: (raster.bridge(w, most), None), size, spreads=True).drop("changed")


def local_components(tiles: DataFrame, keys: Sequence[str], connectivity: int = 8, size: int = SIZE) -> DataFrame:
    """One row for each component of each tile: keys, id, area, its box, sums of x and y, and the pixels on the tile's border.

    id is the first pixel, by rows, as y * 2^32 + x.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                numbers = raster.label(_unpack(batch.column("bits")[k].as_py(), size, size), connectivity)
                y, x = np.nonzero(numbers)
                n, which = int(numbers.max()), numbers[y, x] - 1
                y, x = y + size * batch.column("ti")[k].as_py(), x + size * batch.column("tj")[k].as_py()
                first = np.unique(which, return_index=True)[1]
                low = lambda v: np.minimum.reduceat(v[order], starts) if n else v  # noqa: B023, E731
                high = lambda v: np.maximum.reduceat(v[order], starts) if n else v  # noqa: B023, E731
                order = np.argsort(which, kind="stable")
                starts = np.searchsorted(which[order], np.arange(n))
                rim = (y % size == 0) | (y % size == size - 1) | (x % size == 0) | (x % size == size - 1)
                borders: list[list[dict]] = [[] for _ in range(n)]
                for i in np.flatnonzero(rim):
                    borders[which[i]].append({"y": int(y[i]), "x": int(x[i])})
                ints = [y[first] * 2**32 + x[first], np.bincount(which, minlength=n), low(x), high(x), low(y), high(y), np.bincount(which, x, n).astype(np.int64), np.bincount(which, y, n).astype(np.int64)]
                rims = pa.array(borders, pa.list_(pa.struct([("y", pa.int64()), ("x", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*_rows(batch, keys, n, k), *[pa.array(v, pa.int64()) for v in ints], rims], [*keys, "id", "area", "x_min", "x_max", "y_min", "y_max", "x_sum", "y_sum", "rim"])

    kinds = ", ".join(f"{c} long" for c in ("id", "area", "x_min", "x_max", "y_min", "y_max", "x_sum", "y_sum"))
    return tiles.select(*keys, "ti", "tj", "bits").mapInArrow(run, f"{_kinds(tiles, keys)}, {kinds}, rim array<struct<y:long,x:long>>")


def _joined(local: DataFrame, keys: Sequence[str], connectivity: int) -> DataFrame:
    """(keys, id, component): the first pixel of the whole component that each local one belongs to."""
    keys = list(keys)
    rim = local.select(*keys, "id", F.explode("rim").alias("p")).select(*keys, "id", "p.y", "p.x")
    ahead = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    near = rim.select(*keys, F.col("id").alias("id2"), F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for dy, dx in ahead])).alias("q"))
    near = near.select(*keys, "id2", F.col("q.y").alias("y"), F.col("q.x").alias("x"))
    node = lambda c: F.struct(*keys, F.col(c).alias("id"))
    links = rim.join(near, [*keys, "y", "x"]).where("id <> id2").select(node("id").alias("a"), node("id2").alias("b")).distinct()
    found = components(links).select(F.col("id.*"), F.col("component.id").alias("component"))
    return local.select(*keys, "id").join(found, [*keys, "id"], "left").select(*keys, "id", F.coalesce("component", "id").alias("component"))


def component_boxes(tiles: DataFrame, keys: Sequence[str], connectivity: int = 8, size: int = SIZE) -> DataFrame:
    """(keys, component, area, x_min, x_max, y_min, y_max, cx, cy) of the components of whole sheets; no pixel becomes a row
    but those on tile borders. component is the first pixel as y * 2^32 + x."""
    keys = list(keys)
    local = materialise(local_components(tiles, keys, connectivity, size), "local")
    whole = local.drop("rim").join(_joined(local, keys, connectivity), [*keys, "id"]).groupBy(*keys, "component")
    sums = [F.sum("area").alias("area"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")]
    return whole.agg(*sums, (F.sum("x_sum") / F.sum("area")).alias("cx"), (F.sum("y_sum") / F.sum("area")).alias("cy"))


def inverted(tiles: DataFrame, frames: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Tiles of the background inside frames (keys, width, height)."""
    keys = list(keys)
    upto = lambda c: F.sequence(F.lit(0), F.ceil(F.col(c) / size).cast("int") - 1)
    grid = frames.where("width > 0 and height > 0").withColumn("ti", F.explode(upto("height"))).withColumn("tj", F.explode(upto("width")))
    kinds = _kinds(grid, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(["ti", "tj", "width", "height", "bits"]).to_pylist():
                free = np.zeros((size, size), bool)
                free[: r["height"] - size * r["ti"], : r["width"] - size * r["tj"]] = True
                rows.append(_pack(free & ~_unpack(r["bits"], size, size) if r["bits"] else free))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, "ti", "tj")], pa.array(rows, pa.binary())], [*keys, "ti", "tj", "bits"])

    return grid.join(tiles.select(*keys, "ti", "tj", "bits"), [*keys, "ti", "tj"], "left").mapInArrow(run, f"{kinds}, ti int, tj int, bits binary")


def region_boxes(walls: DataFrame, frames: DataFrame, keys: Sequence[str], least: float = 0.02, thicken: int = 5, size: int = SIZE) -> DataFrame:
    """(keys, group_id, x_min, x_max, y_min, y_max, area): areas that walls part, largest box first, ends excluded.

    walls: tiles; frames: keys, width, height. Walls are thickened, free space is 4-connected, areas whose box is under
    `least` of the frame go; where none is left the frame is one region.
    """
    from pyspark.sql import Window

    keys = list(keys)
    thick = with_halo(walls, keys, thicken, lambda w: (raster.dilate(w, raster.box(thicken, thicken)), None), size, spreads=True)
    boxes = component_boxes(inverted(thick, frames, keys, size), keys, 4, size)
    boxes = boxes.select(*keys, "x_min", (F.col("x_max") + 1).alias("x_max"), "y_min", (F.col("y_max") + 1).alias("y_max"), "component")
    boxes = boxes.withColumn("area", (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min")))
    found = frames.select(*keys, "width", "height").join(boxes, keys, "left").where(F.coalesce(F.col("area") >= F.col("width") * F.col("height") * least, F.lit(False)))
    whole = frames.join(found.select(*keys).distinct(), keys, "left_anti")
    whole = whole.select(*keys, *[F.lit(v).cast("long").alias(c) if isinstance(v, int) else F.col(v).cast("long").alias(c) for c, v in (("x_min", 0), ("x_max", "width"), ("y_min", 0), ("y_max", "height"))], (F.col("width") * F.col("height")).cast("long").alias("area"), F.lit(0).cast("long").alias("component"))
    out = found.select(*keys, "x_min", "x_max", "y_min", "y_max", "area", "component").unionByName(whole)
    return out.withColumn("group_id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("area").desc(), "component")) - 1).drop("component")


def distances(tiles: DataFrame, keys: Sequence[str], frames: DataFrame, size: int = SIZE) -> DataFrame:
    """(keys, x, y, square): squared Euclidean distance of each foreground pixel to the nearest background inside its frame.

    A band of columns is one task first: the distance up and down its columns. A band of rows then takes the least of those
    and the squared way along the row, shift by shift, until the shift alone is further than every pixel of the band. Without
    background in a frame, a column's distance is its width plus its height, as in the whole-sheet operator.
    """
    keys = list(keys)
    kinds = _kinds(tiles, keys)
    framed = tiles.select(*keys, "ti", "tj", "bits").join(frames.select(*keys, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")), keys)

    def down(table: pa.Table) -> pa.Table:
        width, height = table.column("width")[0].as_py(), table.column("height")[0].as_py()
        rows = -(-height // size) * size
        mask = np.zeros((rows, size), bool)
        for ti, bits in zip(table.column("ti").to_pylist(), table.column("bits").to_pylist(), strict=True):
            mask[ti * size : (ti + 1) * size] = _unpack(bits, size, size)
        mask = mask[:height]
        y, far = np.arange(height)[:, None], width + height
        # The last background row above (or below) a pixel, as a running maximum of the background's rows.
        above = y - np.maximum.accumulate(np.where(mask, -far, y), axis=0)
        below = np.minimum.accumulate(np.where(mask, far + height, y)[::-1], axis=0)[::-1] - y
        g = np.minimum(np.minimum(above, below), far).astype(np.int32)
        full = np.zeros((rows, size), np.int32)
        full[:height] = g
        held = [k for k in range(rows // size) if full[k * size : (k + 1) * size].any()]
        return pa.table([*_rows(table, keys, len(held)), pa.array(held, pa.int32()), *[pa.array([table.column(c)[0].as_py()] * len(held), pa.int32()) for c in ("tj", "width")], pa.array([full[k * size : (k + 1) * size].tobytes() for k in held], pa.binary())], names=[*keys, "ti", "tj", "width", "down"])

    def along(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        g = np.zeros((size, -(-width // size) * size), np.int64)
        for tj, part in zip(table.column("tj").to_pylist(), table.column("down").to_pylist(), strict=True):
            g[:, tj * size : (tj + 1) * size] = np.frombuffer(part, np.int32).reshape(size, size)
        g = g[:, :width] ** 2
        best, shift = g.copy(), 1
        while shift < width and shift * shift < best.max():
            best[:, shift:] = np.minimum(best[:, shift:], g[:, :-shift] + shift * shift)
            best[:, :-shift] = np.minimum(best[:, :-shift], g[:, shift:] + shift * shift)
            shift += 1
        y, x = np.nonzero(best)
        return pa.table([*_rows(table, keys, len(x)), pa.array(x, pa.int64()), pa.array(y + size * table.column("ti")[0].as_py(), pa.int64()), pa.array(best[y, x], pa.int64())], names=[*keys, "x", "y", "square"])

    columns = framed.groupBy(*keys, "tj").applyInArrow(down, f"{kinds}, ti int, tj int, width int, down binary")
    return columns.groupBy(*keys, "ti").applyInArrow(along, f"{kinds}, x long, y long, square long")


def split_by_width(tiles: DataFrame, keys: Sequence[str], frames: DataFrame, gap: int = 20, empty: float = 6.0, size: int = SIZE) -> DataFrame:
    """(keys, x, y, half, threshold, thick): the skeleton's pixels with their half widths, parted by each sheet's Otsu level
    over half widths in tenths, as raster.split_by_width() does for one sheet."""
    keys = list(keys)
    half = distances(tiles, keys, frames, size)
    sk = untiled(thinned(materialise(bridged(thinned(tiles, keys, size), keys, gap, size), "bridged"), keys, size), keys, size)
    # A bridge runs over background, whose distance is 0.
    widths = materialise(sk.join(half, [*keys, "x", "y"], "left").select(*keys, "x", "y", F.sqrt(F.coalesce("square", F.lit(0)).cast("double")).alias("half")), "widths")
    out = widths.join(width_threshold(widths, keys, "half", empty), keys)
    return out.withColumn("thick", F.col("half") >= F.col("threshold"))
