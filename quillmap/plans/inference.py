"""Sliding-window prediction over large images: overlapping tiles, any model, weighted blending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Fixed value: the colour of what a tile covers beyond its image.
FILL = (245, 235, 210)


def linear_weights(size: int, margin: int | None = None) -> np.ndarray:
    """Weights of a tile that rise over the margin (a quarter of the side) from its edges; in a corner the further edge counts."""
    margin = size // 4 if margin is None else margin
    edge = np.minimum(np.arange(size), np.arange(size)[::-1])
    r, c = np.broadcast_arrays(edge[:, None], edge[None, :])
    step = np.where((r < margin) & (c < margin), np.maximum(r, c), np.minimum(np.minimum(r, c), margin))
    return ((step + 1) / (margin + 1)).astype(np.float32)


def tiles(images: DataFrame, size: int = 512, stride: int = 256, fill: tuple[int, int, int] = FILL) -> DataFrame:
    """(image_id, row, col, data): the tiles of decoded images (image_id, width, height, channels, data), size x size x 3 bytes each.

    An image is held once, in the task that cuts it; its tiles leave one by one. Grey images become three equal channels.
    """
    kind = images.select("image_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w, h, c = (batch.column(n)[k].as_py() for n in ("width", "height", "channels"))
                img = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(h, w, c)
                for row in range(max(1, -(-(h - size) // stride) + 1)):
                    for col in range(max(1, -(-(w - size) // stride) + 1)):
                        part = img[row * stride : row * stride + size, col * stride : col * stride + size]
                        tile = np.empty((size, size, 3), np.uint8)
                        tile[:] = fill
                        tile[: part.shape[0], : part.shape[1]] = part if c == 3 else part[:, :, :1]
                        yield pa.RecordBatch.from_arrays([batch.column("image_id").slice(k, 1), pa.array([row], pa.int32()), pa.array([col], pa.int32()), pa.array([tile.tobytes()], pa.binary())], ["image_id", "row", "col", "data"])

    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(run, f"image_id {kind}, row int, col int, data binary")


#: Bytes of rows that leave a task together: many small images would else cost a batch each.
TOGETHER = 1 << 20


def together(rows: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """The batches of (bytes, batch), put together until they hold TOGETHER bytes."""
    held, size = [], 0
    for n, batch in rows:
        held, size = [*held, batch], size + n
        if size >= TOGETHER or len(held) >= 1000:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted rows, those of one key together as a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        codes = b.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for start, end in zip(cuts, cuts[1:]):
            part = b.slice(start, end - start)
            if held and not held[-1].column(key)[0].equals(part.column(key)[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


#: Rows of tiles that one task predicts and blends.
BAND_ROWS = 4


def bands(images: DataFrame, size: int, stride: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """(image_id, width, height, channels, first, rows, data): each image's rows of tiles, band_rows at a time, with the pixels under them."""
    kind = images.select("image_id").schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            for k in range(batch.num_rows):
                w, h, c = (batch.column(n)[k].as_py() for n in ("width", "height", "channels"))
                img = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(h, w * c)
                rows = max(1, -(-(h - size) // stride) + 1)
                for first in range(0, rows, band_rows):
                    n = min(band_rows, rows - first)
                    part = img[first * stride : (first + n - 1) * stride + size]
                    ints = [pa.array([v], pa.int32()) for v in (w, h, c, first, n)]
                    yield part.nbytes, pa.RecordBatch.from_arrays([batch.column("image_id").slice(k, 1), *ints, pa.array([part.tobytes()], pa.binary())], ["image_id", "width", "height", "channels", "first", "rows", "data"])

    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(lambda batches: together(cut(batches)), f"image_id {kind}, width int, height int, channels int, first int, rows int, data binary")


def sliding_window(images: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: int, size: int = 512, stride: int = 256, weights: np.ndarray | None = None, batch: int = 8, band_rows: int = BAND_ROWS) -> DataFrame:
    """(image_id, x0, y0, width, height, data): the class mask of each image, in blocks of stride x stride bytes.

    model() is called once in each task and returns a function from tiles (n, size, size, 3), from 0 to 1, to
    probabilities (n, size, size, classes). Overlapping tiles are averaged by weight, and the likeliest class is taken, the
    lower one on ties; the stride must divide the size.

    A task takes a band of band_rows rows of tiles and blends them along the band, so the blocks inside it leave it as
    finished bytes. Only the sums of the blocks that the next band reaches into move on, size / stride - 1 rows of them for
    each seam. A task holds one band, or the sums of one block: parts come sorted by block and are added as they pass.
    """
    if size % stride:
        raise ValueError("the stride must divide the size of a tile")
    weight = (linear_weights(size) if weights is None else weights).astype(np.float32)
    n, kind = size // stride, images.select("image_id").schema[0].dataType.simpleString()
    names = ["image_id", "width", "height", "i", "j", "data", "part"]

    def likeliest(total: np.ndarray) -> np.ndarray:
        return (total[:, :, :classes] / np.maximum(total[:, :, classes:], 1e-6)).argmax(axis=2).astype(np.uint8)

    def inside(likely: np.ndarray, w: int, h: int, i: int, j: int) -> bytes | None:
        cw, ch = max(0, min(stride, w - j * stride)), max(0, min(stride, h - i * stride))
        return likely[:ch, :cw].tobytes() or None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        run = None
        for b in batches:
            run = run or model()
            for k in range(b.num_rows):
                w, h, c, first, rows = (b.column(x)[k].as_py() for x in ("width", "height", "channels", "first", "rows"))
                cols, last = max(1, -(-(w - size) // stride) + 1), first + rows >= max(1, -(-(h - size) // stride) + 1)
                img = np.frombuffer(b.column("data")[k].as_buffer(), np.uint8).reshape(-1, w, c)
                canvas = np.empty(((rows - 1) * stride + size, (cols - 1) * stride + size, 3), np.uint8)
                canvas[:] = FILL
                canvas[: img.shape[0], :w] = img if c == 3 else img[:, :, :1]
                total = np.zeros((*canvas.shape[:2], classes + 1))
                places = [(r * stride, q * stride) for r in range(rows) for q in range(cols)]
                for at in range(0, len(places), batch):
                    some = places[at : at + batch]
                    x = np.stack([canvas[y : y + size, x : x + size] for y, x in some]).astype(np.float32) / 255
                    for (y, x0), p in zip(some, np.asarray(run(x), np.float32), strict=True):
                        total[y : y + size, x0 : x0 + size, :classes] += p * weight[:, :, None]
                        total[y : y + size, x0 : x0 + size, classes] += weight
                out = []
                for r in range(rows + n - 1):
                    shared = first > 0 and r < n - 1 or not last and r >= rows
                    strip = total[r * stride : (r + 1) * stride]
                    done = strip if shared else likeliest(strip)
                    for j in range(cols + n - 1):
                        block = done[:, j * stride : (j + 1) * stride]
                        out.append((first + r, j, *((None, block.tobytes()) if shared else (inside(block, w, h, first + r, j), None))))
                i, j, data, part = zip(*out, strict=True)
                same = [pa.array([v] * len(out), t) for v, t in ((b.column("image_id")[k].as_py(), b.column("image_id").type), (w, pa.int32()), (h, pa.int32()))]
                rows_out = pa.RecordBatch.from_arrays([*same, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(data, pa.binary()), pa.array(part, pa.binary())], names)
                yield rows_out.nbytes, rows_out

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts are added in the order of their bytes, so that the sum does not hang on how they arrive.
        held, total = None, None
        for b in batches:
            out, parts = [], b.column("part")
            for k, block in enumerate(zip(*(b.column(x).to_pylist() for x in names[:5]), strict=True)):
                part = np.frombuffer(parts[k].as_buffer(), float).reshape(stride, stride, classes + 1)
                if block == held:
                    total = total + part
                    continue
                if held is not None:
                    out.append((*held, inside(likeliest(total), *held[1:])))
                held, total = block, part
            total = np.array(total)
            yield rows(out, b.schema)
        if held is not None:
            yield rows([(*held, inside(likeliest(total), *held[1:]))], b.schema)

    def rows(out: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds.field(x).type) for k, x in enumerate(names[:6])], names[:6])

    schema = f"image_id {kind}, width int, height int, i int, j int, data binary"
    found = materialise(bands(images, size, stride, band_rows).repartition("image_id", "first").mapInArrow(lambda batches: together(predict(batches)), f"{schema}, part binary"), "predicted")
    seams = found.where("part IS NOT NULL").repartition("image_id", "i", "j").sortWithinPartitions("image_id", "i", "j", "part").mapInArrow(blend, schema)
    blocks = found.where("part IS NULL").drop("part").unionByName(seams).where("data IS NOT NULL")
    x0, y0 = F.col("j") * stride, F.col("i") * stride
    return blocks.select("image_id", x0.alias("x0"), y0.alias("y0"), F.least(F.lit(stride), F.col("width") - x0).alias("width"), F.least(F.lit(stride), F.col("height") - y0).alias("height"), "data")
