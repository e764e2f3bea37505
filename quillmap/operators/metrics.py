"""Evaluation of masks and blending of overlapping tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1, 2, 3)


def confusion(pixels: DataFrame, keys: Sequence[str], truth: str = "truth", pred: str = "pred", classes: Sequence[int] = CLASSES, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn of each class for each key and, with keys null, over all: one pass with grouping sets.

    A pixel counts for the class of its truth and for that of its prediction, so rows at most double before they are
    summed up on the map side; `weight` lets rows stand for several pixels.
    """
    w = F.lit(1) if weight is None else weight
    t, p = F.col(truth).cast("int"), F.col(pred).cast("int")
    roles = F.when(t == p, F.array(F.struct(t.alias("cls"), F.lit("tp").alias("role")))).otherwise(F.array(F.struct(p.alias("cls"), F.lit("fp").alias("role")), F.struct(t.alias("cls"), F.lit("fn").alias("role"))))
    votes = pixels.select(*keys, w.alias("w"), F.explode(roles).alias("r")).select(*keys, "w", "r.*").where(F.col("cls").isin(*classes))
    counts = [F.sum(F.when(F.col("role") == r, F.col("w")).otherwise(0)).cast("long").alias(r) for r in ("tp", "fp", "fn")]
    if not keys:
        return votes.groupBy("cls").agg(*counts)
    return votes.groupingSets([[*[F.col(k) for k in keys], F.col("cls")], [F.col("cls")]], *keys, "cls").agg(*counts)


def scores(counts: DataFrame) -> DataFrame:
    """precision, recall, iou and dice, 0 where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "iou": ratio(tp, tp + fp + fn), "dice": ratio(2 * tp, 2 * tp + fp + fn)})


def foreground_miou(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean IoU of the classes over 0 that occur."""
    seen = scores(counts).where((F.col("cls") > 0) & (F.col("tp") + F.col("fp") + F.col("fn") > 0))
    return seen.groupBy(*keys).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"))


def blend(tiles: DataFrame, keys: Sequence[str], cls: str = "cls", prob: str = "prob", weight: str = "weight") -> DataFrame:
    """Weighted mean probability of each class at each key, and the class with the largest, the lowest on ties."""
    mean = tiles.groupBy(*keys, cls).agg((F.sum(F.col(weight) * F.col(prob)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("p"))
    return mean.groupBy(*keys).agg(F.max_by(cls, F.struct(F.round("p", 9), -F.col(cls))).alias("cls"), F.max("p").alias("p"))


def tile_grid(images: DataFrame, width: str = "width", height: str = "height", size: int = 512, overlap: float = 0.5, guarded: bool = True) -> DataFrame:
    """Top-left corners of overlapping tiles; guarded gives images under a step at least one row and column."""
    step = int(size * (1 - overlap))
    count = lambda n: F.ceil((F.col(n) - size) / step).cast("int") + 1
    rows, cols = (F.greatest(F.lit(1), count(c)) if guarded else F.greatest(F.lit(0), count(c)) for c in (height, width))
    many = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = images.withColumn("row", F.explode(many(rows))).withColumn("col", F.explode(many(cols)))
    return out.withColumns({"x0": F.col("col") * step, "y0": F.col("row") * step})


def linear_weight(row: Column, col: Column, size: int) -> Column:
    """Weight of a tile's pixel that falls off linearly over the outer quarter."""
    b = size // 4
    dr, dc = F.least(row, size - 1 - row), F.least(col, size - 1 - col)
    return (F.when((dr < b) & (dc < b), F.greatest(dr, dc) + 1).when(dr < b, dr + 1).when(dc < b, dc + 1).otherwise(b + 1) / float(b + 1)).cast("double")


def gaussian_weight(row: Column, col: Column, size: int) -> Column:
    mid, sigma = (size - 1) / 2, size / 6
    return F.exp(-((row - mid) * (row - mid) + (col - mid) * (col - mid)) / (2 * sigma * sigma))


def ramp_weight(row: Column, col: Column, size: int, border: int) -> Column:
    ramp = lambda v: F.least(F.lit(1.0), (F.least(v, size - 1 - v) + 1) / float(border))
    return ramp(row) * ramp(col)


def class_pixels(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pixels.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("pixels"))


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """Class of a colour-mask pixel: red 1, green 2, orange 3, all else background."""
    return F.when((r > 200) & (g < 50) & (b < 50), 1).when((g > 200) & (r < 50) & (b < 50), 2).when((r > 200) & (g > 100) & (g < 200), 3).otherwise(0)


def resized_nearest(pixels: DataFrame, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> DataFrame:
    """Sparse mask at another size: each target pixel takes the source pixel at its floored position."""
    lo = lambda v, a, b: F.ceil(v * b / a).cast("int")
    span = lambda v, a, b: F.sequence(lo(v, a, b), lo(v + 1, a, b) - 1)
    some = (lo(F.col("x") + 1, from_w, to_w) > lo(F.col("x"), from_w, to_w)) & (lo(F.col("y") + 1, from_h, to_h) > lo(F.col("y"), from_h, to_h))
    out = pixels.where(some).withColumn("__y", F.explode(span(F.col("y"), from_h, to_h))).withColumn("x", F.explode(span(F.col("x"), from_w, to_w)))
    return out.withColumn("y", F.col("__y")).drop("__y")


def tile_clip(shapes: DataFrame, tiles: DataFrame, keys: Sequence[str], size: int = 512) -> DataFrame:
    """Shapes clipped to tiles in tile coordinates, one row for each piece.

    Tiles are closed: a shape on the far edge of a tile belongs to it and to the one that begins there.
    """
    from ..functions.geometry import bbox, clipped_polyline, shifted

    b = shapes.withColumn("__b", bbox(F.col("points")))
    step = size // 2
    cells = lambda lo, hi: F.sequence(F.ceil(F.col(lo) / step) - 2, F.floor(F.col(hi) / step))
    b = b.withColumn("__i", F.explode(cells("__b.x_min", "__b.x_max"))).withColumn("__j", F.explode(cells("__b.y_min", "__b.y_max")))
    t = tiles.withColumns({"__i": F.floor(F.col("x0") / step), "__j": F.floor(F.col("y0") / step)})
    both = b.join(t, [*keys, "__i", "__j"]).drop("__b", "__i", "__j")
    x0, y0 = F.col("x0").cast("double"), F.col("y0").cast("double")
    pieces = both.withColumn("piece", F.explode(clipped_polyline(F.col("points"), x0, y0, x0 + size, y0 + size)))
    return pieces.withColumn("points", shifted(F.col("piece"), -x0, -y0)).drop("piece")


def informative_tiles(pixels: DataFrame, tiles: DataFrame, keys: Sequence[str], size: int = 512, least: int = 20) -> DataFrame:
    """Tiles with at least `least` foreground pixels, found through cells of half a tile."""
    step = size // 2
    t = tiles.withColumn("__c", F.explode(F.array(*[F.struct((F.floor(F.col("x0") / step) + i).alias("i"), (F.floor(F.col("y0") / step) + j).alias("j")) for i in range(3) for j in range(3)])))
    p = pixels.select(*keys, "x", "y", F.struct(F.floor(F.col("x") / step).alias("i"), F.floor(F.col("y") / step).alias("j")).alias("__c"))
    inside = F.col("x").between(F.col("x0"), F.col("x0") + size - 1) & F.col("y").between(F.col("y0"), F.col("y0") + size - 1)
    counts = t.join(p, [*keys, "__c"]).where(inside).groupBy(*[c for c in tiles.columns]).agg(F.count(F.lit(1)).alias("pixels"))
    return counts.where(F.col("pixels") >= least)


def biased_patches(pixels: DataFrame, images: DataFrame, keys: Sequence[str], size: int = 512, draws: int = 20, seed: int = 42, share: float = 0.5) -> DataFrame:
    """(keys, draw, x0, y0): seeded corners of patches, of which about `share` lie around a random foreground pixel (x, y).

    The others, and those of images without foreground, lie anywhere. images: keys, width, height; corners stay inside
    where the image is larger than a patch. A draw's pixel is that of the least hash, so that every draw is one minimum,
    taken before the shuffle; pixels do not move.
    """
    keys = list(keys)
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    part = lambda what, k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(what), F.lit(str(seed)), k.cast("string"), name)), 1, 8), 16, 10).cast("double") / 2**32
    pick = lambda k: F.min(F.struct(F.md5(F.concat_ws("|", F.lit("pixel"), F.lit(str(seed)), F.lit(str(k)), F.col("x").cast("string"), F.col("y").cast("string"))).alias("h"), "x", "y"))
    found = pixels.groupBy(*keys).agg(F.array(*[pick(k) for k in range(draws)]).alias("__picked"))
    each = images.select(*keys, "width", "height").join(found, keys, "left").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = F.get("__picked", F.col("draw"))
    near = at.isNotNull() & (part("coin", F.col("draw")) < share)

    def corner(axis: str, extent: str) -> Column:
        around = F.greatest(F.lit(0), F.least(at[axis] - size // 2, F.col(extent) - size))
        return F.when(near, around).otherwise(F.floor(part(axis, F.col("draw")) * F.greatest(F.lit(1), F.col(extent) - size))).cast("long")

    return each.select(*keys, "draw", corner("x", "width").alias("x0"), corner("y", "height").alias("y0"))
