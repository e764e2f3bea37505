"""Detected instance masks as grid lines: confidence, skeleton, orientation, fit and merging of close lines."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import fit, raster
from ..operators.filters import INSTANCE_CONFIDENCE, confident
from ..operators.joins import ROUNDS, TASK_PAIRS, radius_pairs
from ..operators.linework import components
from ..storage import forget, materialise

#: Classes of instances, the tolerance of an arc's simplification, and the distance under which lines are one.
MERIDIAN, PARALLEL, TOLERANCE, CLOSE = 0, 1, 2.0, 50.0


def close_lines(lines: DataFrame, keys: Sequence[str], line: str, within: float = CLOSE) -> DataFrame:
    """(keys, a, b, distance): lines a < b whose nearest ends (x1, y1, x2, y2) are under `within` apart; ends meet through cells.

    A row carries both ends of its line, so a pair is given where its nearest ends meet, the first of equals, and pairs need
    not be brought together again. The line is its key's only one of that name.
    """
    end = lambda k: F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    ends = lines.select(*keys, F.col(line).alias("a"), "x1", "y1", "x2", "y2", F.explode(F.array(end(1), end(2))).alias("p")).select(*keys, "a", "x1", "y1", "x2", "y2", F.col("p.end").alias("__end"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    other = ends.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ends.columns if c not in keys])
    pairs = radius_pairs(ends, other, keys, within, "x", "y", "o_x", "o_y", inclusive=False).where("a < o_a")
    nearer = F.lit(False)
    for i, j in ((i, j) for i in (1, 2) for j in (1, 2)):
        d = F.sqrt((F.col(f"x{i}") - F.col(f"o_x{j}")) ** 2 + (F.col(f"y{i}") - F.col(f"o_y{j}")) ** 2)
        earlier = 2 * F.lit(i) + j < 2 * F.col("__end") + F.col("o___end")
        nearer = nearer | F.coalesce((d < F.col("distance")) | ((d == F.col("distance")) & earlier), F.lit(False))
    return pairs.where(~nearer).select(*keys, "a", F.col("o_a").alias("b"), "distance")


def leading_lines(lines: DataFrame, keys: Sequence[str], line: str, within: float = CLOSE, most: int = TASK_PAIRS) -> DataFrame:
    """Lines in order: the first that is left leads and takes all later ones close to it. Returns the leaders.

    Rounds over cells as wide as the reach, without pairs of lines: the first line that is left in all cells around both its
    ends leads, and what is close to a leader goes. Leaders are apart, so a cell has few. What ROUNDS rounds leave is cut
    where no cells touch; such parts of up to `most` lines are passed through in order, each in one task that holds the
    part's leaders only, and larger ones take more rounds. Lines without a key or a name lead, since nothing is compared to them.
    """
    keys = list(keys)
    names = [*keys, line]
    named = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names])
    cell = lambda k: F.struct(F.floor(F.col(f"x{k}") / within).alias("i"), F.floor(F.col(f"y{k}") / within).alias("j"))
    here = [F.col("__1.i").isNotNull() & F.col("__1.j").isNotNull(), F.col("__2.i").isNotNull() & F.col("__2.j").isNotNull()]
    held = lines.where(named).select(*names, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).withColumns({"__1": cell(1), "__2": cell(2)})
    left, found, rounds = materialise(held, "lines"), [], 0

    def around(c: str) -> Column:
        return F.explode(F.array(*[F.struct((F.col(f"{c}.i") + i).alias("i"), (F.col(f"{c}.j") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def ends(df: DataFrame, *more: str) -> DataFrame:
        """A row for each end with its cell; an end without a place has none."""
        each = F.explode(F.array(*[F.struct(F.when(here[k - 1], F.col(f"__{k}")).alias("c"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)]))
        return df.select(*keys, *more, each.alias("__e")).where("__e.c IS NOT NULL").select(*keys, *more, F.col("__e.c").alias("__c"), F.col("__e.x").alias("__x"), F.col("__e.y").alias("__y"))

    def parted(df: DataFrame) -> DataFrame:
        """df with the part that its first end with a place belongs to; cells that touch or hold one line's ends are of one."""
        name = lambda c: F.struct(*keys, F.col(f"{c}.i").alias("i"), F.col(f"{c}.j").alias("j"))
        full = materialise(ends(df).select(*keys, "__c").distinct(), "cells")
        beside = full.select(*keys, "__c", around("__c").alias("__n")).join(full.select(*keys, F.col("__c").alias("__n")), [*keys, "__n"])
        tied = beside.select(name("__c").alias("a"), name("__n").alias("b")).unionByName(df.where(here[0] & here[1]).select(name("__1").alias("a"), name("__2").alias("b")).distinct())
        return df.withColumn("id", F.when(here[0], name("__1")).otherwise(name("__2"))).join(components(tied), "id").drop("id")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, near = None, {}
        for b in batches:
            kept = []
            rows = zip(*(b.column(c).to_pylist() for c in ("component", "x1", "y1", "x2", "y2", "__1", "__2")), strict=True)
            for k, (own, x1, y1, x2, y2, c1, c2) in enumerate(rows):
                if own != part:
                    part, near = own, {}
                at = [(c["i"], c["j"], x, y) for c, x, y in ((c1, x1, y1), (c2, x2, y2)) if c["i"] is not None and c["j"] is not None]
                if not any(math.sqrt((x - u) ** 2 + (y - v) ** 2) < within for i, j, x, y in at for p in (-1, 0, 1) for q in (-1, 0, 1) for u, v in near.get((i + p, j + q), ())):
                    kept.append(k)
                    for i, j, x, y in at:
                        near.setdefault((i, j), []).append((x, y))
            yield b.select(names).take(pa.array(kept, pa.int64()))

    while not left.isEmpty():
        if rounds == ROUNDS:
            placed = materialise(parted(left.where(here[0] | here[1])), "parted")
            sized = placed.groupBy("component").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most).select("component")
            small = materialise(placed.join(sized, "component", "left_semi"), "small")
            tasks = max(1, -(-small.count() // most))
            sent = small.repartition(tasks, "component").sortWithinPartitions("component", line)
            found.append(materialise(sent.mapInArrow(in_order, sent.select(*names).schema), "leaders"))
            rest = placed.join(small.select("component").distinct(), "component", "left_anti").select(*left.columns)
            rest = rest.unionByName(left.where(~(here[0] | here[1])))
        else:
            first = ends(left, line, "x1", "y1", "x2", "y2", "__1", "__2").groupBy(*keys, "__c").agg(F.min(F.struct(line, "x1", "y1", "x2", "y2", "__1", "__2")).alias("__m"))
            first = materialise(first, "first")
            lowest = first.select(*keys, around("__c").alias("__c"), F.col(f"__m.{line}").alias("__least")).groupBy(*keys, "__c").agg(F.min("__least").alias("__least"))
            waits = ends(first.select(*keys, "__m.*").distinct(), line).join(lowest, [*keys, "__c"]).where(F.col("__least") < F.col(line)).select(*names)
            # A line without a place is close to none.
            leads = first.select(*keys, "__m.*").distinct().join(waits, names, "left_anti").unionByName(left.where(~(here[0] | here[1])))
            found.append(materialise(leads, "leaders"))
            near = ends(found[-1]).select(*keys, around("__c").alias("__c"), F.col("__x").alias("__u"), F.col("__y").alias("__v")).distinct()
            rest = left
            for k in (1, 2):
                other = near.select(*[F.col(c).alias(f"__k_{c}") for c in keys], "__c", "__u", "__v")
                on = (F.col(f"__{k}") == F.col("__c")) & (F.sqrt((F.col(f"x{k}") - F.col("__u")) ** 2 + (F.col(f"y{k}") - F.col("__v")) ** 2) < within)
                for c in keys:
                    on = (F.col(c) == F.col(f"__k_{c}")) & on
                rest = rest.join(other, on, "left_anti")
            rest = rest.join(found[-1].select(*names), names, "left_anti")
        done, left, rounds = left, materialise(rest.select(*held.columns), "lines"), rounds + 1
        forget(done)
    leaders = reduce(DataFrame.unionByName, [f.select(*names) for f in found]) if found else held.select(*names)
    return lines.join(leaders, names, "left_semi").select(*lines.columns).unionByName(lines.where(~named))


def instance_lines(pixels: DataFrame, instances: DataFrame, width, height, least: float = INSTANCE_CONFIDENCE, close: float = CLOSE) -> tuple[DataFrame, DataFrame]:
    """(meridians, parallels) of instance masks.

    pixels: image_id, instance_id, x, y; instances: image_id, instance_id, class_id, confidence. A meridian is the main
    axis of a skeleton that stands steep, clipped to the image (x1, y1, x2, y2), and of close ones the first stays; a
    parallel is the longest path of a skeleton that lies flat, simplified (points). Instances that fit neither go.
    """
    keys = ["image_id", "instance_id"]
    kept = confident(instances, "confidence", least).select(*keys, "class_id")
    shown = pixels.join(kept, keys).select(*keys, "class_id", "x", "y")

    def kernel(mask):
        thin = raster.morphological_skeleton(mask)
        paths = sorted(raster.trace(raster.thin(mask)), key=len, reverse=True)
        dots = [(int(x), int(y)) for y, x in raster.np.argwhere(thin)]
        return [dots, raster.simplify(paths[0], TOLERANCE) if paths else []]

    found = materialise(raster.per_image(shown, kernel, [*keys, "class_id"]), "skeletons")
    dots = found.where("line_id = 0").select(*keys, "class_id", F.explode("points").alias("p")).select(*keys, "class_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    slopes = fit.line_fit(dots, [*keys, "class_id"], F.col("x"), F.col("y"))
    steep = slopes.where((F.col("class_id") == MERIDIAN) & (F.col("n") >= 2) & g.is_vertical(F.col("sxx"), F.col("sxy"))).select(*keys)
    flat = slopes.where((F.col("class_id") == PARALLEL) & g.is_horizontal(F.col("n"), F.col("sxx"), F.col("sxy"))).select(*keys)
    lines = fit.principal_line(dots.join(steep, keys, "left_semi"), keys, "x", "y", F.lit(float(width)), F.lit(float(height)))
    arcs = found.where("line_id = 1").join(flat, keys, "left_semi").select(*keys, "points")
    return leading_lines(lines, ["image_id"], "instance_id", close), arcs
