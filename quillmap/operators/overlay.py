"""Overlay of polygons whose edges cross: noding by snap rounding, labels by winding numbers, set operations on labelled edges.

Coordinates are whole multiples of a unit, so every test is exact in longs. Segments are dealt to the cells of a grid that
they touch; crossings and hot pixels (corners and rounded crossings) are found by joins on the cell. A segment then runs
through the centres of the hot pixels it meets, which leaves edges that meet at their ends only. The winding number below an
edge is that of its cell's corner plus what a path inside the cell crosses; corners get theirs by running sums along the
grid's vertical lines. No sheet meets in one task: joins are by cell, windows by segment or by grid line.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point, segments
from ..storage import materialise

#: Coordinates may reach this many units, so that products of doubled differences stay within a long.
LIMIT = 1 << 27
EDGE = ("ax", "ay", "bx", "by")
#: A cell is this many times as wide as segments are on average.
CELL_SPANS = 2.0


def _div(n: Column, d: Column | int) -> Column:
    """Floor of n / d in longs, d > 0."""
    d = F.lit(d).cast("long") if isinstance(d, int) else d
    return F.call_function("div", n - F.pmod(n, d), d)


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _boxes_meet() -> Column:
    """Whether the boxes of segments ax.. and cx.., the smaller ends first, have a point in common: cheaper than any turn."""
    c = F.col
    return (c("ax") <= c("dx")) & (c("cx") <= c("bx")) & (F.least("ay", "by") <= F.greatest("cy", "dy")) & (F.least("cy", "dy") <= F.greatest("ay", "by"))


def snapped_segments(features: DataFrame, keep: Sequence[str], unit: float, rings: str = "rings", closed: bool = True) -> DataFrame:
    """(keep, ax, ay, bx, by, way): segments of the rings in whole units, the smaller end first; way is -1 where that turns them.

    Rings are closed where their last point is not their first, unless they are lines (closed=False); segments without
    length are dropped. Coordinates beyond LIMIT units raise an error; null rings and points are passed over.
    """
    whole = lambda v: F.when(F.abs(v / unit) < LIMIT, F.floor(v / unit + 0.5).cast("long")).otherwise(F.raise_error(F.lit(f"a coordinate is beyond {LIMIT} units of {unit}")).cast("long"))
    ring = features.select(*keep, F.explode(rings).alias("ring")).select(*keep, F.filter("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("ring")).where(F.size("ring") > 1)
    if closed:
        ring = ring.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    s = ring.select(*keep, F.explode(segments(F.col("ring"))).alias("s")).select(*keep, whole(F.col("s.a.x")).alias("px"), whole(F.col("s.a.y")).alias("py"), whole(F.col("s.b.x")).alias("qx"), whole(F.col("s.b.y")).alias("qy"))
    ahead = (F.col("px") < F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")))
    pick = lambda p, q: F.when(ahead, F.col(p)).otherwise(F.col(q))
    s = s.where((F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy")))
    return s.select(*keep, pick("px", "qx").alias("ax"), pick("py", "qy").alias("ay"), pick("qx", "px").alias("bx"), pick("qy", "py").alias("by"), F.when(ahead, 1).otherwise(-1).alias("way"))


def cell_size(edges: DataFrame) -> int:
    """Width of grid cells in units, from the average span of the edges."""
    span = edges.agg(F.avg(F.greatest(F.col("bx") - F.col("ax"), F.abs(F.col("by") - F.col("ay"))))).first()[0]
    return max(4, int(CELL_SPANS * (span or 0)))


def _cells(edges: DataFrame, cell: int) -> DataFrame:
    """edges with the cells (k, r) that they come within a unit of; grid lines lie at half units, so corners never lie on one."""
    at = lambda v: F.floor((v - 0.5) / cell)
    out = edges.withColumn("__k", F.explode(F.sequence(at(F.col("ax") - 1.0), at(F.col("bx") + 1.0))))
    left, right = F.greatest(F.col("ax"), F.col("__k") * cell - 1.0), F.least(F.col("bx"), (F.col("__k") + 1) * cell + 2.0)
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0))
    y1, y2 = (F.coalesce(F.col("ay") + (x - F.col("ax")) * slope, F.col(end).cast("double")) for x, end in ((left, "ay"), (right, "by")))
    return out.withColumn("__r", F.explode(F.sequence(at(F.least(y1, y2) - 1.5), at(F.greatest(y1, y2) + 1.5))))


def _crossings(held: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """(keys, x, y): the rounded crossings of segments that _cells() holds."""
    c = {n: F.col(n) for n in (*EDGE, "cx", "cy", "dx", "dy")}
    sign = lambda v: F.signum(v.cast("double"))
    at = lambda v: F.floor((F.col(v) - 0.5) / cell)
    other = held.select(*keys, "__k", "__r", *[F.col(a).alias(b) for a, b in zip(EDGE, ("cx", "cy", "dx", "dy"), strict=True)])
    before, after = _orient(c["ax"], c["ay"], c["bx"], c["by"], c["cx"], c["cy"]), _orient(c["ax"], c["ay"], c["bx"], c["by"], c["dx"], c["dy"])
    first = F.struct(*EDGE) < F.struct(*[F.col(b).alias(a) for a, b in zip(EDGE, ("cx", "cy", "dx", "dy"), strict=True)])
    apart = sign(_orient(c["cx"], c["cy"], c["dx"], c["dy"], c["ax"], c["ay"])) * sign(_orient(c["cx"], c["cy"], c["dx"], c["dy"], c["bx"], c["by"])) < 0
    # A merge, so that no table of cells goes through the driver.
    met = held.join(other.hint("merge"), [*keys, "__k", "__r"]).where(_boxes_meet() & first & apart & (sign(before) * sign(after) < 0))
    t = before.cast("double") / (before - after).cast("double")
    points = met.select(*keys, "__k", "__r", *[F.floor(c[a] + (c[b] - c[a]) * t + 0.5).cast("long").alias(n) for n, a, b in (("x", "cx", "dx"), ("y", "cy", "dy"))])
    # A pair that shares several cells is met in that of its crossing only.
    return points.where((at("x") == F.col("__k")) & (at("y") == F.col("__r"))).select(*keys, "x", "y")


def joined_along(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ax, ay, bx, by): segments that overlap or touch on a common line as one, the smaller end first."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ax, ay, bx, by = (batch.column(n).to_numpy(zero_copy_only=False) for n in EDGE)
            dx, dy = bx - ax, by - ay
            whole = np.maximum(np.gcd(dx, np.abs(dy)), 1)
            ex, ey = dx // whole, dy // whole
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (ex, ey, ex * ay - ey * ax))], [*batch.schema.names, "__ex", "__ey", "__off"])

    once = segs.select(*keys, *EDGE)
    lines = once.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in once.schema], "__ex long", "__ey long", "__off long"]))
    line = [*keys, "__ex", "__ey", "__off"]
    along = Window.partitionBy(*line).orderBy("ax", "ay")
    # On an upright line ends differ in y only, on others they stand in the order of x.
    reach = lines.withColumn("__to", F.when(F.col("__ex") == 0, F.col("by")).otherwise(F.col("bx"))).withColumn("__from", F.when(F.col("__ex") == 0, F.col("ay")).otherwise(F.col("ax")))
    so_far = F.max("__to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = reach.withColumn("__new", F.when(F.col("__from") <= so_far, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*line, "__run").agg(F.min(F.struct("ax", "ay")).alias("a"), F.max(F.struct("bx", "by")).alias("b")).select(*keys, F.col("a.ax").alias("ax"), F.col("a.ay").alias("ay"), F.col("b.bx").alias("bx"), F.col("b.by").alias("by"))


def nodes(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y): where segments end or cross, in whole units: the ends of the pieces of noded(), without cutting any.

    Segments that overlap on a line are one, so that a place is not found again by each of them.
    """
    keys = list(keys)
    segs = materialise(segs.select(*keys, *EDGE).distinct(), "segments")
    long = materialise(joined_along(segs, keys), "joined")
    cell = cell_size(long)
    ends = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")
    corners = segs.select(*keys, ends).select(*keys, "p.x", "p.y")
    # Dealt to a number of tasks that is not lowered: few segments may have many crossings.
    held = _cells(long, cell).repartition(int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__k", "__r")
    return _crossings(held, keys, cell).unionByName(corners).distinct()


def noded(segs: DataFrame, keys: Sequence[str], cell: int | None = None, crossing: bool = True) -> DataFrame:
    """segs (keys, more, ax, ay, bx, by, way) cut and snapped where they meet: one row for each piece, in the same columns.

    Only segments with equal keys meet. Two pieces have nothing in common but ends, or are the same. With crossing=False no
    two segments cross, so only corners can cut; segments that pass no other's corner stay as they are.
    """
    keys, more = list(keys), [c for c in segs.columns if c not in {*keys, *EDGE, "way"}]
    segs = materialise(segs, "segments")
    cell = cell or cell_size(segs)
    once = segs.select(*keys, *EDGE)
    if crossing:
        once = once.distinct()
    held = _cells(once, cell)
    c = {n: F.col(n) for n in (*EDGE, "cx", "cy", "dx", "dy")}
    sign = lambda v: F.signum(v.cast("double"))
    at = lambda v: F.floor((F.col(v) - 0.5) / cell)
    ends = F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")
    corners = once.select(*keys, ends).select(*keys, "p.x", "p.y")
    if crossing:
        held = materialise(held, "cells")
        corners = _crossings(held, keys, cell).unionByName(corners)
    hot = materialise(corners.distinct().withColumn("__k", at("x")).withColumn("__r", at("y")), "hot")
    # A pixel is half open; on a tie the segment counts as moved by a little to the right and, much less, upwards.
    dx, dy = 2 * (c["bx"] - c["ax"]), 2 * (c["by"] - c["ay"])

    def side(i: int, j: int) -> Column:
        turn = dx * (2 * F.col("y") + j - 2 * c["ay"]) - dy * (2 * F.col("x") + i - 2 * c["ax"])
        return F.when(turn != 0, sign(turn)).when(dy != 0, sign(dy)).otherwise(-sign(dx))

    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    near = (c["ax"] <= F.col("x")) & (F.col("x") <= c["bx"]) & (low <= F.col("y")) & (F.col("y") <= high)
    meets = held.join(hot, [*keys, "__k", "__r"]).where(near & (F.abs(side(-1, -1) + side(-1, 1) + side(1, -1) + side(1, 1)) < 4))
    rest = None
    if not crossing:
        own = ((F.col("x") == c["ax"]) & (F.col("y") == c["ay"])) | ((F.col("x") == c["bx"]) & (F.col("y") == c["by"]))
        hits = materialise(meets.where(~own).select(*keys, *EDGE, "x", "y").distinct(), "hits")
        hit = hits.select(*keys, *EDGE).distinct()
        meets, rest = hits.unionByName(hit.select(*keys, *EDGE, ends).select(*keys, *EDGE, "p.x", "p.y")), segs.join(hit, [*keys, *EDGE], "left_anti")
    along = Window.partitionBy(*keys, *EDGE).orderBy("x", F.col("y") * sign(c["by"] - c["ay"]).cast("long"))
    pieces = meets.select(*keys, *EDGE, "x", "y", F.lead("x").over(along).alias("x2"), F.lead("y").over(along).alias("y2")).where("x2 IS NOT NULL")
    cut = segs.join(pieces, [*keys, *EDGE]).select(*keys, *more, F.col("x").alias("px"), F.col("y").alias("py"), "x2", "y2", "way")
    ahead = (F.col("px") < F.col("x2")) | ((F.col("px") == F.col("x2")) & (F.col("py") < F.col("y2")))
    turned = [F.when(ahead, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("ax", "px", "x2"), ("ay", "py", "y2"), ("bx", "x2", "px"), ("by", "y2", "py"))]
    out = cut.select(*keys, *more, *turned, F.when(ahead, F.col("way")).otherwise(-F.col("way")).alias("way"))
    return materialise(out.unionByName(rest) if rest else out, "noded")


def winding(edges: DataFrame, keys: Sequence[str], turns: Sequence[str]) -> DataFrame:
    """edges with, for each name t of turns, `below_t`: the winding number just below the edge, right of it where it is vertical.

    edges: noded, one row for each key and edge, the smaller end first, t the net number of times that rings run along it.
    Above (left of) the edge the number is below_t + t.
    """
    keys, turns = list(keys), list(turns)
    edges = materialise(edges, "edges")
    cell = cell_size(edges)
    ax, ay, bx, by = (2 * F.col(n) for n in EDGE)
    dx, dy = bx - ax, by - ay
    # Middles in doubled units, and their cells: a middle is right of or on its cell's left line, and above its lower one.
    middle = edges.withColumn("mx", F.col("ax") + F.col("bx")).withColumn("my", F.col("ay") + F.col("by"))
    middle = middle.withColumn("__k", _div(F.col("mx") - 1, 2 * cell)).withColumn("__r", -_div(-(F.col("my") - 1), 2 * cell) - 1)
    asked = middle.select(*keys, "__k", "__r", "mx", "my", *[F.col(n).alias(f"q_{n}") for n in EDGE])
    x0, y0, s = 2 * cell * F.col("__k") + 1, 2 * cell * F.col("__r") + 1, F.signum(dy.cast("double"))
    rise = dx * (y0 - ay)
    to_middle, to_line = (F.col("mx") - ax) * dy - rise, (x0 - ax) * dy - rise
    sideways = (F.least(ay, by) < y0) & (y0 < F.greatest(ay, by)) & (s * F.signum(to_middle.cast("double")) >= 0) & ((s * F.signum(to_line.cast("double")) < 0) | ((to_line == 0) & (dy > 0)))
    height = ay * dx + dy * (F.col("mx") - ax)
    own = (F.col("q_ax") == F.col("ax")) & (F.col("q_ay") == F.col("ay")) & (F.col("q_bx") == F.col("bx")) & (F.col("q_by") == F.col("by"))
    upwards = (ax <= F.col("mx")) & (F.col("mx") < bx) & ~own & ((height > y0 * dx) | ((height == y0 * dx) & (dy > 0))) & (height < F.col("my") * dx)
    crossed = F.when(sideways, -s.cast("int")).otherwise(0) + F.when(upwards, 1).otherwise(0)
    pairs = _cells(edges, cell).join(asked, [*keys, "__k", "__r"]).withColumn("crossed", crossed).where("crossed <> 0")
    local = pairs.groupBy(*keys, *[F.col(f"q_{n}").alias(n) for n in EDGE]).agg(*[F.sum(F.col("crossed") * F.col(t)).alias(f"l_{t}") for t in turns])
    lines = edges.withColumn("__k", F.explode(F.filter(F.sequence(_div(ax - 1, 2 * cell), _div(bx - 1, 2 * cell)), lambda k: k > _div(ax - 1, 2 * cell))))
    line_x = 2 * cell * F.col("__k") + 1
    row = -_div(-(ay * dx + dy * (line_x - ax) - dx), 2 * cell * dx)
    steps = lines.where(dx > 0).withColumn("__r", row).groupBy(*keys, "__k", "__r").agg(*[F.sum(t).alias(t) for t in turns])
    wanted = middle.select(*keys, "__k", "__r").distinct().select("*", *[F.lit(0).cast("long").alias(t) for t in turns], F.lit(1).alias("asks"))
    up = Window.partitionBy(*keys, "__k").orderBy("__r", "asks").rowsBetween(Window.unboundedPreceding, 0)
    corners = steps.withColumn("asks", F.lit(0)).unionByName(wanted).select(*keys, "__k", "__r", "asks", *[F.sum(t).over(up).alias(f"c_{t}") for t in turns]).where("asks = 1").drop("asks")
    out = middle.join(corners, [*keys, "__k", "__r"]).join(local, [*keys, *EDGE], "left")
    return out.select(*edges.columns, *[(F.col(f"c_{t}") + F.coalesce(F.col(f"l_{t}"), F.lit(0))).alias(f"below_{t}") for t in turns])


def borders(features: DataFrame, keys: Sequence[str], unit: float, layer: str = "layer", rings: str = "rings") -> DataFrame:
    """(keys, layer, feature, ax, ay, bx, by): the edges of each row's region, all rows of a key noded together.

    One row of features is one region: the points with an odd number of its rings around them, whichever way rings run, so
    holes are rings like others, a ring that crosses itself is made valid by that rule, and edges that a region's rings
    share are none of its border.
    """
    keys = list(keys)
    f = features.select(*keys, F.col(layer).alias("layer"), F.monotonically_increasing_id().alias("feature"), F.col(rings).alias("rings"))
    # Written, so that a feature keeps its number.
    pieces = noded(snapped_segments(materialise(f, "features"), [*keys, "layer", "feature"], unit), keys)
    return pieces.groupBy(*keys, "layer", "feature", *EDGE).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")


def labelled(features: DataFrame, keys: Sequence[str], unit: float, layer: str = "layer", rings: str = "rings", layers: Sequence[str] = ("x", "y")) -> DataFrame:
    """(keys, ax, ay, bx, by, t_x, t_y, below_x, below_y): noded edges with how many features of a layer cover what lies below.

    t is what is added above the edge. Features are regions as in borders().
    """
    return sides(borders(features, keys, unit, layer, rings), keys, layers)


def sides(edges: DataFrame, keys: Sequence[str], layers: Sequence[str] = ("x", "y")) -> DataFrame:
    """labelled() of borders() that are there already."""
    keys = list(keys)
    own = edges.withColumn("one", F.lit(1).cast("long"))
    # Of one feature: an odd number of its edges below means that its inside is below, and ends at this edge.
    sided = winding(own, [*keys, "layer", "feature"], ["one"])
    # Every crossing changes the side, so the sign of a crossing does not matter to the parity.
    turned = sided.withColumn("t", F.when(F.pmod("below_one", F.lit(2)) == 1, -1).otherwise(1).cast("long"))
    each = turned.groupBy(*keys, *EDGE).agg(*[F.coalesce(F.sum(F.when(F.col("layer") == l, F.col("t"))), F.lit(0)).cast("long").alias(f"t_{l}") for l in layers])
    return winding(each, keys, [f"t_{l}" for l in layers]).withColumnsRenamed({f"below_t_{l}": f"below_{l}" for l in layers})


#: Whether a point belongs to the result, from whether it lies in x and in y.
OPERATIONS = {
    "union": lambda x, y: x | y,
    "intersection": lambda x, y: x & y,
    "difference": lambda x, y: x & ~y,
    "symmetric_difference": lambda x, y: x != y,
}


def outline(edges: DataFrame, keys: Sequence[str], operation: str, unit: float) -> DataFrame:
    """(keys, a, b): border of the result of an operation on labelled edges, its inside on the left of the way from a to b."""
    keep = OPERATIONS[operation]
    below = keep(F.col("below_x") > 0, F.col("below_y") > 0)
    above = keep(F.col("below_x") + F.col("t_x") > 0, F.col("below_y") + F.col("t_y") > 0)
    ends = [point(F.col(x) * unit, F.col(y) * unit) for x, y in (("ax", "ay"), ("bx", "by"))]
    border = edges.withColumn("b_", below).withColumn("a_", above).where(F.col("b_") != F.col("a_"))
    return border.select(*keys, F.when(F.col("a_"), ends[0]).otherwise(ends[1]).alias("a"), F.when(F.col("a_"), ends[1]).otherwise(ends[0]).alias("b"))


def overlay(x: DataFrame, y: DataFrame | None, keys: Sequence[str], operation: str, unit: float = 1e-6, rings: str = "rings") -> DataFrame:
    """outline() of an operation on two sets of regions (keys, rings), each the union of its rows; y None is empty."""
    keys = list(keys)
    both = x.select(*keys, rings, F.lit("x").alias("layer"))
    if y is not None:
        both = both.unionByName(y.select(*keys, rings, F.lit("y").alias("layer")))
    return outline(labelled(both, keys, unit, rings=rings), keys, operation, unit)


def enclosed(border: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area) inside a border of edges (a, b) that have it on their left."""
    return border.groupBy(*keys).agg((F.sum(F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")) / 2).alias("area"))


def noded_lines(lines: DataFrame, keys: Sequence[str], unit: float, points: str = "points", crossing: bool = True) -> DataFrame:
    """(keys, a, b): the union of lines as distinct edges, the smaller end first, cut wherever lines meet; crossing as in noded()."""
    keys = list(keys)
    pieces = noded(snapped_segments(lines.select(*keys, F.array(points).alias("rings")), keys, unit, closed=False), keys, crossing=crossing)
    return as_points(pieces.select(*keys, *EDGE).distinct(), unit, *keys)


def as_points(edges: DataFrame, unit: float, *keep: str) -> DataFrame:
    """(keep, a, b): the ends of edges as points."""
    return edges.select(*keep, point(F.col("ax") * unit, F.col("ay") * unit).alias("a"), point(F.col("bx") * unit, F.col("by") * unit).alias("b"))


def touching(segs: DataFrame, keys: Sequence[str], line: str, form: str, place: str, last: int) -> DataFrame:
    """(keys, line, form, line2, form2): forms of lines of which a segment meets another one elsewhere than at a common end, or runs along it.

    segs: keys, line, one of its forms, the place in that form, and whole ends ax.. as of snapped_segments(). A line is in one form
    at a time, so its forms do not meet each other. Of lines in form `last`, and of those without a name, which have no
    other form, no pairs among themselves are given; line2 and form2 are null where a form meets a line without a name.
    """
    keys = list(keys)
    held = _cells(segs, cell_size(segs))
    c = {n: F.col(n) for n in (*EDGE, "cx", "cy", "dx", "dy")}
    other = held.select(*keys, "__k", "__r", F.col(line).alias("line2"), F.col(form).alias("form2"), F.col(place).alias("place2"), *[F.col(a).alias(b) for a, b in zip(EDGE, ("cx", "cy", "dx", "dy"), strict=True)])
    sign = lambda *p: F.signum(_orient(*[c[n] for n in p]).cast("double"))
    ab_c, ab_d, cd_a, cd_b = sign(*EDGE, "cx", "cy"), sign(*EDGE, "dx", "dy"), sign("cx", "cy", "dx", "dy", "ax", "ay"), sign("cx", "cy", "dx", "dy", "bx", "by")
    ends = {(p, q): (c[f"{p}x"] == c[f"{q}x"]) & (c[f"{p}y"] == c[f"{q}y"]) for p in "ab" for q in "cd"}

    def on(side: Column, p: str, q: str, x: str) -> Column:
        """Whether x lies between p and q but at neither; side tells on which side of their line it is."""
        within = [c[f"{x}{v}"].between(F.least(f"{p}{v}", f"{q}{v}"), F.greatest(f"{p}{v}", f"{q}{v}")) for v in "xy"]
        at = [ends[min(x, e), max(x, e)] for e in (p, q)]
        return (side == 0) & within[0] & within[1] & ~at[0] & ~at[1]

    meets = ((ab_c * ab_d < 0) & (cd_a * cd_b < 0)) | on(ab_c, "a", "b", "c") | on(ab_d, "a", "b", "d") | on(cd_a, "c", "d", "a") | on(cd_b, "c", "d", "b") | (ends["a", "c"] & ends["b", "d"])
    first = F.struct(line, place) < F.struct(F.col("line2").alias(line), F.col("place2").alias(place))
    free = F.when(F.col("line2").isNull(), True).when(F.col("form2") == last, F.col(line) != F.col("line2")).otherwise(first & ((F.col(line) != F.col("line2")) | (F.col(form) == F.col("form2"))))
    pairs = held.where(F.col(form) < last).join(other, [*keys, "__k", "__r"]).where(_boxes_meet() & free & meets)
    return pairs.select(*keys, line, form, "line2", "form2").distinct()
