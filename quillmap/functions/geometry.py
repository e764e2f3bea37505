"""Plane geometry as column expressions: points are structs of x and y, polylines arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 1e-6


def once(value: Column, then) -> Column:
    """then(value) with value computed once in a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def from_pairs(pairs: Column) -> Column:
    """[[x, y], ...] to points."""
    return F.transform(pairs, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def segments(points: Column) -> Column:
    """Consecutive pairs of points as structs a, b."""
    n = F.size(points)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def arc_length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda acc, s: acc + distance(s["a"], s["b"]))


def bbox(points: Column) -> Column:
    x, y = xs(points), ys(points)
    return F.struct(F.array_min(x).alias("x_min"), F.array_max(x).alias("x_max"), F.array_min(y).alias("y_min"), F.array_max(y).alias("y_max"))


def orientation(points: Column) -> Column:
    """horizontal or vertical where one span is over twice the other, else mixed."""
    return once(bbox(points), lambda b: F.when(b["x_max"] - b["x_min"] > 2 * (b["y_max"] - b["y_min"]), "horizontal").when(b["y_max"] - b["y_min"] > 2 * (b["x_max"] - b["x_min"]), "vertical").otherwise("mixed"))


def slope_angle(sxx: Column, sxy: Column) -> Column:
    """Angle in degrees of a regression of y on x, 0 to 90; null where x does not vary."""
    return F.when(sxx >= RATE, F.abs(F.degrees(F.atan(sxy / sxx))))


def is_vertical(sxx: Column, sxy: Column) -> Column:
    """Regression steeper than 75 degrees, or no spread in x."""
    return F.when(sxx < RATE, True).otherwise(slope_angle(sxx, sxy).between(75, 105))


def is_horizontal(n: Column, sxx: Column, sxy: Column) -> Column:
    """At least three points whose regression rises by at most 45 degrees."""
    return F.when((n < 3) | (sxx < RATE), False).otherwise(slope_angle(sxx, sxy) <= 45)


def steep_segment(dx: Column, dy: Column) -> Column:
    return F.degrees(F.abs(F.atan2(dy, dx))).between(75, 105) & (F.degrees(F.abs(F.atan2(dy, dx))) > 75) & (F.degrees(F.abs(F.atan2(dy, dx))) < 105)


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def normalised(points: Column, width: Column, height: Column) -> Column:
    """Shares of the image, clamped to 0..1."""
    unit = lambda v, n: F.least(F.greatest(v / n, F.lit(0.0)), F.lit(1.0))
    return F.transform(points, lambda p: point(unit(p["x"], width), unit(p["y"], height)))


def ribbon(points: Column, half: float = 3.0) -> Column:
    """A closed outline around a polyline: each vertex moved both ways along the normal of its segment, cut to whole pixels.

    Vertex i takes the direction of segment i, the last one that of the segment before; no length gives the normal (0, 1).
    """
    n = F.size(points)

    def side(sign: float):
        def move(p, i):
            a = F.get(points, F.least(i, n - 2))
            b = F.get(points, F.least(i, n - 2) + 1)
            return once(
                F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), distance(a, b).alias("d")),
                lambda v: point((p["x"] + sign * half * F.when(v["d"] > 0, -v["dy"] / v["d"]).otherwise(0.0)).cast("int"), (p["y"] + sign * half * F.when(v["d"] > 0, v["dx"] / v["d"]).otherwise(1.0)).cast("int")),
            )

        return F.transform(points, move)

    return F.when(n >= 2, F.concat(side(1.0), F.reverse(side(-1.0))))


def densified(points: Column, spacing: float) -> Column:
    """Vertices kept, points added so that neighbours are at most spacing apart."""

    def steps(s):
        k = F.greatest(F.lit(1), F.ceil(distance(s["a"], s["b"]) / spacing).cast("int"))
        return once(k, lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: point(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * i / n, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * i / n)))

    return F.when(F.size(points) < 2, points).otherwise(F.concat(F.slice(points, 1, 1), F.flatten(F.transform(segments(points), steps))))


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, left, top, right, bottom) -> Column:
    """The part of a segment in a rectangle as a struct of x1, y1, x2, y2, or null; a touch gives a pair of equal points.

    Each edge bounds the segment's parameter from one side; what lies between the bounds is inside.
    """
    dx, dy = x2 - x1, y2 - y1
    edges = [(-dx, x1 - left), (dx, right - x1), (-dy, y1 - top), (dy, bottom - y1)]
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in edges])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in edges])
    outside = F.lit(False)
    for p, q in edges:
        outside = outside | ((p == 0) & (q < 0))
    return F.when(~outside & (enter <= leave), F.struct((x1 + enter * dx).alias("x1"), (y1 + enter * dy).alias("y1"), (x1 + leave * dx).alias("x2"), (y1 + leave * dy).alias("y2")))


def clipped_polyline(points: Column, left, top, right, bottom) -> Column:
    """Pieces of a polyline inside a rectangle: clipped segments join where their ends agree to a millionth in both axes."""
    piece = "array<array<struct<x:double,y:double>>>"
    parts = F.filter(F.transform(segments(points), lambda s: clipped(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], left, top, right, bottom)), lambda c: c.isNotNull())

    def join(acc, c):
        a, b = point(c["x1"], c["y1"]), point(c["x2"], c["y2"])
        last = F.element_at(acc, -1)
        end = F.element_at(last, -1)
        meets = (F.size(acc) > 0) & (F.abs(end["x"] - a["x"]) < RATE) & (F.abs(end["y"] - a["y"]) < RATE)
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(b))))).otherwise(F.concat(acc, F.array(F.array(a, b))))

    empty = F.array().cast(piece)
    # An empty array has no last element: the fold looks only at what is there.
    guarded = lambda acc, c: F.when(F.size(acc) == 0, F.array(F.array(point(c["x1"], c["y1"]), point(c["x2"], c["y2"])))).otherwise(join(acc, c))
    return F.aggregate(parts, empty, guarded)


def x_on_vertical(top: Column, bottom: Column, y: Column) -> Column:
    """x of a straight meridian at y, beyond its ends too; its mean x if it has no height."""
    dy = bottom["y"] - top["y"]
    return F.when(dy == 0, (top["x"] + bottom["x"]) / 2).otherwise(top["x"] + (y - top["y"]) / F.nullif(dy, F.lit(0.0)) * (bottom["x"] - top["x"]))


def y_on_parallel(points: Column, x: Column) -> Column:
    """y of a parallel at x, linear between its vertices in the order of x; null outside."""
    ordered = F.array_sort(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))

    def value(ps):
        hit = F.filter(segments(ps), lambda s: (s["a"]["x"] <= x) & (x <= s["b"]["x"]))
        return once(hit, lambda h: F.when(F.size(h) > 0, once(F.get(h, F.lit(0)), lambda s: s["a"]["y"] + F.coalesce((x - s["a"]["x"]) / F.nullif(s["b"]["x"] - s["a"]["x"], F.lit(0.0)), F.lit(0.0)) * (s["b"]["y"] - s["a"]["y"]))))

    return once(ordered, value)


def end_direction(points: Column, at_start: bool, look_back: int = 3) -> Column:
    """Outward unit vector at an end over up to look_back vertices; null under a millionth."""
    n = F.size(points)
    tip = F.element_at(points, 1 if at_start else -1)
    inner = F.get(points, F.least(F.lit(look_back), n - 1)) if at_start else F.get(points, F.greatest(n - 1 - look_back, F.lit(0)))
    return once(F.struct((tip["x"] - inner["x"]).alias("x"), (tip["y"] - inner["y"]).alias("y"), distance(tip, inner).alias("d")), lambda v: F.when((n >= 2) & (v["d"] >= RATE), point(v["x"] / v["d"], v["y"] / v["d"])))


def extended_to_edge(x: Column, y: Column, dx: Column, dy: Column, width: Column, height: Column, reach: float = 200.0) -> Column:
    """An end moved on to the nearest image edge if that is within reach and the end heads for it (outward share over 0.3)."""
    right, bottom = width - 1, height - 1
    gaps = {"l": x, "r": right - x, "t": y, "b": bottom - y}
    nearest = F.least(*gaps.values())
    d = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / F.nullif(d, F.lit(0.0)), dy / F.nullif(d, F.lit(0.0))
    out = {"l": -ux, "r": ux, "t": -uy, "b": uy}
    to = lambda k: out[k] > 0.3
    go = {k: F.struct(F.least(F.greatest(x + ux * gaps[k] / out[k], F.lit(0.0)), right).alias("x"), F.least(F.greatest(y + uy * gaps[k] / out[k], F.lit(0.0)), bottom).alias("y")) for k in gaps}
    stay = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    hit = F.when(nearest > reach, stay).when(d.isNull() | (d < RATE), stay)
    for k in gaps:
        hit = hit.when((gaps[k] == nearest) & to(k), go[k])
    return hit.otherwise(stay)


def polynomial_terms(lon: Column, lat: Column, order: int = 2) -> list[Column]:
    """1, x, y, x2, xy, y2, and for order 3 also x3, x2y, xy2, y3."""
    terms = [F.lit(1.0)]
    for total in range(1, order + 1):
        for k in range(total + 1):
            term = F.lit(1.0)
            for _ in range(total - k):
                term = term * lon
            for _ in range(k):
                term = term * lat
            terms.append(term)
    return terms
