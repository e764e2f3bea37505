"""Lines of regions: dissolved boundaries, overlays of noded edges, components and clean-up.

Regions are given as noded edges: neighbours share whole edges. Then overlays are exact set operations on undirected edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import arc_length, clipped_polyline, densified, point, segments
from ..storage import forget, materialise
from . import overlay, small_sheets
from .fit import plane_value
from .raster import kept_points


def canonical_edges(rings: DataFrame, keys: Sequence[str], points: str = "points") -> DataFrame:
    """Undirected edges of rings, the smaller end first; edges without length are dropped."""
    e = rings.select(*keys, F.explode(segments(F.col(points))).alias("s"))
    e = e.select(*keys, F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"))
    return e.where(F.col("a") != F.col("b"))


def dissolve(edges: DataFrame, keys: Sequence[str], parity: bool = True) -> DataFrame:
    """Outline of the union of regions: edges that occur an odd number of times (once) within each key."""
    n = edges.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") % 2 == 1 if parity else F.col("n") == 1).drop("n")


def union_edges(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y).distinct()


def difference(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.subtract(y)


def symmetric_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.subtract(y).unionByName(y.subtract(x))


def intersection(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.intersect(y)


def ring_area(edges_in_order: str = "points"):
    """Signed area of a closed ring by the shoelace sum."""
    return F.aggregate(segments(F.col(edges_in_order)), F.lit(0.0), lambda acc, s: acc + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2)


def two_levels(edges: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Outer outline of all regions, and the borders between groups that are not part of it."""
    outer = dissolve(edges.select("a", "b"), [])
    inner = dissolve(edges.select(group, "a", "b"), [group]).select("a", "b").distinct()
    return outer, inner.subtract(outer)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id each id is linked to. An id linked to null only is its own.

    Rounds shrink the graph: every id with a smaller neighbour points to its smallest one, the pointers jump until they
    reach ids without any, and links between those are the next round's. So each round at least halves the ids, and the
    links are read once a round. Every round is a table in the shared folder. The ids may be of any ordered type.
    """
    ordered = lambda df: df.select(F.greatest("u", "v").alias("u"), F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.least("u", "v")).alias("v")).distinct()
    whole = materialise(ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    alone = whole.where("v IS NULL OR u = v").select(F.explode(F.array("u", "v")).alias("id"))
    alone = None if alone.isEmpty() else materialise(alone, "alone")
    links, table, levels = whole.where("u <> v"), whole, []
    while not links.isEmpty():
        roots = materialise(links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")), "roots")
        while True:
            hop = lambda c, n: roots.select(F.col("id").alias(c), F.col("root").alias(n))  # noqa: B023, E731
            far = roots.join(hop("root", "__2"), "root", "left").select("id", "root", F.coalesce("__2", "root").alias("__2")).join(hop("__2", "__3"), "__2", "left")
            done, roots = roots, materialise(far.select("id", F.coalesce("__3", "__2").alias("root"), (F.col("__2") != F.col("root")).alias("moved")), "roots")
            forget(done)
            if roots.where("moved").isEmpty():
                break
        levels.append(roots)
        to = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"__{c}"))  # noqa: B023, E731
        moved = links.join(to("u"), "u").join(to("v"), "v", "left").select(F.col("__u").alias("u"), F.coalesce("__v", "v").alias("v"))
        done, links = table, materialise(ordered(moved.where("u <> v")), "edges")
        table = links
        forget(done)
    # A root of one round may point on in a later one; the last rounds are the smallest.
    found = levels[-1].select("id", F.col("root").alias("component")) if levels else links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for roots in levels[-2::-1]:
        further = found.select(F.col("id").alias("root"), F.col("component").alias("__c"))
        found = roots.join(further, "root", "left").select("id", F.coalesce("__c", "root").alias("component")).unionByName(found)
    found = materialise(found, "labels")
    for done in (*levels, table):
        forget(done)
    least = found.select(F.col("component").alias("id"))
    least = (least.unionByName(alone.join(found, "id", "left_anti")) if alone else least).distinct()
    return found.unionByName(least.select("id", F.col("id").alias("component")))


def component_boxes(pixels: DataFrame, keys: Sequence[str], component: str, least: int = 0) -> DataFrame:
    """Pixel count, box, centre and spans of each component with over `least` pixels."""
    c = pixels.groupBy(*keys, component).agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return c.where(F.col("area") > least)


def geo_to_pixel(lines: DataFrame, model: dict, spacing: float, points: str = "points") -> DataFrame:
    """Densify lines of longitudes and latitudes and take them through a fitted polynomial."""
    dense = densified(F.col(points), spacing)
    return lines.withColumn(points, F.transform(dense, lambda p: point(plane_value(model, p["x"], p["y"], 0), plane_value(model, p["x"], p["y"], 1))))


#: Edges of which one task puts the lines in order.
TASK_EDGES = 20_000


def merged(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_id, points): noded edges (a, b) of each key joined into lines at the nodes where just two of them meet.

    A ring begins and ends at its smallest node. line_id is the line's smallest edge as text, made of the finished line, so
    that no text moves.
    """
    keys = list(keys)
    found = paths(edges.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), keys)
    text = lambda s: F.concat_ws(" ", *[F.format_number(end(s["a"], s["b"])[c], 9) for end in (F.least, F.greatest) for c in ("x", "y")], *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return found.select(*keys, F.array_min(F.transform(segments(F.col("points")), text)).alias("line_id"), "points")


def paths(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """merged() of distinct edges, the smaller end first, with numbers as line_id.

    Edges are numbered, and those that share a node of two edges are one component, found in rounds; the lines are then dealt
    to tasks of TASK_EDGES edges or one longer line, and put in order. An edge that shares none is a line as it stands.
    """
    keys = list(keys)
    # Written, so that an edge keeps its number.
    e = materialise(edges.select(*keys, "a", "b", F.monotonically_increasing_id().alias("id")), "edges")
    ends = e.select(*keys, "id", F.explode(F.array("a", "b")).alias("node"))
    inner = ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2")
    line = components(inner.select("a", "b")).select("id", F.col("component").alias("line_id"))
    types = {f.name: f.dataType.simpleString() for f in e.schema}

    def run(table: pa.Table) -> pa.Table:
        lines: dict[int, list[int]] = {}
        for i, name in enumerate(table.column("line_id").to_pylist()):
            lines.setdefault(name, []).append(i)
        ends = [[(n["x"], n["y"]) for n in table.column(c).to_pylist()] for c in ("a", "b")]
        points = [[{"x": x, "y": y} for x, y in small_sheets.walk([(ends[0][i], ends[1][i]) for i in rows])] for rows in lines.values()]
        first = table.select([*keys, "line_id"]).take(pa.array([rows[0] for rows in lines.values()], pa.int64()))
        return first.append_column("points", pa.array(points, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    # Edges that share a node are of one key, so a line is one of its key.
    rows = materialise(e.join(line, "id").select(*keys, "line_id", "a", "b"), "joined")
    tasks = max(1, -(-rows.count() // TASK_EDGES))
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "line_id long", "points array<struct<x:double,y:double>>"])
    found = rows.withColumn("__task", F.pmod(F.xxhash64("line_id"), F.lit(tasks))).groupBy("__task").applyInArrow(lambda t: run(t.drop(["__task"])), schema)
    return e.join(line, "id", "left_anti").select(*keys, F.col("id").alias("line_id"), F.array("a", "b").alias("points")).unionByName(found)


def simplified(lines: DataFrame, tolerance: float, points: str = "points") -> DataFrame:
    """Lines simplified by Douglas-Peucker, an Arrow batch at a time."""
    kind = lines.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(points)
            column, field = batch.column(at), batch.schema.field(at)
            flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = kept_points(np.stack([pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in "xy"], 1), sizes, tolerance)
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
            thin = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(keep)), mask=column.is_null() if column.null_count else None)
            yield batch.set_column(at, field, thin.cast(field.type))

    return lines.mapInArrow(run, kind)


def area(rings: Column) -> Column:
    """Area of a ring of points, whichever way round it runs."""
    return F.abs(F.aggregate(segments(rings), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def mismatch(regions: DataFrame, whole: DataFrame, points: str = "points", unit: float = 1e-6) -> float:
    """Area of what only one of the two covers: rings of regions, and rings of what they should cover together."""
    rings = lambda df: df.select(F.lit(0).alias("all"), F.array(points).alias("rings"))
    off = overlay.enclosed(overlay.overlay(rings(regions), rings(whole), ["all"], "symmetric_difference", unit), ["all"]).first()
    return abs(off["area"]) if off else 0.0


def simplified_apart(lines: DataFrame, keys: Sequence[str], line: str, tolerance: float, points: str = "points", unit: float = 1 / 1024) -> DataFrame:
    """Lines that meet at their ends only, simplified by Douglas-Peucker so that they still do.

    A line that would cross, touch or cover another one or itself is simplified with a quarter of the tolerance, as are the
    lines that it met; what still meets then is not simplified. Rounds end when no more lines meet. Ends stay, so nodes do;
    a ring keeps four points at least.

    So a line that simplification changes has three forms. Which of them meet is found once, and the rounds pass over those
    pairs; other lines have one form and take part in the search only.
    """
    name, other = [*keys, line], [*keys, "line2"]
    rest = [c for c in lines.columns if c != points]
    lines = materialise(lines, "lines")
    long = F.coalesce(F.size(points) > 2, F.lit(False))
    bent = lines.where(long).withColumns({"__own": F.col(points), "__mid": F.col(points)})
    tried = materialise(simplified(simplified(bent, tolerance, points), tolerance / 4, "__mid"), "simplified")
    changed = F.col("__own") != F.col(points)
    straight, bent = lines.where(~long).unionByName(tried.where(~changed).select(lines.columns)), tried.where(changed)
    forms = bent.select(*name, F.col("__own"), F.posexplode(F.array(points, "__mid", "__own")).alias("form", "__form"))
    places = forms.select(*name, "form", F.posexplode(segments(F.col("__form"))).alias("place", "s")).select(*name, "form", "place", F.array(F.array("s.a", "s.b")).alias("rings"))
    moving = overlay.snapped_segments(places, [*name, "form", "place"], unit, closed=False)
    still = overlay.snapped_segments(straight.select(*keys, F.array(points).alias("rings")), keys, unit, closed=False)
    segs = materialise(moving.unionByName(still.withColumns({c: F.lit(None).cast(moving.schema[c].dataType) for c in (line, "form", "place")})), "segments")
    closed = F.get(F.col("__own"), F.lit(0)) == F.element_at("__own", -1)
    flat = forms.where(closed & (F.size("__form") < 4) & (F.size("__own") >= 4)).select(*name, "form", F.col(line).alias("line2"), F.col("form").alias("form2"))
    meet = materialise(overlay.touching(segs, keys, line, "form", "place", 2).unionByName(flat), "meet")
    forget(segs)
    step = materialise(meet.select(*keys, F.explode(F.array(line, "line2")).alias(line)).where(F.col(line).isNotNull()).distinct().withColumns({"form": F.lit(0), "moved": F.lit(True)}), "steps")
    rounds = 0
    while not step.where("moved").isEmpty():
        now = step.select(*name, "form")
        met = meet.join(now, [*name, "form"]).join(now.select(*keys, F.col(line).alias("line2"), F.col("form").alias("form2"), F.lit(True).alias("there")), [*other, "form2"], "left").where("line2 IS NULL OR there")
        back = met.select(*keys, F.explode(F.array(line, "line2")).alias(line)).where(F.col(line).isNotNull()).distinct().withColumn("back", F.lit(True))
        moves = F.col("back").isNotNull() & (F.col("form") < 2)
        done, step = step, materialise(now.join(back, name, "left").select(*name, F.when(moves, 1 if rounds == 0 else 2).otherwise(F.col("form")).alias("form"), moves.alias("moved")), "steps")
        forget(done)
        rounds += 1
    forget(meet)
    taken = F.when(F.col("form") == 2, F.col("__own")).when(F.col("form") == 1, F.col("__mid")).otherwise(F.col(points))
    return straight.select(*rest, points).unionByName(bent.join(step.drop("moved"), name, "left").select(*rest, taken.alias(points)))


def joined_lines(lines: DataFrame, keys: Sequence[str], points: str = "points", unit: float = 1 / 1024, crossing: bool = True) -> DataFrame:
    """(keys, line_id, points): the union of lines, cut where they meet and joined where just two pieces do; crossing as in overlay.noded()."""
    return paths(overlay.noded_lines(lines, keys, unit, points, crossing), keys)


#: Segments of a sheet that is cleaned up in one task, and those of all sheets of a task, squared and added up.
SHEET_SEGMENTS, TASK_SQUARES = 512, 4_000_000


def clean_up(lines: DataFrame, keys: Sequence[str], width: int, height: int, first: float = 1.0, tolerance: float = 2.0, least: float = 8.0, points: str = "points", unit: float = 1 / 1024) -> DataFrame:
    """(keys, points): lines simplified by `first`, united and joined, simplified by `tolerance`, clipped to the image, of `least` pixels.

    Simplification takes the lines as noded arcs, so that a border of two regions stays one line, and makes no crossings.
    Sheets of up to SHEET_SEGMENTS segments move once and are cleaned up side by side in their tasks; the segments of larger
    ones meet in joins by cell, as no such sheet need fit a task.
    """
    keys = list(keys)
    segs = overlay.snapped_segments(lines.select(*keys, F.array(points).alias("rings")), keys, unit, closed=False).select(*keys, *overlay.EDGE)
    segs = materialise(segs.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()), "segments")
    sizes = materialise(segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    small = F.col("__n") <= SHEET_SEGMENTS
    squares, most = sizes.agg(F.sum(F.when(small, F.col("__n") * F.col("__n"))), F.max("__n")).first()
    of = lambda df, which: df.join(sizes.where(which).hint("merge"), keys)
    apart = _arcs_of_small(of(segs, small).drop("__n"), keys, max(1, -(-(squares or 0) // TASK_SQUARES)), first, tolerance, unit)
    if (most or 0) > SHEET_SEGMENTS:
        arcs = joined_lines(of(lines.select(*keys, points), ~small).drop("__n"), keys, points, unit)
        again = joined_lines(simplified_apart(arcs, keys, "line_id", first, unit=unit), keys, unit=unit, crossing=False)
        apart = apart.unionByName(simplified_apart(again, keys, "line_id", tolerance, unit=unit).select(*keys, "points"))
    # Clipping makes no line longer; the pixel is for rounding.
    return clean(apart.where(arc_length(F.col("points")) >= least - 1), keys, width, height, least, 0.0)


def _arcs_of_small(segs: DataFrame, keys: list[str], tasks: int, first: float, tolerance: float, unit: float) -> DataFrame:
    """(keys, points) of small_sheets.arcs_of() of segments whose sheets are dealt to so many tasks."""
    types = {f.name: f.dataType.simpleString() for f in segs.schema}

    def run(table: pa.Table) -> pa.Table:
        code = np.zeros(len(table), np.int64)
        for k in keys:
            held = table.column(k).combine_chunks().dictionary_encode()
            code = np.unique(code * (len(held.dictionary) + 1) + held.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        at = order[np.searchsorted(code[order], np.arange(code.max() + 1))]
        of, sizes, xy = small_sheets.arcs_of(code[order], [table.column(c).to_numpy()[order] for c in overlay.EDGE], first, tolerance, unit)
        flat = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return table.select(keys).take(pa.array(at[of])).append_column("points", pa.ListArray.from_arrays(ends, flat))

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "points array<struct<x:double,y:double>>"])
    return segs.withColumn("__task", F.pmod(F.xxhash64(*keys), F.lit(tasks))).groupBy("__task").applyInArrow(lambda t: run(t.drop(["__task"])), schema)


def clean(lines: DataFrame, keys: Sequence[str], width, height, least: float = 8.0, tolerance: float = 2.0, points: str = "points") -> DataFrame:
    """Simplified lines clipped to the image, of which pieces of at least `least` pixels stay; duplicates are dropped."""
    thin = simplified(lines.select(*keys, points), tolerance, points) if tolerance else lines
    pieces = thin.select(*keys, F.explode(clipped_polyline(F.col(points), F.lit(0.0), F.lit(0.0), F.lit(float(width - 1)), F.lit(float(height - 1)))).alias(points))
    return pieces.where(arc_length(F.col(points)) >= least).distinct()


def run_lengths(pixels: DataFrame, keys: Sequence[str], along: str, least: int) -> DataFrame:
    """Runs of consecutive positions of at least `least`, per key: what an opening by a line of that length keeps."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy(along)
    runs = pixels.select(*keys, along).distinct().withColumn("__g", F.col(along) - F.row_number().over(by))
    out = runs.groupBy(*keys, "__g").agg(F.min(along).alias("start"), F.max(along).alias("end"), F.count(F.lit(1)).alias("length"))
    return out.where(F.col("length") >= least).drop("__g")
