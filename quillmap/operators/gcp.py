"""Ground control points: grid lines from annotations, and the crossings of meridians and parallels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox, mean, xs, ys

STEPS, TOLERANCE = 30, 0.5


def grid_lines(shapes: DataFrame) -> DataFrame:
    """Annotation shapes as grid lines: kind v (two ends, top first), h or s; all other shapes are dropped.

    pos is the mean x of a meridian and the mean y of a parallel, span its extent along the other axis.
    """
    kind = F.when((F.col("label") == "vertical_line") & (F.col("shape_type") == "line"), "v").when((F.col("label") == "horizontal_arc") & (F.col("shape_type") == "linestrip"), "h").when(F.col("label") == "splitter", "s")
    out = shapes.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.size("points") >= 2))
    ends = F.slice("points", 1, 2)
    upright = F.when(F.get(ends, F.lit(0))["y"] <= F.get(ends, F.lit(1))["y"], ends).otherwise(F.reverse(ends))
    out = out.withColumn("points", F.when(F.col("kind") == "v", upright).otherwise(F.col("points"))).withColumn("box", bbox(F.col("points")))
    pos = F.when(F.col("kind") == "h", mean(ys(F.col("points")))).otherwise(mean(xs(F.col("points"))))
    span = F.when(F.col("kind") == "h", F.col("box.x_max") - F.col("box.x_min")).otherwise(F.col("box.y_max") - F.col("box.y_min"))
    return out.withColumns({"pos": pos, "span": span})


#: Places of parallels that are looked at side by side.
SIDE_BY_SIDE = 1 << 20


def crossings(ends: np.ndarray, arcs: tuple[np.ndarray, np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where meridians meet parallels, by fixed-point iteration from the middle of their common range of y; many pairs at a time.

    x = V(y), y' = H(x): outside the parallel there is no point; within half a pixel of y the point (x, y') is taken if
    y' lies in the meridian's range, and the iteration ends either way. NaN without a point. ends: x and y of top and bottom;
    arcs: x and y of the vertices of each parallel in the order of x, filled up with NaN.
    """
    (tx, ty, bx, by), (ax, ay), y = ends, arcs, start.copy()
    px, py, left = np.full(len(y), np.nan), np.full(len(y), np.nan), np.arange(len(y))
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(STEPS):
            dy = by[left] - ty[left]
            x = np.where(dy == 0, (tx[left] + bx[left]) / 2, tx[left] + (y[left] - ty[left]) / dy * (bx[left] - tx[left]))
            hit = (ax[left, :-1] <= x[:, None]) & (x[:, None] <= ax[left, 1:])
            at = hit.argmax(axis=1)
            x1, x2, y1, y2 = ax[left, at], ax[left, at + 1], ay[left, at], ay[left, at + 1]
            new = np.where(hit.any(axis=1), y1 + np.where(x2 == x1, 0.0, (x - x1) / (x2 - x1)) * (y2 - y1), np.nan)
            near = np.abs(new - y[left]) < TOLERANCE
            taken = near & (low[left] <= new) & (new <= high[left])
            px[left[taken]], py[left[taken]] = x[taken], new[taken]
            on = ~near & ~np.isnan(new)
            left = left[on]
            y[left] = new[on]
            if not len(left):
                break
    return px, py


def intersections(verticals: DataFrame, parallels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Control points: every meridian with a degree against every parallel with one whose ranges of y overlap.

    An equi-join on the sheet with the overlap as residual; verticals: points, degree; parallels: points, degree. Lines are
    few bytes and crossings much work, so sheets are dealt to a fixed number of tasks.
    """
    keys = list(keys)
    tasks = int(verticals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = verticals.where(F.col("degree").isNotNull()).select(*keys, F.col("degree").alias("lon"), F.get("points", F.lit(0)).alias("top"), F.get("points", F.lit(1)).alias("bottom"))
    v = v.withColumns({"v_min": F.least("top.y", "bottom.y"), "v_max": F.greatest("top.y", "bottom.y")})
    ordered = F.array_sort(F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    h = parallels.where(F.col("degree").isNotNull()).select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("degree").alias("lat"), ordered.alias("arc"), F.array_min(ys(F.col("points"))).alias("h_min"), F.array_max(ys(F.col("points"))).alias("h_max"))
    on = (F.col("v_min") <= F.col("h_max")) & (F.col("h_min") <= F.col("v_max"))
    for k in keys:
        on = (F.col(k) == F.col(f"h_{k}")) & on
    start = (F.greatest("v_min", "h_min") + F.least("v_max", "h_max")) / 2
    ends = [F.col(f"{p}.{c}").alias(f"__{p}_{c}") for p in ("top", "bottom") for c in ("x", "y")]
    met = v.repartition(tasks, *keys).join(h.repartition(tasks, *[f"h_{k}" for k in keys]), on).select(*keys, "lon", "lat", *ends, "v_min", "v_max", start.alias("__start"), "arc")
    kept = [*keys, "lon", "lat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c, b: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            longest = max([2, *(n or 0 for n in pc.list_value_length(batch.column("arc")).to_pylist())])
            step = max(1, SIDE_BY_SIDE // longest)
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                size = np.array([n or 0 for n in pc.list_value_length(b.column("arc")).to_pylist()], int)
                flat = b.column("arc").flatten()
                arcs = np.full((2, b.num_rows, longest), np.nan)
                arcs[:, np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = [pc.struct_field(flat, [k]).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)]
                x, y = crossings(np.array([column(e, b) for e in ("__top_x", "__top_y", "__bottom_x", "__bottom_y")]), (arcs[0], arcs[1]), *[column(c, b) for c in ("__start", "v_min", "v_max")])
                found = pa.array(~np.isnan(x))
                out = pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(x), pa.array(y)], [*kept, "pixel_x", "pixel_y"])
                yield out.filter(found)

    types = {f.name: f.dataType.simpleString() for f in met.schema}
    out = met.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in kept) + ", pixel_x double, pixel_y double")
    return out.select(*kept, F.bround("pixel_x", 2).alias("pixel_x"), F.bround("pixel_y", 2).alias("pixel_y"))


def main_box(lines: DataFrame, keys: Sequence[str], width: Column, height: Column, longest: int = 10) -> DataFrame:
    """Image box whose right and bottom shrink to the ends of the longest lines; left and top stay at 0."""
    from .ordered import top_k

    v = top_k(lines.where("kind = 'v'"), keys, longest, F.col("span").desc(), F.col("line_id"))
    h = top_k(lines.where("kind = 'h'"), keys, longest, F.col("span").desc(), F.col("line_id"))
    both = v.select(*keys, F.col("box.x_max").alias("r"), F.lit(None).cast("double").alias("b")).unionByName(h.select(*keys, F.lit(None).cast("double").alias("r"), F.col("box.y_max").alias("b")))
    got = lines.groupBy(*keys).agg(F.first(width).alias("__w"), F.first(height).alias("__h")).join(both.groupBy(*keys).agg(F.max("r").alias("r"), F.max("b").alias("b")), list(keys), "left")
    return got.select(*keys, F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), F.least(F.col("__w") - 1, F.coalesce("r", F.col("__w") - 1)).alias("x_max"), F.least(F.col("__h") - 1, F.coalesce("b", F.col("__h") - 1)).alias("y_max"))


def edge_strips(boxes: DataFrame, thickness: float = 200.0) -> DataFrame:
    """The four strips along a box's edges, clamped to it."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x_min", "y_min", "x_max", "y_max"))
    strip = lambda name, a, b, c, d: F.struct(F.lit(name).alias("side"), a.cast("double").alias("x0"), b.cast("double").alias("y0"), c.cast("double").alias("x1"), d.cast("double").alias("y1"))
    strips = [strip("top", x0, y0, x1, F.least(y1, y0 + thickness)), strip("bottom", x0, F.greatest(y0, y1 - thickness), x1, y1), strip("left", x0, y0, F.least(x1, x0 + thickness), y1), strip("right", F.greatest(x0, x1 - thickness), y0, x1, y1)]
    return boxes.select("*", F.explode(F.array(*strips)).alias("s")).select(*[c for c in boxes.columns if c not in ("x_min", "y_min", "x_max", "y_max")], "s.*")


def report(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lines.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("lines"), F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("inferred"), F.min("degree").alias("least"), F.max("degree").alias("most"))
