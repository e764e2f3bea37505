"""Grid lines from class masks: meridians, parallels and fragments, per image and region.

pixels: image_id, group_id, x, y of one class; images: image_id, group_id, width, height. All work is grouped by image and
region; centres and fitted lines are a few rows each, so their joins with the observations are equi-joins on the region.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point
from ..operators import fit
from ..operators.cluster import dedup_by_spacing, gap_clusters
from ..operators.filters import covering
from ..operators.joins import nearest_line
from ..operators.ordered import extend_centres, settled

KEYS = ["image_id", "group_id"]
#: Shares of the height at which reference rows stand, gap of a cluster, every how many pixels are observed.
REFERENCE_SHARES = (0.10, 0.25, 0.40, 0.50, 0.60, 0.75, 0.90)
CLUSTER_GAP, STEP, LEAST_POINTS = 30, 10, 20
#: Width and height of the cells through which pixels meet lines.
CELL = 256.0


def _cluster_centres(px: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    c = gap_clusters(px, keys, F.col(pos), [], CLUSTER_GAP)
    return c.groupBy(*keys, "cluster").agg(F.avg(pos).alias("centre"))


def meridians(pixels: DataFrame, images: DataFrame, draws: tuple[int, int] = (30, 50)) -> DataFrame:
    """(image_id, group_id, line_id, points, inliers, coverage): straight lines through the vertical class.

    Centres come from the reference row with most clusters, continued at equal spacing while other rows support them.
    Pixels near that row give each centre a robust line, all pixels then join their nearest line and fit it again.
    """
    px = pixels.select(*KEYS, "x", "y").join(images.select(*KEYS, "width", "height"), KEYS)
    shares = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(REFERENCE_SHARES)])
    refs = images.select(*KEYS, F.explode(shares).alias("r"), F.col("height")).select(*KEYS, F.col("r.k").alias("ref"), F.floor(F.col("height") * F.col("r.s")).cast("int").alias("y"))
    centres = _cluster_centres(px.join(refs, [*KEYS, "y"]), [*KEYS, "ref", "y"], "x")
    rows = centres.groupBy(*KEYS, "ref", "y").agg(F.array_sort(F.collect_list("centre")).alias("cs"))
    best = rows.groupBy(*KEYS).agg(F.max_by(F.struct("y", "cs"), F.struct(F.size("cs"), -F.col("ref"))).alias("b"), F.flatten(F.collect_list("cs")).alias("support"))
    enough = px.where(F.col("y") % STEP == 0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select(*KEYS)
    best = best.join(enough, KEYS, "left_semi").join(images.select(*KEYS, "width", "height"), KEYS)
    n = F.size("b.cs")
    gaps = F.array_sort(F.zip_with(F.slice("b.cs", 1, F.greatest(n - 1, F.lit(0))), F.slice("b.cs", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a))
    m = F.size("gaps")
    best = best.where(n >= 2).select(*KEYS, F.col("b.y").alias("ref_y"), F.col("b.cs").alias("cs"), "support", "width", "height", gaps.alias("gaps"))
    best = settled(best).withColumn("spacing", (F.get("gaps", F.floor((m - 1) / 2).cast("int")) + F.get("gaps", F.floor(m / 2).cast("int"))) / 2)
    best = settled(best.withColumn("spacing", F.when(F.size("cs") >= 3, F.col("spacing")).otherwise(F.lit(0.0))))
    best = extend_centres(best, "cs", F.col("spacing"), "support", F.col("width"))
    best = best.withColumn("tilt", F.greatest(F.lit(150), F.floor(0.6 * F.get("gaps", F.lit(0)))))
    lines = best.select(*KEYS, "ref_y", "tilt", F.posexplode("cs").alias("line_id", "centre"))
    obs = px.where(F.col("y") % STEP == 0)

    def nearest(candidates: DataFrame, at, tilt) -> DataFrame:
        d = F.abs(F.col("x") - at)
        near = candidates.withColumn("d", d).where(F.col("d") < tilt)
        return near.groupBy(*KEYS, "x", "y").agg(F.min(F.struct("d", "line_id")).alias("m")).select(*KEYS, "x", "y", F.col("m.line_id").alias("line_id"))

    first = nearest(obs.join(lines, KEYS).where(F.abs(F.col("y") - F.col("ref_y")) < F.floor(F.col("height") / 4)), F.col("centre"), F.col("tilt"))
    robust = fit.robust_line(first, [*KEYS, "line_id"], "x", "y", ["x", "y"], draws=draws[0], apart=5.0)
    counts = first.groupBy(*KEYS, "line_id").agg(F.count(F.lit(1)).alias("n"))
    fitted = lines.join(robust, [*KEYS, "line_id"], "left").join(counts, [*KEYS, "line_id"], "left")
    good = (F.coalesce("n", F.lit(0)) >= 10) & F.col("slope").isNotNull()
    fitted = fitted.select(*KEYS, "line_id", "tilt", F.when(good, F.col("slope")).otherwise(0.0).alias("slope"), F.when(good, F.col("intercept")).otherwise(F.col("centre")).alias("intercept"))
    every = nearest_line(obs.select(*KEYS, "x", "y").distinct(), fitted, KEYS, "x", "y", "slope", "intercept", "line_id", F.col("tilt"), CELL).select(*KEYS, "x", "y", "line_id")
    final = fit.robust_line(every, [*KEYS, "line_id"], "x", "y", ["x", "y"], draws=draws[1], apart=10.0)
    spans = every.groupBy(*KEYS, "line_id").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1")).join(images.select(*KEYS, "height"), KEYS)
    spans = covering(spans.where(F.col("n") >= LEAST_POINTS), F.col("y0"), F.col("y1"), F.col("height"))
    out = spans.join(final, [*KEYS, "line_id"])
    x_at = lambda y: F.bround(F.col("slope") * y + F.col("intercept"), 1)
    out = out.withColumn("points", F.array(point(x_at(F.col("y0")), F.col("y0")), point(x_at(F.col("y1")), F.col("y1"))))
    out = out.withColumn("x_mid", (F.get("points", F.lit(0))["x"] + F.get("points", F.lit(1))["x"]) / 2)
    return dedup_by_spacing(out.select(*KEYS, "line_id", "points", "x_mid", "inliers", "coverage"), KEYS, F.col("x_mid"), F.col("inliers"), ["line_id"])


def parallels(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, group_id, line_id, points): arcs of 30 points through the horizontal class.

    Centres come from the middle column, or the first scanned one with two hits; pixels join the nearest centre under 80
    away; medians over 30 windows give a quadratic, which is followed at both ends while pixels support it.
    """
    size = images.select(*KEYS, "width", "height")
    px = pixels.select(*KEYS, "x", "y").join(size, KEYS)
    scan = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(F.col("width") / 4 + i * F.col("width") / 10).cast("int"))
    columns = size.select(*KEYS, F.posexplode(F.concat(F.array(F.floor(F.col("width") / 2).cast("int")), F.filter(scan, lambda c: c < 3 * F.col("width") / 4))).alias("order", "x"))
    centres = _cluster_centres(px.join(columns, [*KEYS, "x"]), [*KEYS, "order", "x"], "y")
    rows = centres.groupBy(*KEYS, "order").agg(F.array_sort(F.collect_list("centre")).alias("cs")).where((F.col("order") == 0) | (F.size("cs") >= 2))
    lines = rows.groupBy(*KEYS).agg(F.min_by("cs", "order").alias("cs")).select(*KEYS, F.posexplode("cs").alias("line_id", "centre"))
    near = px.where(F.col("x") % STEP == 0).join(lines, KEYS).withColumn("d", F.abs(F.col("y") - F.col("centre"))).where("d < 80")
    obs = near.groupBy(*KEYS, "x", "y", "width").agg(F.min(F.struct("d", "line_id")).alias("m")).select(*KEYS, "x", "y", "width", F.col("m.line_id").alias("line_id"))
    ids = [*KEYS, "line_id"]
    spans = obs.groupBy(*ids, "width").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    spans = covering(spans.where(F.col("n") >= LEAST_POINTS), F.col("x0"), F.col("x1"), F.col("width"))
    at = spans.withColumn("window", F.greatest(F.lit(20.0), (F.col("x1") - F.col("x0")) / 30)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("sx", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / 29.0)
    samples = at.select(*ids, "i", "sx", "window").join(obs.select(*ids, "x", "y"), ids).where(F.abs(F.col("x") - F.col("sx")) < F.col("window")).groupBy(*ids, "i", "sx").agg(F.median("y").alias("sy"))
    curve = fit.quadratic_fit(samples, ids, F.col("sx"), F.col("sy")).where((F.col("n") >= 5) & F.col("a").isNotNull()).drop("n")
    y_at = lambda v: F.col("a") * v * v + F.col("b") * v + F.col("c")
    base = spans.join(curve, ids).join(size.select(*KEYS, "height"), KEYS)
    reach = {}
    for name, sign, edge in (("left", -1, "x0"), ("right", 1, "x1")):
        steps = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("width") / STEP).cast("int"))))).withColumn("mx", F.col(edge) + sign * STEP * F.col("k")).where(F.col("mx").between(0, F.col("width") - 1))
        hits = steps.select(*ids, "k", "mx", y_at(F.col("mx")).alias("my")).join(px.select(*KEYS, F.col("x").alias("mx"), "y"), [*KEYS, "mx"]).where(F.abs(F.col("y") - F.col("my")) <= 15).select(*ids, "k").distinct()
        gap = steps.join(hits, [*ids, "k"], "left_anti").groupBy(*ids).agg((F.min("k") - 1).alias("stop"))
        last = steps.groupBy(*ids).agg(F.max("k").alias("all")).join(gap, ids, "left")
        reach[name] = last.select(*ids, F.coalesce("stop", "all").alias(name))
    out = base.join(reach["left"], ids, "left").join(reach["right"], ids, "left")
    lo = F.col("x0") - STEP * F.coalesce("left", F.lit(0))
    hi = F.col("x1") + STEP * F.coalesce("right", F.lit(0))
    out = out.withColumns({"lo": lo, "hi": hi}).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("px", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 29.0)
    y = F.least(F.greatest(y_at(F.col("px")), F.lit(0.0)), F.col("height") - 1.0)
    out = out.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", point(F.bround("px", 1), F.bround(y, 1)).alias("p")))), lambda s: s["p"]).alias("points"))
    mean_y = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["y"]) / F.size("points")
    return out.withColumn("line_id", (F.row_number().over(Window.partitionBy(*KEYS).orderBy(mean_y, "line_id")) - 1).cast("int"))


def fragment_meridians(fragments: DataFrame, images: DataFrame, gap: float = 50.0, least: float = 0.25) -> DataFrame:
    """Fragments (image_id, fragment_id, points) joined to meridians: each is fitted and projected on the middle row,
    projections under `gap` apart form a group, the group's points are fitted and spans under `least` of the height go.
    Without fragments there are no lines."""
    v = fragments.select("image_id", "fragment_id", F.explode("points").alias("p")).select("image_id", "fragment_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).join(images.select("image_id", "height"), "image_id")
    local = v.groupBy("image_id", "fragment_id", "height").agg(F.regr_slope("x", "y").alias("a"), F.regr_intercept("x", "y").alias("b"), F.avg("x").alias("mx"))
    local = local.withColumn("proj", F.coalesce(F.col("a") * F.col("height") / 2 + F.col("b"), F.col("mx")))
    groups = gap_clusters(local.select("image_id", "fragment_id", "proj"), ["image_id"], F.col("proj"), ["fragment_id"], gap, strict=True, name="line_id")
    pts = v.join(groups, ["image_id", "fragment_id"])
    f = pts.groupBy("image_id", "line_id", "height").agg(F.regr_slope("x", "y").alias("a"), F.regr_intercept("x", "y").alias("b"), F.avg("x").alias("mx"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    f = f.where(F.col("y1") - F.col("y0") >= least * F.col("height"))
    x = lambda y: F.coalesce(F.col("a") * y + F.col("b"), F.col("mx"))
    return f.select("image_id", "line_id", F.array(point(x(F.col("y0")), F.col("y0")), point(x(F.col("y1")), F.col("y1"))).alias("points"))


def _y_near(points: np.ndarray, x: float) -> float:
    near = np.abs(points[:, 0] - x) < 50
    return float(points[near, 1].mean()) if near.any() else float(points[np.abs(points[:, 0] - x).argmin(), 1])


def _apart(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Difference in y where two fragments overlap in x, or in the middle between them; and the gap in x."""
    lo, hi = max(a[:, 0].min(), b[:, 0].min()), min(a[:, 0].max(), b[:, 0].max())
    return abs(_y_near(a, (lo + hi) / 2) - _y_near(b, (lo + hi) / 2)), max(0.0, lo - hi)


def group_fragments(parts: Sequence[np.ndarray], height: float, base: float = 80.0) -> list[list[int]]:
    """In order of mean y, a fragment joins the current group if it is locally near to some member and no wide gap in x
    separates it from all of them; else it opens the next group."""
    limit = max(base, 0.025 * height)
    order = sorted(range(len(parts)), key=lambda i: parts[i][:, 1].mean())
    groups: list[list[int]] = []
    for i in order:
        both = [_apart(parts[i], parts[j]) for j in groups[-1]] if groups else []
        if both and min(d for d, _ in both) < limit and any(g < 3 * limit for _, g in both):
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


def sample_line(points: np.ndarray, n: int = 30, least: float = 50.0) -> np.ndarray | None:
    """n positions along x with the mean y around each; a position without points takes the value before."""
    x0, x1 = points[:, 0].min(), points[:, 0].max()
    if x1 - x0 < least:
        return None
    out: list[tuple[int, int]] = []
    for x in np.linspace(x0, x1, n):
        near = points[np.abs(points[:, 0] - x) < max(20.0, (x1 - x0) / n)]
        if len(near):
            out.append((int(x), int(near[:, 1].mean())))
        elif out:
            out.append((int(x), out[-1][1]))
    return np.array(out, float) if len(out) >= 2 else None


def fragment_parallels(fragments: DataFrame, images: DataFrame) -> DataFrame:
    """Fragments joined to parallels, one image in a task."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.array([[p["x"], p["y"]] for p in pts], float) for pts in table.column("points").to_pylist() if pts]
        height = table.column("height")[0].as_py()
        lines = [s for g in group_fragments(parts, height) if (s := sample_line(np.vstack([parts[i] for i in g]))) is not None]
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        return pa.table([pa.array([table.column("image_id")[0].as_py()] * len(lines), table.column("image_id").type), pa.array(range(len(lines)), pa.int32()), pa.array([[{"x": a, "y": b} for a, b in s] for s in lines], kind)], names=["image_id", "line_id", "points"])

    kind = fragments.select("image_id").schema[0].dataType.simpleString()
    rows = fragments.join(images.select("image_id", "height"), "image_id").select("image_id", "points", "height")
    return rows.groupBy("image_id").applyInArrow(run, f"image_id {kind}, line_id int, points array<struct<x:double,y:double>>")
