"""Regressions and thresholds from moment sums and histograms: one partial aggregation each, whatever the input's size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polynomial_terms


def line_fit(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Least squares y = slope * x + intercept, with the count and the sums of squares that orientation needs."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))


def quadratic_fit(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Least squares y = a x2 + b x + c by Cramer's rule over sums of centred powers; nulls under three distinct x."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("__m"))
    centred = df.join(mean, list(keys)) if keys else df.crossJoin(F.broadcast(mean))
    u = x - F.col("__m")
    s = centred.groupBy(*keys).agg(
        F.first("__m").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(u).alias("s1"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(y).alias("t0"), F.sum(u * y).alias("t1"), F.sum(u * u * y).alias("t2"),
    )
    c = F.col
    det = lambda r: r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    n = c("n").cast("double")
    rows = [[c("s4"), c("s3"), c("s2")], [c("s3"), c("s2"), c("s1")], [c("s2"), c("s1"), n]]
    right = [c("t2"), c("t1"), c("t0")]
    whole = F.when(F.abs(det(rows)) > 1e-9 * F.greatest(F.lit(1.0), c("s4") * c("s2") * n), det(rows))
    swap = lambda k: [[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]
    s = s.withColumns({"__a": det(swap(0)) / whole, "__b": det(swap(1)) / whole, "__c": det(swap(2)) / whole})
    return s.select(*keys, c("n"), c("__a").alias("a"), (c("__b") - 2 * c("__a") * c("m")).alias("b"), (c("__c") - c("__b") * c("m") + c("__a") * c("m") * c("m")).alias("c"))


def plane_fit(gcps: DataFrame, u: str = "lon", v: str = "lat", targets: Sequence[str] = ("pixel_x", "pixel_y"), order: int = 2, least: int = 6) -> dict:
    """Polynomial in two z-scored variables by normal equations.

    The sums come to the driver: a fixed number of doubles at any number of points. Scale is the population deviation.
    Raises ValueError for too few points, no spread, or a rank too low.
    """
    first = gcps.agg(F.count(F.lit(1)).alias("n"), F.avg(u).alias("mu"), F.avg(v).alias("mv"), F.stddev_pop(u).alias("su"), F.stddev_pop(v).alias("sv")).first()
    if first["n"] < least:
        raise ValueError(f"{first['n']} control points; at least {least} are needed")
    if not first["su"] or not first["sv"]:
        raise ValueError("the control points have no spread")
    terms = polynomial_terms((F.col(u) - first["mu"]) / first["su"], (F.col(v) - first["mv"]) / first["sv"], order)
    k = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(terms[i] * F.col(t)).alias(f"r{i}_{t}") for i in range(k) for t in targets]
    got = gcps.agg(*sums).first()
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    if np.linalg.matrix_rank(gram) < k:
        raise ValueError(f"the control points have a rank under {k}")
    right = np.array([[got[f"r{i}_{t}"] for t in targets] for i in range(k)])
    return {"mean": (first["mu"], first["mv"]), "scale": (first["su"], first["sv"]), "coefficients": np.linalg.solve(gram, right), "order": order, "targets": tuple(targets), "n": first["n"]}


def plane_value(model: dict, u: Column, v: Column, target: int) -> Column:
    """The fitted polynomial as a column expression, inside whole-stage code."""
    terms = polynomial_terms((u - model["mean"][0]) / model["scale"][0], (v - model["mean"][1]) / model["scale"][1], model["order"])
    out = F.lit(0.0)
    for term, c in zip(terms, model["coefficients"][:, target], strict=True):
        out = out + term * float(c)
    return out


def plane_residuals(gcps: DataFrame, model: dict, u: str = "lon", v: str = "lat") -> DataFrame:
    parts = [plane_value(model, F.col(u), F.col(v), k) - F.col(t) for k, t in enumerate(model["targets"])]
    return gcps.withColumn("residual", F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])))


def detect_order(gcps: DataFrame, saved: str = "saved_residual", tolerance: float = 0.01) -> int:
    """Which order, 2 or 3, gives the saved residuals within tolerance; exactly one must. All-zero residuals tell nothing."""
    if gcps.agg(F.max(F.abs(saved)).alias("m")).first()["m"] < 1e-9:
        raise ValueError("the saved residuals are all zero")
    fits = []
    for order, least in ((2, 6), (3, 10)):
        try:
            model = plane_fit(gcps, order=order, least=least)
        except ValueError:
            continue
        if plane_residuals(gcps, model).agg(F.max(F.abs(F.col("residual") - F.col(saved))).alias("m")).first()["m"] <= tolerance:
            fits.append(order)
    if len(fits) != 1:
        raise ValueError(f"the residuals match {len(fits)} orders")
    return fits[0]


def robust_line(df: DataFrame, keys: Sequence[str], x: str, y: str, ids: Sequence[str], within: float = 5.0, apart: float = 5.0, draws: int = 50, least: int = 10, seed: int = 42) -> DataFrame:
    """Line through most points (x as a function of y), from seeded pairs and a refit on its inliers.

    A pair joins two points drawn by a seeded hash of their ids (MD5, which SQL engines share); pairs closer than `apart` in y are passed over. The pair whose line
    has most points within `within` wins (the first on ties), and if it has at least `least`, they are fitted again.
    Returns slope, intercept (x = slope * y + intercept) and inliers. Each group's draws are a bounded number of rows.
    """
    draw = lambda salt: F.md5(F.concat_ws("|", *ids, F.lit(seed + salt)))
    ends = None
    for salt in (0, 1):
        top = _drawn(df, keys, x, y, draw(salt), draws, f"e{salt}")
        ends = top if ends is None else ends.join(top, [*keys, "draw"])
    dy = F.col("e1.y") - F.col("e0.y")
    lines = ends.where(F.abs(dy) >= apart).withColumn("slope", (F.col("e1.x") - F.col("e0.x")) / dy).withColumn("intercept", F.col("e0.x") - F.col("slope") * F.col("e0.y")).select(*keys, "draw", "slope", "intercept")
    fit = lambda: F.abs(F.col(x) - (F.col("slope") * F.col(y) + F.col("intercept"))) < within
    votes = df.join(lines, list(keys)).groupBy(*keys, "draw", "slope", "intercept").agg(F.count_if(fit()).alias("votes"))
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("slope", "intercept", "votes"), F.struct(F.col("votes"), -F.col("draw"))).alias("b")).select(*keys, "b.*")
    refit = df.join(best, list(keys)).where(fit()).groupBy(*keys).agg(F.regr_slope(x, y).alias("s"), F.regr_intercept(x, y).alias("i"))
    out = best.join(refit, list(keys), "left")
    enough = (F.col("votes") >= least) & F.col("s").isNotNull()
    return out.select(*keys, F.when(enough, F.col("s")).otherwise(F.col("slope")).alias("slope"), F.when(enough, F.col("i")).otherwise(F.col("intercept")).alias("intercept"), F.col("votes").alias("inliers"))


def _drawn(df: DataFrame, keys: Sequence[str], x: str, y: str, draw: Column, n: int, name: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(draw, x, y)
    return df.withColumn("draw", F.row_number().over(by)).where(F.col("draw") <= n).select(*keys, "draw", F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias(name))


def otsu(df: DataFrame, keys: Sequence[str], level: Column, name: str = "threshold") -> DataFrame:
    """Level (whole number) that parts a histogram with the largest variance between classes, the lowest on ties."""
    hist = df.where(level.isNotNull()).groupBy(*keys, level.cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    n0, n = F.sum("n").over(up), F.sum("n").over(whole)
    s0, s = F.sum(F.col("n") * F.col("level")).over(up), F.sum(F.col("n") * F.col("level")).over(whole)
    cum = hist.select(*keys, "level", n0.alias("n0"), n.alias("n"), s0.alias("s0"), s.alias("s"))
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / F.nullif(F.col("n") - F.col("n0"), F.lit(0))
    between = F.coalesce(F.col("n0") * (F.col("n") - F.col("n0")) * gap * gap, F.lit(0.0))
    # Rounding keeps ties from hanging on the last bit.
    return cum.groupBy(*keys).agg(F.max_by("level", F.struct(F.round(between, 3), -F.col("level"))).alias(name))


def width_threshold(df: DataFrame, keys: Sequence[str], width: str, empty: float = 6.0) -> DataFrame:
    """Otsu over widths in tenths, clipped to 0..255; groups of nulls only get `empty`."""
    level = F.floor(F.least(F.greatest(F.col(width) * 10, F.lit(0)), F.lit(255)))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    found = otsu(df, keys, level, "__t")
    out = groups.join(found, list(keys), "left") if keys else groups.join(found, how="left")
    return out.select(*keys, F.coalesce(F.col("__t") / 10, F.lit(empty)).alias("threshold"))


def principal_line(df: DataFrame, keys: Sequence[str], x: str, y: str, width: Column, height: Column, reach: float = 1000.0) -> DataFrame:
    """Line along the main axis of a cloud of points, `reach` both ways from its centre, each coordinate clipped to the image."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"), F.first(width).alias("w"), F.first(height).alias("h"))
    t = F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2
    cut = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.col(n) - 1)
    ends = [v for s, k in ((-1, "1"), (1, "2")) for v in (cut(F.col("mx") + s * reach * F.cos(t), "w").alias(f"x{k}"), cut(F.col("my") + s * reach * F.sin(t), "h").alias(f"y{k}"))]
    return m.select(*keys, *ends)


def progression_consensus(df: DataFrame, keys: Sequence[str], index: str, degree: str, least: int = 3, tolerance: float = 0.51) -> DataFrame:
    """Arithmetic progression that best explains noisy degrees of indexed lines.

    Every pair of lines gives an interval; estimates are rounded half to even, to whole degrees if the interval is at
    least 1, else to tenths; lines within `tolerance` support it. Of the progressions with `least` supporters the one
    with the lowest score 10 * std_pop(rounded - raw) - 0.5 * n wins, the first pair on ties; its supporters get their
    rounded estimates. A group with too few lines or no winner is returned unchanged.
    """
    pts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(degree).cast("double").alias("d")))).alias("ps"))
    n = F.size("ps")
    at = pts.select(*keys, "ps", F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).alias("a"))
    at = at.select("*", F.explode(F.sequence(F.col("a") + 1, F.greatest(F.size("ps") - 1, F.col("a") + 1))).alias("b")).where(F.col("b") < F.size("ps"))
    pa_, pb = F.get("ps", F.col("a")), F.get("ps", F.col("b"))
    step = (pb["d"] - pa_["d"]) / F.nullif(pb["i"] - pa_["i"], F.lit(0))
    at = at.withColumn("step", step).where(F.abs("step") > 1e-9).withColumn("base", pa_)

    def estimate(p):
        raw = F.col("base")["d"] + (p["i"] - F.col("base")["i"]) * F.col("step")
        return F.struct(p["i"].alias("i"), p["d"].alias("d"), raw.alias("raw"), F.when(F.abs("step") >= 1, F.bround(raw, 0)).otherwise(F.bround(raw, 1)).alias("est"))

    at = at.withColumn("es", F.filter(F.transform("ps", estimate), lambda e: F.abs(e["est"] - e["d"]) <= tolerance)).where(F.size("es") >= least)
    total = lambda f: F.aggregate("es", F.lit(0.0), lambda acc, e: acc + f(e))
    size = F.size("es")
    mean = total(lambda e: e["est"] - e["raw"]) / size
    at = at.withColumn("mean", mean)
    std = F.sqrt(F.aggregate("es", F.lit(0.0), lambda acc, e: acc + (e["est"] - e["raw"] - F.col("mean")) * (e["est"] - e["raw"] - F.col("mean"))) / size)
    score = F.round(10 * std - 0.5 * size, 9)
    best = at.groupBy(*keys).agg(F.min_by("es", F.struct(score, F.col("a"), F.col("b"))).alias("es"))
    out = pts.join(best, list(keys), "left")
    result = F.coalesce(F.transform("es", lambda e: F.struct(e["i"].alias("i"), e["est"].alias("d"))), F.col("ps"))
    return out.select(*keys, F.explode(result).alias("r")).select(*keys, F.col("r.i").alias(index), F.col("r.d").alias(degree))


def steadier(first: DataFrame, second: DataFrame, keys: Sequence[str], index: str, degree: str) -> DataFrame:
    """Two passes over the same lines: where both have a degree, that of the pass whose neighbours differ more evenly."""
    by = Window.partitionBy(*keys).orderBy(index)
    def spread(df, name):  # noqa: E306
        return df.withColumn("__d", F.col(degree) - F.lag(degree).over(by)).groupBy(*keys).agg(F.coalesce(F.stddev_pop("__d"), F.lit(0.0)).alias(name))
    both = first.select(*keys, index, F.col(degree).alias("__1")).join(second.select(*keys, index, F.col(degree).alias("__2")), [*keys, index], "full")
    both = both.join(spread(first, "__s1"), list(keys), "left").join(spread(second, "__s2"), list(keys), "left")
    pick = F.when(F.col("__1").isNull(), F.col("__2")).when(F.col("__2").isNull() | (F.coalesce("__s1", F.lit(0.0)) <= F.coalesce("__s2", F.lit(0.0))), F.col("__1")).otherwise(F.col("__2"))
    return both.select(*keys, index, pick.alias(degree))
