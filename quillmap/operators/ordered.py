"""Operators over the order of rows: smoothing, ranks, fills, extrapolation, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed once: a generator stands between them and their uses, so none is copied into each use."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("__r")).select("__r.*")


def smooth(df: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str], window: int = 5) -> DataFrame:
    """Moving average of the inner vertices of each chain; the first and last window // 2 stay, and chains up to window long."""
    half = window // 2
    by = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(by)
    inner = (n > window) & (at > half) & (at <= n - half)
    frame = by.rowsBetween(-half, half)
    return df.withColumns({f"{c}_smooth": F.when(inner, F.avg(c).over(frame)).otherwise(F.col(c).cast("double")) for c in columns})


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence, column: str) -> DataFrame:
    """Missing samples take the value before; leading ones are dropped."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(by)).where(F.col(column).isNotNull())


def support_march(df: DataFrame, keys: Sequence[str], step: str, supported: Column) -> DataFrame:
    """Of steps numbered outwards, those before the first without support."""
    by = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__ok", F.min(supported.cast("int")).over(by)).where("__ok = 1").drop("__ok")


def assign_degrees(df: DataFrame, keys: Sequence[str], order: Sequence, anchors: Column, name: str = "degree") -> DataFrame:
    """Degrees of lines from anchors (map of rank from 0 to degree), equally spaced by the mean of the anchors' slopes.

    From the first anchor on, rank by rank; rounded half to even to whole degrees if the spacing is at least 1, else to
    tenths. `confirmed` marks the anchors. A group with under two anchors gets nulls.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rank", F.row_number().over(by) - 1).withColumn("__a", F.array_sort(F.map_entries(anchors)))
    n = F.size("__a")
    slopes = F.zip_with(F.slice("__a", 1, F.greatest(n - 1, F.lit(0))), F.slice("__a", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (b["value"] - a["value"]) / (b["key"] - a["key"]))
    out = out.withColumn("__s", F.when(n >= 2, slopes)).withColumn("__avg", F.aggregate("__s", F.lit(0.0), lambda acc, s: acc + s) / F.size("__s"))
    first = F.get("__a", F.lit(0))
    raw = first["value"] + (F.col("__rank") - first["key"]) * F.col("__avg")
    value = F.when(F.abs("__avg") >= 1, F.bround(raw, 0)).otherwise(F.bround(raw, 1))
    return out.withColumns({"rank": F.col("__rank").cast("long"), name: value, "confirmed": F.array_contains(F.map_keys(anchors), F.col("__rank").cast("int"))}).drop("__rank", "__a", "__s", "__avg")


def spacing_consistency(df: DataFrame, keys: Sequence[str], index: str, degree: str) -> DataFrame:
    """Mean slope between neighbouring anchors and whether their slopes differ by over 0.1."""
    by = Window.partitionBy(*keys).orderBy(index)
    slope = (F.lead(degree).over(by) - F.col(degree)) / (F.lead(index).over(by) - F.col(index))
    return df.withColumn("__s", slope).groupBy(*keys).agg(F.avg("__s").alias("interval"), (F.max("__s") - F.min("__s") > 0.1).alias("inconsistent"))


def extend_centres(df: DataFrame, centres: str, spacing: Column, support: str, width: Column) -> DataFrame:
    """Go on to both sides of a sorted list of centres by the spacing while a support position lies within 0.4 of it.

    To the left while the next centre is over -0.3 spacings, to the right while it is under the width plus 0.3 spacings:
    so the width tells how many steps there can be.
    """
    most = F.when(spacing > 0, F.ceil(width / spacing)).otherwise(0).cast("int") + 2
    near = lambda c, sp: F.exists(support, lambda s: F.abs(s - c) < 0.4 * sp)

    def go(sign: int):
        def step(acc, _):
            edge = F.element_at(acc["cs"], 1 if sign < 0 else -1)
            nxt = edge + sign * spacing
            inside = (nxt > -0.3 * spacing) if sign < 0 else (nxt < width + 0.3 * spacing)
            grown = F.concat(F.array(nxt), acc["cs"]) if sign < 0 else F.concat(acc["cs"], F.array(nxt))
            on = acc["on"] & inside & near(nxt, spacing)
            return F.struct(F.when(on, grown).otherwise(acc["cs"]).alias("cs"), on.alias("on"))

        return step

    for sign in (-1, 1):
        start = F.struct(F.col(centres).alias("cs"), (spacing > 0).alias("on"))
        df = settled(df.withColumn(centres, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(most, F.lit(1)))), start, go(sign), lambda acc: acc["cs"])))
    return df


def rank_regions(df: DataFrame, keys: Sequence[str], area: Column, ties: Sequence, least: Column | None = None) -> DataFrame:
    """group_id from 0 by falling area; regions under `least` are dropped first."""
    kept = df if least is None else df.where(area >= least)
    return kept.withColumn("group_id", (F.row_number().over(Window.partitionBy(*keys).orderBy(area.desc(), *ties)) - 1).cast("long"))


def argmax_row(df: DataFrame, keys: Sequence[str], value: Column, index: Column, result: Column, name: str) -> DataFrame:
    """The result of the first row with the largest value."""
    return df.groupBy(*keys).agg(F.max_by(result, F.struct(value, -index)).alias(name))


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k).drop("__r")


def one_of_each(df: DataFrame, prefix: str, path: str, seed: int = 42, n: int | None = None) -> DataFrame:
    """One row of each prefix, drawn by a seeded hash of its path (MD5, which SQL engines share); then n of them by the same draw."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(path)))
    rows = df.where(F.col(prefix).isNotNull()).groupBy(prefix).agg(F.min(F.struct(draw, path, F.struct(*[F.col(f"`{c}`") for c in df.columns if c != prefix]).alias("row"))).alias("r"))
    rows = rows.select(prefix, "r.row.*")
    return rows if n is None else rows.orderBy(draw, path).limit(n)


def sample_background(df: DataFrame, is_background: Column, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """All rows of the foreground and a seeded share of the background, without replacement."""
    share = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(~is_background | (share < ratio))


def sort_shapes(df: DataFrame, keys: Sequence[str], rank: Column, box: tuple[Column, Column], index: str, length: Column | None = None) -> DataFrame:
    """Position of each shape after a stable sort by label rank, falling length if given, top and left."""
    order = [rank, *([length.desc()] if length is not None else []), *box, F.col(index)]
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
