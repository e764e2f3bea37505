"""Recognised texts from different recognisers in one form: text, centre, size and confidence in the image's own pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import TEXT_CONFIDENCE, confident

#: Fixed value: the confidence of a text whose recogniser gives none.
UNKNOWN_CONFIDENCE = 0.5


def extent(box: Column) -> Column:
    """(x0, y0, x1, y1) of a box given as four numbers, or as the coordinates x, y, x, y, ... of a polygon; null if it has neither form.

    Four numbers are taken as the corners they are, longer lists as points.
    """
    flat = F.filter(box, lambda v: v.isNotNull())
    n = F.size(flat)
    side = lambda k: F.filter(flat, lambda _, i: i % 2 == k)
    corner = lambda k: F.get(flat, F.lit(k)).cast("double")
    four = F.struct(corner(0).alias("x0"), corner(1).alias("y0"), corner(2).alias("x1"), corner(3).alias("y1"))
    many = F.struct(F.array_min(side(0)).cast("double").alias("x0"), F.array_min(side(1)).cast("double").alias("y0"), F.array_max(side(0)).cast("double").alias("x1"), F.array_max(side(1)).cast("double").alias("y1"))
    return F.when(n == 4, four).when((n > 4) & (n % 2 == 0), many)


def normalised_items(items: DataFrame, text: str = "text", confidence: str = "conf", box: str = "box", scale: str | Column = "scale", least: float = TEXT_CONFIDENCE) -> DataFrame:
    """items with text, cx, cy, w, h and conf in place of these columns, of at least `least` confidence.

    A null text is empty, a null confidence UNKNOWN_CONFIDENCE; rows without a box go. Coordinates are divided by the
    scale at which the image was read; a null scale is 1.
    """
    s = F.coalesce((F.col(scale) if isinstance(scale, str) else scale).cast("double"), F.lit(1.0))
    used = {text, confidence, box, "cx", "cy", "w", "h", "text", "conf"} | ({scale} if isinstance(scale, str) else set())
    kept = confident(items.withColumn("__conf", F.coalesce(F.col(confidence).cast("double"), F.lit(UNKNOWN_CONFIDENCE))), "__conf", least)
    out = kept.withColumns({"__e": extent(F.col(box)), "__s": s}).where(F.col("__e").isNotNull())
    e = F.col("__e")
    return out.select(
        *[F.col(f"`{c}`") for c in items.columns if c not in used], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), ((e["x0"] + e["x1"]) / 2 / F.col("__s")).alias("cx"),
        ((e["y0"] + e["y1"]) / 2 / F.col("__s")).alias("cy"), ((e["x1"] - e["x0"]) / F.col("__s")).alias("w"), ((e["y1"] - e["y0"]) / F.col("__s")).alias("h"), F.col("__conf").alias("conf"),
    )
