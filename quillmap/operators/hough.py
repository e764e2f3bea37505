"""Straight lines by votes: every foreground pixel votes for the lines through it, counted where the pixels of its sheet are."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Directions in a half turn, and the decimals that sines and cosines are rounded to, so that votes are alike everywhere.
TURNS, DIGITS = 180, 6


def directions(turns: int = TURNS) -> list[tuple[float, float]]:
    """(cosine, sine) of each direction of the normal."""
    return [(round(math.cos(math.pi * k / turns), DIGITS), round(math.sin(math.pi * k / turns), DIGITS)) for k in range(turns)]


#: Pixels of a sheet that one task counts; a larger sheet is counted in parts, whose counts are added up.
TASK_PIXELS = 1 << 20


def votes(pixels: DataFrame, keys: Sequence[str], turns: int = TURNS, least: int = 1) -> DataFrame:
    """(keys, theta, rho, votes): how many pixels (x, y) lie on the line x cos + y sin = rho, for lines of `least` votes; theta
    counts half turns in `turns` parts.

    The pixels of a sheet move once and are counted side by side in numpy, a few directions at a time; what leaves the task
    are lines of enough votes. Sheets of over TASK_PIXELS pixels are counted in parts, and all their counts move.
    """
    keys, table = list(keys), np.array(directions(turns))
    types = {f.name: f.dataType.simpleString() for f in pixels.schema}
    shown = pixels.where("x is not null and y is not null").select(*keys, "x", "y")
    for k in keys:
        shown = shown.where(F.col(k).isNotNull())
    # A merge, so that no table of sheets goes through the driver.
    sized = shown.join(shown.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TASK_PIXELS).alias("__parts")).hint("merge"), keys)
    sized = sized.withColumn("__part", F.pmod(F.xxhash64("x", "y"), F.col("__parts")))

    def count(group: pa.Table) -> pa.Table:
        x, y = (group.column(c).to_numpy().astype(float) for c in ("x", "y"))
        whole = group.column("__parts")[0].as_py() == 1
        step, out = max(1, TASK_PIXELS // len(x)), []
        for at in range(0, turns, step):
            c, s = table[at : at + step].T
            rho = np.rint(x * c[:, None] + y * s[:, None]).astype(np.int64)
            low, span = rho.min(), rho.max() - rho.min() + 1
            cell, n = np.unique((rho - low + span * np.arange(len(c))[:, None]).ravel(), return_counts=True)
            kept = n >= (least if whole else 1)
            out.append((at + cell[kept] // span, low + cell[kept] % span, n[kept]))
        theta, rho, n = (np.concatenate(v) for v in zip(*out, strict=True))
        same = [pa.array([group.column(k)[0].as_py()] * len(n), group.column(k).type) for k in keys]
        return pa.table([*same, pa.array([whole] * len(n), pa.bool_()), pa.array(theta, pa.int32()), pa.array(rho, pa.int32()), pa.array(n, pa.int64())], names=[*keys, "whole", "theta", "rho", "votes"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", whole boolean, theta int, rho int, votes long"
    counted = sized.groupBy(*keys, "__parts", "__part").applyInArrow(lambda g: count(g), schema)
    if least == 1:
        return counted.groupBy(*keys, "theta", "rho").agg(F.sum("votes").alias("votes"))
    counted = materialise(counted, "votes")
    parts = counted.where("not whole").groupBy(*keys, "theta", "rho").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= least)
    return counted.where("whole").drop("whole").unionByName(parts)


def peaks(counts: DataFrame, keys: Sequence[str], least: int, turns: int = TURNS) -> DataFrame:
    """(keys, theta, rho, votes) of lines of at least so many votes that no neighbour in direction and distance outdoes.

    Of neighbours with equal votes the one with the smaller theta, then rho, stays. Past the last direction the first comes
    again with the sign of rho turned.
    """
    keys = list(keys)
    strong = counts.where(F.col("votes") >= least)
    # A line stands at its own place and at those of its neighbours, so one aggregation compares them, without a join.
    around = F.array(*[F.struct(F.lit(dt).alias("dt"), F.lit(dr).alias("dr")) for dt in (-1, 0, 1) for dr in (-1, 0, 1)])
    seen = strong.withColumn("o", F.explode(around)).withColumn("t", F.col("theta") + F.col("o.dt")).withColumn("r", F.col("rho") + F.col("o.dr"))
    own, round_ = (F.col("o.dt") == 0) & (F.col("o.dr") == 0), (F.col("t") < 0) | (F.col("t") >= turns)
    rank = F.struct("votes", (-F.col("theta")).alias("t"), (-F.col("rho")).alias("r"))
    seen = seen.select(*keys, F.pmod("t", F.lit(turns)).alias("theta"), F.when(round_, -F.col("r")).otherwise(F.col("r")).alias("rho"), F.when(own, rank).alias("own"), F.when(~own, rank).alias("other"))
    best = seen.groupBy(*keys, "theta", "rho").agg(F.max("own").alias("own"), F.max("other").alias("other"))
    return best.where(F.col("own").isNotNull() & (F.col("other").isNull() | (F.col("own") > F.col("other")))).select(*keys, "theta", "rho", F.col("own.votes").alias("votes"))
