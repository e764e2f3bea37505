"""Grouping of ordered values: gaps, folds and leaders.

A fold that compares each item with the one kept last starts afresh wherever the gap to the item before is already over
the limit. So it is cut there into islands by a window. Islands are dealt to tasks whole and in order, and a task passes
through its rows as they come, an Arrow batch at a time: it holds the batch and the item kept last, however long an island is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, keys: Sequence[str], pos: Column, ties: Sequence[str], gap: float, strict: bool = False, name: str = "cluster") -> DataFrame:
    """Number from 0 the runs of positions in which each is within gap of the one before (under it, if strict)."""
    by = Window.partitionBy(*keys).orderBy(pos, *ties)
    far = pos - F.lag(pos).over(by)
    opens = F.when((far >= gap) if strict else (far > gap), 1).otherwise(0)
    return df.withColumn("__opens", opens).withColumn(name, F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__opens")


def _in_order(marked: DataFrame, keys: Sequence[str], pos: Column, ties: Sequence[str]) -> DataFrame:
    """(island, opens, pos, row): the rows of each island one after the other; opens marks an island's first row.

    marked: with `__opens`, 1 where an island begins, and `__island`, its number within the keys.
    """
    by = Window.partitionBy(*keys, "__island").orderBy(pos, *ties)
    return marked.withColumn("__first", F.row_number().over(by) == 1).repartition(*keys, "__island").sortWithinPartitions(*keys, "__island", pos, *ties)


def _folded(df: DataFrame, keys: Sequence[str], pos: Column, weight: Column, ties: Sequence[str], gap, inclusive: bool) -> DataFrame:
    """The kept rows of a fold over islands: an item apart from the one kept last is kept, else the one of more weight is."""
    gap_col = gap if isinstance(gap, Column) else F.lit(float(gap))
    by = Window.partitionBy(*keys).orderBy(pos, *ties)
    far = pos - F.lag(pos).over(by)
    opens = F.when((far >= gap_col) if inclusive else (far > gap_col), 1).otherwise(0)
    marked = df.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _in_order(marked, keys, pos, ties).select(*[F.col(f"`{c}`") for c in df.columns], F.col("__first"), pos.cast("double").alias("__at"), weight.cast("double").alias("__weight"), gap_col.cast("double").alias("__reach"))

    names, schema = df.columns, df.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, heavy = None, 0.0, 0.0
        for batch in batches:
            own = batch.select(names)
            kept, last = [], -1
            for i, (first, p, w, g) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("__first", "__at", "__weight", "__reach")), strict=True)):
                # A null never is apart and never outweighs, as in SQL.
                apart = p is not None and at is not None and g is not None and (p - at >= g if inclusive else p - at > g)
                if first or apart:
                    if last >= 0:
                        kept.append(last)
                    elif held is not None:
                        yield held
                        held = None
                elif not (w is not None and heavy is not None and w > heavy):
                    continue
                last, at, heavy, held = i, p, w, None
            if kept:
                yield own.take(pa.array(kept, pa.int64()))
            if last >= 0:
                held = own.take(pa.array([last], pa.int64()))
        if held is not None:
            yield held

    return rows.mapInArrow(fold, schema)


def dedup_fold(df: DataFrame, keys: Sequence[str], pos: Column, span: Column, ties: Sequence[str], gap: float) -> DataFrame:
    """In order of position: over gap beyond the item kept last, an item is kept; else the longer of the two is."""
    return _folded(df, keys, pos, span, ties, gap, inclusive=False)


def dedup_by_spacing(df: DataFrame, keys: Sequence[str], pos: Column, inliers: Column, ties: Sequence[str], share: float = 0.3, least: int = 3) -> DataFrame:
    """As dedup_fold with a gap of share of the group's median spacing, the item with more inliers kept; under least items all stay."""
    by = Window.partitionBy(*keys).orderBy(pos, *ties)
    group = Window.partitionBy(*keys)
    spaced = df.withColumn("__d", pos - F.lag(pos).over(by))
    spaced = spaced.withColumn("__gap", F.when(F.count(F.lit(1)).over(group) >= least, share * F.median("__d").over(group)).otherwise(F.lit(-1.0)))
    return _folded(spaced, keys, pos, inliers, ties, F.col("__gap"), inclusive=True).drop("__d", "__gap")


def leader_clusters(df: DataFrame, keys: Sequence[str], pos: Column, ties: Sequence[str], within: float, name: str = "leader") -> DataFrame:
    """In order: the first item not yet taken leads, and takes all later ones at a distance under within. Adds the leader's position.

    On a line the members of a leader stand together, so a leader is followed by the next item at within or more, and
    gaps of within or more cut the fold into islands.
    """
    islands = gap_clusters(df, keys, pos, ties, within, strict=True, name="__island")
    rows = _in_order(islands, keys, pos, ties).select(*[F.col(f"`{c}`") for c in df.columns], F.col("__first"), pos.cast("double").alias("__pos"))

    names = df.columns

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            p = batch.column("__pos").to_numpy(zero_copy_only=False)
            led = np.full(len(p), np.nan)
            first = batch.column("__first").to_numpy(zero_copy_only=False)
            starts = [*np.flatnonzero(first).tolist(), len(p)]
            for at, end in zip([0, *starts], starts, strict=False):
                if at < end and first[at]:
                    leader = None
                while at < end:
                    if leader is None or not p[at] - leader < within:
                        leader = float(p[at])
                    # All that follow within reach, in one step.
                    upto = at + max(1, int(np.searchsorted(p[at:end], leader + within, "left")))
                    while upto > at + 1 and not p[upto - 1] - leader < within:
                        upto -= 1
                    while upto < end and p[upto] - leader < within:
                        upto += 1
                    led[at:upto], at = leader, upto
            yield batch.select(names).append_column(name, pa.array(led))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(lead, f"{kinds}, `{name}` double")
