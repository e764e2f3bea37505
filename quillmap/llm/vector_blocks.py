"""Blocks of whole-number vectors that meet blocks of queries, for the operators with exact scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors and queries that meet in one task at most, and the tasks among which fewer vectors are dealt.
BLOCK_ROWS, QUERY_ROWS, LEAST_BLOCKS, LEAST_ROWS = 16384, 4096, 8, 2048
#: The ends of a long, at which components and scores saturate.
LEAST, MOST = -(2**63), 2**63 - 1


def finite(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id, v, dims, more): rows with an id whose vector is not null and holds finite components only; zero and empty vectors stay."""
    big = F.lit(float("inf"))
    good = F.forall(F.col(vec_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dims"), *more)


def one_each(rows: DataFrame, *more: str) -> DataFrame:
    """Of rows that repeat an id with as many dimensions, the largest by vector, then by the other columns."""
    best = rows.groupBy("id", "dims").agg(F.max(F.struct("v", *more)).alias("r"))
    return best.select("id", "r.v", "dims", *[f"r.{c}" for c in more])


def whole(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component x, as a double, by row; saturated at the ends of a long."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * values)
        out = np.where(scaled >= 2.0**63, MOST, np.where(scaled < -(2.0**63), LEAST, scaled.astype(np.int64)))
    return out.reshape(len(column), -1 if len(values) else 0)


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """The most that the size of an inner product of rows of a and b can be."""
    size = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    return a.shape[1] * size(a) * size(b)


def saturated(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == np.int64 else np.array([min(max(s, LEAST), MOST) for s in scores.ravel()], np.int64).reshape(scores.shape)


def meet(rows: DataFrame, asked: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], kind: pa.Schema, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """kernel(rows, queries) of every block of rows with every block of queries that have as many dimensions.

    Both sides are dealt by a hash of id and vector, alike whenever a task runs again, so that equal vectors and repeated
    ids spread. A row moves once for each query_rows queries, a query once for each block_rows rows.
    """
    n, n_asked = rows.count(), asked.count()
    blocks, q_blocks = max(1, -(-n // block_rows), min(LEAST_BLOCKS, n // LEAST_ROWS)), max(1, -(-n_asked // query_rows))
    dealt = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(parts)).cast("int")
    left = rows.withColumn("b", dealt("row", blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = asked.withColumn("qb", dealt("query", q_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def both(data: pa.Table, queries: pa.Table) -> pa.Table:
        return kernel(data, queries) if len(data) and len(queries) else kind.empty_table()

    ddl = ", ".join(f"{f.name} {'int' if pa.types.is_int32(f.type) else 'long'}" for f in kind)
    return left.groupBy("b", "qb", "dims").cogroup(right.groupBy("b", "qb", "dims")).applyInArrow(both, ddl)
