"""Nearest neighbours by inner product through collision-counting hashing.

Every vector is projected on single random directions, and each direction has its array of projections in sorted order.
A query opens a window around its own projection in every array; a vector that lies in the windows of enough arrays
has collided often enough to be verified by its exact inner product. If too few vectors do, virtual rehashing widens
all windows and the count is taken again. Inner products become distances by one added coordinate that gives vectors the
same norm; so that it stays small, vectors are parted into bands of like norms, each with its own arrays and windows.

The sorted arrays are cut into cells of equal share, and each cut keeps a bitmap of the vectors below it, so that a
window is the difference of two bitmaps, and collisions are counted for 64 vectors at a time in bit-sliced counters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Directions, cells of a sorted array, and the share of the directions in which a vector must collide.
DIRECTIONS, CELLS, THRESHOLD = 256, 64, 0.64
#: First half width of a window, and the factor by which rehashing widens it.
WIDTH, WIDEN = 0.4, 1.08
#: Bands of norms a power of two, and where their edges lie, so that unit vectors fall into one.
BANDS, EDGE = 2, 0.3
#: Vectors and queries that meet in one task at most, and the tasks among which fewer vectors are dealt.
BLOCK_ROWS, QUERY_ROWS, LEAST_BLOCKS, LEAST_ROWS = 16384, 16384, 8, 2048


def share(k: int, n: int) -> float:
    """The share of n vectors that is verified for each query beyond k: sqrt(k n) vectors, so it falls as n grows."""
    return min(1.0, float(np.sqrt(k / max(1, n))))


def directions(dims: int, n: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((dims, n))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, base-2 logarithm of the norms), by way of powers of two, so that no square overflows or vanishes."""
    power = np.frexp(np.abs(vectors).max(axis=1))[1]
    # In two steps, since a power of two may itself be beyond a double.
    small = np.ldexp(np.ldexp(vectors, -(power // 2)[:, None]), -(power - power // 2)[:, None])
    norms = np.linalg.norm(small, axis=1)
    return small / norms[:, None], np.log2(norms) + power


class Block:
    """Sorted projection arrays of one block of vectors of like norms.

    shorter: each vector as a part of the longest, of the same direction.
    """

    def __init__(self, vectors: np.ndarray, unit: np.ndarray | None = None, logs: np.ndarray | None = None):
        n, dims = vectors.shape
        if unit is None:
            unit, logs = scaled(vectors)
        self.vectors, self.n = vectors, n
        self.shorter = unit * np.exp2(logs - logs.max())[:, None]
        fill = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", self.shorter, self.shorter)))
        self.axes = directions(dims + 1)
        projected = np.hstack([self.shorter, fill[:, None]]) @ self.axes
        words = -(-n // 64)
        self.cuts = np.empty((DIRECTIONS, CELLS - 1))
        self.below = np.zeros((DIRECTIONS, CELLS + 1, words), np.uint64)
        columns, kth = np.ascontiguousarray(projected.T), np.unique(np.arange(1, CELLS) * n // CELLS)
        word, bit = np.arange(n) >> 6, np.uint64(1) << (np.arange(n) & 63).astype(np.uint64)
        for j in range(DIRECTIONS):
            self.cuts[j] = np.partition(columns[j], kth)[np.arange(1, CELLS) * n // CELLS]
            # Equal projections fall into one cell, so copies of a vector collide alike.
            cell = np.searchsorted(self.cuts[j], columns[j], side="right")
            held = np.zeros(CELLS * words, np.uint64)
            np.add.at(held, cell * words + word, bit)
            np.bitwise_or.accumulate(held.reshape(CELLS, words), axis=0, out=self.below[j, 1:])

    def collided(self, projected: np.ndarray, half: float) -> np.ndarray:
        """For each query (row of projections), a bitmap of the vectors inside enough windows."""
        low = np.stack([np.searchsorted(self.cuts[j], projected[:, j] - half, side="right") for j in range(DIRECTIONS)])
        high = np.stack([np.searchsorted(self.cuts[j], projected[:, j] + half, side="right") + 1 for j in range(DIRECTIONS)])
        waiting: list[list[np.ndarray]] = [[]]
        for j in range(DIRECTIONS):
            waiting[0].append(self.below[j][high[j]] ^ self.below[j][low[j]])
            weight = 0
            while len(waiting[weight]) == 3:
                x, y, z = waiting[weight]
                either = x ^ y
                waiting[weight] = [either ^ z]
                if weight + 1 == len(waiting):
                    waiting.append([])
                waiting[weight + 1].append((x & y) | (either & z))
                weight += 1
        planes: list[np.ndarray] = []
        weight = 0
        while weight < len(waiting):
            rows = waiting[weight]
            while len(rows) > 1:
                x, y = rows.pop(), rows.pop()
                rows.append(x ^ y)
                if weight + 1 == len(waiting):
                    waiting.append([])
                waiting[weight + 1].append(x & y)
            planes.append(rows[0] if rows else np.zeros((len(projected), self.below.shape[2]), np.uint64))
            weight += 1
        least = int(np.ceil(THRESHOLD * DIRECTIONS))
        over, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
        for k in range(max(len(planes), least.bit_length()) - 1, -1, -1):
            plane = planes[k] if k < len(planes) else np.zeros_like(over)
            if least >> k & 1:
                equal = equal & plane
            else:
                over |= equal & plane
                equal = equal & ~plane
        return over | equal

    def search(self, queries: np.ndarray, k: int, ids: np.ndarray, q_ids: np.ndarray, part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, inner product): each query's best k of all verified vectors with another id, ties by the smaller id.

        Windows widen until the given part of the block and k vectors more are verified.
        """
        unit = scaled(queries)[0]
        projected = unit @ self.axes[:-1]
        open_, half, found = np.arange(len(queries)), WIDTH, []
        ordered = np.sort(ids)
        own = np.searchsorted(ordered, q_ids, side="right") - np.searchsorted(ordered, q_ids, side="left")
        enough = np.minimum(self.n, k + own + int(np.ceil(part * self.n)))
        # Windows open as wide as half of a few queries need, less one step.
        few = open_[:: max(1, len(open_) // 32)]
        while half < 64 and (np.bitwise_count(self.collided(projected[few], half * WIDEN)).sum(axis=1) < enough[few]).mean() > 0.5:
            half *= WIDEN
        while len(open_):
            masks = np.concatenate([self.collided(projected[open_[at : at + 64]], half) for at in range(0, len(open_), 64)])
            counts = np.bitwise_count(masks).sum(axis=1)
            done = (counts >= enough[open_]) | (half > 64)
            for i, mask in zip(open_[done], masks[done], strict=True):
                near = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[: self.n])
                near = near[ids[near] != q_ids[i]]
                # A fast product first; those that rounding could bring among the best k are then summed up exactly alike.
                rough = self.shorter[near] @ unit[i]
                if len(near) > k:
                    near = near[rough >= np.partition(rough, -k)[-k] - 1e-9]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.einsum("ij,j->i", self.vectors[near], queries[i])
                best = np.lexsort((ids[near], -scores))[:k]
                found.append((np.full(len(best), i), near[best], scores[best]))
            open_, half = open_[~done], half * WIDEN
        q, v, scores = (np.concatenate(part) for part in zip(*found, strict=True))
        return q, v, scores


def in_bands(vectors: np.ndarray, queries: np.ndarray, k: int, ids: np.ndarray, q_ids: np.ndarray, part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block.search() in each band of norms of the vectors; up to k of each band for each query."""
    unit, logs = scaled(vectors)
    band = np.floor(BANDS * (logs + EDGE)).astype(int)
    found = []
    for b in np.unique(band):
        rows = np.flatnonzero(band == b)
        q, v, scores = Block(vectors[rows], unit[rows], logs[rows]).search(queries, k, ids[rows], q_ids, part)
        found.append((q, rows[v], scores))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components that are not zero; null ids take no part."""
    v = F.col(vec_col).cast("array<double>")
    big = F.lit(float("inf"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.size(vec_col).alias("dims"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k found vectors with the largest inner product for each query: query_id, rank (from 1), vec_id, score.

    A query's own id is no candidate; ties go to the smaller id; queries with fewer candidates get all of them. Rows
    whose vector is null, empty, zero or holds null or non-finite components, and rows with a null id, take no part;
    vectors meet only queries with as many dimensions. Candidate rows that repeat an id all take part; of queries that
    repeat one, the largest vector in array order is asked. Empty tables give no rows; other columns are not looked at.

    Norms may differ and be as large or small as a double: a score that overflows is infinite, one that underflows is 0, and
    one without a value (infinities that cancel) comes last.

    Blocks of vectors meet blocks of queries, so that a task holds block_rows + query_rows vectors at any size. Each
    block verifies the share of its vectors that share() gives for the whole table, at least k in each band of norms, and
    returns at most k rows a query and band; the best k of all blocks are ranked with a limit before the shuffle. Vectors
    travel in their own element type.
    """
    data = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("id", "dims").agg(F.max("v").alias("v"))
    shape = {r["dims"]: r["n"] for r in data.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shape:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = max(shape.values())
    blocks = max(1, -(-n // block_rows), min(LEAST_BLOCKS, n // LEAST_ROWS))
    q_blocks = max(1, -(-asked.count() // query_rows))
    part = {d: share(k, rows) for d, rows in shape.items()}
    # Rows that repeat an id are dealt by their vectors, and alike whenever a task runs again.
    left = data.select("id", "v", "dims", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    right = asked.select("id", "v", "dims", F.pmod(F.xxhash64(F.lit("query"), "id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def meet(data_part: pa.Table, query_part: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(data_part) or not len(query_part):
            return kind.empty_table()
        ids, vectors_ = _matrix(data_part)
        q_ids, queries_ = _matrix(query_part)
        q, v, scores = in_bands(vectors_, queries_, k, ids, q_ids, part[data_part.column("dims")[0].as_py()])
        return pa.table([q_ids[q], ids[v], scores], schema=kind)

    near = left.groupBy("b", "qb", "dims").cogroup(right.groupBy("b", "qb", "dims")).applyInArrow(meet, "query_id long, vec_id long, score double")
    last = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    by = Window.partitionBy("query_id").orderBy(last.desc(), F.isnan("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
