"""Hard negatives by exact integer scores from a residue number system.

Components are whole numbers. Both matrices are reduced modulo several primes to residues around zero, small enough that
a float32 product of one block is exact: dims * (p / 2)^2 stays under 2^24. Each product is reduced again, and Chinese
remaindering (mixed radix digits) puts the residues together to the exact signed score; as many primes are taken as the
largest possible score needs. The scores are then selected by windows: an anchor's positives first, then for each
positive the best rows of other labels inside its window.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vector_blocks import BLOCK_ROWS, QUERY_ROWS, finite, meet, one_each, reach, saturated, whole

#: float32 holds every whole number under this; components multiplied before a product is reduced; anchors scored at once.
EXACT, DEPTH, AT_ONCE = 1 << 24, 256, 128


@lru_cache
def primes(depth: int, reach_: int) -> tuple[int, ...]:
    """The largest odd primes whose residue products over depth components stay exact, until they tell all scores of that reach apart."""
    p, product, out = 2 * int(((EXACT - 1) // max(1, depth)) ** 0.5) + 1, 1, []
    while product <= 2 * reach_ + 1:
        if p < 3:
            raise ValueError(f"scores up to {reach_} need more primes than there are for {depth} components")
        if p % 2 and all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 1
    return tuple(out)


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    r = np.remainder(matrix, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


class Residues:
    """A block's matrix, reduced once modulo each prime."""

    def __init__(self, rows: np.ndarray, reach_: int):
        self.depth = min(DEPTH, max(1, rows.shape[1]))
        self.primes = primes(self.depth, reach_)
        self.parts = [np.ascontiguousarray(residues(rows, p).T) for p in self.primes]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Exact inner products, (queries, rows); Python's whole numbers if an int64 could not hold them."""
        digits: list[np.ndarray] = []
        for i, (p, part) in enumerate(zip(self.primes, self.parts, strict=True)):
            theirs = residues(queries, p)
            left = np.zeros((len(queries), part.shape[1]), np.int64)
            for at in range(0, part.shape[0], self.depth):
                left += np.remainder(theirs[:, at : at + self.depth] @ part[at : at + self.depth], np.float32(p)).astype(np.int64)
            # Mixed radix: what the digits so far leave over, divided by their primes, modulo this one.
            for q, digit in zip(self.primes[:i], digits, strict=True):
                left = np.remainder((left - digit) * pow(q, -1, p), p)
            digits.append(np.remainder(left, p))
        product = int(np.prod([int(p) for p in self.primes], dtype=object))
        total = np.zeros_like(digits[0]) if product < 2**62 else np.zeros(digits[0].shape, object)
        for p, digit in zip(reversed(self.primes), reversed(digits), strict=True):
            total = total * p + digit
        return saturated(np.where(total > product // 2, total - product, total))


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers n with low * positive <= 100 n <= high * positive, as both ends."""
    return -(-low * positive // 100), high * positive // 100


def _columns(data: pa.Table, *names: str) -> list[np.ndarray]:
    return [data.column(n).to_numpy() for n in names]


def positives(rows: DataFrame, anchors: DataFrame, k: int, scale: float, block_rows: int, query_rows: int) -> DataFrame:
    """(anchor_id, dims, positive_id, positive_score, place): each anchor's k best other rows of its label."""
    kind = pa.schema([("anchor_id", pa.int64()), ("dims", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def kernel(data: pa.Table, queries: pa.Table) -> pa.Table:
        (ids, labels), (q_ids, q_labels) = _columns(data, "id", "label"), _columns(queries, "id", "label")
        matrix, theirs = whole(data.column("v"), scale), whole(queries.column("v"), scale)
        block, found = Residues(matrix, reach(matrix, theirs)), [np.empty((0, 3), np.int64)]
        for at in range(0, len(q_ids), AT_ONCE):
            for i, row in enumerate(block.scores(theirs[at : at + AT_ONCE]), at):
                near = np.flatnonzero((labels == q_labels[i]) & (ids != q_ids[i]))
                if len(near) > k:
                    near = near[row[near] >= np.partition(row[near], -k)[-k]]
                near = near[np.lexsort((ids[near], ~row[near]))[:k]]
                found.append(np.stack([np.full(len(near), q_ids[i]), ids[near], row[near]], axis=1))
        found = np.concatenate(found)
        return pa.table([found[:, 0], np.full(len(found), matrix.shape[1], np.int32), found[:, 1], found[:, 2]], schema=kind)

    best = Window.partitionBy("anchor_id", "dims").orderBy(F.col("positive_score").desc(), "positive_id")
    return meet(rows, anchors, kernel, kind, block_rows, query_rows).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each anchor and each of its positives, the hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x) with the anchor, exact; higher scores come first, ties by the smaller
    id. Positives are an anchor's n_positives best other rows of its label. Negatives are the n_negatives best rows of other
    labels whose score is low to high percent of the positive's; rank counts from 1. A negative positive score has an empty
    window, a score of 0 the window 0.

    Rows whose id, label or vector is null, or whose vector holds null or non-finite components, take no part; zero and
    empty vectors do. Vectors meet only vectors with as many dimensions. Rows with the anchor's id are its own; of anchors
    that repeat an id, the largest by vector and label is asked; other repeated rows all take part. Components and scores
    beyond a long saturate at its ends. Empty tables give no rows; other columns are not looked at.

    Two passes over blocks (see meet()): a task holds block_rows + query_rows vectors and the scores of AT_ONCE anchors, and
    returns n_positives rows an anchor, then n_negatives rows an anchor and positive, whatever the labels' sizes.
    """
    rows = finite(vectors.where(F.col(label_col).isNotNull()), id_col, vec_col, F.col(label_col).alias("label"))
    asked = one_each(finite(anchors.where(F.col(label_col).isNotNull()), id_col, vec_col, F.col(label_col).alias("label")), "label")
    best = materialise(positives(rows, asked, n_positives, scale, block_rows, query_rows), "positives")
    lists = best.groupBy(F.col("anchor_id").alias("id"), "dims").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    asked = asked.join(lists, ["id", "dims"]).select("id", "v", "dims", "label", F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))
    kind = pa.schema([("anchor_id", pa.int64()), ("dims", pa.int32()), ("place", pa.int32()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def kernel(data: pa.Table, queries: pa.Table) -> pa.Table:
        (ids, labels), (q_ids, q_labels) = _columns(data, "id", "label"), _columns(queries, "id", "label")
        matrix, theirs = whole(data.column("v"), scale), whole(queries.column("v"), scale)
        p_ids, p_scores = queries.column("p_ids").to_pylist(), queries.column("p_scores").to_pylist()
        block, found = Residues(matrix, reach(matrix, theirs)), [np.empty((0, 6), np.int64)]
        for at in range(0, len(q_ids), AT_ONCE):
            for i, row in enumerate(block.scores(theirs[at : at + AT_ONCE]), at):
                windows = [window(s, low, high) for s in p_scores[i]]
                open_ = [(place, ends) for place, ends in enumerate(windows) if ends[0] <= ends[1]]
                if not open_:
                    continue
                near = np.flatnonzero((row >= min(e[0] for _, e in open_)) & (row <= max(e[1] for _, e in open_)) & (labels != q_labels[i]) & (ids != q_ids[i]))
                near = near[np.lexsort((ids[near], ~row[near]))]
                falling = -row[near]
                for place, (least, most) in open_:
                    a, b = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                    taken = near[a : min(b, a + n_negatives)]
                    same = np.full((len(taken), 4), (q_ids[i], place, p_ids[i][place], p_scores[i][place]))
                    found.append(np.column_stack([same, ids[taken], row[taken]]))
        found = np.concatenate(found)
        return pa.table([found[:, 0], np.full(len(found), matrix.shape[1], np.int32), found[:, 1].astype(np.int32), found[:, 2], found[:, 4], found[:, 3], found[:, 5]], schema=kind)

    by = Window.partitionBy("anchor_id", "dims", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    near = meet(rows, asked, kernel, kind, block_rows, query_rows).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n_negatives)
    return near.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
