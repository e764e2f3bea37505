"""Exact top-k search by MaxScore over impact postings of whole-number vectors.

A term is a dimension with a sign; its postings are the rows whose component has that sign, with its size as the impact.
For a query a term either adds to a score (the signs agree) or takes from it. A few promising rows give a first
threshold. Adding terms are split by their score bounds, the query's weight times the largest impact of the list: those
whose bounds together stay under the threshold are non-essential, for a row that lies in no other list cannot come in.
The essential lists are traversed and added up; of the rows that can still reach the threshold, the rest is probed term
by term, the largest bounds first, as long as they stay competitive. Every shard returns its best k, which are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector_blocks import BLOCK_ROWS, MOST, QUERY_ROWS, finite, meet, one_each, reach, saturated, whole

#: Lists whose heads give the first threshold, and how many rows a head holds for each that is asked for.
HEADS, HEAD_ROWS = 8, 4
#: Probed terms between two looks at who is still competitive, and how few rows get their scores without more looks.
STRIDE, FEW = 4, 256
#: A list that holds at least one in so many rows is kept as a whole column, 0 where a row is not in it.
DENSE = 8


class Shard:
    """Postings of one block of rows, in the order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, wide: bool = False):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(object) if wide else rows[order]
        self.columns = np.ascontiguousarray(self.rows.T)
        self.lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.most: dict[tuple[int, int], int] = {}
        self.heads: dict[tuple[int, int], np.ndarray] = {}
        self.sizes: dict[tuple[int, int], int] = {}
        for d, column in enumerate(self.columns):
            for sign in (1, -1):
                held = np.flatnonzero(column * sign > 0)
                impacts = column[held] * sign
                self.sizes[d, sign] = len(held)
                self.most[d, sign], n = int(impacts.max()) if len(held) else 0, min(len(held), HEAD_ROWS * k)
                self.heads[d, sign] = held[np.argpartition(impacts, -n)[-n:]] if n else held
                self.lists[d, sign] = (None, np.where(column * sign > 0, column * sign, 0)) if DENSE * len(held) >= len(column) else (held, impacts)
        self.visited = 0

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the k best rows whose id is not own, ties by the smaller id."""
        allowed = len(self.ids) - (np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own, "left"))
        terms = [(abs(int(w)), d, 1 if w > 0 else -1) for d, w in enumerate(query) if w]
        adding = sorted(((w * self.most[d, s], w, d, s) for w, d, s in terms if self.most[d, s]), reverse=True)
        least = self._first(query, adding, k, own) if allowed > k else None
        rest = sum(bound for bound, *_ in adding)
        totals = np.zeros(len(self.ids), self.rows.dtype)
        if least is None or least <= 0:
            # A row in no adding list scores 0 at most, which may be enough: all lists are essential, all rows candidates.
            essential, near = len(adding), np.arange(len(self.ids))
        else:
            below, essential = 0, len(adding)
            while essential and below + adding[essential - 1][0] < least:
                essential -= 1
                below += adding[essential][0]
            near = None
        for bound, w, d, s in adding[:essential]:
            held, impacts = self.lists[d, s]
            if held is None:
                totals += w * impacts
            else:
                totals[held] += w * impacts
            self.visited += self.sizes[d, s]
            rest -= bound
        if near is None:
            near = np.flatnonzero(totals + rest >= least)
        near = near[self.ids[near] != own]
        totals = totals[near]
        probes = [(bound, bound, w, d, s) for bound, w, d, s in adding[essential:]] + [(w * self.most[d, -s], 0, w, d, -s) for w, d, s in terms if self.most[d, -s]]
        for i, (_, bound, w, d, s) in enumerate(sorted(probes, reverse=True)):
            part = self.columns[d][near] * (w * s if bound else -w * s)
            totals += np.maximum(part, 0, out=part) if bound else np.minimum(part, 0, out=part)
            self.visited += len(near)
            rest -= bound
            if least is not None and i % STRIDE == STRIDE - 1:
                hold = totals + rest >= least
                near, totals = near[hold], totals[hold]
                if len(near) <= FEW:
                    totals = self.rows[near] @ query.astype(self.rows.dtype)
                    self.visited += len(near) * (len(probes) - i - 1)
                    break
        totals = saturated(totals)
        if len(near) > k:
            hold = totals >= np.partition(totals, -k)[-k]
            near, totals = near[hold], totals[hold]
        best = np.lexsort((near, ~totals))[:k]
        return near[best], totals[best]

    def _first(self, query: np.ndarray, adding: list, k: int, own: int) -> int | None:
        """The k-th best score among the rows of largest impact in the first lists; None if there are not k."""
        heads = np.unique(np.concatenate([np.empty(0, np.int64), *[self.heads[d, s] for _, _, d, s in adding[:HEADS]]]))
        heads = heads[self.ids[heads] != own]
        scores = self.rows[heads] @ query.astype(self.rows.dtype)
        return min(int(np.sort(scores)[-k]), MOST) if len(heads) >= k else None


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's k rows with the largest inner product of floor(scale * x), exact: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id; a query's own id is no candidate; queries with fewer candidates get all of them. Rows whose
    id or vector is null, or whose vector holds null or non-finite components, take no part; zero and empty vectors do, with
    a score of 0. Vectors meet only queries with as many dimensions. Candidate rows that repeat an id all take part; of
    queries that repeat one, the largest vector in array order is asked. Components and scores beyond a long saturate at its
    ends. Empty tables give no rows; other columns are not looked at.

    A shard is a block of block_rows rows (see meet()); it returns k rows a query, and the best of all shards are ranked
    with a limit before the shuffle.
    """
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def kernel(data: pa.Table, asked: pa.Table) -> pa.Table:
        rows, theirs, q_ids = whole(data.column("v"), scale), whole(asked.column("v"), scale), asked.column("id").to_numpy()
        shard, found = Shard(data.column("id").to_numpy(), rows, k, wide=reach(rows, theirs) >= 2**62), [np.empty((0, 3), np.int64)]
        for q, own in zip(theirs, q_ids, strict=True):
            near, scores = shard.top(q, k, own)
            found.append(np.column_stack([np.full(len(near), own), shard.ids[near], scores]))
        found = np.concatenate(found)
        return pa.table([found[:, 0], found[:, 1], found[:, 2]], schema=kind)

    near = meet(finite(vectors, id_col, vec_col), one_each(finite(queries, id_col, vec_col)), kernel, kind, block_rows, query_rows)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
