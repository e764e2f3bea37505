"""Vector best-fit packing of token sequences into bins with several capacities.

Items are placed in decreasing order of length. An item may go to every open bin whose residual token, document-count
and attention-cost capacities all hold it; of these the rule picks one, or a new bin is opened.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOGETHER, codec, texts_of
from .common import materialise, texts_in_batches

MAX_TOKENS = 4096
END = 1
#: Tokens that one task packs, in bins; bins filled to less than this share are packed again with those of other tasks.
BINS_PER_SHARD, POOR = 256, 0.98


@dataclass(frozen=True)
class Capacities:
    """Of one bin: tokens, documents, and attention cost as the sum of squared lengths. weights: of the three residuals in the rule."""

    tokens: int = MAX_TOKENS
    documents: int = MAX_TOKENS
    attention: int = MAX_TOKENS**2
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, caps: Capacities = Capacities()) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    rule "norm" picks the bin whose residual after placing has the smallest weighted norm, "dot" the one with the
    smallest weighted dot product of item and residual, both in shares of the capacities. Ties go to the older bin. A
    bin that is best for an item stays best for the next equal one, so equal items are placed together.
    """
    limits = (float(caps.tokens), float(caps.documents), float(caps.attention))
    weights = [w / c**2 for w, c in zip(caps.weights, limits, strict=True)]
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sorted_lengths = lengths[order]
    least = float(sorted_lengths[-1]) if n else 0.0
    # Open bins: their numbers and residuals, of which the first `m` places are in use.
    number, rest, m, opened, at = np.zeros(max(16, n), np.int64), [np.zeros(max(16, n)) for _ in limits], 0, 0, 0
    while at < n:
        length = float(sorted_lengths[at])
        end = int(np.searchsorted(-sorted_lengths, -length, side="right"))
        item = (length, 1.0, length * length)
        if any(i > c for i, c in zip(item, limits, strict=True)):
            raise ValueError(f"an item of {length:g} tokens is over the capacity of a bin")
        while at < end:
            r = [x[:m] for x in rest]
            fits = (r[0] >= item[0]) & (r[1] >= item[1]) & (r[2] >= item[2])
            if fits.any():
                if caps.rule == "norm":
                    cost = sum(w * (x - i) ** 2 for w, x, i in zip(weights, r, item, strict=True))
                else:
                    cost = sum((w * i) * x for w, x, i in zip(weights, r, item, strict=True))
                cost[~fits] = np.inf
                k = int(cost.argmin())
            else:
                k, m = m, m + 1
                number[k] = opened
                opened += 1
                for x, c in zip(rest, limits, strict=True):
                    x[k] = c
            count = int(min(end - at, *(x[k] // i for x, i in zip(rest, item, strict=True) if i > 0)))
            placed = order[at : at + count]
            bins[placed] = number[k]
            offsets[placed] = int(limits[0] - rest[0][k]) + int(length) * np.arange(count)
            for x, i in zip(rest, item, strict=True):
                x[k] -= i * count
            at += count
            if rest[0][k] < least or rest[1][k] < 1 or rest[2][k] < least * least:
                # Nothing fits any more: later bins move up, so that older bins still win ties.
                for x in (number, *rest):
                    x[k : m - 1] = x[k + 1 : m]
                m -= 1
    return bins, offsets


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end: int = END, memory: int = 1) -> DataFrame:
    """Tokenise whole texts, end each document with `end`, and cut documents of over max_tokens into pieces.

    Returns id_col, piece (from 0), start, length, ids_crc32. A null text is empty, and its document is the end token.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, closing = codec(path, memory), np.array([end], "<u4").tobytes()
        step = 4 * max_tokens
        for batch in batches:
            rows, numbers, lengths, crcs, row = [], [], [], [], 0
            for texts in texts_of(batch, "text", TOGETHER):
                for ids in bpe.encode_all([t or "" for t in texts]):
                    raw = ids + closing
                    for number, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        rows.append(row)
                        numbers.append(number)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                    row += 1
            number = pa.array(numbers, pa.int32())
            start = pa.array(np.array(numbers, np.int64) * max_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), number, start, pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    out = texts_in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def _packed(dealt: DataFrame, kind: str, shards: int, level: int, caps: Capacities) -> DataFrame:
    """One pass over (row, n): a hash of the row and its place deals it to one of the shards, and each shard is packed by itself."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("n").to_numpy()
        shard = table.column("shard")[0].as_py()
        row = pa.concat_arrays(table.column("row").chunks) if table.column("row").num_chunks != 1 else table.column("row").chunk(0)
        # Rows are put in the order of their whole numbers first, so that packing does not hang on how they arrive.
        whole = [row.field(k).to_numpy(zero_copy_only=False) for k in range(row.type.num_fields) if pa.types.is_integer(row.type.field(k).type)]
        tie = np.lexsort(whole or [np.arange(len(lengths))])
        bins, offsets = best_fit(lengths[tie], caps)
        back = np.empty_like(tie)
        back[tie] = np.arange(len(tie))
        return pa.table({"row": row, "n": lengths, "sequence_id": pa.array(bins[back] + (int(shard) << 32) + (level << 56), pa.int64()), "offset": pa.array(offsets[back], pa.int64())})

    # What parts equal rows: their places in the written table, or those that an earlier pass gave them.
    place = [F.col("sequence_id"), F.col("offset")] if "sequence_id" in dealt.columns else [F.monotonically_increasing_id()]
    rows = dealt.select("row", "n", F.pmod(F.xxhash64(F.lit(level), "row", *place), F.lit(shards)).alias("shard"))
    return rows.groupBy("shard").applyInArrow(run, f"row {kind}, n bigint, sequence_id bigint, offset bigint")


def pack(items: DataFrame, length_col: str = "length", caps: Capacities = Capacities(), bins_per_shard: int = BINS_PER_SHARD) -> DataFrame:
    """Add sequence_id (any numbers) and offset (gapless from 0) to items by vector best fit.

    Items are dealt by a hash of their row over shards of bins_per_shard bins' worth of tokens, each packed in one task:
    a task holds a bounded number of tokens whatever the input. Bins that stay poorly filled are then packed again
    together in the same way, where that saves any. Null and non-positive lengths count as 1. Columns named sequence_id
    and offset are replaced; equal rows are equal items, each packed. An empty table gives no rows.
    """
    names = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    # Written first, so that a row's place, which parts equal rows, is the same whenever a task runs again.
    items = materialise(items.select(*[F.col(f"`{c}`") for c in names]), "items")
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(1)), F.lit(1))
    shards_for = lambda tokens: max(1, -(-tokens // (caps.tokens * bins_per_shard)))
    shards = shards_for(items.agg(F.sum(length)).first()[0] or 0)
    kind = items.schema.simpleString()
    done = _packed(items.select(F.struct("*").alias("row"), length.alias("n")), kind, shards, 0, caps)
    if shards > 1:
        done = materialise(done, "packed")
        fill = done.groupBy("sequence_id").agg(F.sum("n").alias("filled"))
        poor = materialise(fill.where(F.col("filled") < POOR * caps.tokens), "poor")
        count, tokens = poor.agg(F.count(F.lit(1)), F.coalesce(F.sum("filled"), F.lit(0))).first()
        again = materialise(_packed(done.join(poor, "sequence_id", "left_semi"), kind, shards_for(tokens), 1, caps), "repacked")
        if again.select("sequence_id").distinct().count() < count:
            done = done.join(poor, "sequence_id", "left_anti").unionByName(again)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", caps: Capacities = Capacities(), memory: int = 1) -> DataFrame:
    """Tokenise, cut and pack documents; see pieces() and pack(). Other columns are not looked at. memory: see PrefixBpe."""
    return pack(pieces(docs, path, id_col, text_col, caps.tokens, memory=memory), caps=caps)
