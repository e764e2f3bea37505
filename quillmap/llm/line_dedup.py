"""Line deduplication: hash every normalised line, find the hashes that many documents share, drop all but the first holder's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, materialise, packed, unpacked

#: What is stripped from a line's ends, and the letters that are lower-cased.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    r"""Drop every line whose key at least min_docs documents hold, except in the document with the smallest id among them.

    A text is split at \n; a null or empty text is one empty line. Keys under min_chars code points never count. Returns
    docs with text_col replaced by the remaining lines joined by \n (null stays null if nothing was dropped) and with
    n_lines (before dropping) and n_dropped; columns of these names are replaced. A null id counts as the largest id.
    Rows with the same id are one document; all its copies of a line stay or go together. An empty table gives no rows.

    Lines are hashed once and written as two 64-bit hashes without their text. Counting is pre-aggregated before its
    shuffle; the shared lines are written too, so that the join of a hot line's rows is one that adaptive execution
    splits. The texts move once, to meet the positions to drop.
    """
    names = docs.columns
    base = packed(docs, k=F.coalesce(F.col(id_col), F.lit(NULL_ID)), text=F.coalesce(F.col(text_col), F.lit("")), was_null=F.col(text_col).isNull())
    base = base.withColumn("h", F.xxhash64("text"))
    lines = base.select("k", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("k", "h", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = materialise(lines.select("k", "h", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("line"), "key").alias("b")), "lines")
    if min_docs <= 2:
        counts = lines.groupBy("a", "b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        shared = counts.where(F.col("lo") < F.col("hi")) if min_docs == 2 else counts
    else:
        once = lines.select("a", "b", "k").distinct()
        shared = once.groupBy("a", "b").agg(F.min("k").alias("lo"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    drops = lines.join(materialise(shared.select("a", "b", "lo"), "shared"), ["a", "b"]).where(F.col("k") != F.col("lo"))
    drops = drops.groupBy("k", "h").agg(F.collect_list("pos").alias("drops"))
    joined = base.join(drops, ["k", "h"], "left")
    # One-element arrays bind the split text and its remaining positions, so that each is made once in a row.
    remaining = F.transform(
        F.array(F.split("text", "\n")),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops")), lambda i: F.get(ls, i)), "\n"),
    )[0]
    text = F.when(F.col("drops").isNotNull(), remaining).when(~F.col("was_null"), F.col("text"))
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce(F.size(F.array_distinct("drops")), F.lit(0)).cast("long")
    return unpacked(joined, names, **{text_col: text, "n_lines": n_lines, "n_dropped": n_dropped})
