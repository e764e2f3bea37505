"""Exact deduplication through a log-structured merge index of text digests.

Flush: each input split is a memtable, written as one run sorted by digest. Compaction: runs are merged into one level
that holds, per digest, the id that stays and the group's size, and a filter over the digests that several rows hold: a
bitmap of bounded size. Look-up: a row whose digest the filter lacks is alone, and its text never moves. The others
find their digest in the level, and a hit is believed only after its bytes are compared with those of the document that
stays. Rows that share a digest but not the bytes are grouped again by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a hot group that are compared with one copy of the text that stays.
SALT_ROWS = 64
#: Bits of the filter, 8 MB, as 2048 bitmaps of 32768 bits; when more digests are held by several rows, more rows pass.
FILTER_BITS = 1 << 26


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _read(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return out.withColumn("digest", digest(F.col("text")))


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """Sorted runs (digest, id), one for each input split; the texts stay where they are."""
    runs = _read(docs, id_col, text_col, digest).select("digest", "id").sortWithinPartitions("digest", "id")
    return materialise(runs, "runs")


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """Merge runs: (digest, keep_id, group_size), counted within each run before the shuffle."""
    best = F.min("id") if keep == "min" else F.max("id")
    level = runs.groupBy("digest").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialise(level, "level")


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS))


def filter_of(level: DataFrame) -> DataFrame:
    """(bucket, bits): which digests several rows hold, FILTER_BITS / 32768 rows of 4 KB at most."""
    bit = _bit(F.col("digest"))
    bits = level.where("group_size > 1").groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    return materialise(bits, "filter")


def passing(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose digest the filter may hold. The filter is broadcast: FILTER_BITS bounds its size."""
    at = F.bitmap_bit_position(_bit(F.col("digest")))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(_bit(F.col("digest"))) == F.col("bucket")) & held, "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest=digest_of) -> DataFrame:
    """Groups of equal texts: id_col, keep_id (the smallest or, with keep="max", largest id stays), group_size, kept, digest.

    One row for each input row. Null counts as the empty text; nothing is normalised. Null ids never stay if the group
    has another id; a group of null ids only has a null keep_id and keeps its rows. Rows repeated with their id are all
    returned and all kept if their id stays; all of them are compared. An empty table gives no rows. Other columns are not looked at. Hot groups
    are pre-aggregated in each run; their rows are compared in salted shares of SALT_ROWS with copies of the text that stays.
    """
    runs = flush(docs, id_col, text_col, digest)
    level = compact(runs, keep)
    found = runs.join(level, "digest")
    shares = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    hits = found.where(F.col("group_size") > 1).select("id", "digest", F.pmod(F.xxhash64("id"), shares).alias("share")).distinct()
    texts = passing(_read(docs, id_col, text_col, digest), filter_of(level)).select("id", "digest", "text")
    stays = level.where("group_size > 1").select(F.col("keep_id"), F.col("digest").alias("keep_digest"), shares.alias("shares"))
    # Rows that repeat the one that stays are one text to compare with.
    stays = texts.join(stays, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))).groupBy("digest", "shares").agg(F.min("text").alias("keep_text"))
    stays = stays.select("digest", "keep_text", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    theirs = texts.join(hits.select(F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"), "share"), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))).select("digest", "share", "text")
    bad = theirs.join(stays, ["digest", "share"]).where(F.col("text") != F.col("keep_text")).select("digest").distinct()
    bad = materialise(bad, "collisions")
    columns = [F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest"]
    if bad.isEmpty():
        return found.select(*columns)
    best = F.min("id") if keep == "min" else F.max("id")
    mixed = texts.join(bad, "digest", "left_semi")
    groups = mixed.groupBy("digest", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return found.join(bad, "digest", "left_anti").select(*columns).unionByName(mixed.join(groups, ["digest", "text"]).select(*columns))
