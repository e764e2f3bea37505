"""A Merkle manifest of a dataset: leaves of rows, a tree for each source, a tree over the sources, and proofs.

Slot pivot: one conditional aggregate for each slot spreads a parent's children into as many columns as the fanout;
concatenating all columns hashes the parent, concatenating all but the own slot column gives a child's siblings. Going up
leaves one table a level; going down, the siblings above a parent are put together once for all its children, so that a
row meets its own parent only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

FANOUT = 16


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: list[Column]) -> Column:
    """Hash of the values: '-' for null, else the UTF-8 byte count, ':' and the value."""
    text = [v.cast("string") for v in values]
    return hashed(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `pos`, their place (from 0) within `group` in the given order, nulls first, and the group's `size`, as a written table.

    Rows are dealt by ranges of group and order, so that no group, however large, meets in one task. A row's place in its
    range then only needs the number of rows that earlier ranges hold of its group: one row for each range and group.
    """
    at, part = F.monotonically_increasing_id(), F.call_function("shiftright", F.col("__at"), F.lit(33))
    # Rows equal in all of these can stand in any order; their place in the input keeps them from filling one range.
    dealt = rows.withColumn("__any", at).repartitionByRange(group, *order, "__any").sortWithinPartitions(group, *order, "__any").drop("__any")
    dealt = materialise(dealt.withColumn("__at", at).withColumn("__part", part), "ranges")
    held = dealt.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(group, "__part", "__first", before.alias("__before"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    out = dealt.join(held, [group, "__part"])
    out = materialise(out.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).select(*rows.columns, "pos", "size"), "placed")
    forget(dealt)
    return out


def _parents(nodes: DataFrame, child: Column, fanout: int, digest) -> DataFrame:
    """(grp, pos, size, s0.., h): each run of fanout nodes as one row, a slot column for each child; digest gives a slot's hash."""
    slots = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == s, child)).alias(f"s{s}") for s in range(fanout)]
    out = nodes.groupBy("grp", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(F.ceil(F.max("size") / fanout).cast("long").alias("size"), *slots)
    return out.withColumn("h", F.sha2(F.concat_ws("", *[digest(F.col(f"s{s}")) for s in range(fanout)]), 256))


def _children(parents: DataFrame, fanout: int, digest, *kept: str) -> DataFrame:
    """(grp, pos, child, left, right, kept): each held slot of each parent with its siblings on either side, joined."""
    column = [F.col(f"s{s}") for s in range(fanout)]
    join = lambda cs: F.concat_ws("", *[digest(c) for c in cs]) if cs else F.lit("")
    each = [F.when(column[s].isNotNull(), F.struct(F.lit(s).alias("slot"), column[s].alias("child"), join(column[:s]).alias("left"), join(column[s + 1 :]).alias("right"))) for s in range(fanout)]
    out = parents.select("grp", "pos", *kept, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return out.select("grp", (F.col("pos") * fanout + F.col("x.slot")).alias("pos"), "x.child", "x.left", "x.right", *kept)


class Tree:
    """The trees of nodes (grp, pos, size, h, row) with places from 0 in every group: a written table of parents for each level.

    Every node carries the size of its level in its group, so nothing is joined by the group alone.
    """

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT):
        self.nodes, self.fanout, self.levels = nodes, fanout, []
        size = nodes.agg(F.max("size")).first()[0] or 1
        child, digest, below = F.struct("h", "row"), (lambda c: c["h"]), nodes
        while size > 1:
            self.levels.append(materialise(_parents(below.where("size > 1"), child, fanout, digest), "level"))
            child, digest, below, size = F.col("h"), (lambda c: c), self.levels[-1].select("grp", "pos", "size", "h"), -(-size // fanout)

    def roots(self) -> DataFrame:
        """(grp, h): what remains of each group."""
        out = self.nodes.where("size = 1").select("grp", "h")
        for level in self.levels:
            out = out.unionByName(level.where("size = 1").select("grp", "h"))
        return out

    def rows(self, above: DataFrame) -> DataFrame:
        """(row, h, left, right, path, subroot, root): each node with its siblings on either side, null if it is its group's
        root itself, and the array of those of its ancestors up to the root. above: (grp, path, root), the path from each
        group's root on."""
        down: DataFrame | None = None
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            ends = level.where("size = 1").join(above, "grp").withColumn("subroot", F.col("h"))
            if down is not None:
                ends = ends.unionByName(level.where("size > 1").join(down, ["grp", "pos"]))
            digest = (lambda c: c) if i else (lambda c: c["h"])
            down = _children(ends, self.fanout, digest, "path", "subroot", "root")
            if i:
                own = F.array(F.struct("left", "right"))
                down = down.select("grp", "pos", F.concat(own, "path").alias("path"), "subroot", "root")
        ends = self.nodes.where("size = 1").join(above, "grp").select("row", "h", F.lit(None).cast("string").alias("left"), F.lit(None).cast("string").alias("right"), "path", F.col("h").alias("subroot"), "root")
        if down is None:
            return ends
        return down.select("child.row", "child.h", "left", "right", "path", "subroot", "root").unionByName(ends)


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None, fanout: int = FANOUT, with_path: bool = False) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified, one row for each row of docs.

    A leaf is the hash (lower-case hex of SHA-256, inputs concatenated) of the columns in the given order, each '-' if null,
    else its UTF-8 byte count, ':' and its value. In each group leaves ascend by id_col; as long as a group has several
    nodes, every fanout consecutive ones, the last run perhaps fewer, become their hash. What remains is the subroot; the
    subroots, ordered by group, make the root likewise. proof_sha256 is the hash of all siblings on the way from the leaf to
    the root. folded_root is computed anew from those siblings and the leaf of the tampered columns, where `tampered` names
    any, and verified tells whether it equals root. With with_path, `left`, `right` and `path` hold the siblings.

    Null groups are one group and come first, null ids come first in their group; ids that repeat stand in the order of
    their leaves, and rows that repeat each have a leaf. Empty texts are values, null texts are not. An empty table gives no
    rows, one row is its own root. Other columns are not looked at.

    The texts are read and hashed once, and only digests move: by ranges of group and id, then by parent. Siblings of upper
    levels are joined per parent, one sixteenth of the level below.
    """
    kept = [F.col(f"`{c}`") for c in columns]
    changed = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in columns]
    # A null group sorts before any other: '-' is less than '='.
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("-"))
    leaves = docs.select(group.alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf_of(kept).alias("h"), leaf_of(changed).alias("t"))
    leaves = materialise(leaves, "leaves")
    nodes = placed(leaves, "grp", "id", "h").select("grp", "pos", "size", "h", F.struct("id", "t").alias("row"))
    forget(leaves)
    tree = Tree(nodes, fanout)
    subroots = materialise(tree.roots().select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "h"), "subroots")
    top = Tree(placed(subroots, "grp", "name").select("grp", "pos", "size", "h", F.struct("name").alias("row")), fanout)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    whole = top.rows(top.roots().select("grp", nothing.alias("path"), F.col("h").alias("root")))
    own = F.when(F.col("left").isNull(), nothing).otherwise(F.array(F.struct("left", "right")))
    above = whole.select(F.col("row.name").alias("grp"), F.concat(own, "path").alias("path"), "root")
    found = tree.rows(materialise(above, "above"))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    beside = F.coalesce(F.concat("left", "right"), F.lit(""))
    folded = F.aggregate("path", F.coalesce(hashed(F.col("left"), F.col("row.t"), F.col("right")), F.col("row.t")), lambda acc, x: hashed(x["left"], acc, x["right"]))
    out = found.select(F.col("row.id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", hashed(beside, siblings).alias("proof_sha256"), folded.alias("folded_root"), *(["left", "right", "path"] if with_path else []))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The manifest of documents for DuckDB: a level of all trees, then of the tree over them, for each step of the recursions.
ORACLE_SQL = r"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS id, doc_id, source, text, lang, n_chars,
               list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                   lambda acc, b: list_reduce(list_prepend(xor(acc, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS state
        FROM documents),
    f AS (SELECT *, concat(coalesce(CAST(octet_length(encode(CAST(doc_id AS VARCHAR))) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR), '-'),
                           coalesce(CAST(octet_length(encode(source)) AS VARCHAR) || ':' || source, '-'), coalesce(CAST(octet_length(encode(lang)) AS VARCHAR) || ':' || lang, '-'),
                           coalesce(CAST(octet_length(encode(CAST(n_chars AS VARCHAR))) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
                 coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text, '-') AS body,
                 coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lower
          FROM d),
    l AS (SELECT id, doc_id, coalesce('=' || source, '-') AS grp, sha256(head || body) AS leaf,
                 sha256(head || CASE WHEN xor(state, 4294967295) % 5 = 0 THEN lower ELSE body END) AS tampered FROM f),
    p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
    up AS (SELECT 0 AS lev, grp, pos, leaf AS h FROM p
           UNION ALL
           SELECT any_value(lev) + 1, grp, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM up) WHERE n > 1 GROUP BY grp, pos // 16),
    sub AS (SELECT grp, h FROM up QUALIFY lev = max(lev) OVER (PARTITION BY grp)),
    s AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos FROM sub),
    top AS (SELECT 0 AS lev, pos, h FROM s
            UNION ALL
            SELECT any_value(lev) + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY pos // 16),
    root AS (SELECT h AS root FROM top QUALIFY lev = max(lev) OVER ()),
    deep AS (SELECT grp, max(lev) AS last FROM up GROUP BY grp),
    runs AS (SELECT lev, grp, pos // 16 AS run, list({'pos': pos, 'h': h} ORDER BY pos) AS hs FROM up JOIN deep USING (grp) WHERE lev < last GROUP BY ALL
             UNION ALL SELECT lev, '', pos // 16, list({'pos': pos, 'h': h} ORDER BY pos) FROM top WHERE lev < (SELECT max(lev) FROM top) GROUP BY ALL),
    walk AS (SELECT p.id, p.grp AS grp, 0 AS lev, p.pos AS pos, tampered AS h, '' AS seen, p.grp AS name, last, false AS over FROM p JOIN deep USING (grp)
             UNION ALL
             SELECT w.id, CASE WHEN w.lev = w.last THEN '' ELSE w.grp END, CASE WHEN w.lev = w.last THEN 0 ELSE w.lev + 1 END,
                    CASE WHEN w.lev = w.last THEN s.pos ELSE w.pos // 16 END,
                    CASE WHEN w.lev = w.last THEN w.h ELSE sha256(list_reduce(list_prepend('', list_transform(r.hs, lambda x: CASE WHEN x.pos = w.pos THEN w.h ELSE x.h END)), lambda a, b: a || b)) END,
                    CASE WHEN w.lev = w.last THEN w.seen ELSE w.seen || list_reduce(list_prepend('', list_transform(r.hs, lambda x: CASE WHEN x.pos = w.pos THEN '' ELSE x.h END)), lambda a, b: a || b) END,
                    w.name, CASE WHEN w.lev = w.last THEN (SELECT max(lev) FROM top) ELSE w.last END, w.over OR w.lev = w.last
             FROM walk w LEFT JOIN runs r ON r.lev = w.lev AND r.grp = w.grp AND r.run = w.pos // 16 AND w.lev < w.last LEFT JOIN s ON s.grp = w.name AND w.lev = w.last
             WHERE NOT (w.over AND w.lev = w.last)),
    done AS (SELECT id, h, seen FROM walk WHERE over AND lev = last)
    SELECT p.doc_id, p.leaf, sub.h AS subroot, root, sha256(seen) AS proof_sha256, done.h AS folded_root, done.h = root AS verified
    FROM p JOIN sub USING (grp) CROSS JOIN root JOIN done USING (id)
"""
