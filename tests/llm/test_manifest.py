"""The Merkle manifest against a plain recursion, and the query against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmap.llm import catalog, manifest

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(hashes, fanout):
    """Root of the hashes, and for each the list of its runs: (before, after) level by level."""
    ways, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for way, i in zip(ways, at, strict=True):
            run = i // fanout * fanout
            way.append((level[run:i], level[i + 1 : run + fanout]))
        level, at = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)], [i // fanout for i in at]
    return level[0], ways


def plain(rows, fanout):
    """doc_id, leaf, subroot, root, proof, folded, verified of rows (doc_id, source, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [grow([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names]
    root, ways = grow([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, own), above in zip(names, trees, ways, strict=True):
        for x, way in zip(sorted(groups[s], key=lambda x: x[:3]), own, strict=True):
            doc_id, source, text = x[3]
            lower = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            fold = leaf((doc_id, source, text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text))) if lower else x[2]
            for a, b in way + above:
                fold = sha(*a, fold, *b)
            out.append((doc_id, x[2], subroot, root, sha(*[h for a, b in way + above for h in a + b]), fold, fold == root))
    return out


def query(docs, fanout=16):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    return manifest.manifest(docs, ["doc_id", "source", "text"], tampered={"text": tampered}, fanout=fanout)


def key(r):
    return [str(x) for x in r]


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_equals_the_plain_recursion(spark, fanout):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", f"Text {i}" * (i % 4)) for i in range(700)]
    rows += [(i, None, "A") for i in range(700, 735)] + [(900, "lone", "Ünï"), (901, "é", None), (902, "z", ""), (901, "é", None), (None, "hot", "B"), (None, "hot", "B"), (None, None, None), (-5, "hot", "Q" * 100_000), (16, "hot", "same id"), (17, "", "empty name")]
    docs = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, source string, text string, leaf string, pos int")
    got = [tuple(r) for r in query(docs, fanout).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, fanout), key=key)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", "X")], [(i, "a", "X") for i in range(17)], [(i, None, None) for i in range(16)], [(5, f"s{i:03}", "t") for i in range(300)]])
def test_small_and_flat_trees(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted((tuple(r) for r in query(docs).collect()), key=key) == sorted(plain(rows, 16) if rows else [], key=key)


def test_paths_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "t") for i in range(100)], "doc_id long, source string, text string")
    for r in manifest.manifest(docs, ["doc_id", "text"], with_path=True).collect():
        fold = r["leaf"]
        for left, right in [(r["left"], r["right"]), *r["path"]]:
            fold = sha(left, fold, right)
        assert fold == r["root"] == r["folded_root"] and r["verified"]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = catalog.QUERIES["op12_manifest"](spark, SF), con.sql(catalog.SQL["op12_manifest"])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
