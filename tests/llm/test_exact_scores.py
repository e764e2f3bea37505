"""Hard negatives and exact top-k against plain Python whole numbers."""

import math

import duckdb
import numpy as np
import pytest

from quillmap.llm import catalog, hard_negatives, maxscore

MOST = 2**63 - 1


def whole(v):
    big = lambda x: min(max(math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256, -MOST - 1), MOST)
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [big(x) for x in v]


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -MOST - 1), MOST)


def top(rows, asked, k):
    ok = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    return {(q, r, i, -s) for q, a in ok if q in asked for r, (s, i) in enumerate(sorted((-dot(a, w), i) for i, w in ok if i != q and len(w) == len(a))[:k], 1)}


def mined(rows, asked, k, n):
    ok = [(i, w, c) for i, v, c in rows if i is not None and c is not None and (w := whole(v)) is not None]
    out = set()
    for q, a, c in ok:
        if q in asked:
            scored = [(-dot(a, w), i, d == c) for i, w, d in ok if i != q and len(w) == len(a)]
            for p, pid, _ in sorted(x for x in scored if x[2])[:k]:
                hard = sorted(x for x in scored if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:n]
                out |= {(q, pid, r, i, -p, -s) for r, (s, i, _) in enumerate(hard, 1)}
    return out


def odd_rows(rng):
    rows = [(int(i), rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [0.0] * 6), (404, []), (405, []), (406, [1.0, 2.0]), (408, [-1.0, 2.0]), (None, [1.0] * 6)]
    return rows + [(410 + i, (1e4**i * rng.standard_normal(6)).tolist()) for i in range(6)] + [(420, [1e200, -1e200, 1.0, 0.0, 0.0, 0.0]), (421, [1e306] * 6), (422, [-1e17] * 6), (423, [1e-200] * 6), (424, [-1e-200] * 6)]


def test_topk_equals_brute_force_on_odd_rows(spark):
    rows = odd_rows(np.random.default_rng(1))
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = maxscore.search(df, df.where("vec_id % 2 = 0"), k=5, block_rows=100, query_rows=50)
    assert {tuple(r) for r in got.collect()} == top(rows, {i for i, _ in rows if i is not None and i % 2 == 0}, 5)
    assert maxscore.search(df.limit(0), df.limit(0)).count() == 0
    assert maxscore.search(df, df.where("vec_id = 406"), k=5).collect() == [(406, 1, 408, 256 * 256 * 3)]


def test_topk_of_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (3, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in maxscore.search(df, df.where("vec_id = 1"), k=5).orderBy("rank").collect()]
    # Of the queries with id 1, [1, 0] is the larger; every repeated candidate takes part.
    assert got == [(1, 1, 2, 65536), (1, 2, 2, 65536), (1, 3, 3, 0), (1, 4, 3, -65536)]


def test_maxscore_skips_postings():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.standard_normal((4000, 64)) / 8).astype(np.int64)
    sparse = rows * (rng.random(rows.shape) < 0.05)
    for matrix in (rows, sparse):
        shard, held = maxscore.Shard(np.arange(4000), matrix, 5), 0
        for q in range(50):
            near, scores = shard.top(matrix[q], 5, q)
            exact = matrix @ matrix[q]
            exact[q] = np.iinfo(np.int64).min
            want = np.lexsort((np.arange(4000), ~exact))[:5]
            assert near.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
            held += np.count_nonzero(matrix[:, matrix[q] != 0])
        # Of all postings of the queries' dimensions.
        assert shard.visited < 0.95 * held


@pytest.mark.parametrize("dims", [1, 64, 300])
@pytest.mark.parametrize("size", [3, 1 << 20, 1 << 40, 2**63 - 1])
def test_residues_give_exact_scores(dims, size):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-size, size, (n, dims), endpoint=True) for n in (7, 50))
    a[0], b[0], b[1] = size, size, -size
    got = hard_negatives.Residues(b, dims * size * size).scores(a)
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(r, s, strict=True)), -MOST - 1), MOST) for s in b] for r in a]
    assert got.tolist() == want


def test_hard_negatives_equal_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, None if n % 41 == 40 else int(rng.integers(0, 3)) if n % 3 else 1) for n, (i, v) in enumerate(odd_rows(rng))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, positive_id string")
    got = hard_negatives.mine(df, df.where("vec_id % 4 = 0"), block_rows=100, query_rows=50).collect()
    want = mined(rows, {i for i, *_ in rows if i is not None and i % 4 == 0}, 5, 10)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 1000
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0


def test_windows_are_whole():
    assert [hard_negatives.window(p, 30, 90) for p in (0, 1, 10, 11, -10)] == [(0, 0), (1, 0), (3, 9), (4, 9), (-3, -9)]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_topk"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got, want = catalog.QUERIES[name](spark, sf), con.sql(catalog.SQL[name])
    assert got.columns == want.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
