import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quillmap.llm import exact_dedup, line_dedup, minhash

TEXTS = ["same", "same", "other", "", None, "same ", "Same", "x" * 50_000, "x" * 50_000, "", "other"]


def brute_exact(rows, keep):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for doc, text in rows:
        ids = [d for d in groups[text or ""] if d is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        out.append((doc, best, len(groups[text or ""]), doc == best))
    return sorted(out, key=str)


def test_exact_dedup_equals_brute_force(spark):
    rows = [*enumerate(TEXTS), (None, "same"), (None, "only null ids"), (3, "")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, digest string, keep_id int")
    for keep in ("min", "max"):
        got = exact_dedup.exact_dedup(df, keep=keep).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute_exact(rows, keep)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = [(k, f"text {k % 40}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c: F.unhex(F.hex(F.crc32(c) % 5))
    got = exact_dedup.exact_dedup(df, keep="max", digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute_exact(rows, "max")


def test_hot_group_is_compared_in_shares(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 4)
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    assert exact_dedup.exact_dedup(df).groupBy("keep_id", "group_size").count().collect()[0].asDict() == {"keep_id": 0, "group_size": 300, "count": 300}


def brute_lines(rows, least=10, docs=2):
    table = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda s: s.strip(line_dedup.BLANK).translate(table)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and doc != min(holders[key(x)]))]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_rows_that_repeat_an_id_are_compared(spark):
    weak = lambda text: F.unhex(F.sha2(F.substring(text, 1, 1), 256))
    rows = [(1, "ab"), (1, "ac"), (1, "ab"), (2, "ab"), (None, "ab"), (None, "ad"), (3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest=weak).collect()), key=str)
    assert got == sorted([(1, 1, 4, True), (1, 1, 1, True), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (None, None, 1, True), (3, 3, 1, True)], key=str)
    many = spark.range(3000).selectExpr("id div 3000 as doc_id", "'same' as text")
    assert exact_dedup.exact_dedup(many).where("kept and group_size = 3000").count() == 3000


def test_filter_passes_all_digests_held_by_several_rows(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "cast(id div (1 + id % 2) as string) as text")
    level = exact_dedup.compact(exact_dedup.flush(df))
    rows = level.select("digest", "group_size")
    kept = exact_dedup.passing(rows, exact_dedup.filter_of(level))
    assert kept.where("group_size > 1").count() == rows.where("group_size > 1").count() > 1000
    assert kept.where("group_size = 1").count() < 20


LINES = [(1, "shared line one\nown\n\tSHARED LINE TWO \x0b"), (2, "Shared Line One\nshared line two\nshared line two\nshort"), (3, None), (4, ""), (5, "\n\n"), (6, "Éclair partagé\nshort\nmine is a longer line"), (7, "éclair partagé\nÉclair partagé  "), (8, "\n".join(f"line number {k % 60}" for k in range(500))), (9, "line number 7\nzzz"), (2, "shared line two\nanother row of document two")]


def test_line_dedup_equals_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in LINES], "doc_id long, text string, line string, n_lines int")
    got = sorted((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df).collect())
    assert got == brute_lines(LINES)
    got = sorted((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, min_docs=3, min_chars=3).collect())
    assert got == brute_lines(LINES, 3, 3)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect() if r.doc_id == 3}
    assert kept == {3: None}


def test_line_dedup_null_id_is_the_last_holder(spark):
    df = spark.createDataFrame([(None, "a line that is shared"), (5, "a line that is shared")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df).collect()} == {None: 1, 5: 0}


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows, least=0.8):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, t or "", shingles(t or "")) for d, t in rows]
    for i, (a, ta, sa) in enumerate(sets):
        for b, tb, sb in sets[:i]:
            if ta == tb or sa and sb and len(sa & sb) >= least * len(sa | sb) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in rows}


def corpus():
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        rows.append(" ".join(text))
        for copy in range(rng.randint(0, 12)):
            t = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    return [*enumerate(rows), (900, ""), (901, None), (902, "   "), (903, "one two"), (904, "One  two"), (905, "x " * 20_000)]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c", "b") for d, t in rows], "doc_id long, text string, class_id string, bucket string")
    got = minhash.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_other_similarities_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = []
    for base in range(25):
        text = [f"b{base}w{k}" for k in range(rng.randint(40, 120))]
        for _ in range(5):
            t = list(text)
            for _ in range(rng.randint(1, 12)):
                t[rng.randrange(len(t))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (0.5, 0.3, 0.9):
        assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, similarity=least).collect()} == brute_classes(rows, least)
    assert [minhash.rows_of_band(x) for x in (0.8, 0.5, 0.1)] == [5, 2, 1]


def test_pairs_far_apart_in_wide_buckets_are_linked(spark):
    # 396 shingles of a shared passage and 54 of each text's own: 396 / 504 = 0.786 between any two. The last 40 texts
    # have 8 words more in common with one of the first: 404 / 496 = 0.815, and stand anywhere in buckets of hundreds.
    shared = [f"t{k}" for k in range(400)]
    own = {doc: [f"d{doc}x{k}" for k in range(50)] for doc in range(1500)}
    for doc in range(1460, 1500):
        own[doc][:8] = own[doc - 1400][:8]
    rows = [(doc, " ".join(shared + own[doc])) for doc in own]
    a, b, c = (shingles(rows[k][1]) for k in (60, 1460, 61))
    assert len(a & b) >= 0.8 * len(a | b) and len(b & c) < 0.8 * len(b | c) and len(a & c) < 0.8 * len(a | c)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {doc: doc - 1400 if doc >= 1460 else doc for doc in own}


def test_rare_shingles_find_every_pair_and_few_others(spark):
    # A passage of 300 shingles in every text, of which each has 60 to 90 more; every tenth shares most of these with the next.
    import numpy as np

    rng = np.random.default_rng(12)
    passage, sets = np.arange(300), {}
    for k in range(4000):
        own = 10_000 + 100 * k + np.arange(rng.integers(60, 90))
        if k % 10 == 1:
            own = np.concatenate([own[: rng.integers(5, 40)], sets[k - 1][300:]])
        sets[k] = np.concatenate([passage, own])
    rows = [(k, k, np.sort(x).astype(np.uint32).tobytes()) for k, x in sets.items()]
    df = spark.createDataFrame(rows, "id long, label long, names binary")
    found = {(r.a, r.b) for r in minhash._pairs_by_rare_shingles(df, 0.8).collect()}
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = {(k - 1, k) for k in range(1, 4000, 10) if alike(sets[k - 1], sets[k])}
    assert want and {tuple(sorted(p)) for p in found} >= want
    # Any two texts are 300 / 450 alike, 8 million pairs in all.
    assert len(found) < 20 * 4000
    few = {k: sets[k] for k in range(120)}
    some = {tuple(sorted((r.a, r.b))) for r in minhash._pairs_by_rare_shingles(df.where("id < 120"), 0.6).collect()}
    assert some >= {(a, b) for a in few for b in few if a < b and len(np.intersect1d(few[a], few[b])) >= 0.6 * len(np.union1d(few[a], few[b]))}
    assert minhash._pairs_by_rare_shingles(df.withColumn("label", df["id"] * 0), 0.8).count() == 0


def test_near_duplicates_with_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "quite another text than that"), (2, "a b c d e f")]
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 1, False)], key=str)


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    els = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = minhash.signatures([els, els], [a, b], 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03
    x, y = els[:200], els[50:260]
    sig = minhash.signatures([x, y], [np.ones(200), np.ones(210)], 4000)
    assert abs((sig[0] == sig[1]).mean() - 150 / 260) < 0.03
    assert (minhash.signatures([x[:1], x[:1], x[:0]], [np.ones(1), np.ones(1), np.ones(0)])[:2] > 0).all()


def test_digest_is_plain_sha256(spark):
    df = spark.createDataFrame([(1, "é")], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).first().digest.hex() == hashlib.sha256("é".encode()).hexdigest()
