import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmap.llm import catalog

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns and docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
            docs = docs.cache()
    assert kept["language_id"] >= 198 and kept["line_dedup"] == kept["language_id"] >= kept["near_duplicates"] == kept["personal_data"]
    assert docs.select("doc_id").distinct().count() == kept["personal_data"]
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n != "pipeline"])
def test_every_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.SQL[name])
    cols = sorted(want.columns)
    rows = lambda r: sorted(str(tuple(x[c] for c in cols)) for x in r)
    assert rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]) == rows([r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()])


ROWS = [(1, "die katze und der hund sitzen auf der matte und schlafen", "de"), (1, "die katze und der hund sitzen auf der matte und schlafen", "de"), (None, "the cat and the dog sleep on the mat all day long", "en"), (3, None, "en"), (4, "", None), (5, "the cat and the dog sleep on the mat all day long\nmail me@example.com", None), (6, "die katze und der hund sitzen auf der matte und schlafen", "de")]


def test_each_stage_handles_nulls_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or ""), "x") for d, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, n_found string")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, "").columns == docs.columns
    # Only German has labelled texts with an id, so English is no learned language.
    assert {r[0] for r in rows(stages["language_id"](spark, docs, ""))} == {1, 6}
    kept = rows(stages["line_dedup"](spark, docs, ""))
    assert len(kept) == len(ROWS) and (None, "") in kept and (6, "") in kept and (3, None) in kept and (5, ROWS[5][1]) in kept
    assert sorted((r[0] for r in rows(stages["near_duplicates"](spark, docs, ""))), key=str) == [1, 1, 3, 5, None]
    hidden = dict(rows(stages["personal_data"](spark, docs, "")))
    assert hidden[5].endswith("@example.com") and hidden[5] != ROWS[5][1] and hidden[3] is None
    packed = stages["packing"](spark, docs, "").collect()
    assert sorted((r.doc_id for r in packed), key=str) == sorted((d for d, *_ in ROWS), key=str) and sum(r.length == 1 for r in packed) == 2
