"""Queries of the operators in this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, hard_negatives, html_text, langid, line_dedup, manifest, maxscore, minhash, packing, pii
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, memory=2)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), memory=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("conv_id", "participant", "segment", "continued", "n_messages", "n_trained", "text", spans.alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, vectors.where(F.col("vec_id") % 100 == 0), n_positives=5, n_negatives=10, low=30, high=90)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    return manifest.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", tampered={"text": tampered})


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_minhash, op4_line_dedup, op5_neighbours, op6_packing, op7_pii, op8_html, op9_langid, op10_chat, op11_hard_negatives, op12_manifest, op13_topk, pipeline)
}

#: Whole-number vectors of embeddings, without those that take no part.
_WHOLE = """
    w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) IS NOT FALSE)
"""
#: The inner product of two of them.
_DOT = "CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT)"

SQL: dict[str, str] = {
    "op11_hard_negatives": f"""
        WITH {_WHOLE}, r AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM w WHERE label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, {_DOT} AS score
              FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
        WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER best <= 10
    """,
    "op12_manifest": manifest.ORACLE_SQL,
    "op13_topk": f"""
        WITH {_WHOLE}
        SELECT a.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, b.vec_id AS vec_id, {_DOT} AS score
        FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WINDOW best AS (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) QUALIFY row_number() OVER best <= 5
    """,
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
    """,
    "op4_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.doc_id, k.line, k.pos, s.lo IS NOT NULL AND k.doc_id <> s.lo AS gone FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op10_chat": """
        WITH m AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'row ' || row_number() OVER ()) AS key, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        s AS (SELECT key, min(turn // 64) AS first_, min(turn) FILTER (role = 'system') AS turn, arg_min(text, (turn, text)) FILTER (role = 'system') AS text FROM m GROUP BY key),
        g AS (SELECT key, conv_id, turn // 64 AS segment, count(*) AS n_messages FROM m GROUP BY ALL),
        x AS (SELECT key, turn // 64 AS segment, turn, role, text FROM m UNION ALL SELECT g.key, g.segment, s.turn, 'system', s.text FROM g JOIN s ON g.key = s.key WHERE s.turn // 64 < g.segment),
        p AS (SELECT DISTINCT key, role AS participant FROM m WHERE role <> 'system'),
        r AS (SELECT x.key, p.participant, segment, turn, role, text,
                     CASE WHEN role = 'system' THEN '<|system|>' WHEN role = participant THEN '<|assistant|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
                     text || '<|end|>' || chr(10) AS body
              FROM x JOIN p ON x.key = p.key),
        o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY key, participant, segment ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM r),
        t AS (SELECT key, participant, segment, count(*) FILTER (role = participant) AS n_trained, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
                     coalesce(string_agg(CAST(e - length(body) AS VARCHAR) || ':' || CAST(e - 1 AS VARCHAR), ',' ORDER BY turn, role, text, e) FILTER (role = participant), '') AS spans
              FROM o GROUP BY key, participant, segment)
        SELECT g.conv_id, t.participant, CAST(t.segment AS BIGINT) AS segment, t.segment > s.first_ AS continued, n_messages, n_trained, t.text, spans FROM t JOIN g ON t.key = g.key AND t.segment = g.segment JOIN s ON t.key = s.key
    """,
}
