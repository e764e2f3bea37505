"""The corpus pipeline: language, repeated lines, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import langid, line_dedup, minhash, packing, pii
from quillmap.llm.catalog import tokenizer_path
from quillmap.llm.common import materialise


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out with the columns of docs, n_chars counted anew."""
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on the stage's own labelled documents.

    Null and empty texts and texts without a letter go, and with no label at all everything does. Null ids and repeated
    rows stay as they are.
    """
    return langid.identify(docs).where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document with a smaller id holds too; see line_dedup().

    A text whose lines all go is empty; null texts stay null; rows with a null id lose what any other document holds.
    """
    return _like(line_dedup.line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; of texts that only rows without an id hold, all those rows.

    Rows that repeat the kept id with the same text all stay. Null and empty texts are one class.
    """
    kept = minhash.near_duplicates(docs, with_digest=True).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    same = (F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)) == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return docs.join(kept, same, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms; null texts stay null."""
    return _like(pii.pseudonymise(docs), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its place in a sequence; a null or empty text is its end token alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", sequences)]

#: No SQL expresses the trained model, the tokens or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
