"""What the operators of this subpackage share: tables, intermediate storage and column plumbing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, materialise  # noqa: F401

#: Stands in for a null document id in comparisons: it loses to every real id where the smallest wins.
NULL_ID = 2**63 - 1

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_in_batches(df: DataFrame) -> DataFrame:
    """df, in whose session whole texts go to Python 1000 at a time where Spark's own default of 10000 rows still holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """df's rows as one struct `__row` beside the given working columns, so that no name of df can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, names: list[str], **columns: Column) -> DataFrame:
    """Undo packed(): the row's own columns, those in `columns` replaced or added."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"__row.`{c}`").alias(c) for c in names if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])
