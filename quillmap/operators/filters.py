"""Row filters that several plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least confidence of a detected instance and of a recognised text, and least share of the sheet's height that a meridian spans.
INSTANCE_CONFIDENCE, TEXT_CONFIDENCE, LINE_COVERAGE = 0.5, 0.35, 0.25


def confident(df: DataFrame, confidence: str = "conf", least: float = INSTANCE_CONFIDENCE, missing: float | None = None) -> DataFrame:
    """Rows of at least that confidence; a null one counts as `missing`, or drops the row."""
    c = F.col(confidence) if missing is None else F.coalesce(F.col(confidence), F.lit(missing))
    return df.where(c >= least)


def covering(df: DataFrame, low: Column, high: Column, extent: Column, least: float = LINE_COVERAGE, name: str = "coverage") -> DataFrame:
    """Lines whose span is at least a share of the sheet's extent, with that share added; a sheet without extent keeps none."""
    return df.withColumn(name, (high - low) / F.nullif(extent.cast("double"), F.lit(0.0))).where(F.col(name) >= least)
