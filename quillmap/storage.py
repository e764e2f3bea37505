"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session, whose executors share the driver's disk, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"{tempfile.gettempdir()}/checkpoints/quillmap"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _own[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing needs any more."""
    path = getattr(df, "_table_path", None)
    spark = _own.pop(path, None)
    if spark is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
        pass


@atexit.register
def _forget_all() -> None:
    while _own:
        path, spark = _own.popitem()
        _delete(spark, path)
