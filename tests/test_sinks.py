"""The feature collection is one valid file, and a failed write leaves the old one."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillmap.sources.sinks import write_feature_collection


def features(spark, n, parts=3):
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("coordinates")).alias("geometry"), F.struct("id").alias("properties")))
    return spark.range(0, n, 1, parts).select("id", f.alias("value"))


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_one_collection_in_order(spark, tmp_path, n):
    path = f"{tmp_path}/gaps.geojson"
    assert write_feature_collection(features(spark, n), path, ["id"]) == n
    held = json.loads(open(path).read())
    assert held["type"] == "FeatureCollection" and [f["properties"]["id"] for f in held["features"]] == list(range(n))
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["gaps.geojson"]
    assert write_feature_collection(features(spark, 2), path) == 2
    assert len(json.loads(open(path).read())["features"]) == 2


def test_a_failed_write_leaves_the_old_file(spark, tmp_path):
    path = f"{tmp_path}/gaps.geojson"
    write_feature_collection(features(spark, 3), path)
    before = open(path).read()
    bad = features(spark, 9).withColumn("value", F.when(F.col("id") < 5, F.col("value")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        write_feature_collection(bad, path)
    assert open(path).read() == before
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["gaps.geojson"]


def test_line_breaks_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([('{"a":\n1}',), (None,), ('{"a":",\\n"}',)], "value string").coalesce(1)
    assert write_feature_collection(rows, f"{tmp_path}/x.json") == 2
    assert [f["a"] for f in json.loads(open(f"{tmp_path}/x.json").read())["features"]] == [1, ",\n"]
