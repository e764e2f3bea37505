"""Writers of annotation documents, control points, label files, patches, reports and gap features."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalised


def annotation_documents(images: DataFrame, shapes: DataFrame, version: str = "5.0.1", digits: int | None = None, flags: Column | None = None) -> DataFrame:
    """(image_id, json): one document for each image, its shapes in the order of shape_idx; images without shapes get none."""
    value = (lambda v: F.round(v, digits)) if digits is not None else (lambda v: v)
    pair = lambda p: F.array(value(p["x"]), value(p["y"]))
    shape = F.struct("label", F.transform("points", pair).alias("points"), "group_id", F.coalesce("description", F.lit("")).alias("description"), "shape_type", F.coalesce("flags", F.create_map().cast("map<string,string>")).alias("flags"))
    lists = shapes.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shape_idx", shape.alias("s"))), lambda a, b: a["shape_idx"] - b["shape_idx"]), lambda x: x["s"]).alias("shapes"))
    doc = F.struct(
        F.lit(version).alias("version"),
        (flags if flags is not None else F.coalesce("flags", F.create_map().cast("map<string,string>"))).alias("flags"),
        F.coalesce("shapes", F.array().cast(lists.schema["shapes"].dataType)).alias("shapes"),
        F.col("image_path").alias("imagePath"), F.lit(None).cast("string").alias("imageData"), F.col("height").alias("imageHeight"), F.col("width").alias("imageWidth"),
    )
    return images.join(lists, "image_id", "left").select("image_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def write_annotations(documents: DataFrame, path: str) -> None:
    """Documents as text, one line each, in a folder for each image."""
    documents.select("image_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("image_id").text(path)


def control_point_rows(points: DataFrame, model: dict | None = None) -> DataFrame:
    """Rows of a control-point file: y negated; residuals 0, or those of a fitted transform."""
    zero = F.lit(0.0)
    res = [zero, zero, zero]
    if model:
        from ..operators.fit import plane_value

        dx, dy = (plane_value(model, F.col("lon"), F.col("lat"), k) - F.col(c) for k, c in enumerate(("pixel_x", "pixel_y")))
        res = [dx, -dy, F.sqrt(dx * dx + dy * dy)]
    return points.select(F.col("lon").alias("mapX"), F.col("lat").alias("mapY"), F.col("pixel_x").alias("sourceX"), (-F.col("pixel_y")).alias("sourceY"), F.lit(1).alias("enable"), *[r.alias(n) for r, n in zip(res, ("dX", "dY", "residual"), strict=True)])


def write_control_points(points: DataFrame, path: str, model: dict | None = None) -> None:
    control_point_rows(points, model).write.mode("overwrite").csv(path, header=True)


def yolo_lines(shapes: DataFrame, images: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(image_id, value): `class x1 y1 x2 y2 ...` in shares of the image for each outline; unknown labels are dropped."""
    cls = F.create_map(*[F.lit(v) for kv in classes.items() for v in kv])[F.col("label")]
    rows = shapes.join(images.select("image_id", "width", "height"), "image_id").withColumn("cls", cls).where("cls is not null")
    pts = normalised(F.col("points"), F.col("width"), F.col("height"))
    flat = F.flatten(F.transform(pts, lambda p: F.array(F.format_string("%.6f", p["x"]), F.format_string("%.6f", p["y"]))))
    return rows.select("image_id", F.concat_ws(" ", F.col("cls").cast("string"), F.array_join(flat, " ")).alias("value"))


def dataset_config(classes: dict[str, int], root: str) -> str:
    names = "\n".join(f"  {v}: {k}" for k, v in sorted(classes.items(), key=lambda kv: kv[1]))
    return f"path: {root}\ntrain: images\nval: images\nnames:\n{names}\n"


def coordinate_report(lines: DataFrame) -> DataFrame:
    """(image_id, value): one line of text for each polyline."""
    pts = F.array_join(F.transform("points", lambda p: F.format_string("(%.1f, %.1f)", p["x"], p["y"])), " ")
    return lines.select("image_id", F.concat(F.col("label"), F.lit(": "), pts).alias("value"))


def write_patches(tiles: DataFrame, path: str) -> None:
    """Patches as Parquet under their image, named {image}_pRR_CC."""
    tiles.withColumn("patch", F.format_string("%s_p%02d_%02d", "image_id", "row", "col")).write.mode("overwrite").partitionBy("image_id").parquet(path)


def summary(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): counts and total length of each label."""
    from ..functions.geometry import arc_length

    per = lines.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(arc_length(F.col("points"))).alias("length"))
    return per.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("label", "n", "length")))).alias("json"))


def sorted_shapes(shapes: DataFrame, ranks: dict[str, int], by_length: bool = False) -> DataFrame:
    """shapes renumbered by label rank (length first among equals if asked), top and left; `changed` marks images whose
    order differs, so that a dry run can count them and a rewrite can leave the others alone. Empty shapes sort by 0, 0."""
    from pyspark.sql import Window

    from ..functions.geometry import arc_length, bbox
    from ..operators.ordered import sort_shapes

    rank = F.coalesce(F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv])[F.col("label")], F.lit(max(ranks.values(), default=-1) + 1))
    box = bbox(F.col("points"))
    out = sort_shapes(shapes, ["image_id"], rank, (F.coalesce(box["y_min"], F.lit(0.0)), F.coalesce(box["x_min"], F.lit(0.0))), "shape_idx", arc_length(F.col("points")) if by_length else None)
    moved = F.max(F.col("position") != F.col("shape_idx")).over(Window.partitionBy("image_id"))
    return out.withColumn("changed", moved).withColumn("shape_idx", F.col("position").cast("int")).drop("position")


def gap_features(gaps: DataFrame) -> DataFrame:
    """(value): GeoJSON point features of the ends that are not connected."""
    props = F.struct(*[F.col(c) for c in gaps.columns if c not in ("x", "y")])
    geo = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return gaps.where("status != 'connected'").select(F.to_json(F.struct(F.lit("Feature").alias("type"), geo.alias("geometry"), props.alias("properties"))).alias("value"))


def write_feature_collection(features: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Features (value: GeoJSON text) as one FeatureCollection file at `path`; returns how many.

    Tasks write the features as parts beside the target, in the given order if any. The file system's own streams put the
    parts behind each other, the whole is counted, and takes the target's name in one step. Whatever fails before that
    leaves an older file as it was, and nothing beside it. Null values are passed over.
    """
    spark, between = features.sparkSession, ",\n"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    target = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path))
    beside = lambda name: jvm.org.apache.hadoop.fs.Path(target.getParent(), f"{target.getName()}.{uuid.uuid4().hex}.{name}")
    parts, staged = beside("parts"), beside("staged")
    try:
        rows = (features.orderBy(*order) if order else features).where("value IS NOT NULL")
        # A feature is one line; in JSON a line break is no more than a space.
        rows.select(F.translate("value", "\r\n", "  ").alias("value")).write.option("lineSep", between).text(parts.toString())
        files = sorted((f for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
        n = spark.read.option("lineSep", between).text(parts.toString()).count()
        out = fs.create(staged, True)
        try:
            out.write(bytearray(b'{"type":"FeatureCollection","features":[\n'))
            for k, f in enumerate(files):
                part = fs.open(f.getPath())
                try:
                    # Nothing stands between the last feature and the end.
                    held = jvm.org.apache.commons.io.input.BoundedInputStream(part, f.getLen() - len(between) * (k == len(files) - 1))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 16, False)
                finally:
                    part.close()
            out.write(bytearray(b"\n]}\n"))
        finally:
            out.close()
        written = spark.read.text(staged.toString()).count()
        if written != max(n, 1) + 2:
            raise OSError(f"{written} lines instead of {n + 2} were written for {path}")
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, how)
        return n
    finally:
        for left in (parts, staged):
            fs.delete(left, True)
