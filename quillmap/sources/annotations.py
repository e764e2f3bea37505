"""Readers of annotation documents, images, control points, anchors, masks and vector layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.geometry import from_pairs
from ..functions.text import anchors
from ..operators.metrics import colour_class

#: Endings of image files.
SCANS = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[tT][iI][fF],[tT][iI][fF][fF],[bB][mM][pP]}"
DRAWN = "*.{[pP][nN][gG],[pP][gG][mM],[pP][pP][mM]}"
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def read_annotations(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, shapes, rejected) of the annotation documents under a path.

    One document a file; names that begin with `._` are passed over; files that are no JSON object, or hold no list of
    shapes, come back as rejected (image_id, path) so that drops can be counted.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive).text(path)
    raw = raw.select(F.col("value"), F.col("_metadata.file_path").alias("path")).where(~file_name(F.col("path")).startswith("._"))
    doc = raw.select(stem(F.col("path")).alias("image_id"), "path", F.from_json("value", schema.ANNOTATION_JSON).alias("doc"))
    good = doc.where(F.col("doc.shapes").isNotNull())
    images = good.select("image_id", F.col("doc.imagePath").alias("image_path"), F.col("doc.imageWidth").alias("width"), F.col("doc.imageHeight").alias("height"), "doc.version", "doc.flags")
    shapes = good.select("image_id", F.posexplode("doc.shapes").alias("shape_idx", "s"))
    shapes = shapes.select("image_id", "shape_idx", "s.label", "s.shape_type", from_pairs(F.col("s.points")).alias("points"), "s.group_id", "s.description", "s.flags")
    return images, shapes, doc.where(F.col("doc.shapes").isNull()).select("image_id", "path")


def list_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, image_id, length) of image files by their ending in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length")
    files = files.withColumns({"name": file_name(F.col("path")), "image_id": stem(F.col("path"))})
    return files.where(ending(F.col("path")).isin(*IMAGE_ENDINGS) & ~F.col("name").startswith("._"))


def read_images(spark: SparkSession, path: str, recursive: bool = False, strict: bool = False) -> DataFrame:
    """(image_id, path, width, height, channels, data): images decoded to bytes row by row, colours as red, green, blue.

    JPEG, TIFF and BMP go through Spark's image source, PNG, PGM and PPM through Arrow batches. Files that cannot be
    decoded are dropped, or fail the read if strict.
    """
    from .pixels import decode, red_first

    kind = "image_id string, path string, width int, height int, channels int, data binary"
    # Each reader lists its own endings, so that no file is read to be dropped.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", DRAWN).load(path)
    own = files.select(stem(F.col("path")).alias("image_id"), "path", "content")
    scans = spark.read.format("image").option("recursiveFileLookup", recursive).option("pathGlobFilter", SCANS).load(path).select("image.*")
    good = F.when(F.col("height") >= 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("cannot decode "), "origin")) if strict else F.lit(None).cast("int"))
    scans = scans.select(stem(F.col("origin")).alias("image_id"), F.col("origin").alias("path"), "width", good.alias("height"), F.col("nChannels").alias("channels"), "data").where("height is not null")
    return own.mapInArrow(decode(strict), kind).where(F.col("width").isNotNull()).unionByName(scans.mapInArrow(red_first, kind))


def mask_pixels(images: DataFrame, colour: bool = True) -> DataFrame:
    """Foreground pixels (image_id, x, y, cls) of decoded masks: colour masks by their colours, others by value."""
    from .pixels import foreground

    px = images.select("image_id", "width", "channels", "data").mapInArrow(foreground, "image_id string, x int, y int, r int, g int, b int")
    cls = colour_class(F.col("r"), F.col("g"), F.col("b")) if colour else F.col("r")
    return px.select("image_id", "x", "y", cls.cast("int").alias("cls")).where("cls > 0")


def read_control_points(spark: SparkSession, path: str, least: int = 6) -> DataFrame:
    """Enabled control points as (lon, lat, pixel_x, pixel_y); lines that begin with # are comments.

    Raises ValueError if a column is missing or fewer than `least` points are enabled. Pixel y is the negated sourceY.
    """
    raw = spark.read.csv(path, header=True, comment="#")
    needed = {"mapX", "mapY", "sourceX", "sourceY", "enable"}
    if missing := needed - set(raw.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    num = lambda c: F.col(c).cast("double")
    out = raw.where(F.col("enable").cast("int") == 1).select(num("mapX").alias("lon"), num("mapY").alias("lat"), num("sourceX").alias("pixel_x"), (-num("sourceY")).alias("pixel_y"))
    if (n := out.count()) < least:
        raise ValueError(f"{n} enabled control points; at least {least} are needed")
    return out


def read_anchors(spark: SparkSession, specs: dict[str, str]) -> DataFrame:
    """(image_id, v, h): maps from line index to degree, of strings like `v:4=92,5=96;h:2=52`."""
    rows = spark.createDataFrame(list(specs.items()), "image_id string, spec string")
    return rows.select("image_id", anchors(F.col("spec"), "v").alias("v"), anchors(F.col("spec"), "h").alias("h"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and line features of GeoJSON files as (feature_id, properties, geometry_type, rings).

    rings are arrays of points; polygons of a multipolygon lie one after the other. Null geometries are dropped.
    """
    raw = spark.read.option("wholetext", True).text(path)
    doc = raw.select(F.explode(F.from_json("value", "features array<struct<properties map<string,string>, geometry struct<type string, coordinates string>>>")["features"]).alias("f"))
    doc = doc.where("f.geometry.coordinates is not null").select(F.monotonically_increasing_id().alias("feature_id"), "f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"))
    line = F.array(F.from_json("c", "array<array<double>>"))
    rings = F.when(F.col("geometry_type") == "LineString", line).when(F.col("geometry_type").isin("Polygon", "MultiLineString"), F.from_json("c", "array<array<array<double>>>")).when(F.col("geometry_type") == "MultiPolygon", F.flatten(F.from_json("c", "array<array<array<array<double>>>>")))
    return doc.where(rings.isNotNull()).select("feature_id", "properties", "geometry_type", F.transform(rings, from_pairs).alias("rings"))
