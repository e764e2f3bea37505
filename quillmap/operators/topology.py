"""Open ends of boundary networks, classed by how far and in which direction the nearest line lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import end_direction, segments

CONNECTED, SNAP, REVIEW, REACH = 1.5, 5.0, 10.0, 50.0
ANGLE, APART = 30.0, 2.0


def end_points(lines: DataFrame) -> DataFrame:
    """Both ends of each polyline with their outward directions. lines: image_id, line_id, level, points."""
    side = lambda start: F.struct(F.lit("start" if start else "end").alias("side"), F.element_at("points", 1 if start else -1).alias("p"), end_direction(F.col("points"), start).alias("d"))
    ends = lines.where(F.size("points") >= 2).select("image_id", "line_id", "level", F.explode(F.array(side(True), side(False))).alias("e"))
    return ends.select("image_id", "line_id", "level", "e.side", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"), F.col("e.d.x").alias("dx"), F.col("e.d.y").alias("dy"))


def gaps(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Status of every end: connected, snappable, review, ambiguous or open, with its nearest candidate.

    Candidates are the nearest points of the other lines' segments within reach, found through buckets, and of the
    frame (image_id, x_min, y_min, x_max, y_max). An end of level 1 that meets level 2 only is for review. Both joins are
    merges: no table goes through the driver, however small it looks.
    """
    ends = end_points(lines)
    cell = lambda v: F.floor(v / REACH)
    seg = lines.select("image_id", F.col("line_id").alias("to_line"), F.col("level").alias("to_level"), F.explode(segments(F.col("points"))).alias("s"))
    lo, hi = lambda a, b: cell(F.least(a, b)) - 1, lambda a, b: cell(F.greatest(a, b)) + 1
    seg = seg.withColumn("i", F.explode(F.sequence(lo(F.col("s.a.x"), F.col("s.b.x")), hi(F.col("s.a.x"), F.col("s.b.x"))))).withColumn("j", F.explode(F.sequence(lo(F.col("s.a.y"), F.col("s.b.y")), hi(F.col("s.a.y"), F.col("s.b.y")))))
    near = ends.withColumns({"i": cell(F.col("x")), "j": cell(F.col("y"))}).join(seg.hint("merge"), ["image_id", "i", "j"]).where("line_id != to_line")
    ux, uy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    t = F.coalesce(((F.col("x") - F.col("s.a.x")) * ux + (F.col("y") - F.col("s.a.y")) * uy) / F.nullif(ux * ux + uy * uy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    near = near.withColumns({"tx": F.col("s.a.x") + t * ux, "ty": F.col("s.a.y") + t * uy})
    by_frame = ends.join(frames.hint("merge"), "image_id")
    walls = [("x_min", True), ("x_max", True), ("y_min", False), ("y_max", False)]
    hits = F.array(*[F.struct((F.col(c).cast("double") if is_x else F.col("x")).alias("tx"), (F.col("y") if is_x else F.col(c).cast("double")).alias("ty")) for c, is_x in walls])
    by_frame = by_frame.withColumn("h", F.explode(hits)).select(*ends.columns, F.lit(-1).cast("long").alias("to_line"), F.lit(0).alias("to_level"), "h.tx", "h.ty")
    cand = near.select(*ends.columns, F.col("to_line").cast("long").alias("to_line"), F.col("to_level").cast("int").alias("to_level"), "tx", "ty").unionByName(by_frame)
    d = F.sqrt((F.col("tx") - F.col("x")) ** 2 + (F.col("ty") - F.col("y")) ** 2)
    # Without a direction of either there is no angle; the least and greatest of a null and a number would be the number.
    turn = (F.col("dx") * (F.col("tx") - F.col("x")) + F.col("dy") * (F.col("ty") - F.col("y"))) / F.nullif(F.col("distance"), F.lit(0.0))
    angle = F.when(turn.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), turn)))))
    # An end without a candidate has one at no distance, which comes last.
    none = ends.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("to_line", "long"), ("to_level", "int"), ("tx", "double"), ("ty", "double"))])
    cand = cand.unionByName(none).withColumn("distance", d).withColumn("angle", angle)
    # One candidate for each other line: its nearest point.
    per_line = cand.groupBy(*ends.columns, "to_line").agg(F.min(F.struct("distance", "to_level", "angle", "tx", "ty")).alias("c")).select(*ends.columns, "to_line", "c.*")
    by = Window.partitionBy(*ends.columns).orderBy(F.asc_nulls_last("distance"), "to_line")
    ranked = per_line.withColumn("r", F.row_number().over(by)).withColumn("second", F.lead("distance").over(by)).withColumn("within", F.count_if(F.col("distance") <= REVIEW).over(Window.partitionBy(*ends.columns)))
    ranked = ranked.withColumn("own", F.count_if((F.col("distance") <= SNAP) & ((F.col("to_level") == F.col("level")) | (F.col("to_line") == -1))).over(Window.partitionBy(*ends.columns)))
    best = ranked.where("r = 1").drop("r")
    only_other = (F.col("level") == 1) & (F.col("own") == 0)
    status = (
        F.when(F.col("distance").isNull() | (F.col("distance") > REVIEW), "open")
        .when((F.col("distance") <= SNAP) & only_other, "review")
        .when(F.col("distance") <= CONNECTED, "connected")
        .when(F.col("distance") > SNAP, "review")
        .when(F.coalesce(F.col("second") - F.col("distance") < APART, F.lit(False)), "ambiguous")
        .when(F.coalesce(F.col("angle") <= ANGLE, F.lit(False)), "snappable")
        .otherwise("review")
    )
    return best.select("image_id", "line_id", "level", "side", "x", "y", status.alias("status"), "to_line", "to_level", "distance", "angle", "tx", "ty", F.coalesce("within", F.lit(0)).alias("candidates"))
