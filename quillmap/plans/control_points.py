"""End-to-end plans: annotations to control points, OCR items to anchors, geographic lines to annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import degree_candidates
from ..operators import fit, gcp, linework, overlay
from ..operators.cluster import dedup_fold
from ..operators.filters import TEXT_CONFIDENCE, confident
from ..operators.joins import greedy_match, inset_anti, point_in_box_anti
from ..operators.ordered import assign_degrees
from ..storage import materialise

#: Square degrees by which chosen regions and their provinces may differ.
DEDUP_GAP, MISMATCH = 100.0, 2.0
LON_REACH, LAT_REACH = 180.0, 160.0


def main_lines(shapes: DataFrame, dedup: bool = True) -> DataFrame:
    """Meridians and parallels outside insets, close ones merged, with line_id."""
    lines = gcp.grid_lines(shapes).withColumn("line_id", F.col("shape_idx"))
    flat = lines.select("image_id", "line_id", "kind", "points", "pos", "span", "box", "box.*")
    insets = flat.where("kind = 's'").select("image_id", "x_min", "x_max", "y_min", "y_max")
    kept = inset_anti(flat.where("kind != 's'"), insets, ["image_id"])
    return dedup_fold(kept, ["image_id", "kind"], F.col("pos"), F.col("span"), ["line_id"], DEDUP_GAP) if dedup else kept


def control_points(shapes: DataFrame, anchors: DataFrame, dedup: bool = True) -> DataFrame:
    """(image_id, lon, lat, pixel_x, pixel_y) from annotation shapes and anchors (image_id, v, h)."""
    lines = main_lines(shapes, dedup).join(anchors, "image_id")
    order = ["pos", "line_id"]
    v = assign_degrees(lines.where("kind = 'v'"), ["image_id"], order, F.col("v"))
    h = assign_degrees(lines.where("kind = 'h'"), ["image_id"], order, F.col("h"))
    return gcp.intersections(v, h, ["image_id"])


def ocr_anchors(items: DataFrame, lines: DataFrame, insets: DataFrame, axis: str, least: int = 2) -> DataFrame:
    """(image_id, index, degree): numbers read near line ends, matched one to one and made an arithmetic progression.

    items: image_id, text, cx, cy, conf; lines: image_id, index, pos along the strip. Items of low confidence and those in
    insets are dropped; `axis` is lon (matched by x) or lat (by y).
    """
    kept = point_in_box_anti(confident(items, "conf", TEXT_CONFIDENCE), insets, ["image_id"])
    cand = kept.withColumn("degree", F.explode(degree_candidates(F.col("text"), axis))).withColumn("pos_", F.col("cx" if axis == "lon" else "cy"))
    # Written, since the numbers of the candidates are looked up again.
    cand = materialise(cand.select("image_id", "degree", "pos_", F.monotonically_increasing_id().alias("cand_id")), "candidates")
    pairs = greedy_match(cand, lines.select("image_id", "index", "pos"), ["image_id"], "pos_", "pos", "cand_id", "index", LON_REACH if axis == "lon" else LAT_REACH)
    found = pairs.select("image_id", F.col("l_id").alias("cand_id"), F.col("r_id").alias("index")).join(cand, ["image_id", "cand_id"]).select("image_id", "index", "degree")
    return fit.progression_consensus(found, ["image_id"], "index", "degree", least)


def boundary_annotations(rings: DataFrame, name: str, provinces: list[str], group: str, model: dict, width: int, height: int, spacing: float, province_rings: DataFrame | None = None) -> DataFrame:
    """(label, points): outer outline (boundary_1) and inner borders (boundary_2) of chosen regions in pixels.

    rings: name and group columns and points of noded rings in degrees. Names are compared trimmed, and all must be
    there. Edges are joined into lines where two of them meet, then simplified, clipped and freed of short pieces. If
    the provinces' own rings are given, the chosen regions must cover them but for MISMATCH square degrees.
    """
    chosen = rings.where(F.trim(name).isin([p.strip() for p in provinces]))
    missing = {p.strip() for p in provinces} - {r[0] for r in chosen.select(F.trim(name)).distinct().limit(len(provinces) + 1).collect()}
    if missing:
        raise ValueError(f"no such regions: {', '.join(sorted(missing))}")
    if province_rings is not None and (off := linework.mismatch(chosen, province_rings)) > MISMATCH:
        raise ValueError(f"the regions and the provinces differ by {off:.3f} square degrees")
    outer, inner = linework.two_levels(linework.canonical_edges(chosen, [group]), group)
    parts = outer.withColumn("label", F.lit("boundary_1")).unionByName(inner.withColumn("label", F.lit("boundary_2")))
    lines = linework.geo_to_pixel(linework.merged(parts, ["label"]), model, spacing)
    return linework.clean(lines, ["label"], width, height)


def province_boundaries(provinces: DataFrame, prefectures: DataFrame, province: str, model: dict, width: int, height: int, spacing: float, unit: float = 1e-6) -> DataFrame:
    """(label, points): the borders of all provinces (boundary_1) and those of one province's prefectures inside it (boundary_2), in pixels.

    provinces: name, rings; prefectures: province, name, rings, in degrees and not noded; names are compared trimmed. Rows
    without rings are passed over, invalid rings count by parity. Raises ValueError if the province has no prefectures, is
    not there just once, or differs from the union of its prefectures by over MISMATCH square degrees.
    """
    held = lambda df: df.where(F.size("rings") > 0)
    chosen = held(prefectures.where(F.trim("province") == province.strip()))
    target = held(provinces.where(F.trim("name") == province.strip()))
    if chosen.isEmpty():
        raise ValueError(f"no prefectures of {province}")
    if (n := target.count()) != 1:
        raise ValueError(f"{n} provinces are called {province}")
    layers = target.select("rings", F.lit("x").alias("layer")).unionByName(chosen.select("rings", F.lit("y").alias("layer")))
    layers = layers.unionByName(held(provinces).select("rings", F.lit("all").alias("layer"))).withColumn("sheet", F.lit(0))
    edges = materialise(overlay.borders(layers, ["sheet"], unit), "borders")
    off = overlay.enclosed(overlay.outline(overlay.sides(edges.where("layer <> 'all'"), ["sheet"]), ["sheet"], "symmetric_difference", unit), ["sheet"]).first()
    if off and off["area"] > MISMATCH:
        raise ValueError(f"{province} and its prefectures differ by {off['area']:.3f} square degrees")
    of = lambda layer: edges.where(F.col("layer") == layer).select(*overlay.EDGE).distinct()
    level_1, level_2 = of("all"), of("y").subtract(of("x"))
    parts = level_1.withColumn("label", F.lit("boundary_1")).unionByName(level_2.withColumn("label", F.lit("boundary_2")))
    lines = linework.geo_to_pixel(linework.merged(overlay.as_points(parts, unit, "label"), ["label"]), model, spacing)
    return linework.clean_up(lines.select("label", "points"), ["label"], width, height)
