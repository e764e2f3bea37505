"""Schemas of the map-annotation tables."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
POINTS = f"array<{POINT}>"

#: One annotation document as it is stored.
ANNOTATION_JSON = (
    "version string, flags map<string,string>, imagePath string, imageData string, imageHeight int, imageWidth int, description string, "
    "shapes array<struct<label:string,points:array<array<double>>,group_id:int,description:string,shape_type:string,flags:map<string,string>,mask:string>>"
)
IMAGES = "image_id string, image_path string, width int, height int, version string, flags map<string,string>"
SHAPES = f"image_id string, shape_idx int, label string, shape_type string, points {POINTS}, group_id int, description string, flags map<string,string>"
GRID_LINES = f"image_id string, line_id int, kind string, points {POINTS}, pos double, span double"
GCP_CSV = "mapX double, mapY double, sourceX double, sourceY double, enable int, dX double, dY double, residual double"
GCPS = "image_id string, lon double, lat double, pixel_x double, pixel_y double"
OCR_ITEMS = "image_id string, text string, cx double, cy double, w double, h double, conf double"
PIXELS = "image_id string, x int, y int, cls int"
TILES = "image_id string, row int, col int, x0 int, y0 int"
POLYLINES = f"image_id string, line_id int, points {POINTS}"

#: Labels of shapes and the classes of their pixels, for grids and for boundaries.
GRID_CLASSES = {"vertical_line": 1, "horizontal_arc": 2, "splitter": 3}
BOUNDARY_CLASSES = {"boundary": 1, "boundary_1": 1, "boundary_2": 2}
#: Red, green, blue of each class in a colour mask.
CLASS_COLOURS = {1: (255, 0, 0), 2: (0, 255, 0), 3: (255, 165, 0)}
