"""Colour spaces as column expressions, in the scale of 8-bit images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to XYZ, the D65 white point, and the break of the cube root.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
BREAK = 0.008856


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """L* from 0 to 255, a* and b* around 0, of sRGB bytes."""
    linear = lambda v: F.when(v / 255 <= 0.04045, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4)))
    rgb = [linear(c.cast("double")) for c in (r, g, b)]
    xyz = [sum((m * c for m, c in zip(row[1:], rgb[1:], strict=True)), row[0] * rgb[0]) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    f = lambda t: F.when(t > BREAK, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    light = F.when(xyz[1] > BREAK, 116 * F.cbrt(xyz[1]) - 16).otherwise(903.3 * xyz[1])
    return light * 255 / 100, 500 * (f(xyz[0]) - f(xyz[1])), 200 * (f(xyz[1]) - f(xyz[2]))


def is_band(r: Column, g: Column, b: Column, least_a: float = 10.0) -> Column:
    """Magenta and purple of boundary bands: a* over least_a, lightness between 60 and 230."""
    light, a, _ = lab(r, g, b)
    return (F.round(a) > least_a) & (F.round(light) > 60) & (F.round(light) < 230)


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")
