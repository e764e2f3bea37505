"""Repair of numbers that OCR has read from map margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each misread character stands for. No result is itself a key, so one translation does them all.
REPAIRS = {
    "O": "0", "Q": "0", "D": "0",
    "I": "1", "l": "1", "|": "1", "！": "1",
    "Z": "2", "S": "5", "B": "8", "G": "6", "g": "9",
    "A": "4", "T": "7", "Y": "4", "b": "6",
    "。": ".", "，": ".", ",": ".", " ": "",
}
#: Degrees that count as longitudes and latitudes, inclusive.
LON_RANGE, LAT_RANGE = (60.0, 150.0), (10.0, 61.0)
BLANKS = " \t\n\r\x0b\x0c"


def repaired(text: Column) -> Column:
    """Outer white space stripped, misread characters replaced, blanks dropped."""
    kept = {k: v for k, v in REPAIRS.items() if v}
    dropped = "".join(k for k, v in REPAIRS.items() if not v)
    return F.translate(F.trim(text, F.lit(BLANKS)), "".join(kept) + dropped, "".join(kept.values()))


def numbers(text: Column) -> Column:
    """All decimal numbers in a text as doubles, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: n.cast("double"))


def degree_candidates(text: Column, axis: str) -> Column:
    low, high = LON_RANGE if axis == "lon" else LAT_RANGE
    return F.filter(numbers(repaired(text)), lambda v: v.between(low, high))


def sheet_prefix(name: Column) -> Column:
    """Volume and sheet number at the start of a file name, or null."""
    found = F.regexp_extract(name, r"^([0-9]+-[0-9]+)", 1)
    return F.when(found != "", found)


def anchors(spec: Column, axis: str) -> Column:
    """`v:4=92,5=96;h:2=52` to the map of one axis; other prefixes are passed over."""
    part = F.filter(F.split(spec, ";"), lambda s: F.trim(s).startswith(f"{axis}:"))
    pairs = F.filter(F.split(F.substring(F.trim(F.get(part, F.lit(0))), 3, 1 << 20), ","), lambda s: s.contains("="))
    entry = lambda s: F.struct(F.trim(F.get(F.split(s, "="), F.lit(0))).cast("int").alias("index"), F.trim(F.get(F.split(s, "="), F.lit(1))).cast("double").alias("degree"))
    return F.map_from_entries(F.transform(F.coalesce(pairs, F.array().cast("array<string>")), entry))
