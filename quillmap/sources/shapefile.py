"""Shapefiles as a Python data source: geometry (.shp), its index (.shx) and attributes (.dbf), split by record.

The index holds the place of every record, so a file is cut into splits of so many records, and a task reads the stretch
of its split and decodes the columns that the schema asks for. A file without an index is one split that is walked through.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, record long, geometry_type string, rings array<array<struct<x:double,y:double>>>, properties map<string,string>, error string"
#: Records of one split, and of one Arrow batch.
SPLIT_RECORDS, BATCH_RECORDS = 10_000, 512
#: Codes of shapes, by what they are without z and m, and sizes of the format's headers.
KINDS = {0: None, 1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
FILE_HEADER, INDEX_ENTRY, RECORD_HEADER, FIELD = 100, 8, 8, 32
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_TYPES = {"path": pa.string(), "record": pa.int64(), "geometry_type": pa.string(), "rings": pa.list_(pa.list_(_POINT)), "properties": pa.map_(pa.string(), pa.string()), "error": pa.string()}


def _opened(path: str):
    """(file system, path within it), for a local path or any address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sibling(path: str, ending: str) -> list[str]:
    return [path[:-4] + e for e in (ending, ending.upper())]


def _existing(system, path: str, ending: str) -> str | None:
    from pyarrow import fs

    return next((i.path for i in system.get_file_info(_sibling(path, ending)) if i.type == fs.FileType.File), None)


def geometry(body: bytes) -> tuple[str | None, list[np.ndarray]]:
    """(kind, parts) of a record's content; raises ValueError if it does not hold what it says."""
    if len(body) < 4:
        raise ValueError("the record is cut short")
    code = struct.unpack_from("<i", body)[0]
    kind = KINDS.get(code % 10, "") if 0 <= code < 30 else ""
    if kind == "":
        raise ValueError(f"unknown shape {code}")
    if kind is None:
        return None, []
    if kind in ("Point", "MultiPoint"):
        n = 1 if kind == "Point" else struct.unpack_from("<i", body, 36)[0] if len(body) >= 40 else -1
        at = 4 if kind == "Point" else 40
        starts = np.zeros(1, np.int64)
    else:
        m, n = struct.unpack_from("<ii", body, 36) if len(body) >= 44 else (-1, -1)
        at = 44 + 4 * m
        if m < 0 or at > len(body):
            raise ValueError("the record is cut short")
        starts = np.frombuffer(body, "<i4", m, 44).astype(np.int64)
    if n < 0 or at + 16 * n > len(body):
        raise ValueError("the record is cut short")
    if len(starts) and (starts[0] != 0 or (np.diff(starts) < 0).any() or starts[-1] > n):
        raise ValueError("parts are out of order")
    points = np.frombuffer(body, "<f8", 2 * n, at).reshape(-1, 2)
    if not np.isfinite(points).all():
        raise ValueError("a coordinate is not finite")
    return kind, np.split(points, starts[1:])


class Attributes:
    """The attribute table beside a shapefile: rows of fixed width, read by number."""

    def __init__(self, source, encoding: str):
        self.source, self.encoding = source, encoding
        head = source.read(32)
        self.rows, self.start, self.width = struct.unpack_from("<IHH", head, 4)
        fields, at = source.read(self.start - 32), 1
        self.fields: list[tuple[str, int, int]] = []
        for k in range(0, len(fields) - FIELD + 1, FIELD):
            if fields[k] == 0x0D:
                break
            size = fields[k + 16]
            self.fields.append((fields[k : k + 11].split(b"\0")[0].decode(encoding, "replace").strip(), at, size))
            at += size

    def read(self, first: int, last: int) -> list[list[tuple[str, str | None]] | None]:
        """Name and value of every field of rows first to last (excluded); None for rows that are not there or deleted."""
        self.source.seek(self.start + first * self.width)
        data = self.source.read(max(0, min(last, self.rows) - first) * self.width)
        out = []
        for k in range(last - first):
            row = data[k * self.width : (k + 1) * self.width]
            values = [(n, row[at : at + size].decode(self.encoding, "replace").strip(" \0") or None) for n, at, size in self.fields]
            out.append(values if len(row) == self.width and row[:1] != b"*" else None)
        return out


@dataclass
class Split(InputPartition):
    path: str
    first: int
    last: int | None


class ShapefileReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = schema.fieldNames()
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.records = int(options.get("splitRecords", SPLIT_RECORDS))

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True))] if info.type == fs.FileType.Directory else [path]
        files = sorted(f for f in files if f.lower().endswith(".shp") and not f.rpartition("/")[2].startswith("._"))
        if not files:
            raise FileNotFoundError(f"no shapefile at {self.path}")
        out = []
        for f in files:
            index = _existing(system, f, ".shx")
            n = (system.get_file_info(index).size - FILE_HEADER) // INDEX_ENTRY if index else None
            out += [Split(f, 0, None)] if n is None else [Split(f, k, min(n, k + self.records)) for k in range(0, n, self.records)]
        return out

    def _places(self, system, split: Split, size: int) -> Iterator[tuple[int, int, int]]:
        """(record, place, length) of the split's records, from the index or from record to record."""
        if split.last is not None:
            with system.open_input_file(_existing(system, split.path, ".shx")) as f:
                f.seek(FILE_HEADER + INDEX_ENTRY * split.first)
                entries = np.frombuffer(f.read(INDEX_ENTRY * (split.last - split.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
            yield from ((split.first + k, int(p) + RECORD_HEADER, int(n)) for k, (p, n) in enumerate(entries))
            return
        with system.open_input_file(split.path) as f:
            at, k = FILE_HEADER, 0
            while at + RECORD_HEADER <= size:
                f.seek(at)
                n = 2 * struct.unpack(">ii", f.read(RECORD_HEADER))[1]
                yield k, at + RECORD_HEADER, n
                at, k = at + RECORD_HEADER + max(n, 0), k + 1

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        table = _existing(system, partition.path, ".dbf") if "properties" in self.columns else None
        shapes = {"geometry_type", "rings", "error"} & {*self.columns}
        with system.open_input_file(partition.path) as f:
            size, waiting = f.size(), []
            attributes = Attributes(system.open_input_file(table), self.encoding) if table else None
            for record, at, length in self._places(system, partition, size):
                kind, parts, error = None, None, None
                if shapes:
                    try:
                        if length < 0 or at < FILE_HEADER or at + length > size:
                            raise ValueError("the record lies outside the file")
                        f.seek(at)
                        kind, parts = geometry(f.read(length))
                    except (ValueError, struct.error) as e:
                        error = str(e)
                waiting.append((record, kind, parts, error))
                if len(waiting) == BATCH_RECORDS:
                    yield self._batch(partition.path, waiting, attributes)
                    waiting = []
            if waiting:
                yield self._batch(partition.path, waiting, attributes)

    def _batch(self, path: str, rows: list, attributes: Attributes | None) -> pa.RecordBatch:
        values = {
            "path": lambda: [path] * len(rows),
            "record": lambda: [r[0] for r in rows],
            "geometry_type": lambda: [r[1] for r in rows],
            "rings": lambda: [None if r[1] is None else [[{"x": x, "y": y} for x, y in part.tolist()] for part in r[2]] for r in rows],
            "properties": lambda: attributes.read(rows[0][0], rows[-1][0] + 1) if attributes else [None] * len(rows),
            "error": lambda: [r[3] for r in rows],
        }
        return pa.RecordBatch.from_arrays([pa.array(values[c](), _TYPES[c]) for c in self.columns], self.columns)


class ShapefileSource(DataSource):
    """Format `shapefile`; options: encoding (of attributes, utf-8), splitRecords. A schema of fewer columns reads only those."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        if unknown := set(schema.fieldNames()) - set(_TYPES):
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return ShapefileReader(schema, self.options)


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8", split_records: int = SPLIT_RECORDS, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, rejected) of the shapefiles at a path, a file or a folder.

    features: path, record, properties, geometry_type, rings (of polygons and lines their parts, of points one part), or
    those of them that `columns` names; null shapes are dropped. rejected: path, record, error of records that are cut
    short, lie outside the file, have parts out of order, unknown shapes or coordinates that are not finite. Rows of the
    attribute table that are missing or deleted give null properties.
    """
    spark.dataSource.register(ShapefileSource)
    source = spark.read.format("shapefile").option("encoding", encoding).option("splitRecords", split_records)
    types = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    wanted = columns or ["path", "record", "properties", "geometry_type", "rings"]
    held = list(dict.fromkeys([*wanted, "geometry_type"]))
    features = source.schema(", ".join(f"{c} {types[c]}" for c in held)).load(path).where(F.col("geometry_type").isNotNull()).select(*wanted)
    rejected = source.schema(", ".join(f"{c} {types[c]}" for c in ("path", "record", "error"))).load(path).where(F.col("error").isNotNull())
    return features, rejected
