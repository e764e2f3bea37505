"""Shapefiles that the test writes itself read back to equal rings; bad records are named."""

import struct

import pytest

from quillmap.sources.shapefile import read_shapefile


def record(kind, parts):
    points = [p for part in parts for p in part]
    if kind in (1, 11):
        return struct.pack("<i2d", kind, *points[0])
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    box = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)]
    body = struct.pack(f"<i4d2i{len(starts)}i", kind, *box, len(parts), len(points), *starts)
    return body + b"".join(struct.pack("<2d", *p) for p in points)


def write(folder, bodies, rows, index=True, encoding="utf-8", name="a"):
    header = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    shp, shx = b"", b""
    for k, body in enumerate(bodies):
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(body) // 2)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
    (folder / f"{name}.shp").write_bytes(header((100 + len(shp)) // 2) + shp)
    if index:
        (folder / f"{name}.shx").write_bytes(header((100 + len(shx)) // 2) + shx)
    fields = [("NAME_CH", 20), ("LEV1_CH", 12)]
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, len(rows), 32 + 32 * len(fields) + 1, 1 + sum(n for _, n in fields))
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size, 0]) + bytes(14) for n, size in fields) + b"\r"
    (folder / f"{name}.dbf").write_bytes(head + b"".join((b"*" if r is None else b" ") + b"".join((v.encode(encoding)).ljust(size) for v, (_, size) in zip(r or ("", ""), fields, strict=True)) for r in rows))


SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]


def rings(r):
    return [[tuple(p) for p in ring] for ring in r["rings"]]


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_rings_and_attributes_read_back(spark, tmp_path, index, encoding):
    shapes = [(5, [SQUARE, HOLE]), (3, [SQUARE[:3]]), (1, [[(7.5, -8.25)]]), (15, [SQUARE])]
    bodies = [record(*s) for s in shapes[:3]] + [record(*shapes[3]) + struct.pack("<7d", 0, 1, *[0.5] * 5)] + [struct.pack("<i", 0)]
    names = [("河南", "豫"), ("山东", "鲁"), ("p", ""), None]
    write(tmp_path, bodies, names, index, encoding)
    features, rejected = read_shapefile(spark, str(tmp_path), encoding, split_records=2)
    got = {r["record"]: r for r in features.collect()}
    assert {k: rings(r) for k, r in got.items()} == {k: s[1] for k, s in enumerate(shapes)}
    assert [got[k]["geometry_type"] for k in range(4)] == ["Polygon", "LineString", "Point", "Polygon"]
    assert [got[k]["properties"] for k in range(4)] == [{"NAME_CH": "河南", "LEV1_CH": "豫"}, {"NAME_CH": "山东", "LEV1_CH": "鲁"}, {"NAME_CH": "p", "LEV1_CH": None}, None]
    assert rejected.count() == 0
    assert features.rdd.getNumPartitions() == (3 if index else 1)


def test_bad_records_are_named_and_the_rest_stays(spark, tmp_path):
    good = record(5, [SQUARE])
    turned = bytearray(record(5, [SQUARE, HOLE]))
    struct.pack_into("<i", turned, 44, 3)
    endless = record(5, [[(0.0, float("nan"))] * 4])
    write(tmp_path, [good, good[:60], struct.pack("<i", 99), bytes(turned), endless, good], [("x", "y")] * 6)
    features, rejected = read_shapefile(spark, str(tmp_path / "a.shp"), split_records=4)
    assert sorted(r["record"] for r in features.collect()) == [0, 5]
    assert {r["record"]: r["error"].split()[0] for r in rejected.collect()} == {1: "the", 2: "unknown", 3: "parts", 4: "a"}
    data = (tmp_path / "a.shp").read_bytes()
    (tmp_path / "a.shp").write_bytes(data[:-20])
    assert sorted(r["record"] for r in rejected.collect()) == [1, 2, 3, 4, 5]


def test_columns_are_pruned_and_folders_read(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path, [record(5, [SQUARE])] * 3, [("x", "y")] * 3, name=name)
    (tmp_path / "b.dbf").unlink()
    features, _ = read_shapefile(spark, f"file://{tmp_path}", columns=["record", "rings"])
    assert features.columns == ["record", "rings"] and features.count() == 6
    assert {r["properties"] is None for r in read_shapefile(spark, str(tmp_path))[0].collect()} == {True, False}
    with pytest.raises(Exception, match="no shapefile"):
        read_shapefile(spark, str(tmp_path / "a.dbf"))[0].count()
