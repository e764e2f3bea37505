"""Decoding of PNG, PGM and PPM images in Arrow batches, and the channels of those that Spark's image source decodes."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def read_png(content: bytes) -> np.ndarray:
    """Rows x columns x channels (1 or 3) of an 8-bit, not interlaced PNG: grey, colour or palette, alpha left out."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlace")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, (width + 1) * channels), np.int64)
    c = channels
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y, c:]
        if kind == 0:
            out[y + 1, c:] = line
        elif kind == 2:
            out[y + 1, c:] = (line + up) & 255
        elif kind == 1:
            out[y + 1, c:] = (line.reshape(-1, c).cumsum(axis=0) & 255).reshape(-1)
        else:
            row = out[y + 1]
            for x in range(c, len(row)):
                a, b, d = int(row[x - c]), int(out[y, x]), int(out[y, x - c])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row[x] = (int(line[x - c]) + guess) & 255
    img = out[1:, c:].astype(np.uint8).reshape(height, width, c)
    if colour == 3:
        return palette[img[:, :, 0]]
    return img[:, :, : 3 if colour in (2, 6) else 1]


def write_png(img: np.ndarray) -> bytes:
    """An 8-bit PNG of rows x columns (grey) or rows x columns x 3."""
    img = np.ascontiguousarray(img, np.uint8)
    h, w = img.shape[:2]
    raw = np.zeros((h, 1 + img.size // max(h, 1)), np.uint8)
    raw[:, 1:] = img.reshape(h, -1)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def read_pnm(content: bytes) -> np.ndarray:
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", content)
    if not m or int(m[4]) > 255:
        raise ValueError("no binary PGM or PPM of 8 bits")
    c = 3 if m[1] == b"P6" else 1
    w, h = int(m[2]), int(m[3])
    return np.frombuffer(content, np.uint8, w * h * c, m.end()).reshape(h, w, c)


def read_image(content: bytes) -> np.ndarray:
    return read_png(content) if content[:4] == b"\x89PNG" else read_pnm(content)


def decode(strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    img = read_image(batch.column("content")[k].as_py())
                    cells = [img.shape[1], img.shape[0], img.shape[2], img.tobytes()]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error, UnboundLocalError):
                    if strict:
                        raise
                    cells = [None] * 4
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column("image_id").slice(k, 1), batch.column("path").slice(k, 1), *[pa.array([v], t) for v, t in zip(cells, kinds, strict=True)]], ["image_id", "path", "width", "height", "channels", "data"])

    return run


def red_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Images whose pixels are grey, or blue, green, red and maybe alpha, as grey or as red, green, blue."""
    for batch in batches:
        for k in range(batch.num_rows):
            c = batch.column("channels")[k].as_py()
            img = np.frombuffer(batch.column("data")[k].as_buffer(), np.uint8).reshape(-1, c)
            img = img[:, :1] if c < 3 else img[:, 2::-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(k, 1) for n in ("image_id", "path", "width", "height")], pa.array([img.shape[1]], pa.int32()), pa.array([img.tobytes()], pa.binary())], ["image_id", "path", "width", "height", "channels", "data"])


def foreground(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            w, c = batch.column("width")[k].as_py(), batch.column("channels")[k].as_py()
            img = np.frombuffer(batch.column("data")[k].as_py(), np.uint8).reshape(-1, w, c)
            y, x = np.nonzero(img.any(axis=2))
            rgb = img[y, x] if c == 3 else np.repeat(img[y, x], 3, axis=1)
            ids = pa.array([batch.column("image_id")[k].as_py()] * len(x), pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(x, pa.int32()), pa.array(y, pa.int32()), *[pa.array(rgb[:, j], pa.int32()) for j in range(3)]], ["image_id", "x", "y", "r", "g", "b"])
