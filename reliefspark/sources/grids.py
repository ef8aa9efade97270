"""Height grids (16-bit, big or little endian) and PNG rasters, to and from cells; files come from Spark's binaryFile source.

Bytes are packed and unpacked by arrays within one tile; everything before and after is columns."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The stored value of a missing height.
NONE = -32768
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_grid(data: bytes, size: int, little: bool = False) -> np.ndarray:
    """(size, size), row 0 in the south. The file has a row more in the north and a column more in the east, both left out."""
    n = (size + 1) ** 2
    if len(data) < n * 2:
        raise ValueError(f"{len(data)} bytes, not {n * 2}")
    grid = np.frombuffer(data, "<i2" if little else ">i2", n).reshape(size + 1, size + 1)
    return grid[1:, :size][::-1].astype(np.int16)


def encode_grid(grid: np.ndarray, little: bool = False, overlap: bool = True) -> bytes:
    """The inverse; overlap adds the northern row and eastern column as missing."""
    g = grid[::-1]
    if overlap:
        g = np.pad(g, ((1, 0), (0, 1)), constant_values=NONE)
    return g.astype("<i2" if little else ">i2").tobytes()


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filter_rows(rows: np.ndarray, pixel: int) -> bytes:
    """PNG filtering, row by row the filter of the least sum of bytes; ties go to the lower filter."""
    r = rows.astype(np.int32)
    up = np.vstack([np.zeros((1, r.shape[1]), np.int32), r[:-1]])
    left, corner = np.zeros_like(r), np.zeros_like(r)
    left[:, pixel:], corner[:, pixel:] = r[:, :-pixel], up[:, :-pixel]
    kinds = [k & 255 for k in (r, r - left, r - up, r - (left + up) // 2, r - _paeth(left, up, corner))]
    best = np.argmin(np.stack([k.sum(axis=1) for k in kinds]), axis=0)
    picked = np.stack(kinds)[best, np.arange(len(r))].astype(np.uint8)
    return np.hstack([best[:, None].astype(np.uint8), picked]).tobytes()


def _rebuilt(kind: int, row: bytes, before: bytes, pixel: int) -> bytearray:
    """A row behind the average (3) or Paeth (4) filter, byte by byte: each depends on the one a pixel to its left."""
    now = bytearray(row)
    if kind == 3:
        for x in range(len(now)):
            now[x] = (now[x] + ((now[x - pixel] if x >= pixel else 0) + before[x] >> 1)) & 255
        return now
    for x in range(min(pixel, len(now))):
        now[x] = (now[x] + before[x]) & 255
    for x in range(pixel, len(now)):
        a, b, c = now[x - pixel], before[x], before[x - pixel]
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        now[x] = (now[x] + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
    return now


def unfilter_rows(data: bytes, height: int, width: int, pixel: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    before = np.zeros(width, np.uint8)
    for y in range(height):
        kind, row = int(raw[y, 0]), raw[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 1:  # sums along the row, modulo 256
            for k in range(min(pixel, width)):
                out[y, k::pixel] = np.cumsum(row[k::pixel], dtype=np.uint8)
        elif kind == 2:
            out[y] = row + before
        elif kind in (3, 4):
            out[y] = np.frombuffer(_rebuilt(kind, row.tobytes(), before.tobytes(), pixel), np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        before = out[y]
    return out


# Colour type and bits of a sample, by kind of picture: grey of 1, 8 and 16 bits, and colour with alpha.
PNG_KINDS = {"gray1": (0, 1), "gray8": (0, 8), "gray16": (0, 16), "rgba8": (6, 8)}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(image: np.ndarray, kind: str) -> bytes:
    """image: (height, width) of integers, or (height, width, 4) for rgba8; row 0 on top."""
    color, bits = PNG_KINDS[kind]
    h, w = image.shape[:2]
    rows = np.packbits(image.astype(np.uint8), axis=1) if bits == 1 else image.astype(">u2").view(np.uint8).reshape(h, w * 2) if bits == 16 else image.astype(np.uint8).reshape(h, -1)
    body = zlib.compress(filter_rows(rows, max(1, bits * (4 if color == 6 else 1) // 8)), 6)
    return PNG_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, 0)) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[str, np.ndarray]:
    """Kind and image. Checks signature and every CRC; several IDAT chunks are joined, other chunks passed over."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, body, header = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if header is None or header[4:] != (0, 0, 0)[: len(header[4:])]:
        raise ValueError("no header, or interlaced")
    w, h, bits, color = header[:4]
    name = next((k for k, v in PNG_KINDS.items() if v == (color, bits)), None)
    if name is None:
        raise ValueError(f"colour type {color} of {bits} bits")
    samples = 4 if color == 6 else 1
    length = -(-w * bits * samples // 8)
    rows = unfilter_rows(zlib.decompress(b"".join(body)), h, length, max(1, bits * samples // 8))
    if bits == 1:
        return name, np.unpackbits(rows, axis=1)[:, :w]
    return name, rows.view(">u2").astype(np.uint16) if bits == 16 else rows.reshape(h, w, 4) if samples == 4 else rows


FORMATS = ("hgt", "xth", "png16", "png1")


def encode_tile(grid: np.ndarray, how: str) -> bytes:
    if how in ("hgt", "xth"):
        return encode_grid(grid, how == "xth")
    top_down = grid[::-1].astype(np.int32)
    if how == "png1":
        if not np.isin(top_down, (0, 1)).all():
            raise ValueError("a value that is neither 0 nor 1")
        return encode_png(top_down, "gray1")
    return encode_png(np.where(top_down == NONE, 0, top_down + 32768), "gray16")


def decode_tile(data: bytes, size: int, how: str) -> np.ndarray:
    if how in ("hgt", "xth"):
        return decode_grid(data, size, how == "xth")
    kind, image = decode_png(data)
    if image.shape[:2] != (size, size) or kind != {"png16": "gray16", "png1": "gray1"}[how]:
        raise ValueError(f"{kind} of {image.shape}, not {how} of {size}x{size}")
    image = image[::-1].astype(np.int32)
    return (image if how == "png1" else np.where(image == 0, NONE, image - 32768)).astype(np.int16)


def to_tiles(cells: DataFrame, size: int, how: str) -> DataFrame:
    """(tile_x, tile_y, content) of cells (x, y, h); one task packs one tile at a time."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((size, size), 0 if how == "png1" else NONE, np.int16)
        some = pdf[pdf["h"].notna()]
        grid[some["y"] - key[1] * size, some["x"] - key[0] * size] = some["h"].astype(np.int16)
        return pd.DataFrame({"tile_x": [key[0]], "tile_y": [key[1]], "content": [encode_tile(grid, how)]})

    keyed = cells.selectExpr("x", "y", "h", f"cast(floor(x / {size}) as int) as tile_x", f"cast(floor(y / {size}) as int) as tile_y")
    return keyed.groupBy("tile_x", "tile_y").applyInPandas(pack, "tile_x int, tile_y int, content binary")


def from_tiles(tiles: DataFrame, size: int, how: str) -> DataFrame:
    """(x, y, h) of (tile_x, tile_y, content); missing heights are null."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = (a.reshape(-1) for a in np.mgrid[0:size, 0:size])
        for b in batches:
            for tx, ty, content in zip(b["tile_x"], b["tile_y"], b["content"], strict=True):
                h = decode_tile(content, size, how).reshape(-1)
                yield pd.DataFrame({"x": x + tx * size, "y": y + ty * size, "h": pd.array(np.where(h == NONE, 0, h), "Int32").copy()}).assign(h=lambda d, h=h: d["h"].mask(h == NONE))

    return tiles.select("tile_x", "tile_y", "content").mapInPandas(unpack, "x int, y int, h int")
