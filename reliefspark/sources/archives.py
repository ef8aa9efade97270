"""Files by the batch: zip archives, tiled or striped TIFF, lists of tiles in GeoJSON, and tiles with all their errors.

Files come from Spark's binaryFile source as (path, content); each task opens its own."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import parse_tile_name
from .grids import NONE, decode_tile


def unzip(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """(path, name, content) of every entry of zip archives (path, content) whose name matches the regular expression."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in z.infolist():
                        if not entry.is_dir() and (pattern is None or re.search(pattern, entry.filename)):
                            yield pd.DataFrame({"path": [path], "name": [entry.filename], "content": [z.read(entry)]})

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def zip_tiles(tiles: DataFrame, extension: str = "hgt") -> DataFrame:
    """(path, content): a zip archive for each of (name, content), holding name.extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{name}.{extension}", content)
                yield pd.DataFrame({"path": [f"{name}.zip"], "content": [out.getvalue()]})

    return tiles.select("name", "content").mapInPandas(run, "path string, content binary")


def decode_all(tiles: DataFrame, size: int, how: str) -> DataFrame:
    """(name, tile_x, tile_y, x, y, h, error) of (name, content): the cells of each tile that can be read, and one row with the
    error of each that can't, so that all errors of a batch are seen. Names are tile names with or without a path and an
    ending, as N46E015.hgt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ys, xs = (a.reshape(-1) for a in np.mgrid[0:size, 0:size])
        for b in batches:
            for name, tx, ty, content in zip(b["name"], b["tile_x"], b["tile_y"], b["content"], strict=True):
                error, h = None, None
                try:
                    if pd.isna(tx):
                        raise ValueError("not the name of a tile")
                    h = decode_tile(content, size, how).reshape(-1)
                except (ValueError, zlib.error, struct.error) as e:
                    error = str(e)
                if h is None:
                    yield pd.DataFrame({"name": [name], "tile_x": pd.array([tx], "Int32"), "tile_y": pd.array([ty], "Int32"), "x": pd.array([None], "Int32"), "y": pd.array([None], "Int32"), "h": pd.array([None], "Int32"), "error": [error]})
                else:
                    value = pd.Series(pd.array(h.astype(np.int32), "Int32")).mask(h == NONE)
                    yield pd.DataFrame({"name": name, "tile_x": np.int32(tx), "tile_y": np.int32(ty), "x": (xs + tx * size).astype(np.int32), "y": (ys + ty * size).astype(np.int32), "h": value, "error": None})

    stem = F.regexp_extract("name", r"([NS][0-9]{2,3}[EW][0-9]{3})[^/]*$", 1)
    tx, ty = parse_tile_name(stem)
    named = tiles.select("name", tx.alias("tile_x"), ty.alias("tile_y"), "content")
    return named.mapInPandas(run, "name string, tile_x int, tile_y int, x int, y int, h int, error string")


def read_batch(tiles: DataFrame, size: int, how: str) -> DataFrame:
    """(x, y, h) of all tiles (name, content); raises one error that names every tile that can't be read."""
    read = decode_all(tiles, size, how)
    bad = read.where("error is not null").select("name", "error").orderBy("name").collect()  # one row for each damaged file
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['error']}" for r in bad))
    return read.select("x", "y", "h")


def listed_tiles(texts: DataFrame, key: str = "ll_tile") -> DataFrame:
    """(name, tile_x, tile_y) of the features of GeoJSON texts (value): the property `key` names a tile."""
    parsed = texts.select(F.from_json("value", "features array<struct<properties: map<string, string>>>").alias("g"))
    names = parsed.select(F.explode("g.features").alias("f")).select(F.col("f.properties")[key].alias("name")).where("name is not null")
    tx, ty = parse_tile_name(F.col("name"))
    return names.select("name", tx.alias("tile_x"), ty.alias("tile_y"))


# TIFF tags, and bytes of a field by type.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    out, table, width, held, n, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, n = (held << 8 | byte) & 0xFFFFFF, n + 8
        if n < width:
            continue
        n -= width
        code = held >> n & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if last:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        else:
            word = table[code]
        out += word
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def _header(data: bytes) -> tuple[str, dict[int, tuple]]:
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack_from(end + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(end + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        if kind in FIELD:
            size = struct.calcsize(FIELD[kind]) * n
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{end}{n}{FIELD[kind]}", data, place)
    return end, tags


def decode_tiff(data: bytes, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """(height, width) of the first picture of one sample; row 0 on top. Not compressed, LZW or deflate, in strips or tiles.

    window: (left, top, width, height); only the tiles or strips that it touches are unpacked."""
    end, tags = _header(data)
    one = lambda tag, other=None: tags[tag][0] if tag in tags else other
    w, h, bits, how = one(WIDTH), one(HEIGHT), one(BITS, 1), one(COMPRESSION, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if w is None or h is None or bits not in (8, 16, 32, 64) or kind is None or (kind == "f" and bits < 32) or how not in (1, 5, 8, 32946) or len(tags[BITS]) > 1:
        raise ValueError(f"a TIFF of {bits} bits, compression {how}")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS, h), h))
    offsets, counts = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
    left, top, wide, high = window or (0, 0, w, h)
    if left < 0 or top < 0 or left + wide > w or top + high > h:
        raise ValueError("the window is not inside the picture")
    kind_of = np.dtype(f"{end}{kind}{bits // 8}")
    out, across = np.zeros((high, wide), kind_of.newbyteorder("=")), -(-w // tw)
    for ty in range(top // th, -(-(top + high) // th)):
        for tx in range(left // tw, -(-(left + wide) // tw)):
            k = ty * across + tx
            raw = data[offsets[k] : offsets[k] + counts[k]]
            if len(raw) < counts[k]:
                raise ValueError("the file is cut short")
            raw = raw if how == 1 else _lzw(raw) if how == 5 else zlib.decompress(raw)
            rows = th if tiled else min(th, h - ty * th)
            part = np.frombuffer(raw, kind_of, rows * tw).reshape(rows, tw).astype(out.dtype)
            if one(PREDICTOR, 1) == 2:
                part = np.cumsum(part, axis=1, dtype=part.dtype)
            y0, x0 = max(top, ty * th), max(left, tx * tw)
            y1, x1 = min(top + high, ty * th + rows), min(left + wide, tx * tw + tw)
            out[y0 - top : y1 - top, x0 - left : x1 - left] = part[y0 - ty * th : y1 - ty * th, x0 - tx * tw : x1 - tx * tw]
    return out


def encode_tiff(image: np.ndarray, tile: int = 256) -> bytes:
    """Little endian, deflated square tiles of whole numbers, one sample."""
    h, w = image.shape
    kind = 2 if image.dtype.kind == "i" else 1
    parts = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            part = np.zeros((tile, tile), image.dtype.newbyteorder("<"))
            cut = image[y : y + tile, x : x + tile]
            part[: cut.shape[0], : cut.shape[1]] = cut
            parts.append(zlib.compress(part.tobytes()))
    n, sizes = len(parts), [len(p) for p in parts]
    fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [image.dtype.itemsize * 8]), (COMPRESSION, 3, [8]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, [0] * n), (TILE_COUNTS, 4, sizes), (FORMAT, 3, [kind])]
    after = 8 + 2 + 12 * len(fields) + 4
    body = after + (8 * n if n > 1 else 0)
    fields[6] = (TILE_OFFSETS, 4, [body + sum(sizes[:k]) for k in range(n)])
    entries, extra = b"", b""
    for tag, form, v in fields:
        packed = struct.pack(f"<{len(v)}{FIELD[form]}", *v)
        if len(packed) > 4:
            entries += struct.pack("<HHII", tag, form, len(v), after + len(extra))
            extra += packed
        else:
            entries += struct.pack("<HHI", tag, form, len(v)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra + b"".join(parts)


def tiff_cells(files: DataFrame, step: int = 1, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, x, y, h) of TIFF files (path, content), y growing north from the southern row of the window. step: cells that each
    sample fills along x, 2 where a file has half the columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                image = np.repeat(decode_tiff(content, window), step, axis=1)[::-1]
                y, x = (a.reshape(-1).astype(np.int32) for a in np.mgrid[0 : image.shape[0], 0 : image.shape[1]])
                yield pd.DataFrame({"path": path, "x": x, "y": y, "h": image.reshape(-1).astype(np.int32)})

    return files.select("path", "content").mapInPandas(run, "path string, x int, y int, h int")
