"""Compact columns of integers for rows that stand for a whole block: byte planes, then Zstandard."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def _pack(a: np.ndarray, width: int) -> bytes:
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize)[:, :width].T.tobytes()
    return struct.pack("<BQ", width, len(a)) + zstandard.ZstdCompressor(3).compress(planes)


def _unpack(b: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", b)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[9:]), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _width(a: np.ndarray) -> int:
    return max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1


def pack_ints(a: np.ndarray) -> bytes:
    """Integers of 64 bits in any order; small ones take fewer planes, negative ones all eight."""
    a = np.ascontiguousarray(a).astype("<i8").view("<u8")
    return _pack(a, _width(a))


def unpack_ints(b: bytes) -> np.ndarray:
    return _unpack(b).view(np.int64)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    d = np.diff(np.ascontiguousarray(a).astype("<u8"), prepend=np.uint64(0))
    return _pack(d, _width(d))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


def slices(keys: np.ndarray, bits: int, lead: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of ascending keys below 2**bits by their `lead` leading bits; empty parts are left out."""
    if not len(keys):
        return []
    part = keys.astype(np.uint64) >> np.uint64(bits - lead)
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return list(zip(part[begin].astype(np.int64).tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True))
