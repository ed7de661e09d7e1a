"""Compact byte form of integer arrays for shuffles: differences, split by byte significance, zstandard."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_write, _read = zstandard.ZstdCompressor(level=5), zstandard.ZstdDecompressor()


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: memoryview, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack(*arrays: np.ndarray, rising: tuple[int, ...] = ()) -> bytes:
    """Arrays of unsigned integers in one blob; those numbered in `rising` are sorted and kept as differences."""
    out = []
    for i, x in enumerate(arrays):
        if i in rising and len(x):
            x = np.concatenate([x[:1], np.diff(x)])
        out.append(struct.pack("<IB", len(x), x.itemsize) + planes(x))
    return _write.compress(struct.pack("<B", len(arrays)) + b"".join(out))


def unpack(blob: bytes, rising: tuple[int, ...] = ()) -> list[np.ndarray]:
    raw = memoryview(_read.decompress(blob))
    at, found = 1, []
    for i in range(raw[0]):
        n, size = struct.unpack_from("<IB", raw, at)
        x = unplanes(raw[at + 5 : at + 5 + n * size], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size], n)
        found.append(np.cumsum(x, dtype=x.dtype) if i in rising else x)
        at += 5 + n * size
    return found
