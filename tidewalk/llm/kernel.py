"""Words of whole texts as 64-bit codes, for many texts at a time with NumPy.

Words are maximal runs of bytes other than ASCII space and 09-0D. A word's code mixes its length and its bytes, eight
at a time, through multiply-and-shift rounds (words over LONG bytes: BLAKE2), so equal words have equal codes wherever
they stand, and different ones share a code with odds of about 2**-64, however regular they are. `checks` gives 64 more
bits for where that isn't enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words of more bytes are hashed one by one.
LONG = 64
#: Bytes of text that are worked on at a time (a longer text is taken whole).
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What each byte counts as: itself, or its lower-case form in A-Z.
EXACT = np.arange(256, dtype=np.uint8)
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _hashed(eights: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """Codes of byte runs of at most LONG bytes; eights[i] is the eight bytes from i on."""
    factor, seed = stream(salt, LONG // 8 + 1), stream(salt + 50, LONG + 1)
    code = mix((eights[start] & _FIRST[np.minimum(size, 8)]) ^ seed[size])
    more = np.flatnonzero(size > 8)
    for k in range(1, LONG // 8):
        if not len(more):
            break
        next_bytes = eights[start[more] + 8 * k] & _FIRST[np.minimum(size[more] - 8 * k, 8)]
        code[more] = mix(code[more] * factor[k] + next_bytes)
        more = more[size[more] > 8 * (k + 1)]
    return code


class Words:
    """The words of several texts: `code`, byte range `start:end` in `data`, and `first[i]:first[i+1]` per text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray, between: np.ndarray = SPACE, apart: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """data: bytes of the texts one after another; at: where each begins, and the end; between: bytes outside words.

        apart: two sets of bytes that end one another's words.
        """
        self.data, self.at = data, at
        n = len(data)
        space = between[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True  # a text's first byte begins a word even if the text before ended in one
        if apart is not None:
            one, other = apart[0][data], apart[1][data]
            edge[1:n] |= (one[1:] & other[:-1]) | (one[:-1] & other[1:])
        begins, ends = np.empty(n + 1, bool), np.empty(n + 1, bool)
        begins[0], begins[n] = n > 0 and not space[0], False
        ends[0], ends[n] = False, n > 0 and not space[n - 1]
        begins[1:n] = ~space[1:] & (space[:-1] | edge[1:n])
        ends[1:n] = ~space[:-1] & (space[1:] | edge[1:n])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self._folded = np.zeros(n + LONG + 8, np.uint8)
        np.take(table, data, out=self._folded[:n])
        self._eights = np.ndarray((n + LONG,), np.dtype("<u8"), self._folded, strides=(1,))
        self.code = self._codes(31)
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def _codes(self, salt: int, words: slice | np.ndarray = slice(None)) -> np.ndarray:
        start, end = self.start[words], self.end[words]
        size = end - start
        long = np.flatnonzero(size > LONG)
        code = _hashed(self._eights, start, np.minimum(size, LONG), salt)
        for i in long.tolist():
            digest = hashlib.blake2b(self._folded[start[i] : end[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little"))
            code[i] = int.from_bytes(digest.digest(), "little")
        return code

    def checks(self, words: slice | np.ndarray = slice(None)) -> np.ndarray:
        """A second code of each word, independent of the first."""
        return self._codes(41, words)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the first `size` (at most 8) bytes of the words that are longer, and those words' indexes."""
        at = np.flatnonzero(self.end - self.start > size)
        return mix((self._eights[self.start[at]] & _FIRST[size]) ^ stream(61, size)[-1]), at

    def windows(self, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of every run of `width` words inside one text, and the index of its first word."""
        n = len(self.code) - width + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        factors = stream(seed, width)
        total = self.code[:n] * factors[0]
        for j in range(1, width):
            total += self.code[j : j + n] * factors[j]
        inside = np.zeros(n, bool)
        left = np.repeat(self.first[1:], self.count)[:n]  # where the word's text ends
        np.less_equal(np.arange(n) + width, left, out=inside)
        at = np.flatnonzero(inside)
        return mix(total[at]), at


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch in runs of about STEP bytes: which rows, their bytes and their offsets."""
    if not batch.num_rows:
        return
    data, at = texts_of(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + STEP, "right")) - 1)
        yield slice(begin, end), data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def binary(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
