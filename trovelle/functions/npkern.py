"""Vectorised kernels over the byte buffers of Arrow string columns.

Words are found, hashed and rolled into n-grams for a whole batch at once, without one Python object
a word. Hashes are 64 bits: prefix sums of a polynomial, taken apart with the inverse of its base
(odd, hence invertible modulo 2**64) and finished by an avalanche mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = {"byte": 0x9E3779B97F4A7C15, "gram": 0xC2B2AE3D27D4EB4F}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}
SLICE = 1 << 20


def _powers(which: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = _BASE[which]
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def byte_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each value; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first = int(offsets[0])
    size = int(offsets[-1]) - first
    data = np.frombuffer(buffers[2], np.uint8, size, first) if size else np.zeros(0, np.uint8)
    return data, offsets - first


def table_of(chars: bytes, complement: bool = False) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return ~t if complement else t


BLANK = table_of(b" \t\r\n", complement=True)
ALNUM_LOWER = table_of(b"abcdefghijklmnopqrstuvwxyz0123456789")


class Words:
    """Words of a batch of texts: start, end (bytes), and of each text the range lo:hi of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(data)
        inside = table[data]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edge - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        bounds = np.searchsorted(self.start, offsets)
        self.lo, self.hi = bounds[:-1], bounds[1:]
        self.data = data

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return hash_ranges(self.data, self.start, self.end)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each of the ranges, which follow one another."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        upto = max(at + 1, int(np.searchsorted(end, lo + SLICE, side="right")))
        hi = int(end[upto - 1])
        up, down = _powers("byte", hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        part = data[lo:hi].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: hi - lo]
        np.cumsum(part, out=total[1:])
        out[at:upto] = (total[end[at:upto] - lo] - total[start[at:upto] - lo]) * down[start[at:upto] - lo]
        at = upto
    return mix(out)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive words; the caller drops runs that cross texts."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers("gram", n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def runs_of(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start[i] .. end[i]-1 for each i."""
    up, down = _powers("gram", len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - have : len(x) - have + 1]) if have < w else m


def expand_ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers lo[i] .. lo[i]+n[i]-1 of all i in a row, and the i of each."""
    n = np.maximum(n, 0)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(len(owner)) - first[owner] + lo[owner], owner


def text_hashes(column: pa.Array) -> np.ndarray:
    """64-bit hash of each whole value."""
    data, offsets = byte_buffers(column)
    size = np.diff(offsets)
    return mix(hash_ranges(data, offsets[:-1], offsets[1:]) + size.astype(np.uint64))


_UNICODE: dict[str, np.ndarray] = {}


def unicode_class(name: str) -> np.ndarray:
    """A table over all code points: word (letters, digits, underscore), space, or visible (no space)."""
    if name not in _UNICODE:
        chars = [chr(i) for i in range(0x110000)]
        word = np.fromiter((c.isalnum() for c in chars), bool, 0x110000)
        word[ord("_")] = True
        _UNICODE["word"] = word
        _UNICODE["space"] = np.fromiter((c.isspace() for c in chars), bool, 0x110000)
        _UNICODE["visible"] = ~_UNICODE["space"]
    return _UNICODE[name]


_LOWER: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """The lower case of each code point, where it is a single one."""
    if not _LOWER:
        low = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):
            c = chr(i).lower()
            if len(c) == 1:
                low[i] = ord(c)
        _LOWER.append(low)
    return _LOWER[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column and the offset of each value."""
    size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = byte_buffers(column)
    if len(data) == int(size.sum()):
        return data.astype(np.uint32), offsets
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(size)])
