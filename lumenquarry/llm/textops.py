"""Vectorised text work on Arrow buffers: slices of batches, token bounds and rolling hashes.

A text is looked at as its UTF-8 bytes; hashes of all tokens or windows of a slice come from
one cumulative sum of ``value * R**i`` modulo 2**64, so the cost is a few nanoseconds a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = b" \t\n\r\f"
SPACE, WORD, PUNCT = 0, 1, 2
CLASS = np.full(256, PUNCT, np.uint8)
for _b in range(256):
    if _b in SPACES:
        CLASS[_b] = SPACE
    elif _b >= 0x80 or chr(_b).isalnum() or _b == 0x5F:
        CLASS[_b] = WORD
RUN = np.where(CLASS == SPACE, SPACE, WORD).astype(np.uint8)
VALUE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    got = _POWERS.get(base)
    if got is None or got.size < n:
        size, got = 1 << max(12, (max(1, n) - 1).bit_length()), np.ones(1, U)
        while got.size < size:
            got = np.concatenate([got, got * U(pow(base, got.size, 2**64))])
        if size <= 1 << 23:
            _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def seed64(*parts: object) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or one row. NULL is as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters that UTF-8 begins with C3."""
    out = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    if data.size > 1:
        latin = np.zeros(data.size, bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out = np.where(latin, out | np.uint8(32), out)
    return out.astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = CLASS, only: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of one class other than space; ``only`` keeps one class."""
    n = data.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    c = classes[data]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = c[1:] != c[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    kind = c[start]
    keep = kind != SPACE if only is None else kind == only
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands."""
    total = np.zeros(data.size + 1, U)
    np.cumsum(VALUE[data] * powers(R, data.size), out=total[1:])
    return mix((total[end] - total[start]) * powers(R_INVERSE, data.size + 1)[start] + (end - start).astype(U))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours in ``h`` (of rows that follow each other too: mask those)."""
    if h.size < width:
        return np.zeros(0, U)
    total = np.zeros(h.size + 1, U)
    np.cumsum(h * powers(R, h.size), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(R_INVERSE, h.size + 1)[: h.size - width + 1])


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in it) of each member of groups of these lengths."""
    group = np.repeat(np.arange(lengths.size), lengths)
    first = np.cumsum(lengths) - lengths
    return group, np.arange(group.size) - first[group]
