"""Bloom filters over 64-bit hashes: one that tells repeated hashes apart, one that is broadcast.

``again`` finds the hashes that may occur more than once. The hashes (8 bytes a row) go to
partitions by their value; a partition streams its own through a Bloom filter, and a hash
that finds all of its cells taken may have been there before, so it is handed on. Each
partition has a filter of its own, of 16 cells a hash, so none fills up, however many rows
there are. Of a hot hash, a task hands on one for each batch it occurs in.

``containing`` makes a filter of hashes that is broadcast: built by tasks as sorted cells
(compressed differences, a few bytes a hash) and merged by segments of cells. It takes 2 bytes
a hash and is bounded by ``max_cells`` bits; beyond that it lets more hashes pass, which costs
time but no result, as whoever uses it verifies what passes. It is used for what recurs
alone, repeated texts or grouped documents; of a hash that it takes, two rows at least
belong to what passes anyway. ``both`` gives besides the filter of hashes that occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES, CELLS_PER_KEY, SEGMENT = 3, 16, 1 << 20
#: Bits of the broadcast filter: 256 MiB at most, by design for 134 million hashes.
MAX_CELLS = 1 << 31
#: Hashes of a partition of ``again``, about; its filter has 16 bits for each.
PART = 4_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(h: np.ndarray, size: int) -> list[np.ndarray]:
    a, b = mixed(h), mixed(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.uint32) for i in range(HASHES)]


def size_for(n: int, max_cells: int = MAX_CELLS) -> int:
    return min(max_cells, max(SEGMENT, 1 << (max(1, n) * CELLS_PER_KEY - 1).bit_length()))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hash once a batch, with whether it came twice there."""
    for b in batches:
        h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["h", "twice"])


def _streamed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.zeros(size, bool)
        for b in batches:
            h, one, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            twice = b.column(1).to_numpy(zero_copy_only=False)
            seen = n > 1
            np.logical_or.at(seen, np.searchsorted(h, b.column(0).to_numpy(zero_copy_only=False)), twice)
            c = cells(h.view(np.uint64), size)
            full = np.ones(h.size, bool)
            for x in c:
                full &= taken[x]
            for x in c:
                taken[x] = True
            yield pa.RecordBatch.from_arrays([pa.array(h[seen | full])], ["h"])

    return run


def again(hashes: DataFrame, n: int, part: int = PART) -> DataFrame:
    """(h): the hashes of the one BIGINT column of ``hashes`` (about ``n`` rows) that may occur more than once, none left out."""
    parts = -(-max(1, n) // part)
    return hashes.mapInArrow(_first_seen, "h long, twice boolean").repartition(parts, "h").mapInArrow(_streamed(size_for(min(n, 2 * part))), "h long").distinct()


def _partial(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(0, np.uint32)
        many = np.zeros(0, np.uint32)

        def fold(parts: list[np.ndarray], once: np.ndarray, many: np.ndarray):
            got, n = np.unique(np.concatenate([once, *parts]), return_counts=True)
            return got, np.union1d(many, got[n > 1])

        parts, held = [], 0
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            c = np.stack(cells(h, size))
            c.sort(axis=0)  # a hash that meets itself in a cell counts there once
            keep = np.ones(c.shape, bool)
            keep[1:] = c[1:] != c[:-1]
            parts.append(c[keep])
            held += parts[-1].size
            if held > 4_000_000:
                (once, many), parts, held = fold(parts, once, many), [], 0
        once, many = fold(parts, once, many)
        pack = zstandard.ZstdCompressor(level=1)
        for kind, at in ((1, once), (2, many)):
            edges = np.searchsorted(at, np.arange(0, size, SEGMENT, dtype=np.uint64))
            for s, (i, j) in enumerate(zip(edges, [*edges[1:], at.size])):
                if j > i:
                    gaps = np.diff(at[i:j] - np.uint32(s * SEGMENT), prepend=np.uint32(0))
                    planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "kind": pa.array([kind], pa.int32()), "cells": pa.array([pack.compress(planes)], pa.binary())})

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    unpack, once, many = zstandard.ZstdDecompressor(), np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
    for kind, packed in zip(pdf["kind"], pdf["cells"]):
        at = np.cumsum(np.frombuffer(unpack.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel())
        if kind == 2:
            many[at] = True
        else:
            many[at[once[at]]] = True
            once[at] = True
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "once": [np.packbits(once, bitorder="little").tobytes()], "many": [np.packbits(many, bitorder="little").tobytes()]})


def _gathered(hashes: DataFrame, n: int, max_cells: int, *kinds: str):
    size = size_for(n, max_cells)
    rows = hashes.mapInArrow(_partial(size), "segment int, kind int, cells binary").groupBy("segment").applyInPandas(_merged, "segment int, once binary, many binary")
    bits = [np.zeros(size // 8, np.uint8) for _ in kinds]
    for r in rows.select("segment", *kinds).toLocalIterator():
        for b, kind in zip(bits, kinds):
            b[r["segment"] * (SEGMENT // 8) : (r["segment"] + 1) * (SEGMENT // 8)] = np.frombuffer(r[kind], np.uint8)
    return [hashes.sparkSession.sparkContext.broadcast(b) for b in bits]


def containing(hashes: DataFrame, n: int, max_cells: int = MAX_CELLS):
    """The broadcast filter of hashes that may occur."""
    return _gathered(hashes, n, max_cells, "once")[0]


def both(hashes: DataFrame, n: int, max_cells: int = MAX_CELLS):
    """The broadcast filters of hashes that may occur, and that may occur more than once."""
    return _gathered(hashes, n, max_cells, "once", "many")


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(h.shape, bool)
    for c in cells(h, bits.size * 8):
        out &= (bits[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def maybe(h: Column, filter_) -> Column:
    """Whether a BIGINT may be in the broadcast filter; NULL gives anything."""

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        return pd.Series(has(filter_.value, s.fillna(0).to_numpy(np.int64).view(np.uint64)))

    return test(h)
