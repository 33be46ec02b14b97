"""Operator 8: substring dedup by fixed-block anchors.

Texts are sequences of words (runs of other than white space). Every document is cut into
blocks of ``BLOCK`` = 25 words that don't overlap; their hashes are the reference index, a
two-bit Bloom filter. Then every rolling window of 25 words of every document probes it: a
window off the block grid hits where any block may equal it, a block where another block
may. A repeat of 2 * BLOCK - 1 words or more holds a whole block of each of its documents,
so each of its occurrences has a hit.

Hits are extended to all windows of ``LENGTH`` = 50 words around them. These are hashed to
96 bits, and those that occur in two documents or more are exact repeats; this compares an
occurrence with all others of the passage at once, so a passage that thousands of documents
share costs no pairs. Windows that two documents of one task share are settled there: their
places stay, as spans, and one row alone tells the other tasks of the window. So a hot
passage is a row a task and window in the shuffle, not a row a document; what is shuffled
else are the windows that only one document of a task has. Neighbouring windows join to
maximal spans. What the Bloom filter lets pass wrongly costs rows, but no result.

The index takes 16 bits a block, up to ``max_cells`` bits for a filter. For a larger corpus
there are several filters, each for one range of hashes; the block hashes are written once to
the shared folder to build them. ``HELD`` of them at a time are probed by a pass of all
windows, so a task's memory stays bounded, and the passes' hits are joined.

Defined cases: NULL, empty and short texts (under 50 words) have no repeats; rows with a
NULL doc_id are left out; a repeat within one document alone is none, also if the document
stands in several rows (rows of one doc_id are one document: equal rows give their spans once,
and different texts give the spans of each); overlapping or touching repeats are one span,
even if they are shared with different documents; all documents that tie, as they share a
passage, have it; a very long text is one slice and needs memory in proportion to its length (some 60 bytes for each
of its own); doc_id may be of any type (64-bit hashes stand for ids that aren't whole numbers); an empty table gives an empty one; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import col, integral, prepare, staged
from .textops import RUN, U, hashes, mix, slices, tokens, windows

BLOCK, LENGTH = 25, 50
MAX_CELLS = 1 << 28
#: Pairs of filters that a task holds at once, 64 MiB each at most. Windows that it holds before it settles what it can.
HELD, SETTLED = 4, 1 << 20
#: Kinds of rows in the shuffle: a window at one place, one that is known to be shared, settled places, a window at several places.
ONCE, SHARED, PLACES, OFTEN = range(4)
ROW = "h long, doc_id long, rest long, kind int, places array<int>"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word, and its place in the row."""
    start, end, row = tokens(data, off, RUN)
    first = np.searchsorted(row, np.arange(off.size - 1))
    return hashes(data, start, end), row, np.arange(row.size) - first[row]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, off in slices(b.column(0)):
            h, row, at = _words(data, off)
            w = windows(h, BLOCK)
            own = (at[: w.size] % BLOCK == 0) & (row[: w.size] == row[BLOCK - 1 :]) if w.size else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(w[own].view(np.int64))], ["h"])


def _of_turn(rounds: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h[_turn(h.view(U), rounds) == r])], ["h"])

    return run


def _turn(h: np.ndarray, rounds: int) -> np.ndarray:
    return ((h >> U(32)) * U(rounds) >> U(32)).astype(np.int64)


def _hits(w: np.ndarray, same: np.ndarray, at: np.ndarray, filters, rounds: int) -> np.ndarray:
    """Places of the windows that hit the filters {round: (any, many)}; those of other rounds don't."""
    out = []
    turn = _turn(w, rounds) if rounds > 1 else None
    for r, (some, many) in filters.items():
        where = np.flatnonzero(same if turn is None else same & (turn == r))
        block = at[where] % BLOCK == 0
        ok = np.zeros(where.size, bool)
        ok[~block] = bloom.has(some.value, w[where[~block]])
        ok[block] = bloom.has(many.value, w[where[block]])
        out.append(where[ok])
    return np.concatenate(out)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(keys[0].size, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys]) if keys[0].size else False
    return np.flatnonzero(new)


def _spanned(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(group, places of each): first and last place of every run of windows that touch, on end; a group's rows stand together."""
    new = np.ones(at.size, bool)
    new[1:] = (group[1:] != group[:-1]) | (at[1:] - at[:-1] > LENGTH) | (at[1:] < at[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], at.size) - 1
    heads = _heads(group[first])
    ends = np.stack([at[first], at[last]], axis=1).astype(np.int32).ravel()
    return group[first][heads], pa.ListArray.from_arrays(pa.array((2 * np.append(heads, first.size)).astype(np.int32)), pa.array(ends))


def _rows(h, doc, rest, kind: int, places: pa.Array | None = None) -> pa.RecordBatch:
    n = len(doc)
    given = pa.nulls(n, pa.list_(pa.int32())) if places is None else places
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(rest), pa.array(np.full(n, kind, np.int32)), given], ["h", "doc_id", "rest", "kind", "places"])


def _grouped(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size) of the windows that are equal; the order within them is that of the rows."""
    order = np.argsort(h, kind="stable")
    first = _heads(h[order], check[order])
    if first.size > _heads(h[order]).size:  # two windows have one hash: their checks may alternate
        order = np.lexsort((check, h))
        first = _heads(h[order], check[order])
    return order, first, np.diff(np.append(first, h.size))


def _several(doc: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each group has more than one document."""
    return np.logical_or.reduceat(doc != np.repeat(doc[first], size), first)


def _settle(h: np.ndarray, doc: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows for the windows (hash, document, check and place) that a task has found."""
    at = (rest & U(0xFFFFFFFF)).astype(np.int64)
    order, first, size = _grouped(h, rest >> U(32))
    shared = _several(doc[order], first, size)
    row_shared, alone = np.repeat(shared, size), np.repeat(size == 1, size)
    if alone.any():
        own = order[alone]
        yield _rows(h[own], doc[own], rest[own].view(np.int64), ONCE)
    if shared.any():
        one = order[first[shared]]
        yield _rows(h[one], doc[one], rest[one].view(np.int64), SHARED)
        own = np.sort(order[row_shared])  # as they stand in the texts
        docs, places = _spanned(doc[own], at[own])
        yield _rows(mix(docs.view(U)).view(np.int64), docs, np.zeros(docs.size, np.int64), PLACES, places)
    often = ~row_shared & ~alone
    if often.any():
        groups, places = _spanned(np.repeat(np.arange(first.size), size)[often], at[order[often]])
        head = order[first[groups]]
        yield _rows(h[head], doc[head], rest[head].view(np.int64), OFTEN, places)


def _extend(filters, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids = b.column(1).to_numpy()
            for i, _, data, off in slices(b.column(0)):
                h, row, at = _words(data, off)
                w, long, check = windows(h, BLOCK), windows(h, LENGTH), windows(mix(h + U(1)), LENGTH)
                if not long.size:
                    continue
                hit = _hits(w, row[: w.size] == row[BLOCK - 1 :], at[: w.size], filters, rounds)
                near = np.zeros(row.size + 1, np.int32)  # the LENGTH windows that hold a hit begin up to LENGTH - BLOCK earlier
                np.add.at(near, np.maximum(hit - (LENGTH - BLOCK), 0), 1)
                np.add.at(near, hit + 1, -1)
                pick = np.flatnonzero((np.cumsum(near)[: long.size] > 0) & (row[: long.size] == row[LENGTH - 1 :]))
                if pick.size:
                    held.append((long[pick].view(np.int64), ids[i + row[pick]], (check[pick] >> U(32) << U(32)) | at[pick].astype(U)))
                    n += pick.size
                if n > SETTLED:
                    yield from _settle(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield from _settle(*map(np.concatenate, zip(*held)))

    return run


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, places) of the windows of one partition of hashes that two documents have."""
    held, lists, n = [], [], 0
    for b in batches:
        kind = b.column(3).to_numpy()
        done = np.flatnonzero(kind == PLACES)
        if done.size:
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(done)), b.column(4).take(pa.array(done))], ["doc_id", "places"])
        rest = np.flatnonzero(kind != PLACES)
        if rest.size:
            held.append([b.column(i).to_numpy()[rest] for i in range(4)])
            often = np.flatnonzero(kind[rest] == OFTEN)
            lists.append((n + often, b.column(4).take(pa.array(rest[often]))))
            n += rest.size
    if not held:
        return
    h, doc, rest, kind = map(np.concatenate, zip(*held))
    rest = rest.view(U)
    order, first, size = _grouped(h, rest >> U(32))
    known = _several(doc[order], first, size) | np.logical_or.reduceat(kind[order] == SHARED, first)
    keep = np.zeros(n, bool)
    keep[order] = np.repeat(known, size)
    one = np.flatnonzero(keep & (kind == ONCE))
    if one.size:
        docs, at = doc[one], (rest[one] & U(0xFFFFFFFF)).astype(np.int64)
        by = np.lexsort((at, docs))
        yield pa.RecordBatch.from_arrays([*map(pa.array, _spanned(docs[by], at[by]))], ["doc_id", "places"])
    for where, places in lists:
        own = np.flatnonzero(keep[where])
        if own.size:
            yield pa.RecordBatch.from_arrays([pa.array(doc[where[own]]), places.take(pa.array(own))], ["doc_id", "places"])


def _spans(places: pd.Series) -> pd.Series:
    out = []
    for parts in places:
        ends = np.concatenate([np.asarray(p) for p in parts]).reshape(-1, 2)
        ends = ends[np.argsort(ends[:, 0], kind="stable")]
        reach = np.maximum.accumulate(ends[:, 1])
        cut = np.flatnonzero(ends[1:, 0] - reach[:-1] > LENGTH) + 1
        out.append([{"start_word": int(a), "end_word": int(b) + LENGTH} for a, b in zip(ends[np.append(0, cut), 0], reach[np.append(cut - 1, len(ends) - 1)])])
    return pd.Series(out)


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", max_cells: int = MAX_CELLS, rounds: int | None = None) -> DataFrame:
    """(doc_id, start_word, end_word): the spans of words (from 0, end excluded) that occur in other documents too."""
    prepare(docs.sparkSession)
    if not integral(docs, key):  # other ids are hashed, and looked up for what is found
        ids = docs.select(F.xxhash64(col(key)).alias("hashed"), col(key).alias("doc_id")).where("doc_id is not null").distinct()
        found = repeats(docs.select(F.when(col(key).isNotNull(), F.xxhash64(col(key))).alias("hashed"), col(text).alias("text")), "text", "hashed", max_cells, rounds)
        return found.withColumnRenamed("doc_id", "hashed").join(ids, "hashed").select("doc_id", "start_word", "end_word")
    own = docs.select(col(text).alias("text"), col(key).cast("bigint").alias("doc_id")).where("text is not null and doc_id is not null")
    n = own.select((F.length("text") / 50 + 1).cast("bigint").alias("n")).agg(F.sum("n")).first()[0] or 0  # about the blocks, or more
    rounds = rounds or max(1, -(-n * bloom.CELLS_PER_KEY // (2 * max_cells)))
    hashes_of = own.select("text").mapInArrow(_blocks, "h long")
    if rounds > 1:
        hashes_of = staged(hashes_of, "blocks")  # the texts are read for them once
    found = None
    for first in range(0, rounds, HELD):
        filters = {r: tuple(bloom.both(hashes_of if rounds == 1 else hashes_of.mapInArrow(_of_turn(rounds, r), "h long"), n // rounds, max_cells)) for r in range(first, min(rounds, first + HELD))}
        part = own.mapInArrow(_extend(filters, rounds), ROW)
        found = part if found is None else found.union(part)
    found = found.repartition("h").mapInArrow(_confirm, "doc_id long, places array<int>")
    spans = F.pandas_udf(_spans, "array<struct<start_word:int,end_word:int>>")
    return found.groupBy("doc_id").agg(F.collect_list("places").alias("places")).select("doc_id", F.explode(spans("places")).alias("s")).select("doc_id", F.col("s.start_word").cast("bigint").alias("start_word"), F.col("s.end_word").cast("bigint").alias("end_word"))


#: Whole tables; windows of 50 words joined by single blanks, as words hold no white space.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM p),
r AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
q AS (SELECT DISTINCT doc_id, i FROM h JOIN r USING (h)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM q),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g)
SELECT doc_id, min(i)::BIGINT AS start_word, (max(i) + 50)::BIGINT AS end_word FROM s GROUP BY doc_id, s
"""
