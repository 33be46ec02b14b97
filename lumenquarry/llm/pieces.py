"""Operator 5: SentencePiece encoding and decoding with seeded merge-dropout.

A pre-token is segmented by merges as the vocabulary ranks them: an agenda holds a candidate
for each two neighbours that make a piece, the best score first and the leftmost of equals.
When a candidate comes up, it is skipped with probability ``dropout``, decided by a keyed hash
of (seed, doc_id, place of the pre-token in the text, pre-token, borders of the two parts);
what is skipped never merges, what merges makes new candidates with its neighbours. So every
occurrence of a word is segmented by itself, the same in every run. Where documents are
repeated, as by mixing, the copy's number is part of the key if a column has it (``copy``).
A dropout of 0 gives the model's own ids.

Decoding joins the pieces' bytes and drops the blank put before: for every text and dropout
it returns the text itself, as no normalisation takes place and bytes stand for unknown
characters (and for the model's meta symbol).

Occurrences share only what they decide alike: each tests the merges of its word by its own
key, and the first one that it skips leads on to the merges that follow then. These are found
once for a word and the merges skipped, many at once in vectors, and kept for later slices.
Long pre-tokens (over ``LONG`` characters) go through the agenda as a heap, each by itself.
One narrow pass, no shuffle.

Defined cases: NULL and empty texts have no ids and decode to the empty text; a NULL doc_id
is hashed as 0, one that isn't a whole number by a 64-bit hash; merges that tie in rank go from the left; a very long
text is one slice and needs memory in proportion to its length (some 200 bytes for each of its own); repeated rows have equal ids without ``copy``; an empty
table gives an empty one; columns of ``docs`` pass through, and a name that is taken is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary
from .common import col, prepare
from .textops import U, mix, ragged, seed64, slices
from .vocabulary import UNKNOWN, PreTokens, Vocabulary

#: Borders of pre-tokens of up to LONG characters take 6 bits each. Nodes that a task keeps; when it has more, it starts anew.
DROPOUT, SEED, LONG, KEPT = 0.1, 5, 48, 500_000
_NONE, _MASK = np.int64(1) << 30, (1 << 64) - 1


def mix_int(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _MASK
    return h ^ (h >> 31)


def borders(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the candidates that join start:middle and middle:end."""
    return mix(start.astype(U) + middle.astype(U) * U(0x9E3779B97F4A7C15) + end.astype(U) * U(0xC2B2AE3D27D4EB4F))


def skipped(key: np.ndarray, hashed: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidates with these hashed borders are skipped."""
    return mix(key ^ hashed) < U(min(_MASK, int(dropout * 2.0**64)))


def _skipped_one(key: int, start: int, middle: int, end: int, dropout: float) -> bool:
    if dropout <= 0:
        return False
    return mix_int(key ^ mix_int((start + middle * 0x9E3779B97F4A7C15 + end * 0xC2B2AE3D27D4EB4F) & _MASK)) < min(_MASK, int(dropout * 2.0**64))


def agenda(v: Vocabulary, symbols: list[int], key: int, dropout: float, pairs: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(id, first character) of one pre-token's segments, by the agenda as it is defined."""
    n = len(symbols)
    sym, end, after, before = list(symbols), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    todo: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0 and (got := pairs.get(sym[i] * v.size + sym[j])):
            heapq.heappush(todo, (got[1], i, end[i], end[j], got[0]))

    for i in range(n - 1):
        offer(i)
    while todo:
        _, i, middle, stop, merged = heapq.heappop(todo)
        j = after[i]
        if sym[i] is None or end[i] != middle or j >= n or end[j] != stop:
            continue  # a part has merged elsewhere
        if _skipped_one(key, i, middle, stop, dropout):
            continue
        sym[i], end[i], after[i] = merged, stop, after[j]
        sym[j] = None
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [(s, i) for i, s in enumerate(sym) if s is not None]


class Slots:
    """Places of keys in an array, by a table of their hashes: most keys aren't there, which an empty slot tells at once."""

    def __init__(self, keys: np.ndarray):
        bits = (8 * keys.size + 8).bit_length()
        self.keys, self.shift, self.last = np.append(keys, -1), U(64 - bits), (1 << bits) - 1
        self.at = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(keys.size), self.slots(keys)
        while left.size:
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]
            more = self.at[slot] != left
            left, slot = left[more], slot[more] + 1 & self.last

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't."""
        slot = self.slots(keys)
        out = self.at[slot]
        more = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while more.size:
            slot[more] = slot[more] + 1 & self.last
            out[more] = self.at[slot[more]]
            more = more[(out[more] >= 0) & (self.keys[out[more]] != keys[more])]
        return out


def _merged(v: Vocabulary, slots: Slots, sym: np.ndarray, word: np.ndarray, start: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of many pre-tokens (id, word, first character) and the merges made (word, borders in order).

    It goes in rounds of one merge for each word; ``barred`` has the sorted word << 18 | borders of what never merges.
    """
    end = start + 1
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    made: list[tuple[np.ndarray, np.ndarray]] = []

    def ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of the candidates of i and what follows."""
        rank, to = np.full(i.size, _NONE), np.zeros(i.size, np.int64)
        ok = np.flatnonzero(i + 1 < sym.size)
        j = i[ok]
        ok = ok[(word[j] == word[j + 1]) & (sym[j] >= 0) & (sym[j + 1] >= 0)]
        j = i[ok]
        at = slots(sym[j] * v.size + sym[j + 1])
        ok, j, at = ok[at >= 0], j[at >= 0], at[at >= 0]
        if barred.size:
            keep = vocabulary.look_up(word[j] << 18 | start[j] << 12 | end[j] << 6 | end[j + 1], barred) < 0
            ok, at = ok[keep], at[keep]
        rank[ok], to[ok] = v.pair_rank[at], v.pair_id[at]
        return rank, to

    rank, to = ranks(np.arange(sym.size))
    while sym.size:
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat((rank << 32) | np.arange(sym.size), first)
        live = best < _NONE << 32
        if not live.all():
            stay = np.repeat(live, np.diff(np.append(first, sym.size)))
            done.append((sym[~stay], word[~stay], start[~stay]))
            moved = np.cumsum(stay) - 1
            best = moved[best[live] & 0xFFFFFFFF]
            at = np.flatnonzero(stay)
            sym, word, start, end, rank, to = sym[at], word[at], start[at], end[at], rank[at], to[at]
            if not sym.size:
                break
        else:
            best = best & 0xFFFFFFFF
        made.append((word[best], start[best] << 12 | end[best] << 6 | end[best + 1]))
        sym[best], end[best] = to[best], end[best + 1]
        stay = np.ones(sym.size, bool)
        stay[best + 1] = False
        best = best - np.arange(best.size)  # one symbol goes for each word before
        at = np.flatnonzero(stay)
        sym, word, start, end, rank, to = sym[at], word[at], start[at], end[at], rank[at], to[at]
        left = best[best > 0] - 1
        again = np.concatenate([best, left[word[left] == word[left + 1]]])
        rank[again], to[again] = ranks(again)
    none = [np.zeros(0, np.int64)]
    out = [np.concatenate(x) for x in zip(*done)] if done else none * 3
    order = np.lexsort((out[2], out[1]))
    who, what = [np.concatenate(x) for x in zip(*made)] if made else none * 2
    by = np.argsort(who, kind="stable")
    return out[0][order], out[1][order], out[2][order], who[by], what[by]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.all, self.size = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        while self.size + x.size > self.all.size:
            self.all = np.concatenate([self.all, np.zeros_like(self.all)])
        self.all[self.size : self.size + x.size] = x
        self.size += x.size


class Segmenter:
    """Segments every pre-token with its own key, keeping what it knows over the slices of a task.

    A node stands for a word and the merges skipped so far. It has the merges that follow if
    nothing more is skipped (the path) and the ids to which they lead. A pre-token tests its
    path by its key; the first merge that it skips leads to a child of the node.
    """

    def __init__(self, v: Vocabulary, dropout: float):
        self.v, self.dropout, self.slots = v, dropout, Slots(v.pair_key)
        self.pairs: dict[int, tuple[int, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.word, self.root = np.zeros(0, U), np.zeros(0, np.int64)  # sorted hashes of words, their nodes
        self.path, self.hashed, self.child = Grown(np.int32), Grown(U), Grown(np.int32)
        self.ids = Grown(np.int32)
        # of each node: where path and ids begin and their sizes, merges before the path, the node it comes from and what that skipped
        self.path_at, self.path_n, self.ids_at, self.ids_n = Grown(np.int64), Grown(np.int32), Grown(np.int64), Grown(np.int32)
        self.before, self.parent, self.barred = Grown(np.int32), Grown(np.int32), Grown(np.int32)

    def spelt(self, t: PreTokens, at: np.ndarray, word: np.ndarray, sym: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) for each word: unknown characters, from character ``at``, become their bytes."""
        size = np.where(sym == UNKNOWN, t.char_at[at + 1] - t.char_at[at], 1)
        own, k = ragged(size)
        ids = np.where(sym[own] == UNKNOWN, self.v.byte_base + t.data[t.char_at[at[own]] + k].astype(np.int64), sym[own])
        return ids.astype(np.int32), np.bincount(word, weights=size, minlength=words).astype(np.int64)

    def grow(self, t: PreTokens, symbols: np.ndarray, which: np.ndarray, parent: np.ndarray, barred: np.ndarray, before: np.ndarray) -> np.ndarray:
        """New nodes for the pre-tokens ``which``."""
        first = t.first_char[which]
        own, k = ragged(t.first_char[which + 1] - first)
        no, up, bar = [], parent.astype(np.int64), barred.astype(np.int64)
        on = np.flatnonzero(up >= 0)
        while on.size:  # what the node and those before it skip
            no.append(on << 18 | bar[on])
            bar[on], up[on] = self.barred.all[up[on]], self.parent.all[up[on]]
            on = on[up[on] >= 0]
        sym, word, start, who, what = _merged(self.v, self.slots, symbols[first[own] + k].astype(np.int64), own, k, np.sort(np.concatenate(no)) if no else np.zeros(0, np.int64))
        ids, n = self.spelt(t, first[word] + start, word, sym, which.size)
        made = np.bincount(who, minlength=which.size)
        late = np.arange(who.size) - (np.cumsum(made) - made)[who] >= before[who]
        what, made = what[late], made - before
        node = self.path_at.size + np.arange(which.size)
        self.path_at.add(self.path.size + np.cumsum(made) - made), self.path_n.add(made)
        self.ids_at.add(self.ids.size + np.cumsum(n) - n), self.ids_n.add(n)
        self.path.add(what), self.hashed.add(borders(what >> 12, what >> 6 & 63, what & 63)), self.child.add(np.full(what.size, -1))
        self.ids.add(ids), self.before.add(before), self.parent.add(parent), self.barred.add(barred)
        return node

    def roots(self, t: PreTokens, symbols: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The node without skips of each pre-token of ``which``."""
        h, one, inverse = np.unique(t.hash[which], return_index=True, return_inverse=True)
        at = vocabulary.look_up(h, self.word) if self.word.size else np.full(h.size, -1)
        node = np.where(at >= 0, self.root[at], -1) if self.word.size else at
        new = np.flatnonzero(at < 0)
        if new.size:
            none = np.full(new.size, -1)
            node[new] = self.grow(t, symbols, which[one[new]], none, none, np.zeros(new.size, np.int64))
            both = np.concatenate([self.word, h[new]])
            order = np.argsort(both, kind="stable")
            self.word, self.root = both[order], np.concatenate([self.root, node[new]])[order]
        return node[inverse]

    def nodes(self, t: PreTokens, symbols: np.ndarray, which: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The node at which each pre-token of ``which`` ends."""
        node = self.roots(t, symbols, which)
        if self.dropout <= 0:
            return node
        out, on, now = node.copy(), np.arange(which.size), node
        while on.size:
            begin = self.path_at.all[now]
            own, k = ragged(self.path_n.all[now])
            hit = np.flatnonzero(skipped(key[on][own], self.hashed.all[begin[own] + k], self.dropout))
            hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])] if hit.size else hit  # the first of each
            at, parent, on = begin[own[hit]] + k[hit], now[own[hit]], on[own[hit]]
            now = self.child.all[at].astype(np.int64)
            new = np.flatnonzero(now < 0)
            if new.size:
                _, one, inverse = np.unique(at[new], return_index=True, return_inverse=True)
                lead = new[one]
                got = self.grow(t, symbols, which[on[lead]], parent[lead], self.path.all[at[lead]], self.before.all[parent[lead]] + at[lead] - self.path_at.all[parent[lead]])
                self.child.all[at[lead]] = got
                now[new] = got[inverse]
            out[on] = now
        return out

    def __call__(self, t: PreTokens, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) for each pre-token."""
        if self.path_at.size > KEPT:
            self.clear()
        symbols = vocabulary.char_symbols(self.v, t)
        length = np.diff(t.first_char)
        short, long = np.flatnonzero(length <= LONG), np.flatnonzero(length > LONG)
        node = self.nodes(t, symbols, short, key[short])
        n = np.zeros(length.size, np.int64)
        n[short] = self.ids_n.all[node]
        heaped: list[tuple[int, np.ndarray]] = []
        if long.size:
            self.pairs = self.pairs or {int(a): (int(b), int(c)) for a, b, c in zip(self.v.pair_key, self.v.pair_id, self.v.pair_rank)}
            seen: dict[int, np.ndarray] = {}
            for w in long.tolist():
                first, h = int(t.first_char[w]), int(t.hash[w])
                ids = seen.get(h) if self.dropout <= 0 else None
                if ids is None:
                    got = agenda(self.v, symbols[first : first + int(length[w])].tolist(), int(key[w]), self.dropout, self.pairs)
                    sym, start = np.array(got, np.int64).reshape(-1, 2).T
                    ids = seen[h] = self.spelt(t, first + start, np.zeros(sym.size, np.int64), sym, 1)[0]
                    if self.dropout > 0:
                        seen.clear()
                heaped.append((w, ids))
                n[w] = ids.size
        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int32)
        own, k = ragged(n[short])
        out[begin[short][own] + k] = self.ids.all[self.ids_at.all[node][own] + k]
        for w, ids in heaped:
            out[begin[w] : begin[w] + ids.size] = ids
        return out, n


def encode_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, seed: int, dropout: float, by: Segmenter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their number) for each text; ``doc`` are 64-bit keys of the texts.

    ``by`` keeps what it knows for the next slice.
    """
    t = vocabulary.split(data, offsets)
    rows = offsets.size - 1
    if not t.hash.size:
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    key = mix(t.hash ^ mix(mix(doc ^ U(seed64("merge", seed)))[t.row] + t.place.astype(U)))
    ids, n = (by or Segmenter(v, dropout))(t, key)
    return ids, np.bincount(t.row, weights=n, minlength=rows).astype(np.int64)


def decode_slice(v: Vocabulary, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their number) for each list of ids."""
    size = np.diff(v.text_at)[ids]
    own, k = ragged(size)
    data = v.text[v.text_at[ids][own] + k]
    rows = np.repeat(np.arange(n.size), n)
    total = np.bincount(rows, weights=size, minlength=n.size).astype(np.int64)
    keep = np.ones(data.size, bool)
    keep[(np.cumsum(total) - total)[total > 0]] = False  # the blank put before
    return data[keep], total - (total > 0)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", check: str | None = None, seed: int = SEED, dropout: float = DROPOUT, model: str = vocabulary.MODEL, copy: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text; ``check`` names a column that says whether they decode to the text, ``copy`` one that numbers copies of a row."""
    for name in filter(None, (out, check)):
        if name.lower() in {c.lower() for c in docs.columns}:
            raise ValueError(f"there is a column {name} already; name another")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.load(model))
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    mine = F.coalesce(col(key).cast("long") if whole else F.xxhash64(col(key)), F.lit(0))
    if copy:
        mine = F.xxhash64(mine, col(copy))
    at = len(docs.columns)
    schema = T.StructType([*docs.schema, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(check, T.BooleanType(), False)] if check else [])])
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        by = Segmenter(v, dropout)
        for b in batches:
            doc = b.column(at).to_numpy(zero_copy_only=False).view(U)
            for i, j, data, off in slices(b.column(text_at), 1 << 20):
                ids, n = encode_slice(v, data, off, doc[i:j], seed, dropout, by=by)
                more = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids))]
                if check:
                    back, m = decode_slice(v, ids, n)
                    same = np.array_equal(m, np.diff(off)) and np.array_equal(back, data)
                    ok = [True] * (j - i) if same else [bytes(back[e - k : e]) == bytes(data[off[r] : off[r + 1]]) for r, (e, k) in enumerate(zip(np.cumsum(m).tolist(), m.tolist()))]
                    more.append(pa.array(ok, pa.bool_()))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(at)], *more], schema.names)

    # columns go by place, so names may clash in any way
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], mine.alias("key"))
    inner = T.StructType([*[T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)], *[T.StructField(f"c{at + i}", f.dataType, True) for i, f in enumerate(schema.fields[at:])]])
    names = schema.names

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, inner.names)

    return plain.mapInArrow(renamed, inner).toDF(*names)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", model: str = vocabulary.MODEL) -> DataFrame:
    """``df`` with the text of each list of ids; NULL gives the empty text."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already; name another with out=")
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.load(model))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            lists = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in s]
            n = np.array([x.size for x in lists], np.int64)
            data, m = decode_slice(shared.value, np.concatenate([np.zeros(0, np.int32), *lists]), n)
            end = np.cumsum(m)
            yield pd.Series([bytes(data[e - k : e]).decode("utf8", "replace") for e, k in zip(end.tolist(), m.tolist())])

    return df.withColumn(out, F.coalesce(text(col(ids)), F.lit("")))
