"""Operator 7: token counts by trie-shared dynamic programming.

The distinct pre-tokens of a slice of texts are put in a trie, level by level. A node holds
the best unigram score of its prefix and the tokens of that segmentation; it is computed
once from its ancestors (a piece of k characters leads from the ancestor k levels up),
however many pre-tokens share the prefix. The counts at the terminals are stored and looked
up for every occurrence, over all slices of a task. On ties the longest last piece wins. A
character that is no piece costs the lowest score less 10 and counts a token for each of its
bytes. Pre-tokens of over ``LONG`` characters go through the same programme one by one, in
chunks, at a cost in proportion to their length.

The vocabulary file holds a merge model, whose scores are ranks and no probabilities. So a
unigram model over its pieces is fitted first, to all documents: their distinct pre-tokens
are counted by the cluster (summed up in the tasks before the shuffle) and written to the
shared folder; the first scores come from the file's own segmentation of them, and ``ROUNDS``
of hard EM follow: the best segmentation of each pre-token under the scores (the trie run
backwards from the terminals) counts its pieces as often as the pre-token occurs, and a
piece's score becomes the logarithm of its share, each count raised by ``SMOOTHING``. Rounds
read the pre-tokens only, not the texts; each sends the driver a row a piece, at most the vocabulary.

Two narrow passes over the texts; only pre-tokens with their counts are shuffled.

Defined cases: NULL and empty texts have 0 tokens; a very long text needs memory in
proportion to its length (some 100 bytes for each of its own); blanks and line ends count as the model
spells them; the model's meta symbol itself, where a text has it, is spelt as its bytes;
repeated rows count alike; an empty table gives an empty one, and where no piece is met all have one score;
doc_id isn't looked at; columns of ``docs`` pass through, and a name that is taken is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, vocabulary
from .common import col, prepare, staged
from .textops import U, slices
from .vocabulary import PreTokens, Spans, Vocabulary

PENALTY, SMOOTHING, ROUNDS = 10.0, 0.5, 2
#: Pre-tokens whose counts a task keeps; when it has more, it starts anew.
KEPT = 2_000_000
#: Characters from which on a pre-token isn't put in the trie, and those of it that are looked at at once.
LONG, CHUNK = 200, 1 << 16


def lowest(v: Vocabulary) -> float:
    return v.score[v.piece_id].min() - PENALTY


def long_count(v: Vocabulary, t: PreTokens, which: int, weight: int = 0, into: np.ndarray | None = None) -> int:
    """Tokens of one long pre-token; with ``into`` the pieces of its segmentation are added there ``weight`` times."""
    first, end = int(t.first_char[which]), int(t.first_char[which + 1])
    data = t.data[t.char_at[first] : t.char_at[end]]
    at = t.char_at[first : end + 1] - t.char_at[first]
    bare, n, most = lowest(v), at.size - 1, v.longest
    best, count, back = [0.0], [0], []
    for lo in range(0, n, CHUNK):
        hi, begin = min(n, lo + CHUNK), max(0, lo - most)
        span = Spans(data[at[begin] : at[hi]])
        ends, steps, ids = [], [], []
        for k in range(1, most + 1):
            stop = np.arange(max(lo + 1, k), hi + 1)
            if not stop.size:
                break
            piece = vocabulary.pieces_of(v, span(at[stop - k] - at[begin], at[stop] - at[begin]))
            ok = np.flatnonzero(piece >= 0) if k > 1 else np.arange(stop.size)
            ends.append(stop[ok]), steps.append(np.full(ok.size, k)), ids.append(piece[ok])
        e, k, i = map(np.concatenate, (ends, steps, ids))
        order = np.lexsort((k, e))
        e, k, i = e[order], k[order], i[order]
        score = np.where(i >= 0, v.score[i], bare)
        tokens = np.where(i >= 0, 1, at[e] - at[e - 1])
        now, top, many, how = -1, 0.0, 0, (0, 0)
        for stop, step, piece, s, add in zip(e.tolist(), k.tolist(), i.tolist(), score.tolist(), tokens.tolist()):
            if stop != now:
                if now >= 0:
                    best.append(top), count.append(many), back.append(how)
                now, top = stop, -np.inf
            got = best[stop - step] + s
            if got >= top:
                top, many, how = got, count[stop - step] + add, (step, piece)
        best.append(top), count.append(many), back.append(how)
    if into is not None:
        while n:
            step, piece = back[n - 1]
            if piece >= 0:
                into[piece] += weight
            n -= step
    return count[-1]


def counts(v: Vocabulary, t: PreTokens, which: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Tokens of the pre-tokens ``which`` (their numbers), by one trie; with ``weight`` (of each) how often each piece occurs instead."""
    length = (t.first_char[1:] - t.first_char[:-1])[which]
    total = None if weight is None else np.zeros(v.size, np.int64)
    back = np.empty(which.size, np.int64)
    for w in np.flatnonzero(length > LONG).tolist():
        back[w] = long_count(v, t, int(which[w]), 0 if weight is None else int(weight[w]), total)
    short = np.flatnonzero(length <= LONG)
    order = short[np.argsort(-length[short], kind="stable")]
    which, length = which[order], length[order]
    span, first = Spans(t.data), t.first_char[which]
    start = t.char_at[first]
    out = np.zeros(which.size, np.int64)
    # the last levels: the node of each word, and the nodes' scores and counts
    nodes, score, count, low = [np.zeros(which.size, np.int32)], [np.zeros(1)], [np.zeros(1, np.int64)], lowest(v)
    trail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each level: the nodes' last pieces, their length, where they begin
    ends: list[tuple[slice, np.ndarray]] = []
    for depth in range(1, int(length[0]) + 1 if length.size else 1):
        alive = int(np.searchsorted(-length, -depth, "right"))
        end = t.char_at[first[:alive] + depth]
        _, one, node = np.unique(span(start[:alive], end), return_index=True, return_inverse=True)
        best, n = np.full(one.size, -np.inf), np.zeros(one.size, np.int64)
        last, step, origin = np.full(one.size, -1, np.int64), np.ones(one.size, np.int64), np.zeros(one.size, np.int64)
        at, head, on = end[one], first[one] + depth, np.arange(one.size)
        for k in range(1, min(v.longest, depth) + 1):
            begin = t.char_at[head[on] - k]
            h = span(begin, at[on])
            piece = vocabulary.pieces_of(v, h)
            up = nodes[-k][one[on]]
            ok = np.flatnonzero(piece >= 0)
            got, to = score[-k][up[ok]] + v.score[piece[ok]], on[ok]
            better = got >= best[to]
            to, ok = to[better], ok[better]
            best[to], n[to] = got[better], count[-k][up[ok]] + 1
            last[to], step[to], origin[to] = piece[ok], k, up[ok]
            if k == 1:
                bare = np.flatnonzero(piece < 0)
                best[bare], n[bare], origin[bare] = score[-1][up[bare]] + low, count[-1][up[bare]] + (at - begin)[bare], up[bare]
            on = on[v.tails[h & U(v.tails.size - 1)]]  # longer pieces end with this
            if not on.size:
                break
        nodes.append(node.astype(np.int32))
        score.append(best)
        count.append(n)
        ended = slice(int(np.searchsorted(-length, -depth, "left")), alive)
        out[ended] = n[node[ended]]
        if weight is not None:
            trail.append((last, step, origin))
            ends.append((ended, node[ended]))
        if len(nodes) > v.longest:
            nodes.pop(0), score.pop(0), count.pop(0)
    if weight is not None:
        passed = [np.zeros(1, np.int64), *[np.zeros(x[0].size, np.int64) for x in trail]]
        for level, (own, node) in enumerate(ends, 1):
            np.add.at(passed[level], node, weight[order[own]])
        for level in range(len(trail), 0, -1):
            (last, step, origin), w = trail[level - 1], passed[level]
            np.add.at(total, last[last >= 0], w[last >= 0])
            for k in np.unique(step).tolist():
                own = step == k
                np.add.at(passed[level - k], origin[own], w[own])
        return total
    back[order] = out
    return back


class Counter:
    """Counts texts, keeping what it knows of pre-tokens."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.n = v, np.zeros(0, U), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        t = vocabulary.split(data, offsets)
        h, one, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
        at = vocabulary.look_up(h, self.known) if self.known.size else np.full(h.size, -1)
        n = np.where(at >= 0, self.n[at], 0) if self.known.size else np.zeros(h.size, np.int64)
        new = np.flatnonzero(at < 0)
        if new.size:
            n[new] = counts(self.v, t, one[new])
            if self.known.size + new.size > KEPT:
                self.known, self.n = h, n
            else:
                both = np.concatenate([self.known, h[new]])
                order = np.argsort(both, kind="stable")
                self.known, self.n = both[order], np.concatenate([self.n, n[new]])[order]
        return np.bincount(t.row, weights=n[inverse], minlength=offsets.size - 1).astype(np.int64)


def pre_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every distinct pre-token of all texts, as bytes, with its number."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, off in slices(b.column(0), 1 << 20):
                t = vocabulary.split(data, off)
                if not t.hash.size:
                    continue
                _, one, n = np.unique(t.hash, return_index=True, return_counts=True)
                begin, end = t.char_at[t.first_char[one]], t.char_at[t.first_char[one + 1]]
                size = end - begin
                own, k = np.repeat(begin - (np.cumsum(size) - size), size), np.arange(int(size.sum()))
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), one.size, [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(t.data[own + k])])
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def joined(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some bytes: the more words a trie has, the more they share."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def piece_counts(words: DataFrame, v: Vocabulary, merges: bool = False) -> np.ndarray:
    """How often each piece stands in the best segmentation of (word, n) under the scores of ``v``; with ``merges`` in the file's own."""
    shared = words.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        by, total = pieces.Segmenter(v, 0.0), np.zeros(v.size, np.int64)
        for b in joined(batches):
            weight = b.column(1).to_numpy()
            for i, j, data, off in slices(b.column(0), 1 << 20):
                t = vocabulary.whole(data, off)
                if merges:
                    ids, n = by(t, np.zeros(t.hash.size, U))
                    np.add.at(total, ids, np.repeat(weight[i:j], n))
                else:
                    total += counts(v, t, np.arange(t.hash.size), weight[i:j])
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["piece", "n"])

    out = np.zeros(v.size, np.int64)
    for r in words.select("word", "n").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def with_scores(v: Vocabulary, n: np.ndarray) -> Vocabulary:
    score = np.zeros(v.size)
    of = n[v.piece_id] + SMOOTHING
    score[v.piece_id] = np.log(of / of.sum())
    return replace(v, score=score)


def fit(docs: DataFrame, text: str = "text", model: str = vocabulary.MODEL, rounds: int = ROUNDS) -> Vocabulary:
    """The vocabulary with the unigram log probabilities of its pieces over all documents."""
    words = staged(pre_tokens(docs, text), "pre-tokens")
    v = vocabulary.load(model)
    v = with_scores(v, piece_counts(words, v, merges=True))
    for _ in range(rounds):
        v = with_scores(v, piece_counts(words, v))
    return v


def token_count(docs: DataFrame, text: str = "text", out: str = "n_tokens", model: str = vocabulary.MODEL) -> DataFrame:
    """``docs`` with the number of unigram tokens of each text."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out} already; name another with out=")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text, model))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for s in batches:
            got = np.zeros(len(s), np.int64)
            for i, j, data, off in slices(pa.Array.from_pandas(s, type=pa.large_string()), 1 << 20):
                got[i:j] = counter(data, off)
            yield pd.Series(got)

    return docs.withColumn(out, count(col(text)))
