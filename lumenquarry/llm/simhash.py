"""Operator 1: SimHash near-dedup by a segment-popcount embedding.

Fingerprints have ``BITS`` = 256 bits over the set of a text's words (lower case, without
punctuation; each distinct word counts once). Each is embedded as the bit counts of its 128
segments of two bits. The Manhattan distance of two such vectors is at most the Hamming
distance of the fingerprints, so it is a lower bound that may reject a pair.

Range join without a miss: the bits are cut into parts, and a part p has a number of bits
t_p such that the t_p + 1 add up to ``MAX_BITS`` + 1. So fingerprints within ``MAX_BITS`` differ
in at most t_p bits of some part. Each part has a family of masks (``families``): bit i of the part
has a vector m(i) of t_p + 1 bits, and for each v other than 0 there is a mask of the bits with
an odd m(i) & v. The vectors of t_p differing bits don't span the space, so for some v none of
them is in the mask: the pair agrees on the whole mask and shares its cell. This holds for every pair,
by proof and not by chance. A candidate is dropped where the part differs in more than t_p bits or the lower
bound exceeds ``MAX_BITS``, and accepted where the exact Hamming distance doesn't. The number
of parts is that of the least cost for the number of fingerprints: fewer parts have more masks
and finer cells. Equal fingerprints are put together beforehand.

A task compares two blocks of up to ``ROWS`` fingerprints (or one with itself) by some of the
masks: it sorts the masked parts, and looks at what is equal. Every two blocks meet under every
mask. What a task has already connected isn't compared again.

Cells of up to ``SMALL`` fingerprints compare all their pairs. In larger ones, where a group
of near copies may hold a large part of all documents, stars grow around leaders: a row within the
distance of a leader joins it, and only rows which the triangle inequality allows to be near
one of its members are compared with these, until one is found. Groups come out as from all
pairs (in the tests too), at a cost of rows times stars.

Connected groups of accepted pairs are found by label propagation with pointer jumping over
tables written to the shared folder. One document of each group stays: the least doc_id.

Shuffled are 33 bytes for each distinct fingerprint and task that it takes part in, no texts:
as many as there are blocks, or with few blocks as many as keep all cores busy. A task needs
some 170 bytes for each fingerprint of its two blocks. The number of tasks grows as the square of that of blocks.
Groups are rows (document, class), never
lists. Only rows of groups with more than one document go through a join in ``near_dedup``;
a Bloom filter over their doc_ids lets the others pass straight through.

Defined cases: NULL texts have no near copies and all stay, as do rows with a NULL doc_id
unless ``near_dedup`` is to compare them too (``null_keys``; they come after all others then);
texts without a word (empty ones too) have as only feature their characters without white
space; a very long text is one slice and needs memory in proportion to its length (some 100 bytes
for each of its own); doc_id may be of any type that has an order; of repeated rows or of several rows with one doc_id in a group one row stays (the
least of the remaining columns, and any one of rows that tie in all of them); two rows of one doc_id with different texts bring their
groups together; an empty table gives an empty one; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import col, discard, fresh, prepare, staged
from .exact_dedup import first_row
from .textops import CLASS, SPACE, SPACES, U, WORD, hashes, lowered, mix, seed64, slices, tokens

BITS, MAX_BITS = 256, 44
#: Random grids of the embedding, which found most pairs but not all (``recall``). They aren't used any more.
AXES, GRIDS, SEED = 11, 48, 1
#: Fingerprints of a block, parts of the least and bits of the most masks, tries for masks of even sizes.
ROWS, FEWEST, DEEPEST, TRIES = 1 << 20, 4, 12, 100
#: Fingerprints of a cell up to which all pairs are compared, and rows that a leader's members are compared with at once.
SMALL, BLOCK = 64, 256
WORDS = [f"f{i}" for i in range(BITS // 64)]
_SALT = [U(seed64("simhash", i)) for i in range(BITS // 64)]


def recall(segments: int, grids: int = GRIDS, axes: int = AXES) -> float:
    """The chance that a pair that differs in so many segments shares a cell of random grids, as the join had before ``families``."""
    return 1 - (1 - comb(BITS // 2 - segments, axes) / comb(BITS // 2, axes)) ** grids


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct words of each row, in the order of rows."""
    low = lowered(data)
    start, end, row = tokens(low, offsets, CLASS, WORD)
    h = hashes(low, start, end)
    bare = np.setdiff1d(np.arange(offsets.size - 1), row)
    if bare.size:
        rest = [bytes(b for b in bytes(data[offsets[i] : offsets[i + 1]]) if b not in SPACES) for i in bare.tolist()]
        h, row = np.concatenate([h, [U(seed64("bare", x)) for x in rest]]).astype(U), np.concatenate([row, bare])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def fingerprint(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BITS / 64 words for each text; every row of ``offsets`` has a feature."""
    h, row = features(data, offsets)
    out = np.empty((offsets.size - 1, len(WORDS)), U)
    first = np.searchsorted(row, np.arange(offsets.size - 1))
    count = np.diff(np.append(first, row.size))
    for k, salt in enumerate(_SALT):
        bits = np.unpackbits(mix(h ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(U)[:, 0]
    return out


def node_of(f: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint, so that rows of the grids needn't carry one besides."""
    h = np.zeros(len(f), U)
    for word, salt in zip(f.T, _SALT):
        h = mix(h ^ word + salt)
    return h


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, f0 .. f3, node) of all documents that have a text and a doc_id; ``node`` is a hash of the fingerprint."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in slices(b.column(1), 1 << 20):
                f = fingerprint(data, off)
                node, f = node_of(f).view(np.int64), f.view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(f[:, k]) for k in range(len(WORDS))], pa.array(node)], ["doc_id", *WORDS, "node"])

    own = docs.select(col(key).alias("doc_id"), col(text).alias("text")).where("doc_id is not null and text is not null")
    return own.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{w} long" for w in [*WORDS, "node"]))


def embed(word: Column) -> Column:
    """The bit counts of a word's 32 segments, two bits for each."""
    pairs, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(word, 1)
    return word.bitwiseXOR(next_bit).bitwiseAND(pairs).bitwiseOR(F.shiftleft(word.bitwiseAND(next_bit).bitwiseAND(pairs), 1))


@cache
def _masks(width: int, bits: int) -> np.ndarray:
    """For any ``bits`` - 1 of ``width`` bits, one of these masks at least has none of them."""
    rng, v = np.random.Generator(np.random.PCG64(width << 8 | bits)), np.arange(1, 1 << bits)
    best, least = None, np.inf
    for _ in range(max(1, TRIES >> max(0, bits - 8))):
        m = rng.choice(v, width, replace=width > v.size)
        inside = np.bitwise_count(v[:, None] & m[None]) & 1
        shared = (0.5 ** inside.sum(axis=1)).sum()
        if shared < least:
            best, least = inside, shared
    return (best.astype(U) << np.arange(width, dtype=U)[None]).sum(axis=1, dtype=U)


@cache
def _families(parts: int, most: int) -> list[tuple[int, int, int, np.ndarray]]:
    border = [BITS * p // parts for p in range(parts + 1)]
    depth = [(most + 1 + p) // parts for p in range(parts)]
    return [(a, b - a, k - 1, _masks(b - a, k)) for a, b, k in zip(border, border[1:], depth) if k]


def families(n: int, most: int = MAX_BITS, blocks: int = 1) -> list[tuple[int, int, int, np.ndarray]]:
    """(first bit, width, differing bits, masks) of each part, for a table of n fingerprints.

    The cost is that of sorting n rows with each block for each mask and of looking at the pairs of random
    fingerprints that share a cell.
    """
    least, best = np.inf, None
    for parts in range(FEWEST, BITS + 1):
        if -(-(most + 1) // parts) > DEEPEST:
            continue
        got = _families(parts, most)
        cost = sum(m.size * n * blocks + n * n * (0.5 ** np.bitwise_count(m)).sum() for _, _, _, m in got)
        if cost >= least:
            break
        least, best = cost, got
    if best is None:
        raise ValueError(f"most is {most}, but at most {DEEPEST * BITS - 1} bits may differ")
    return best


def _part(f: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits first to first + width (64 at most) of each fingerprint."""
    word, at = divmod(first, 64)
    out = f[:, word] >> U(at)
    if at + width > 64:
        out = out | f[:, word + 1] << U(64 - at)
    return out & U((1 << width) - 1)


def _lower_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the embeddings of rows of fingerprints."""
    pairs, total = U(0x5555555555555555), np.zeros(len(a), np.int64)
    for x, y in zip(a.T, b.T):
        x, y = (x & pairs, (x >> U(1)) & pairs), (y & pairs, (y >> U(1)) & pairs)
        # counts differ by 2 where 00 meets 11, by 1 where one of them is 01 or 10 and the other isn't
        odd = (x[0] ^ x[1]) ^ (y[0] ^ y[1])
        far = ~(x[0] ^ x[1]) & ~(y[0] ^ y[1]) & (x[0] ^ y[0]) & pairs
        total += np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(far)
    return total


def _stars(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of one cell that connect what all its pairs within ``most`` connect."""
    left, a, b = np.arange(len(f)), [], []
    while left.size > 1:
        leader, rest = left[0], left[1:]
        d = np.bitwise_count(f[rest] ^ f[leader]).sum(axis=1, dtype=np.int64)
        joins = d <= most
        members, far = rest[joins], d[joins]
        a.append(np.full(members.size, leader)), b.append(members)
        # a row within most of a member is at most that farther from the leader than the member
        able = ~joins & (d <= most + (far.max() if far.size else 0))
        near, gap = rest[able], d[able]
        if near.size:
            order = np.argsort(-far, kind="stable")
            members, far = members[order], far[order]
            for i in range(0, members.size, BLOCK):
                part = members[i : i + BLOCK]
                open_ = np.flatnonzero(gap - far[i] <= most)
                if not open_.size:
                    break
                keep = np.ones(near.size, bool)
                for rows in np.split(open_, range(16 * BLOCK, open_.size, 16 * BLOCK)):
                    hit = np.bitwise_count(f[near[rows], None] ^ f[part][None]).sum(axis=2, dtype=np.int64) <= most
                    found = hit.any(axis=1)
                    a.append(part[hit[found].argmax(axis=1)]), b.append(near[rows[found]])
                    keep[rows[found]] = False
                near, gap = near[keep], gap[keep]
                if not near.size:
                    break
        left = rest[~joins]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _near(f: np.ndarray, parts: list[tuple[int, int, int, np.ndarray]], most: int, own: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of the pairs within ``most`` that share a cell; a pair may come several times.

    If ``own`` is less than all rows, only pairs of one of the first ``own`` rows and another one count. With
    ``label`` only pairs of different groups are looked for, and it gets the least row of each row's group.
    """
    n = len(f)
    low = U((1 << max(1, (n - 1).bit_length())) - 1)
    row, odd = np.arange(n, dtype=U), U(0x9E3779B97F4A7C15)
    for first, width, differ, masks in parts:
        part = _part(f, first, width)
        for mask in masks:
            # equal keys stand together; keys that only have equal hashes are candidates too
            s = part & mask
            s *= odd
            s &= ~low
            s |= row
            s.sort()
            left = np.flatnonzero((s[1:] ^ s[:-1]) <= low)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            if label is not None and left.size >= SMALL:
                run = np.flatnonzero(np.append(True, np.diff(left) > 1))
                size = np.diff(np.append(run, left.size))
                for at, k in zip(left[run[size >= SMALL]].tolist(), size[size >= SMALL].tolist()):
                    rows = (s[at : at + k + 1] & low).astype(np.int64)
                    if (label[rows] != label[rows[0]]).any():
                        i, j = _stars(f[rows], most)
                        found.append((rows[i], rows[j]))
                left = left[np.repeat(size < SMALL, size)]
            step = 1
            while left.size:
                i, j = (s[left] & low).astype(np.int64), (s[left + step] & low).astype(np.int64)
                ok = np.bitwise_count(part[i] ^ part[j]) <= differ
                if label is not None:
                    ok &= label[i] != label[j]
                if own < n:
                    ok &= (i < own) != (j < own)
                i, j = i[ok], j[ok]
                ok = _lower_bound(f[i], f[j]) <= most
                i, j = i[ok], j[ok]
                d = np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64)
                ok = d <= most
                if ok.any():
                    i, j = i[ok], j[ok]
                    if label is None:
                        yield i, j, d[ok]
                    else:
                        found.append((i, j))
                step += 1
                left = left[left + step < n]
                left = left[(s[left] ^ s[left + step]) <= low]
            if found:
                i, j = map(np.concatenate, zip(*found))
                nodes, root = _forest(label[i], label[j])
                to = np.arange(n)
                to[nodes] = root
                label[:] = to[label]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node of its group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: a.size], at[a.size :], np.arange(nodes.size)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def near_pairs(reps: DataFrame, most: int = MAX_BITS, forest: bool = False, rows: int = ROWS) -> DataFrame:
    """(a, b, distance) of all pairs of distinct fingerprints (f0 .. f3) within ``most``, by their nodes, a < b; a pair may come several times.

    With ``forest`` each task gives only edges that connect what its pairs connect.
    """
    spark = reps.sparkSession
    n = reps.count()
    blocks = max(1, -(-n // rows))
    parts = families(n, most, blocks)
    pairs = blocks * (blocks + 1) // 2
    # few blocks share the masks out, so that all cores have work
    shares = max(1, min(-(-3 * spark.sparkContext.defaultParallelism // pairs), sum(m.size for *_, m in parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        task, mine, words = t.column(0).to_numpy(), t.column(1).to_numpy(), np.stack([t.column(2 + i).to_numpy().view(U) for i in range(len(WORDS))], axis=1)
        del t, got
        for one in np.unique(task).tolist():
            # rows of the task's first block come first
            at = np.flatnonzero(task == one)
            at = np.concatenate([at[mine[at]], at[~mine[at]]])
            f, own, share = words[at], int(np.count_nonzero(mine[at])), one % shares
            node = node_of(f).view(np.int64)
            some = [(a, w, k, m[share::shares]) for a, w, k, m in parts]
            label = np.arange(len(f)) if forest else None
            for i, j, d in _near(f, some, most, own, label):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(d.astype(np.int32))], ["a", "b", "distance"])
            if forest:
                i = np.flatnonzero(label != np.arange(len(f)))
                j = label[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(np.zeros(i.size, np.int32))], ["a", "b", "distance"])

    block = F.pmod(F.xxhash64(*WORDS), F.lit(blocks)).cast("int")
    placed = reps.select(*WORDS, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks * shares - 1))).alias("k"))
    # the pair of blocks lo <= hi is the one after all those of a lesser lo
    other = F.expr(f"k div {shares}").cast("int")
    lo, hi = F.least("block", other), F.greatest("block", other)
    pair = F.expr("lo * (2 * blocks - lo + 1) div 2 + hi - lo")
    placed = placed.select(*WORDS, "block", "k", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(blocks).cast("long").alias("blocks"))
    placed = placed.select((pair * shares + F.col("k") % shares).alias("task"), (F.col("block") == F.col("lo")).alias("mine"), *WORDS)
    return placed.repartitionById(pairs * shares, F.col("task").cast("int")).mapInArrow(run, "a long, b long, distance int")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected group, for every node of ``edges`` (a, b)."""
    one = staged(edges.select("a", "b").where("a <> b").distinct(), "near-edges")
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "near-roots")
    while True:
        seen = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("seen"))
        hop = seen.join(label, F.col("a") == F.col("node")).select("node", "root", F.least("root", "seen").alias("next"))
        jump = label.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        new = staged(hop.join(jump, F.col("next") == F.col("at"), "left").select("node", F.coalesce(F.least("beyond", "next"), "next").alias("root"), (F.coalesce(F.least("beyond", "next"), "next") != F.col("root")).alias("moved")), "near-roots")
        moved = new.where("moved").limit(1).count()
        discard(label)
        label = new.drop("moved")
        label._staged_at = new._staged_at
        if not moved:
            discard(one)
            return label


def classes(docs: DataFrame, most: int = MAX_BITS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id): every document with a text, and the least doc_id of its group of near copies."""
    f = staged(fingerprints(docs, text, key), "fingerprints")
    reps = staged(f.groupBy(*WORDS).agg(F.first("node").alias("node")), "distinct-fingerprints")
    grid = near_pairs(reps, most, forest=True)
    # fingerprints of one doc_id with several texts belong together
    own = f.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    again = f.join(own, "doc_id").select("a", F.col("node").alias("b"))
    root = components(grid.select("a", "b").union(again)).withColumnRenamed("node", "at")
    placed = f.select("doc_id", "node").join(root, F.col("node") == F.col("at"), "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    placed = staged(placed.distinct(), "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class"))
    # classes of one document needn't be looked up, and those are most
    several = least.where("n_class > 1").select(F.col("root").alias("r"), "class_id", "n_class")
    return placed.join(several, F.col("root") == F.col("r"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_class", F.lit(1).cast("bigint")).alias("n_class"))


def near_dedup(docs: DataFrame, most: int = MAX_BITS, text: str = "text", key: str = "doc_id", null_keys: bool = False) -> DataFrame:
    """One whole row of each group of near copies, and all rows that are in none; with ``null_keys`` rows with a NULL ``key`` are compared too."""
    names, by = docs.columns, key
    if null_keys and docs.where(col(key).isNull() & col(text).isNotNull()).limit(1).count():
        # rows without a key of their own are told apart by their texts
        (by,) = fresh(docs, "near_key")
        digest = F.when(col(key).isNull(), F.sha2(col(text).cast("binary"), 256))
        docs = docs.withColumn(by, F.struct(col(key).isNull().alias("no_key"), col(key).alias("key"), digest.alias("digest")))
    found = classes(docs.select(col(by).alias(by), col(text).alias(text)), most, text, by)
    many = staged(found.where("n_class > 1").select(F.col("doc_id").alias("d"), F.col("class_id").alias("root")), "near-groups")
    (row_key,) = fresh(docs, "row_key")
    # rows that share a doc_id are a group too
    shared = docs.select(col(by).alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d", F.col("d").alias("root"))
    many = staged(many.union(shared.join(many, "d", "left_anti")), "near-groups")
    mine, hashed = col(by), lambda c: F.xxhash64(F.lit("near"), c)
    maybe = bloom.maybe(hashed(mine), bloom.containing(many.select(hashed(F.col("d")).alias("h")), many.count())) & mine.isNotNull() & col(text).isNotNull()
    (flag,) = fresh(docs, "maybe_grouped")
    marked = docs.withColumn(flag, maybe)
    own = [col(c) for c in names]
    rest, some = marked.where(~F.col(flag)).select(*own), marked.where(F.col(flag)).drop(flag)
    groups = many.select(F.col("d").alias(fresh(docs, "group_d")[0]), F.col("root").alias(row_key))
    joined = some.join(groups, mine == F.col(groups.columns[0]), "left").drop(groups.columns[0])
    alone = joined.where(F.col(row_key).isNull()).select(*own)
    return rest.unionByName(alone).unionByName(first_row(joined.where(F.col(row_key).isNotNull()), row_key, names, text, key))
