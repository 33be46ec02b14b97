"""Operator 6: a quality classifier by importance resampling.

Two generative models of hashed n-grams (words and runs of punctuation, one and two at a
time) are fitted: the target's on labelled texts of quality 1, the raw one's on all
documents. A document's log weight is ``TEMPER`` times the mean over its n-grams of
``log p_target - log p_raw``; the mean, so that a text doesn't weigh more for being long, and
so that weights are of the size of the noise that is added. That is Gumbel noise from a
keyed hash of doc_id; the k documents of the highest sums are taken, which samples k
documents without replacement in proportion to their weights.

k is a parameter, or the share ``keep`` of all rows (``KEEP`` = 0.9: the tenth that is least
like the target goes). Neither is fitted to the labels. The k-th largest sum is found
exactly, by a histogram of all of them and a look into one of its bins.

The n-grams have a number of buckets that grows as the square root of the characters of all
documents (``buckets``), as the number of distinct words does: 2**16 up to 67 million
characters, 2**17 for 0.8e9, 2**26 for 100 TB. That is what the driver gathers and broadcasts, 4 bytes each
(256 MiB at 100 TB). The labelled sample has a documented bound, ``LABELLED`` rows (the least
hashes of doc_id); the raw counts, the weights and the choice cover every document.

Defined cases: NULL and empty texts have no n-grams and the log weight 0; a very long text
needs memory in proportion to its length (some 100 bytes for each of its own); a NULL doc_id is hashed
as ``\\N``, any other by its string, so it may be of any type; repeated rows share their noise
and are kept or rejected alike; rows that tie at the k-th sum are all kept; if no label has
quality 1, or none has another, nothing can be told apart and everything is kept; an empty
table gives an empty one; the columns of ``docs`` pass through, whatever their names; the
column ``weight`` takes the next free name if its own is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, prepare, staged, unit
from .textops import U, hashes, mix, slices, tokens

LEAST, LABELLED, SEED, PRIOR = 1 << 16, 20_000, 6, 5.0
KEEP, TEMPER = 0.9, 20.0


def buckets(chars: int) -> int:
    """The power of two at or above 4 * sqrt(chars)."""
    return max(LEAST, 1 << (int(4 * max(1, chars) ** 0.5) - 1).bit_length())


def features(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram of one and two tokens."""
    start, end, row = tokens(data, offsets)
    h = hashes(data, start, end)
    same = row[1:] == row[:-1]
    two = mix(h[:-1] * U(3) + h[1:])[same]
    return (np.concatenate([h, two]) & U(size - 1)).astype(np.int64), np.concatenate([row, row[:-1][same]])


def counts(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of the buckets over the one text column, added up by the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, _, data, off in slices(b.column(0)):
                at, n = np.unique(features(data, off, size)[0], return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size, np.float64)
    got = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket.

    The target's share of a bucket is the raw text's, times (t + PRIOR) / (e + PRIOR), where t
    is the target's count and e what it would be if the target were like the raw text (the
    mean under a Gamma prior): what is too rare to tell says nothing either way.
    """
    base = (raw + 1) / (raw.sum() + raw.size)
    p = base * (target + PRIOR) / (base * target.sum() + PRIOR)
    return np.log(p / p.sum()) - np.log(base)


def log_weight(text: Column, ratio) -> Column:
    """The log weight of each text; ``ratio`` is the broadcast vector."""

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        out, of = np.zeros(len(s)), ratio.value
        for i, j, data, off in slices(pa.Array.from_pandas(s, type=pa.large_string())):
            bucket, row = features(data, off, of.size)
            n = np.bincount(row, minlength=j - i)
            out[i:j] = TEMPER * np.bincount(row, weights=of[bucket], minlength=j - i) / np.maximum(1, n)
        return pd.Series(out)

    return score(text)


def gumbel(key: Column, seed: int) -> Column:
    return -F.ln(-F.ln(unit(F.concat(F.lit(f"gumbel|{seed}|"), F.coalesce(key.cast("string"), F.lit("\\N"))))))


def sample_of(labels: DataFrame, what: str, limit: int) -> DataFrame:
    """(id, label) of ``limit`` labelled doc_ids at most, those of the least hashes; a doc_id labelled twice has its larger label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(what).isNotNull())
    one = known.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max(what).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, what: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, text, label) of the sample; ``limit`` bounds what is broadcast. Ids are compared as strings, so they may be of any type."""
    picked = staged(sample_of(labels, what, limit), "labels")
    own = docs.select(col(key).cast("string").alias("id"), col(text).alias("text")).where(F.col("text").isNotNull())
    return staged(own.join(F.broadcast(picked), "id"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, text: str = "text", key: str = "doc_id") -> np.ndarray | None:
    """The log ratios by bucket; None if the labels tell nothing apart."""
    prepare(docs.sparkSession)
    known = labelled_texts(docs, labels, "quality", limit, text, key)
    if known.select((F.col("label") == 1).alias("good")).distinct().count() < 2:
        return None
    size = buckets(docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0)
    return log_ratio(counts(known.where("label = 1").select("text"), size), counts(docs.select(col(text)), size)).astype(np.float32)


def kth_largest(keys: DataFrame, name: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value of a column that has more than k rows."""
    lo, hi = keys.agg(F.min(name), F.max(name)).first()
    while True:
        if lo == hi:
            return lo
        at = F.least(F.lit(bins - 1), F.floor((F.col(name) - lo) / (hi - lo) * bins)).cast("int")
        got = keys.where(F.col(name).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in got:
            if r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep: float = KEEP, limit: int = LABELLED, seed: int = SEED, text: str = "text", key: str = "doc_id", weight: str | None = None) -> DataFrame:
    """The k documents (or the share ``keep`` of them) that the Gumbel top-k sample takes; ``weight`` names a column for the log weight."""
    w, at = fresh(docs, weight or "log_weight", "gumbel_key")
    ratio = fit(docs, labels, limit, text, key)
    if ratio is None and k is None:
        return docs.withColumn(w, F.lit(0.0)) if weight else docs
    value = F.lit(0.0) if ratio is None else log_weight(col(text), docs.sparkSession.sparkContext.broadcast(ratio))
    keyed = docs.withColumn(w, value).withColumn(at, F.col(w) + gumbel(col(key), seed))
    keys = staged(keyed.select(at), "gumbel-keys")
    n = keys.count()
    most = -int(-n * keep // 1) if k is None else k
    cut = -np.inf if n <= most else np.inf if most <= 0 else kth_largest(keys, at, most)
    kept = keyed.where(F.col(at) >= F.lit(float(cut))) if cut > -np.inf else keyed
    return kept.select(*[col(c) for c in docs.columns], *([F.col(w)] if weight else []))
