"""Operator 4: exact dedup by two-pass Bloom filtering.

Pass one sends a 64-bit hash of every text, 8 bytes a row, to partitions by its value, where
a streaming Bloom filter finds those that may occur again (``bloom.again``; a partition has
its own filter, sized to its rows). Pass two splits the rows by a broadcast filter of these
hashes: rows that may be repeated shuffle on the SHA-256 of their text, aggregated before the
shuffle so that a hot group is small by then; all others pass straight through. What is
broadcast grows with the repeated texts, not with the rows, and is bounded (256 MiB). What a
filter lets pass wrongly is a group of one in the shuffle: results are exact.

Defined cases: of equal texts the row with the least doc_id stays (a NULL doc_id comes after
all others; between rows of one doc_id the least of the remaining columns in their order,
NULL first, so the result doesn't depend on row order; rows alike in all columns that have an order are ties, of which any one
stays); texts are equal if all characters are, case and white space included, however long they are; empty texts equal one another; a NULL text equals none,
and such rows all stay; doc_id may be of any type that has an order; an empty table gives an empty one; columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import col, fresh, prepare, staged


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def first_row(rows: DataFrame, group: str, names: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each group the whole row of the least ``key``, NULL last; then of the least other columns, ``text`` at the end."""
    fields = [col(c).alias(f"c{i}") for i, c in enumerate(names)]
    others = [c for c in names if c not in (key, text) and _orderable(rows.schema[c].dataType)]
    rank = F.struct(col(key).isNull().alias("k0"), col(key).alias("k1"), *[col(c).alias(f"s{i}") for i, c in enumerate([*others, text])])
    kept = rows.groupBy(col(group).alias("g")).agg(F.min_by(F.struct(*fields), rank).alias("r"))
    return kept.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])


def _split(docs: DataFrame, text: str, max_cells: int):
    """Rows whose text may occur again, and the rest."""
    prepare(docs.sparkSession)
    (h,) = fresh(docs, "bloom_hash")
    key = F.xxhash64(F.lit("exact"), col(text))
    keys = docs.where(col(text).isNotNull()).select(key.alias("h"))
    twice = staged(bloom.again(keys, docs.count()), "repeated")
    found = bloom.containing(twice, twice.count(), max_cells)
    (flag,) = fresh(docs, "bloom_repeated")
    marked = docs.withColumn(h, key).withColumn(flag, bloom.maybe(F.col(h), found) & col(text).isNotNull())
    return marked.where(F.col(flag)).drop(h, flag), marked.where(~F.col(flag)).drop(h, flag)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_cells: int = bloom.MAX_CELLS) -> DataFrame:
    """One whole row of each group of equal texts."""
    again, rest = _split(docs, text, max_cells)
    (g,) = fresh(docs, "text_digest")
    kept = first_row(again.withColumn(g, F.sha2(col(text).cast("binary"), 256)), g, docs.columns, text, key)
    return rest.unionByName(kept)


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", max_cells: int = bloom.MAX_CELLS) -> DataFrame:
    """(doc_id, n_copies): the kept document of each group of equal texts and the group's size."""
    docs = docs.select(col(key).alias("doc_id"), col(text).alias("text"))
    again, rest = _split(docs, "text", max_cells)
    kept = again.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("g")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
    return rest.select("doc_id", F.lit(1).cast("bigint").alias("n_copies")).unionByName(kept.select("doc_id", "n_copies"))


SQL = """
SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, 1::BIGINT FROM documents WHERE text IS NULL
"""
