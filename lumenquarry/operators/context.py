"""Context of sentences: neighbours in the text, and similar sentences of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import vectors


def neighbours(n: int, by: str = "doc_id", order: str = "sent_index", text: str = "sent") -> Column:
    """The n texts before and after, the row's own left out."""
    w = Window.partitionBy(by).orderBy(order)
    if n <= 0:
        return F.array().cast("array<string>")
    return F.concat(F.collect_list(text).over(w.rowsBetween(-n, -1)), F.collect_list(text).over(w.rowsBetween(1, n)))


def _joined(parts: Column, most: int) -> Column:
    whole = F.array_join(F.filter(F.transform(parts, lambda x: X.strip(x)), lambda x: x != ""), " ")
    return F.substring(F.regexp_replace(X.strip(whole), r"\s+", " "), 1, most)


def with_context(sentences: DataFrame, enabled: bool = True, around: int = 1, similar: int = 2, most: int = 600, vector: str | None = None, by: str = "doc_id", order: str = "sent_index", text: str = "sent") -> DataFrame:
    """``sentences`` with ``context``: the neighbours in order, then the most similar others.

    A neighbour may come again as a similar sentence. ``vector`` names the column of
    embeddings; without it there are neighbours only.
    """
    if not enabled:
        return sentences.withColumn("context", F.lit(""))
    df = sentences.withColumn("near", neighbours(around, by, order, text))
    if vector is None or similar <= 0:
        return df.withColumn("context", _joined(F.col("near"), most)).drop("near")
    close = vectors.nearest(sentences, by, order, vector, similar)
    said = sentences.select(F.col(by).alias("d"), F.col(order).alias("neighbour"), F.col(text).alias("said"))
    close = close.withColumnRenamed(by, "d").join(said, ["d", "neighbour"]).groupBy("d", order).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "said"))), lambda x: x["said"]).alias("similar"))
    df = df.join(close.withColumnRenamed("d", by), [by, order], "left")
    return df.withColumn("context", _joined(F.concat("near", F.coalesce("similar", F.array().cast("array<string>"))), most)).drop("near", "similar")
