"""Similarity of vectors: prototypes, pairs and nearest neighbours within a group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def best_similarity(vector: Column, prototypes: Sequence[Sequence[float]]) -> Column:
    """The highest cosine with a prototype, 0 at least. The prototypes are a few literals: no join, no shuffle."""
    if not prototypes:
        return F.lit(0.0)
    given = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in prototypes])
    return F.greatest(F.lit(0.0), F.array_max(F.transform(given, lambda p: S.cosine(vector, p))))


def matches_prototypes(vector: Column, prototypes: Sequence[Sequence[float]], threshold: float) -> Column:
    """False for a vector that is missing."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & (best_similarity(vector, prototypes) >= threshold)


#: Rows of a group that are multiplied with as many others at once.
BLOCK = 2048


def _matrix(pdf: pd.DataFrame, vector: str) -> np.ndarray:
    """Unit vectors; those of no length are zero."""
    v = np.stack([np.asarray(x, np.float64) for x in pdf[vector]])
    norm = np.sqrt((v * v).sum(axis=1))
    return np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)


def _blocked(df: DataFrame, group: str, key: str, vector: str):
    """Two sides of (g, i, j): each group's rows in blocks, every block with every block of the group."""
    own = df.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")).where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    blocks = own.groupBy(F.col("g").alias("of")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    placed = own.join(blocks, F.col("g").eqNullSafe(F.col("of"))).withColumn("b", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    all_ = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = placed.select("g", F.col("b").alias("i"), all_.alias("j"), "k", "v").toDF("g", "i", "j", "k", "v")
    b = placed.select("g", all_.alias("i"), F.col("b").alias("j"), "k", "v").toDF("g2", "i2", "j2", "k2", "v2")
    return a.groupBy("g", "i", "j").cogroup(b.groupBy("g2", "i2", "j2"))


def pairs_over(df: DataFrame, group: str, key: str, vector: str, threshold: float) -> DataFrame:
    """(group, a, b, cosine) of the pairs of a group that reach the threshold, by products of blocks; vectors of a group have one length."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"g": [], "a": [], "b": [], "cosine": []})
        sims, ka, kb = _matrix(a, "v") @ _matrix(b, "v2").T, a["k"].to_numpy(), b["k2"].to_numpy()
        i, j = np.nonzero((sims >= threshold) & (ka[:, None] < kb[None]))
        return pd.DataFrame({"g": [a["g"].iloc[0]] * i.size, "a": ka[i], "b": kb[j], "cosine": sims[i, j]})

    found = _blocked(df, group, key, vector).applyInPandas(run, f"g {kinds[group]}, a {kinds[key]}, b {kinds[key]}, cosine double")
    return found.withColumnRenamed("g", group)


def nearest(df: DataFrame, group: str, key: str, vector: str, k: int = 2) -> DataFrame:
    """(group, key, neighbour, rank, cosine): the k nearest others of each row's group, the lesser key first among equals.

    Blocks of a group are multiplied with each other in tasks of their own, so no group is one
    task and no pair is a row; a block hands on k rows for each of its own, which are merged.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"g": [], "k": [], "neighbour": [], "cosine": []})
        b = b.sort_values("k2", kind="stable")
        ka, kb = a["k"].to_numpy(), b["k2"].to_numpy()
        sims = np.round(_matrix(a, "v") @ _matrix(b, "v2").T, 12)
        sims[ka[:, None] == kb[None]] = -np.inf
        most = min(k, len(b))
        best = np.argsort(-sims, axis=1, kind="stable")[:, :most]
        cosine = np.take_along_axis(sims, best, axis=1).ravel()
        out = pd.DataFrame({"g": [a["g"].iloc[0]] * cosine.size, "k": np.repeat(ka, most), "neighbour": kb[best].ravel(), "cosine": cosine})
        return out[np.isfinite(cosine)]

    found = _blocked(df, group, key, vector).applyInPandas(run, f"g {kinds[group]}, k {kinds[key]}, neighbour {kinds[key]}, cosine double")
    rank = F.row_number().over(Window.partitionBy("g", "k").orderBy(F.desc("cosine"), "neighbour")).cast("bigint")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("g").alias(group), F.col("k").alias(key), "neighbour", "rank", "cosine")
