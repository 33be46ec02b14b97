"""Operator 3: rendezvous hashing of stable record keys over weighted shards.

Every record gets the shard with the least ``-ln(u) / weight``, u being a keyed hash of
(seed, shard name, key) in (0, 1). A shard's share of the records is in proportion to its
weight. A shard that is added takes records only for itself, and the records of a shard
that is removed are all that move. One narrow projection in generated code, no shuffle.

Defined cases: a NULL in a key column counts as the value ``\\N``, so such records are
assigned too; equal keys (repeated rows) go to one shard; a tie of scores goes to the
shard listed first; texts don't matter, keys may be of any type and length; an empty table gives an empty one; a weight of 0 gets no records;
other columns pass through, and the new column must not be one of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, unit, unit_sql

#: Production shards: sixteen, the later half twice as large.
SHARDS: dict[str, float] = {f"shard-{i:02d}": 1.0 if i < 8 else 2.0 for i in range(16)}


def shard_of(keys: Sequence[str], shards: Mapping[str, float] = SHARDS, seed: int = 0) -> Column:
    live = [(s, w) for s, w in shards.items() if w > 0]
    if not live or any(w < 0 for w in shards.values()):
        raise ValueError("give shards with weights of at least 0, one above it")
    key = F.concat_ws("\x1f", *[F.coalesce(col(k).cast("string"), F.lit("\\N")) for k in keys])
    scored = [F.struct((-F.ln(unit(F.concat(F.lit(f"{seed}|{s}|"), key))) / F.lit(float(w))).alias("at"), F.lit(n).alias("n"), F.lit(s).alias("shard")) for n, (s, w) in enumerate(live)]
    return (F.least(*scored) if len(scored) > 1 else scored[0]).getField("shard")


def assign_shards(df: DataFrame, keys: Sequence[str] = ("doc_id",), shards: Mapping[str, float] = SHARDS, seed: int = 0, out: str = "shard") -> DataFrame:
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already; name another with out=")
    return df.withColumn(out, shard_of(keys, shards, seed))


def write_shards(df: DataFrame, path: str, **kwargs) -> None:
    """Write one folder for each shard; no shuffle, so a task writes to every shard it has records of."""
    assign_shards(df, **kwargs).write.partitionBy(kwargs.get("out", "shard")).parquet(path)


def shard_sql(shards: Mapping[str, float] = SHARDS, seed: int = 0) -> str:
    names = ", ".join(f"{{'s': '{s}', 'w': {float(w)}::DOUBLE}}" for s, w in shards.items())
    score = f"-ln({unit_sql(f"'{seed}|' || x.s || '|' || coalesce(doc_id::VARCHAR, '\\N')")}) / x.w"
    return f"SELECT doc_id, list_min(list_transform([{names}], lambda x: {{'at': {score}, 's': x.s}})).s AS shard FROM documents"
