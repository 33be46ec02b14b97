"""Shared helpers: tables, names that are free, hashes that any SQL engine has."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import discard, fresh_path, shared_dir, staged

__all__ = ["col", "discard", "fresh", "fresh_path", "integral", "prepare", "shared_dir", "staged", "table", "unit", "unit_sql"]
ROOT = str(Path(__file__).resolve().parents[2])


#: Texts differ in length by far: batches that go to Python are bounded in bytes, as memory is.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_MARK = "lumenquarry.batches"


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (on a cluster ship it with ``--py-files``).

    Arrow batches get smaller, once a session, unless its creator set them.
    """
    if spark.conf.get(_MARK, None) is None:
        given = dict(spark.sparkContext.getConf().getAll())
        for name, value in BATCHES.items():
            if name not in given:
                spark.conf.set(name, value)
        spark.conf.set(_MARK, "set")
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever their case."""
    used, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, n = base, 0
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def unit(key: Column) -> Column:
    """A hash of a string in (0, 1), the same in any SQL engine: 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def unit_sql(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 12))::BIGINT)::DOUBLE + 0.5) / {float(2**48)!r}"
