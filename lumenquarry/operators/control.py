"""Rate control as folds over a sequence of observations, for replay and tests.

In running jobs Spark's own source options (``maxFilesPerTrigger``, ``rowsPerSecond``) and
dynamic allocation take this place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_bucket(steps: Column, capacity: float, rate: float, partial: bool = False) -> Column:
    """Grants of a bucket over ``steps`` (ARRAY<STRUCT<dt, want>>): all or nothing, or as many whole tokens as there are. For short sequences in a row; ``granted`` takes any."""
    rate = max(0.1, rate)
    start = F.struct(F.lit(float(capacity)).alias("tokens"), F.array().cast("array<bigint>").alias("granted"))

    def step(s: Column, x: Column) -> Column:
        tokens = F.least(F.lit(float(capacity)), s["tokens"] + x["dt"] * rate)
        want = x["want"].cast("bigint")
        grant = F.least(F.floor(tokens), want) if partial else F.when(tokens >= want, want).otherwise(0)
        grant = grant.cast("bigint")
        return F.struct((tokens - grant).alias("tokens"), F.concat(s["granted"], F.array(grant)).alias("granted"))

    return F.aggregate(steps, start, step, lambda s: s["granted"])


def granted(requests: DataFrame, key: str, order: list[str], at: str, want: str, capacity: float, rate: float) -> DataFrame:
    """``requests`` with granted and granted_part: what a bucket of each key gives, all or nothing and in part.

    ``at`` is in seconds. One shuffle on the key; sorted rows stream through with nothing but
    the state of the present key, so a key may have any number of them.
    """
    rate = max(0.1, rate)
    fields = requests.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, whole, part = object(), 0.0, 0.0, 0.0
        for pdf in batches:
            out: list[tuple[int, int]] = []
            for k, t, n in zip(pdf[key], pdf[at], pdf[want]):
                if k != now:
                    now, last, whole, part = k, t, float(capacity), float(capacity)
                whole, part, last = min(capacity, whole + (t - last) * rate), min(capacity, part + (t - last) * rate), t
                a, b = n if whole >= n else 0, min(math.floor(part), n)
                whole, part = whole - a, part - b
                out.append((a, b))
            yield pdf.assign(granted=[a for a, _ in out], granted_part=[b for _, b in out])

    return requests.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{fields}, granted long, granted_part long")


def settings(quota: dict[str, float]) -> dict[str, str]:
    """A worker's quota as Spark's own options: what a batch may hold, cores and the share of a GPU for each task.

    max_batch -> records of an Arrow batch, and files of a micro-batch; token_rate -> rows a
    second of a rate source; threads -> cores of a task; cores -> executors' cores that a job may take; gpu_frac -> GPU of a task.
    """
    names = {
        "max_batch": ("spark.sql.execution.arrow.maxRecordsPerBatch", "maxFilesPerTrigger"),
        "token_rate": ("rowsPerSecond",),
        "threads": ("spark.task.cpus",),
        "cores": ("spark.cores.max",),
        "gpu_frac": ("spark.task.resource.gpu.amount",),
    }
    unknown = set(quota) - set(names)
    if unknown or any(v <= 0 for v in quota.values()):
        raise ValueError(f"give positive quotas of {sorted(names)}")
    whole = lambda k, v: f"{v:g}" if k == "gpu_frac" else str(max(1, math.floor(v)))
    return {name: whole(k, v) for k, v in quota.items() for name in names[k]}


def adapt(data_rate: Column, lit_rate: Column, seen_data: Column, seen_lit: Column) -> Column:
    """The next rates of both workers: the faster one slows down and the other follows; both speed up while both work."""
    ahead, behind = seen_data > 1.3 * seen_lit, seen_lit > 1.3 * seen_data
    slower_data, slower_lit = data_rate * 0.85, lit_rate * 0.85
    d = F.when(ahead, slower_data).when(behind, F.least(data_rate * 1.15, slower_lit * 1.1 + 0.5)).otherwise(data_rate)
    lit = F.when(ahead, F.least(lit_rate * 1.15, slower_data * 1.1 + 0.5)).when(behind, slower_lit).otherwise(lit_rate)
    grow = F.when((seen_data > 0.2) & (seen_lit > 0.2), 1.05).otherwise(1.0)
    return F.struct((d * grow).alias("data_rate"), (lit * grow).alias("lit_rate"))


def adapt_all(observed: Column, data_rate: float, lit_rate: float) -> Column:
    """The rates after each observation (ARRAY<STRUCT<data, lit>>)."""
    pair = "struct<data_rate:double,lit_rate:double>"
    start = F.struct(F.struct(F.lit(float(data_rate)).alias("data_rate"), F.lit(float(lit_rate)).alias("lit_rate")).alias("now"), F.array().cast(f"array<{pair}>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        now = adapt(s["now"]["data_rate"], s["now"]["lit_rate"], x["data"], x["lit"])
        return F.struct(now.alias("now"), F.concat(s["all"], F.array(now)).alias("all"))

    return F.aggregate(observed, start, step, lambda s: s["all"])
