"""Matching of data and literature results on their topic, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

TOPICS = ["metagenomics IBD remission", "infant microbiome antibiotic exposure", "human gut microbiome 16S", "microbiome antibiotics longitudinal adults", "IBD antibiotics recovery"]
DATA = "topic string, datasets array<string>, variables map<string,int>, samples int, feasibility_score double"
LIT = "topic string, counts array<int>, significance_score double, top_terms array<string>, emb_dim int"


def stub_data(topics: DataFrame) -> DataFrame:
    """The stand-in of the data provider: one constant record for each topic."""
    return topics.select("topic", F.array(F.lit("Qiita:123"), F.lit("MGnify:ABC")).alias("datasets"), F.create_map(*[F.lit(x) for pair in (("age", 1200), ("antibiotics", 900), ("body_site", 1500)) for x in pair]).alias("variables"), F.lit(2000).alias("samples"), F.lit(0.78).alias("feasibility_score"))


def stub_literature(topics: DataFrame, dim: int = 384) -> DataFrame:
    return topics.select("topic", F.array(*map(F.lit, (120, 140, 155, 170, 182))).alias("counts"), F.lit(0.80).alias("significance_score"), F.array(*map(F.lit, ("diversity", "antibiotics", "IBD"))).alias("top_terms"), F.lit(dim).alias("emb_dim"))


def record(d: str = "d", lit: str = "l") -> list[Column]:
    """The match record of a row that holds both payloads as structs."""
    d, lit = F.col(d), F.col(lit)
    scores = F.struct(d["feasibility_score"].alias("feasibility"), lit["significance_score"].alias("significance"), S.combined(d["feasibility_score"], lit["significance_score"]).alias("combined"))
    return [scores.alias("scores"), F.struct(d["datasets"].alias("datasets"), d["variables"].alias("variables"), lit["counts"].alias("pub_trend"), lit["top_terms"].alias("top_terms")).alias("why")]


def latest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last ``value`` of each key: an aggregation, partial before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def match_topics(data: DataFrame, literature: DataFrame) -> DataFrame:
    """Records of the topics that both sides have; topics are unique on each."""
    d = data.select("topic", F.struct(*[c for c in data.columns if c != "topic"]).alias("d"))
    lit = literature.select("topic", F.struct(*[c for c in literature.columns if c != "topic"]).alias("l"))
    return d.join(lit, "topic").select("topic", *record())


def unmatched(side: DataFrame, other: DataFrame, key: str = "topic") -> DataFrame:
    return side.join(other, key, "left_anti")


def fold(messages: DataFrame, key: str = "topic") -> DataFrame:
    """Consume-once matches of messages (key, seq, side 'data' or 'lit', score) in the order of seq.

    Each key holds one pending score a side at most, the later in the earlier's place; when
    both are there, they are a match and both go. So a match can only be at the first message of
    a run of one side, with the message before, and is there if something was left pending:
    always after a run of two or more, and after a run of one if that was no match itself.
    Windows say so without a fold: one shuffle on the key, no key's messages in one row.
    """
    by = Window.partitionBy(key).orderBy("seq")
    known = messages.where(F.col("side").isin("data", "lit") & F.col("score").isNotNull())
    df = known.withColumns({"was": F.lag("side").over(by), "last": F.lag("score").over(by), "place": F.row_number().over(by)})
    runs = df.where(F.col("was").isNull() | (F.col("was") != F.col("side")))  # the first of each run
    long = F.col("place") - F.lag("place").over(by) > 1  # the run before
    runs = runs.withColumns({"nth": F.row_number().over(by), "long": F.coalesce(long, F.lit(False))})
    # since the first run, after which something is pending, or since a run after a long one, runs of one take turns
    since = F.max(F.struct(F.when(F.col("long") | (F.col("nth") == 1), F.col("nth")).alias("nth"), F.col("long").alias("long"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    matched = runs.withColumn("since", since).where((F.col("nth") - F.col("since.nth")) % 2 == F.when(F.col("since.long"), 0).otherwise(1))
    first = lambda side: F.when(F.col("side") == side, F.col("score")).otherwise(F.col("last"))
    out = matched.withColumns({"d": first("data"), "l": first("lit"), "n": F.row_number().over(by).cast("bigint") - 1})
    return out.select(key, "n", "seq", F.col("d").alias("feasibility"), F.col("l").alias("significance"), S.combined(F.col("d"), F.col("l")).alias("combined"))


def sliding_rate(events: DataFrame, ts: str = "ts", window: str = "10 seconds", slide: str = "2 seconds", seconds: int = 10) -> DataFrame:
    """(start, rps) of completions in each window."""
    return events.groupBy(F.window(ts, window, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rps"))


def tumbling_rate(events: DataFrame, ts: str = "ts", window: str = "1 hour", seconds: int = 3600) -> DataFrame:
    return events.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))


def last_n(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
