"""Streams of typed JSON messages, matched on topic as they come.

A topic holds one pending message a side; a later one takes its place; when both are there,
they are emitted and cleared. A pending message expires when the watermark has passed its time
by ``TTL_MS``, so that state stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match
from ..shared import fresh_path

MESSAGE = "type string, payload string"
#: How long a message may wait for its match, in event time.
TTL_MS = 30 * 24 * 3600 * 1000
OUTPUT = "topic string, seq long, feasibility double, significance double, combined double, data string, lit string"
STATE = "d double, has_d boolean, dp string, l double, has_l boolean, lp string"


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """(type, payload) of the lines that are JSON objects; blank and broken ones are left out."""
    return lines.select(F.from_json(value, MESSAGE).alias("m")).where("m.type is not null").select("m.*")


def route(messages: DataFrame, kind: str, schema: str) -> DataFrame:
    return messages.where(F.col("type") == kind).select(F.from_json("payload", schema).alias("p")).select("p.*")


def _match(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    d, has_d, dp, lit, has_l, lp = state.get if state.exists else (0.0, False, None, 0.0, False, None)
    rows = pd.concat([b for b in batches if len(b)]).sort_values("seq", kind="stable")  # arrival order within a group isn't kept
    out = []
    for seq, side, score, payload in zip(rows["seq"], rows["side"], rows["score"], rows["payload"]):
        if side == "data":
            d, has_d, dp = float(score), True, payload
        else:
            lit, has_l, lp = float(score), True, payload
        if has_d and has_l:
            out.append((key[0], int(seq), d, lit, dp, lp))
            has_d = has_l = False
    if has_d or has_l:
        state.update((d, has_d, dp if has_d else None, lit, has_l, lp if has_l else None))
        state.setTimeoutTimestamp(max(int(rows["event_time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + TTL_MS)
    else:
        state.remove()
    if not out:
        return
    got = pd.DataFrame(out, columns=["topic", "seq", "feasibility", "significance", "data", "lit"])
    got["combined"] = (0.6 * got["feasibility"] + 0.4 * got["significance"]).round(3)
    yield got[["topic", "seq", "feasibility", "significance", "combined", "data", "lit"]]


def match_stream(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Matches of a stream of (topic, seq, side 'data' or 'lit', score, event_time), with both payloads where there is a column payload.

    Messages later than the watermark still take part while their topic's state lives.
    """
    known = messages.where(F.col("side").isin("data", "lit") & F.col("score").isNotNull() & F.col("topic").isNotNull() & F.col("event_time").isNotNull())
    payload = (F.col("payload") if "payload" in messages.columns else F.lit(None)).cast("string")
    typed = known.select(F.col("topic").cast("string").alias("topic"), F.col("seq").cast("long").alias("seq"), "side", F.col("score").cast("double").alias("score"), F.col("event_time").cast("timestamp").alias("event_time"), payload.alias("payload"))
    return typed.withWatermark("event_time", late).groupBy("topic").applyInPandasWithState(_match, OUTPUT, STATE, "append", "EventTimeTimeout")


def records(matches: DataFrame) -> DataFrame:
    """The match records (topic, seq, scores, why) of what ``match_stream`` gives."""
    d, lit = F.from_json("data", match.DATA), F.from_json("lit", match.LIT)
    scores = F.struct("feasibility", "significance", "combined")
    why = F.struct(d["datasets"].alias("datasets"), d["variables"].alias("variables"), lit["counts"].alias("pub_trend"), lit["top_terms"].alias("top_terms"))
    return matches.select("topic", "seq", scores.alias("scores"), why.alias("why"))


def from_wire(messages: DataFrame) -> DataFrame:
    """(topic, seq, side, score, event_time, payload) of parsed messages; seq is the payload's or 0, the time the payload's or now. Others, as those that end a stream, are left out."""
    p = F.from_json("payload", "topic string, seq long, event_time timestamp, feasibility_score double, significance_score double")
    side: Column = F.when(F.col("type") == "data_result", "data").when(F.col("type") == "lit_result", "lit")
    known = messages.select(side.alias("side"), p.alias("p"), "payload").where("side is not null")
    return known.select(F.col("p.topic").alias("topic"), F.coalesce("p.seq", F.lit(0)).alias("seq"), "side", F.when(F.col("side") == "data", F.col("p.feasibility_score")).otherwise(F.col("p.significance_score")).alias("score"), F.coalesce("p.event_time", F.current_timestamp()).alias("event_time"), "payload")


def rates(events: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "10 seconds", slide: str = "2 seconds", seconds: int = 10) -> DataFrame:
    """Completions a second in sliding windows, late rows dropped by the watermark."""
    return match.sliding_rate(events.withWatermark(ts, late), ts, window, slide, seconds)


def match_rates(events: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour", seconds: int = 3600) -> DataFrame:
    """What was done a second in windows that don't overlap, late rows dropped by the watermark."""
    return match.tumbling_rate(events.withWatermark(ts, late), ts, window, seconds)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", kind: str = "parquet", name: str | None = None) -> str:
    """Work off what there is, with exactly-once files, and stop; the run's id."""
    writer = stream.writeStream.format(kind).option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()
    return str(query.runId)


def _ran(stream: DataFrame, tag: str) -> DataFrame:
    """What a stream gives, run to its end in the shared folder."""
    at = fresh_path(stream.sparkSession, tag)
    run_to_end(stream, f"{at}/out", f"{at}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's ``match_fold`` as a stream over the events, run to its end: (topic, n, seq, scores, payloads' event ids)."""
    e = event_stream(spark, sf_dir)
    side = F.when(F.col("event_type") == "view", "data").when(F.col("event_type") == "click", "lit")
    payload = F.to_json(F.struct(F.array(F.col("event_id").cast("string")).alias("datasets"), F.array(F.col("event_id").cast("string")).alias("top_terms")))
    messages = e.select(F.col("user_id").alias("topic"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), side.alias("side"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("event_time"), payload.alias("payload"))
    got = records(_ran(match_stream(messages), "match"))
    return got.select("topic", "seq", F.col("scores.feasibility").alias("feasibility"), F.col("scores.significance").alias("significance"), F.col("scores.combined").alias("combined"), F.col("why.datasets")[0].cast("bigint").alias("data_event"), F.col("why.top_terms")[0].cast("bigint").alias("lit_event"))


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding rate as a stream over the events: the windows that the watermark has closed."""
    done = rates(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), window="1 hour", slide="30 minutes", seconds=3600)
    return _ran(done, "rates").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("rps", 9).alias("rps"))


def event_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling rate as a stream over the events: the windows that the watermark has closed."""
    done = match_rates(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return _ran(done, "match-rates").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("rate", 9).alias("rate"))
