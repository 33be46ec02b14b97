"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from . import audio, exact_dedup, mixing, pieces, quality, sharding, simhash, substring, tokencount, toxicity
from .common import table


def op1_simhash(spark, sf_dir):
    """Every document with its class, that of its near copies, and the documents of the class."""
    return simhash.classes(table(spark, sf_dir, "documents"))


def _voices(texts: pd.Series) -> pd.Series:
    return texts.map(audio.voiced)  # NULL stays NULL


def op2_audio(spark, sf_dir):
    """The tensors of every turn of the conversations, voiced by a stand-in, as the tables hold no recordings."""
    turns = table(spark, sf_dir, "conversations")
    voice = F.pandas_udf(_voices, "binary")
    return audio.audio_tensors(turns.select("conv_id", "turn", voice("text").alias("audio")))


def op3_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op5_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="lossless").select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "lossless")


def op6_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.resample(docs.select("doc_id", "text"), labels, weight="log_weight").select("doc_id", F.round("log_weight", 6).alias("log_weight"))


def op7_token_counts(spark, sf_dir):
    return tokencount.token_count(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op8_substring(spark, sf_dir):
    return substring.repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxic(docs.select("doc_id", "text"), labels).select("doc_id", F.round("toxicity", 6).alias("toxicity"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), copy="copy_no", rate="rate").select("doc_id", "source", F.round("rate", 6).alias("rate"), "copy_no")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_audio, op3_sharding, op4_exact_dedup, op5_pieces, op6_quality, op7_token_counts, op8_substring, op9_toxicity, op10_mixing)}
SQL = {"op3_sharding": sharding.shard_sql(), "op4_exact_dedup": exact_dedup.SQL, "op8_substring": substring.SQL, "op10_mixing": mixing.mix_sql()}
