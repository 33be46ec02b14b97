"""The corpus pipeline: quality, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``. Whoever runs STAGES writes each result as Parquet and rereads it as
the next one's ``docs``; ``run`` does so in the folder that all executors share.

In every stage columns besides doc_id, source and text may be NULL and have any name, an
empty table gives an empty one, and very long texts need memory in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenquarry.llm import exact_dedup, mixing, pieces, quality, simhash
from lumenquarry.llm.common import staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The nine tenths of the documents that the importance resampling takes (operator 6).

    NULL and empty texts have the neutral weight, a NULL doc_id is hashed as a value of its
    own, repeated rows are kept or go alike, ties at the last place all stay, and without
    labels of both kinds everything stays.
    """
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 4).

    The least doc_id stays, NULL after all others, then the least other columns; empty texts
    are equal, NULL texts all stay, repeated rows leave one.
    """
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 1).

    The least doc_id stays, NULL after all others, then the least other columns; rows with a NULL
    text all stay, texts without a word are compared by their characters, repeated rows leave one.
    """
    return simhash.near_dedup(docs, null_keys=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks (operator 10).

    NULL is a source of its own; NULL and empty texts have no tokens, and a source without
    any is left out; repeated rows are emitted alike; no rows are compared, so none tie.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text with merge-dropout (operator 5); copies that mixing made are numbered, so each has its own.

    ``lossless`` says whether the ids decode to the text. NULL and empty texts have no ids; a
    NULL doc_id is a key of its own; repeated rows count as copies.
    """
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    numbered = docs.select("doc_id", "source", "text", F.row_number().over(copies).alias("copy_no"))
    return pieces.encode(numbered, check="lossless", copy="copy_no").select("doc_id", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids", "lossless")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("encode", encode)]

#: SQL can't express the hashed models, the fingerprints and the agenda; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
