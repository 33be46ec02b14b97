"""Labelled sentences: a cleaner of raw CSV lines and readers of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def clean_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The other columns with (sentence, label, bad) of each line that isn't empty, a header or a comment.

    The last comma parts the label off; a line without one is ``bad``. Labels other than 0
    and 1 are empty.
    """
    others = [c for c in lines.columns if c != line]
    df = lines.withColumn(line, F.regexp_replace(F.replace(F.col(line), F.lit("﻿"), F.lit("")), r"[\r\n]+\z", ""))
    bare = X.strip(F.col(line))
    df = df.where((F.col(line) != "") & ~bare.startswith("#") & (F.lower(bare) != "sentence,label"))
    bad = ~F.col(line).contains(",")
    part = lambda i: X.strip(F.regexp_extract(line, r"(?s)^(.*),([^,]*)\z", i))
    s, label = F.when(bad, bare).otherwise(part(1)), F.when(bad, "").otherwise(part(2))
    df = df.select(*others, bad.alias("bad"), s.alias("s"), label.alias("l"))
    s = F.col("s")
    unquoted = F.when(s == '"', "").when(s.startswith('"') & s.endswith('"'), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    return df.select(*others, unquoted.alias("sentence"), F.when(F.col("l").isin("0", "1"), F.col("l")).otherwise("").alias("label"), "bad")


def clean_csv(spark: SparkSession, path: str, out: str) -> int:
    """Write the cleaned file with a header; the number of bad lines."""
    cleaned = clean_lines(spark.read.text(path).withColumnRenamed("value", "line"))
    cleaned.where("not bad").select("sentence", "label").write.mode("overwrite").csv(out, header=True, quote='"', escape='"', emptyValue="")
    return cleaned.agg(F.count_if("bad")).first()[0]


def preview(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"').limit(n)


def examples(raw: DataFrame, keep: list[str] | None = None, drop_bad: bool = False) -> DataFrame:
    """(sentence, label) from the columns sentence or text, label or requires_new_data, as far as there are such.

    A label that is no number is 0, or drops its row with ``drop_bad``.
    """
    def first(*names: str) -> Column:
        have = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in raw.columns]
        return F.coalesce(*have, F.lit(None).cast("string")) if have else F.lit(None).cast("string")

    given = F.coalesce(first("label", "requires_new_data"), F.lit("0"))
    number = given.try_cast("bigint") if drop_bad else given.try_cast("double").cast("bigint")
    out = raw.select(*(keep or []), X.strip(first("sentence", "text")).alias("sentence"), number.alias("label")).where("sentence <> ''")
    return out.where("label is not null") if drop_bad else out.select(*(keep or []), "sentence", F.coalesce("label", F.lit(0).cast("bigint")).alias("label"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, or JSON lines."""
    if path.lower().endswith(".csv"):
        return examples(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    fields = "sentence string, text string, label string, requires_new_data string"
    return examples(spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path), drop_bad=True)
