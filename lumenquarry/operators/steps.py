"""Next steps from questions and limitations, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

STEPS = {
    "replicate": ("Replicate and validate the main finding in an external cohort", "External validity and robustness", "Preregister, define inclusion criteria, report effect sizes after a power analysis", 0.7, 0.4),
    "sample": ("Increase sample size and rerun the analysis", "Address low power risk", "Recruit additional participants after a power analysis, adjust for multiple testing", 0.6, 0.3),
    "control": ("Add the missing measurement or control", "Reduce bias from missing variable", "Add a control group or collect the missing covariate", 0.6, 0.5),
}


def first_n(df: DataFrame, n: int, order: str, by: str = "doc_id") -> DataFrame:
    """The first n rows of each ``by``; Spark limits the groups before it shuffles them."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= n)


def _step(kind: Column) -> Column:
    out = None
    for name, (question, why, how, impact, difficulty) in STEPS.items():
        row = F.struct(F.lit(question).alias("question"), F.lit(why).alias("rationale"), F.lit(how).alias("suggested_approach"), F.lit(impact).alias("expected_impact"), F.lit(difficulty).alias("difficulty"))
        out = F.when(kind == name, row) if out is None else out.when(kind == name, row)
    return out


def next_steps(questions: DataFrame, limitations: DataFrame, n: int = 5) -> DataFrame:
    """One step for each of a document's first n questions, then for those of its first n limitations that name a remedy."""
    asked = first_n(questions.select("doc_id", F.col("evidence.text").alias("text"), F.col("evidence.sent_index").alias("sent_index")), n, "sent_index").withColumn("kind", F.lit("replicate"))
    low = F.lower("text")
    lacking = first_n(limitations.select("doc_id", "text", "sent_index"), n, "sent_index").withColumn("kind", F.when(low.contains("small sample"), "sample").when(low.contains("lack of"), "control")).where("kind is not null")
    both = asked.withColumn("part", F.lit(0)).unionByName(lacking.withColumn("part", F.lit(1)))
    out = both.withColumn("step", _step(F.col("kind"))).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "nth")).cast("bigint"))
    return out.select("doc_id", "ordinal", "step.*", F.array("text").alias("links"))


def top_steps(steps: DataFrame, n: int = 5) -> DataFrame:
    """A document's n steps of the highest priority, the earlier first among equals."""
    ranked = steps.withColumn("priority", F.round(S.priority(F.col("expected_impact"), F.col("difficulty")), 6))
    order = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "ordinal")
    return ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def doc_totals(docs: DataFrame, questions: DataFrame, limitations: DataFrame, future: DataFrame) -> DataFrame:
    """Counts for every document, those with none included. Steps don't count as extractions."""
    one = lambda df, kind: df.select("doc_id", F.lit(kind).alias("kind"))
    found = one(questions, "rq").unionByName(one(limitations, "lim")).unionByName(one(future, "fd")).unionByName(one(docs, "doc"))
    per = found.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("rq", "n_rq"), ("lim", "n_lim"), ("fd", "n_fd"))])
    return with_total(per)


def with_total(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", "n_rq", "n_lim", "n_fd", (F.col("n_rq") + F.col("n_lim") + F.col("n_fd")).alias("total_extractions"))


def corpus_totals(totals: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    n = F.count("*")
    return totals.agg(n.alias("docs"), zero("n_rq").alias("rqs"), zero("n_lim").alias("limitations"), zero("n_fd").alias("future"), zero("total_extractions").alias("total_extractions"), F.round(F.when(n > 0, zero("total_extractions") / n).otherwise(0.0), 6).alias("avg_extractions_per_doc"))


def metrics(docs: DataFrame, questions: DataFrame, steps: DataFrame, future: DataFrame, secs: float | None = None) -> DataFrame:
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"))
    all_ = one(docs, "docs").unionByName(one(questions, "rqs")).unionByName(one(steps, "steps")).unionByName(one(future, "future"))
    out = all_.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("docs", "rqs", "steps", "future")])
    return out if secs is None else out.withColumn("secs", F.lit(float(secs)))
