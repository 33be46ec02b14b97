"""Where results go: JSON lines, metrics, the markdown summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import steps as st

ATTRIBUTES = ("title", "embedding", "openalex", "entities")


def with_attributes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Each item with its document's attributes (a hundred of its entities, as the written form has)."""
    own = docs.select("doc_id", "title", "embedding", "openalex", F.slice("entities", 1, 100).alias("entities"))
    return items.join(own, "doc_id")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_text(signals: Column) -> Column:
    return S.signals_json(signals)


def _numbered(df: DataFrame, order: str, line: Column, name: str, most: int | None = None) -> DataFrame:
    """(doc_id, name): a document's lines in order, numbered."""
    per = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("x"))
    rows = F.slice("x", 1, most) if most else F.col("x")
    return per.select("doc_id", F.array_join(F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"], F.lit("\n"))), "").alias(name))


def summary(docs: DataFrame, questions: DataFrame, limitations: DataFrame, next_steps: DataFrame, future: DataFrame) -> DataFrame:
    """(doc_id, markdown) for every document."""
    none, join = F.lit("None detected.\n"), F.concat
    q = _numbered(questions.withColumn("o", F.col("evidence.sent_index")), "o", join("question", F.lit("\n   - Identified by: "), as_text(F.col("signals"))), "q")
    lim = _numbered(limitations, "sent_index", join("text", F.format_string("\n   - Confidence: %.2f", "confidence")), "l")
    item = lambda name, c: join(F.lit(f"\n   - {name}: "), F.col(c).cast("string"))
    s = _numbered(next_steps, "ordinal", join("question", item("Rationale", "rationale"), item("Approach", "suggested_approach"), item("Expected Impact", "expected_impact"), item("Difficulty", "difficulty")), "s")
    ctx = F.when(S.has_context(F.col("context")), join(F.lit("\n   - Context: "), "context")).otherwise("")
    f = _numbered(future, "sent_index", join(F.lit("["), "category", F.lit("] "), "text", F.lit("\n   - Identified by: "), as_text(F.col("signals")), ctx), "f", 10)
    d = docs
    for part in (q, lim, s, f):
        d = d.join(part, "doc_id", "left")
    block = lambda title, c: join(F.lit(f"## {title}\n"), F.coalesce(F.col(c), none), F.lit("\n"))
    oa = F.col("openalex")
    found = join(F.lit("## OpenAlex Summary\n- Year: "), F.coalesce(oa["year"].cast("string"), F.lit("")), F.lit("\n- Citations: "), S.citations(oa).cast("string"), F.lit("\n- Concepts: "), F.array_join(F.coalesce(oa["concepts"], F.array().cast("array<string>")), ", "), F.lit("\n\n"))
    labels = S.entity_labels(F.col("entities"))
    entities = F.when(F.size(labels) > 0, join(F.lit("## Entities Found\n"), F.array_join(labels, ", "), F.lit("\n\n"))).otherwise("")
    head = join(F.lit("# "), "title", F.lit("\n"), F.when(F.col("doi") != "", join(F.lit("DOI: "), "doi", F.lit("\n"))).otherwise(""), F.when(S.has_openalex(oa), found).otherwise(""))
    return d.select("doc_id", join(head, block("Explicit Research Questions", "q"), block("Limitations", "l"), block("Proposed Next Steps", "s"), block("Future Directions Mined From the Paper", "f"), entities, F.lit("---\n")).alias("markdown"))


def write_summary(markdown: DataFrame, path: str) -> None:
    """Text files in the order of doc_id, sorted by range and not in one task."""
    markdown.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("markdown").write.mode("overwrite").text(path)


def show(docs: DataFrame, questions: DataFrame, future: DataFrame, next_steps: DataFrame, n: int = 5, each: int = 3) -> DataFrame:
    """The first documents with their first items, cut to a line, for the terminal."""
    first = docs.orderBy("doc_id").limit(n).select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.nullif("doi", F.lit("")), F.lit("(untitled)")).alias("header"))
    lines = lambda df, order, text, name: st.first_n(df.withColumn("o", order), each, "o").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))), lambda x: X.cut(x["t"])).alias(name))
    q = lines(questions, F.col("evidence.sent_index"), F.col("question"), "questions")
    f = lines(future, F.col("sent_index"), F.concat(F.lit("["), "category", F.lit("] "), "text"), "future")
    s = lines(next_steps, F.col("ordinal"), F.col("question"), "steps")
    return first.join(q, "doc_id", "left").join(f, "doc_id", "left").join(s, "doc_id", "left").orderBy("doc_id")


def by_title(items: DataFrame) -> DataFrame:
    """Written items, read again and gathered under their title."""
    return items.groupBy("title").agg(F.collect_list(F.struct(*[c for c in items.columns if c != "title"])).alias("items"))


def events(df: DataFrame, kind: str) -> DataFrame:
    """Rows as typed JSON messages."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("payload"))).alias("value"))
