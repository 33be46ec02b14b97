"""More registered queries: records, sections, readers and sinks, semantic gates, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as S
from ..functions import text as X
from ..operators import context, extract, sections, steps
from ..shared import fresh_path, staged
from ..sources import labels as label_source
from ..sources import papers, sinks
from . import analyze
from .queries import _future, _limits, _parts, _questions, _sectioned, label_clean, seeded, table

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIMILAR_LETTERS = 0.93


def as_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a title, an abstract and, for a third of them, a DOI."""
    d = F.col("doc_id")
    docs = seeded(spark, sf_dir)
    return docs.select("doc_id", F.concat(F.lit("Paper "), (d % 97).cast("string")).alias("title"), F.concat_ws(" ", "lang", "source").alias("abstract"), "text", F.when(d % 3 == 0, F.concat(F.lit("10.1/"), d.cast("string"))).otherwise("").alias("doi"))


def work_json(d: Column) -> Column:
    """A work's JSON, as the service would answer, made of a number."""
    author = lambda name: F.struct(F.struct(name.alias("display_name")).alias("author"))
    return F.to_json(F.struct(
        F.concat(F.lit("W"), d.cast("string")).alias("id"), F.concat(F.lit("Work "), d.cast("string")).alias("title"), (F.lit(1990) + d % 30).cast("int").alias("publication_year"), F.when(d % 4 > 0, d % 500).alias("cited_by_count"),
        F.transform(F.sequence(F.lit(1), (d % 14 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("display_name"))).alias("concepts"),
        F.transform(F.sequence(F.lit(1), (d % 25 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("W"), i.cast("string")).alias("id"))).alias("related_works"),
        F.array(author(F.concat(F.lit("A"), (d % 7).cast("string"))), author(F.lit(None).cast("string")), author(F.lit("B"))).alias("authorships"),
    ))


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def paper_fields(spark, sf_dir):
    """Identity, base text and the text to embed of each paper."""
    p = as_papers(spark, sf_dir)
    base = sections.base_text(F.col("abstract"), F.col("text"))
    return p.select("doc_id", S.identifier(F.col("doi"), F.col("title")).alias("identifier"), digest(base).alias("base_digest"), digest(S.summary_text(F.col("title"), F.col("abstract"))).alias("summary_digest"))


def section_access(spark, sf_dir):
    s = F.col("s")
    size = lambda c, n: F.length(c).cast("bigint").alias(n)
    return _sectioned(spark, sf_dir).select("doc_id", size(S.section(s, "methods"), "methods"), size(S.section(s, "nothing"), "nothing"), digest(S.question_text(s)).alias("question_digest"), digest(S.future_text(s)).alias("future_digest"))


def openalex_fields(spark, sf_dir):
    oa = F.col("oa")
    got = table(spark, sf_dir, "documents").select("doc_id", S.openalex(F.when(F.col("doc_id") % 5 > 0, work_json(F.col("doc_id"))).otherwise("no object")).alias("oa"))
    return got.select("doc_id", oa["openalex_id"].alias("openalex_id"), oa["title_oa"].alias("title_oa"), F.coalesce(oa["year"].cast("bigint"), F.lit(-1)).alias("year"), S.citations(oa).alias("citations"), F.array_join(oa["concepts"], ",").alias("concepts"), F.coalesce(F.size(oa["related_ids"]).cast("bigint"), F.lit(-1)).alias("n_related"), F.array_join(oa["authors"], ",").alias("authors"), S.has_openalex(oa).alias("has_openalex"))


def enriched(spark, sf_dir):
    """Papers with the works that a table has for their identifiers; two thirds share a title's work."""
    p = as_papers(spark, sf_dir)
    works = table(spark, sf_dir, "labels").select(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("key"), S.openalex(work_json(F.col("doc_id"))).alias("openalex"))
    got = papers.enrich(p, works)
    return got.select("doc_id", F.col("openalex.openalex_id").alias("openalex_id"), S.citations(F.col("openalex")).alias("citations"), F.size("embedding").cast("bigint").alias("n_embedding"), F.size("entities").cast("bigint").alias("n_entities"))


def question_labels(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", F.col("evidence.sent_index").cast("bigint").alias("sent_index"), S.question_label(F.col("confidence"), F.col("question")).alias("label"))


def record_round_trip(spark, sf_dir):
    """Future directions as JSON records and back, with the properties of what came back."""
    f = _future(spark, sf_dir)
    wire = F.to_json(F.struct("type", "text", "category", "sent_index", "confidence", S.signals_json(F.col("signals")).alias("signals"), "context"))
    back = F.from_json(wire, "type string, text string, category string, sent_index int, confidence double, signals string, context string")
    got = f.select("doc_id", back.alias("b")).select("doc_id", "b.*").withColumn("signals", S.signals_from_json(F.col("signals")))
    s = F.col("signals")
    return got.select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "type", "text", "category", "confidence", S.strength(s).alias("strength"), S.signal_count(s).alias("n_signals"), S.has_context(F.col("context")).alias("has_context"), s.classifier_score.isNull().alias("no_classifier"))


def _scored(spark, sf_dir):
    """Sentences with a score that a model might give: a tenth of their length, modulo 100."""
    return sections.explode_sentences(seeded(spark, sf_dir), F.col("text")).withColumn("ml_score", F.length("sent") % 100 / 100)


def future_by_model(spark, sf_dir):
    """The gate with a classifier: all confidences and strengths occur."""
    f = extract.future_directions(_scored(spark, sf_dir), 0.4)
    s = F.col("signals")
    return f.select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "confidence", S.strength(s).alias("strength"), S.signal_count(s).alias("n_signals"), S.is_actionable(F.col("confidence"), F.col("category"), F.col("text")).alias("actionable"))


def decision_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.sigmoid((F.col("n_chars") - 2000) / 1000.0), 9).alias("probability"))


def entity_labels(spark, sf_dir):
    """The distinct labels of each user's first hundred events."""
    one = F.struct("event_id", F.struct(F.col("event_type").alias("text"), F.when(F.col("event_type") != "error", F.upper("event_type")).otherwise("").alias("label")).alias("e"))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias("e"))
    return per.select("user_id", F.array_join(S.entity_labels(F.col("e")), ",").alias("labels"))


def malformed_lines(spark, sf_dir):
    return label_clean(spark, sf_dir).agg(F.count_if("bad").alias("bad"), F.count("*").alias("lines"), F.count_if(F.col("label") == "").alias("without_label"))


def smart_sentences(spark, sf_dir):
    return sections.explode_sentences(seeded(spark, sf_dir), F.col("text"), "smart").select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "sent")


def paper_lines(spark, sf_dir):
    """Papers written as JSON lines, some of them broken or without fields, and read again."""
    p = as_papers(spark, sf_dir)
    d = F.col("doc_id")
    whole = F.to_json(F.struct(d.cast("string").alias("title"), "abstract", F.when(d % 7 > 0, F.col("text")).alias("text"), F.when(d % 2 > 0, F.col("doi")).alias("doi")))
    line = F.when(d % 11 == 0, F.concat(F.lit("{broken "), d.cast("string"))).when(d % 13 == 0, F.lit("  ")).otherwise(whole)
    path = fresh_path(spark, "lines")
    p.select(line.alias("value")).write.text(path)
    good, bad = papers.read_json_lines(spark, path)
    known = papers.with_defaults(good)
    cols = lambda df, title, digested, kind: df.select(title.alias("title"), digest(digested).alias("text_digest"), F.lit(kind).alias("kind"))
    return cols(known, F.col("title"), F.concat("text", F.lit("|"), "abstract", F.lit("|"), "doi"), "read").unionByName(cols(bad, F.lit(""), F.col("value"), "broken"))


def summary_markdown(spark, sf_dir):
    """The markdown of every paper; what is said in it comes from one pass over the texts."""
    p = papers.enrich(as_papers(spark, sf_dir))
    q, lim, f = extract.from_parts(staged(_parts(seeded(spark, sf_dir)).where("part is not null"), "found"))
    md = sinks.summary(p, q, lim, steps.next_steps(q, lim), f)
    return md.select("doc_id", F.length("markdown").cast("bigint").alias("n_chars"), digest(F.col("markdown")).alias("digest"))


def first_papers(spark, sf_dir):
    """What the terminal shows: five papers with three items each. All papers are ranked; what isn't shown isn't extracted first."""
    p = papers.enrich(as_papers(spark, sf_dir))
    first = p.select("doc_id").orderBy("doc_id").limit(5).distinct()
    own = seeded(spark, sf_dir).join(F.broadcast(first), "doc_id", "left_semi")  # five rows
    q, lim, f = extract.from_parts(staged(_parts(own).where("part is not null"), "found"))
    shown = sinks.show(p, q, f, steps.next_steps(q, lim))
    line = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "|").alias(c)
    return shown.select("doc_id", "header", line("questions"), line("future"), line("steps"))


def attributed(spark, sf_dir):
    """Limitations with their papers' attributes, written, read and gathered under the title."""
    p = papers.enrich(as_papers(spark, sf_dir))
    path = fresh_path(spark, "attributed")
    sinks.write_json(sinks.with_attributes(_limits(spark, sf_dir), p), path)
    back = sinks.by_title(spark.read.schema("title string, doc_id long, sent_index int, text string, confidence double").json(path))
    said = F.array_join(F.transform(F.array_sort(F.transform(F.col("items"), lambda x: F.struct(x["doc_id"], x["sent_index"], x["text"]))), lambda x: x["text"]), "|")
    return back.select("title", F.size("items").cast("bigint").alias("n"), digest(said).alias("digest"))


def wire_events(spark, sf_dir):
    """Limitations as typed JSON messages, parsed and routed again."""
    from ..streaming import matching

    kind = "limitation_found"
    out = sinks.events(_limits(spark, sf_dir).select("doc_id", "sent_index", "text"), kind)
    return matching.route(matching.parse(out), kind, "doc_id long, sent_index long, text string")


def similar_context(spark, sf_dir):
    """The most similar others of each vector's label, as context."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("said"))
    return context.with_context(v, around=1, similar=2, vector="embedding", by="label", order="vec_id", text="said").select("label", "vec_id", "context")


def letters() -> Callable[[list[str]], np.ndarray]:
    """A stand-in for an embedder: how often each letter occurs in each of the texts, which are in lower case."""
    n = len(LETTERS)

    def count(texts: list[str]) -> np.ndarray:  # a function of its own goes to workers whole
        said = [t.encode() for t in texts]
        of = np.repeat(np.arange(len(said)), [len(t) for t in said])
        code = np.frombuffer(b"".join(said), np.uint8).astype(np.int64) - ord("a")
        mine = (code >= 0) & (code < n)
        return np.bincount(of[mine] * n + code[mine], minlength=len(said) * n).reshape(-1, n).astype(np.float64)

    return count


def letters_of(text: str) -> list[float]:
    return [float(text.lower().count(c)) for c in LETTERS]


def semantic_future(spark, sf_dir):
    """Future directions with the semantic gates open. Sentences of a key differ in case, blanks and citation numbers only, so they have the same letters."""
    s = sections.explode_sentences(seeded(spark, sf_dir), F.col("text"))
    s = s.withColumn("semantic_future", analyze.says(F.lower("sent"), letters(), [letters_of(t) for t in L.PROTOTYPES["future"]], SIMILAR_LETTERS))
    f = extract.future_directions(s, by_key=True)
    return f.select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "category", "confidence", F.col("signals.semantic").alias("semantic"), S.strength(F.col("signals")).alias("strength"))


def preview_lines(spark, sf_dir):
    """Labelled sentences written as CSV by the cleaner's sink, and read as examples."""
    k = F.col("doc_id") % 3
    sent = F.regexp_replace("text", r"[\r\n]", " ")
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit(" "), F.replace(sent, F.lit('"'), F.lit("'")), F.lit('",'), F.when(k == 0, "1").when(k == 1, "0").otherwise("x")).alias("value"))
    at = fresh_path(spark, "labels")
    lines.write.text(f"{at}/in")
    label_source.clean_csv(spark, f"{at}/in", f"{at}/out.csv")
    got = label_source.read_examples(spark, f"{at}/out.csv")
    return got.select(F.regexp_extract("sentence", r"^(\d+)", 1).cast("bigint").alias("doc_id"), F.length("sentence").cast("bigint").alias("n_chars"), "label")


RECORDS = {f.__name__: f for f in (
    paper_fields, section_access, openalex_fields, enriched, question_labels, record_round_trip, future_by_model, decision_scores, entity_labels, malformed_lines, smart_sentences, paper_lines, summary_markdown, first_papers, attributed, wire_events,
    similar_context, semantic_future, preview_lines,
)}
