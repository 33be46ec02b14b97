"""The whole batch analysis: papers to questions, limitations, directions, steps, files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as S
from ..operators import context, extract, sections, steps, vectors
from ..shared import staged
from ..sources import papers, sinks

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass
class Options:
    """What a run may set; providers are functions that the caller plugs in."""

    splitter: str = "naive"
    wide: bool = False
    threshold: float = 0.7
    context: bool = False
    around: int = 1
    #: Sentences of the document that are most similar, as context; they take an embedder.
    similar: int = 2
    max_chars: int = 600
    #: Texts to vectors: opens the semantic gates and similar sentences as context.
    embedder: Embedder | None = None
    similarity: float = L.SIMILAR
    works: DataFrame | None = None
    providers: dict = field(default_factory=dict)
    #: (sentences) -> sentences with columns of models, see ``operators.extract``.
    models: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Analysis:
    docs: DataFrame
    questions: DataFrame
    limitations: DataFrame
    future: DataFrame
    rejected: DataFrame
    steps: DataFrame

    def computed(self) -> Analysis:
        """The same with all results worked out once and written to the shared folder."""
        done = {n: staged(getattr(self, n), n) for n in ("docs", "questions", "limitations", "future", "rejected")}
        return replace(self, **done, steps=staged(steps.next_steps(done["questions"], done["limitations"]), "steps"))

    def metrics(self, secs: float | None = None) -> DataFrame:
        return steps.metrics(self.docs, self.questions, self.steps, self.future, secs)

    def summary(self) -> DataFrame:
        return sinks.summary(self.docs, self.questions, self.limitations, self.steps, self.future)

    def write(self, folder: str, began: float | None = None) -> Analysis:
        """Write everything; the metrics come last and have the seconds since ``began`` (or since the call). The computed results."""
        began = time.time() if began is None else began
        done = self.computed()
        for name, items in (("explicit_rqs", done.questions), ("proposed_next_steps", done.steps), ("future_directions", done.future), ("limitations", done.limitations)):
            sinks.write_json(sinks.with_attributes(items, done.docs), f"{folder}/{name}.jsonl")
        done.rejected.write.mode("append").json(f"{folder}/rejected_sentences")
        sinks.write_summary(done.summary(), f"{folder}/summary.md")
        sinks.write_json(done.metrics(time.time() - began), f"{folder}/metrics.json")
        return done


def embedded(sentences: DataFrame, embedder: Embedder, text: str = "sent", out: str = "vector") -> DataFrame:
    """``sentences`` with the vector of each, batch by batch."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in embedder(s.tolist())], dtype=object)

    return sentences.withColumn(out, embed(F.col(text)))


def says(text: Column, embedder: Callable[[list[str]], np.ndarray], prototypes: list[list[float]], threshold: float = L.SIMILAR) -> Column:
    """Whether a prototype is similar enough, as ``semantic`` has it, where nothing else takes the vectors: they stay in the Python worker, batch by batch."""
    p = np.asarray(prototypes, np.float64)
    norm = np.sqrt((p * p).sum(axis=1))

    @F.pandas_udf("boolean")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = np.asarray(embedder(s.tolist()), np.float64)
            size = np.sqrt((v * v).sum(axis=1))[:, None] * norm
            cosine = np.divide(v @ p.T, size, out=np.zeros_like(size), where=size > 0)
            yield pd.Series((cosine >= threshold).any(axis=1))

    return near(text)


def semantic(sentences: DataFrame, prototypes: dict[str, list[list[float]]], threshold: float = L.SIMILAR, vector: str = "vector") -> DataFrame:
    """``sentences`` with semantic_rq, semantic_limit and semantic_future: whether a prototype is similar enough."""
    names = {"rq": "semantic_rq", "limit": "semantic_limit", "future": "semantic_future"}
    return sentences.withColumns({names[k]: vectors.matches_prototypes(F.col(vector), p, threshold) for k, p in prototypes.items()})


def analyze(docs: DataFrame, options: Options | None = None) -> Analysis:
    """``docs`` as ``papers.load`` gives them, or others that have a doc_id each."""
    o = options or Options()
    base = sections.base_text(F.col("abstract"), F.col("text"), o.wide)
    parts = docs.select("doc_id", base.alias("base"), sections.split_sections(base, o.wide).alias("s"))
    prototypes = {k: o.embedder(texts) for k, texts in L.PROTOTYPES.items()} if o.embedder else {}

    def split(text: Column) -> DataFrame:
        found = sections.explode_sentences(parts, text, o.splitter, o.wide)
        if o.embedder:
            found = staged(semantic(embedded(found, o.embedder), prototypes, o.similarity), "sentences")
        return o.models(found) if o.models else found

    s: Column = F.col("s")
    questions = extract.research_questions(split(sections.question_bucket(s)))
    limits = extract.limitations(split(sections.limitation_bucket(s)))
    whole = split(F.col("base"))
    around = context.with_context(whole, True, o.around, o.similar if o.embedder else 0, o.max_chars, "vector" if o.embedder else None) if o.context else None
    future = extract.future_directions(whole, o.threshold, around)
    providers = dict(o.providers)
    if o.embedder:
        providers.setdefault("embedder", o.embedder)
    if "entities" in providers and "entity_text" not in providers:
        own = sections.split_sections(base, o.wide)
        docs = docs.withColumn("entity_text", S.joined_sections(own, ["introduction", "discussion", "conclusion"]))
        providers["entity_text"] = F.col("entity_text")
    enriched = papers.enrich(docs, o.works, **providers)
    return Analysis(enriched.drop("entity_text"), questions, limits, future, extract.rejected(whole, o.threshold), steps.next_steps(questions, limits))
