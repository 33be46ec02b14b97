"""Column functions over signals, scores, vectors and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNALS = "struct<hook:boolean,semantic:boolean,modal:boolean,will_infinitive:boolean,classifier_score:double>"


def signals(hook: Column, semantic: Column, modal: Column, will: Column, classifier: Column | None = None) -> Column:
    return F.struct(hook.alias("hook"), semantic.alias("semantic"), modal.alias("modal"), will.alias("will_infinitive"), (F.lit(None) if classifier is None else classifier).cast("double").alias("classifier_score"))


def signals_json(s: Column) -> Column:
    """The wire form: short names, the classifier as text, left out where there is none."""
    score = s.getField("classifier_score")
    return F.to_json(F.struct(*[s.getField(a).alias(b) for a, b in (("hook", "hook"), ("semantic", "semantic"), ("modal", "modal"), ("will_infinitive", "will_inf"))], F.when(score.isNotNull(), F.format_string("ml:%.3f", score)).alias("classifier")))


def signals_from_json(text: Column) -> Column:
    """The inverse of ``signals_json``."""
    x = F.from_json(text, "hook boolean, semantic boolean, modal boolean, will_inf boolean, classifier string")
    flag = lambda name: F.coalesce(x.getField(name), F.lit(False))
    return signals(flag("hook"), flag("semantic"), flag("modal"), flag("will_inf"), F.regexp_replace(x.getField("classifier"), "^ml:", "").try_cast("double"))


def strength(s: Column) -> Column:
    score = F.coalesce(s.getField("classifier_score"), F.lit(0.0))
    return F.when((score > 0.85) | (s.getField("will_infinitive") & s.getField("semantic")), "strong").when(s.getField("hook") & s.getField("modal"), "moderate").otherwise("weak")


def signal_count(s: Column) -> Column:
    flags = [s.getField(n).cast("int") for n in ("hook", "semantic", "modal", "will_infinitive")]
    return (sum(flags[1:], flags[0]) + F.when(s.getField("classifier_score") > 0.7, 1).otherwise(0)).cast("bigint")


def is_high_confidence(confidence: Column, threshold: float = 0.8) -> Column:
    return confidence >= threshold


def has_context(context: Column) -> Column:
    return F.length(F.coalesce(context, F.lit(""))) > 0


def is_actionable(confidence: Column, category: Column, text: Column) -> Column:
    return (confidence >= 0.75) & (category != "unspecified") & (F.length(text) > 50)


def priority(impact: Column, difficulty: Column) -> Column:
    return impact * (1 - difficulty)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def combined(feasibility: Column, significance: Column) -> Column:
    return F.round(0.6 * feasibility + 0.4 * significance, 3)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is NULL, empty or zero; the product ends with the shorter one, the norms don't."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    dot = total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def identifier(doi: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(doi, F.lit("")), title)


def section(sections: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(sections, F.lit(name)), F.lit(""))


def joined_sections(sections: Column, names: list[str]) -> Column:
    return F.array_join(F.filter(F.array(*[section(sections, n) for n in names]), lambda x: x != ""), "\n")


def question_text(sections: Column) -> Column:
    return joined_sections(sections, ["introduction", "related"])


def future_text(sections: Column) -> Column:
    return joined_sections(sections, ["discussion", "conclusion", "limitations", "future"])


def question_label(confidence: Column, question: Column) -> Column:
    return F.format_string("RQ[%.2f]: %s...", confidence, F.substring(question, 1, 80))


def summary_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit(". Abstract: "), F.coalesce(abstract, F.lit("")))


def entity_labels(entities: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.slice(entities, 1, 100), lambda e: e.getField("label")), lambda x: F.coalesce(x, F.lit("")) != "")))


def openalex(work: Column) -> Column:
    """The fields kept of a work's JSON; NULL where it isn't an object."""
    w = F.from_json(work, "id string, title string, publication_year int, cited_by_count bigint, concepts array<struct<display_name:string>>, related_works array<struct<id:string>>, authorships array<struct<author:struct<display_name:string>>>")
    authors = F.filter(F.transform(w.getField("authorships"), lambda a: a.getField("author").getField("display_name")), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(w.getField("id").isNotNull(), F.struct(
        w.getField("id").alias("openalex_id"), w.getField("title").alias("title_oa"), w.getField("publication_year").alias("year"), F.coalesce(w.getField("cited_by_count"), F.lit(0).cast("bigint")).alias("cited_by_count"),
        F.slice(F.transform(w.getField("concepts"), lambda c: c.getField("display_name")), 1, 10).alias("concepts"), F.slice(F.transform(w.getField("related_works"), lambda c: c.getField("id")), 1, 20).alias("related_ids"), authors.alias("authors"),
        F.get_json_object(work, "$.authorships").alias("authorships"),
    ))


def has_openalex(oa: Column) -> Column:
    return oa.isNotNull()


def citations(oa: Column) -> Column:
    return F.coalesce(oa.getField("cited_by_count"), F.lit(0).cast("bigint"))
