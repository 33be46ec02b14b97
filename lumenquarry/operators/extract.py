"""Signals of sentences, and the three extractors over them.

``sentences`` are rows (doc_id, sent_index, sent), and key where it is known already, with
these columns where a model is plugged in: ``semantic_rq``, ``semantic_limit``, ``semantic_future`` (BOOLEAN), ``discourse``
(STRING), ``ml_score`` (DOUBLE). Without them the rules decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as S
from ..functions import text as X


#: Characters of a sentence that may be a question or a direction.
QUESTION_LENGTH, FUTURE_LENGTH = (30, 280), (40, 350)


def _or(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(name), otherwise) if name in df.columns else otherwise


def _keyed(df: DataFrame) -> DataFrame:
    return df if "key" in df.columns else df.withColumn("key", X.dedup_key(F.col("sent")))


def _first(df: DataFrame) -> DataFrame:
    """The first row of each (doc_id, key)."""
    order = Window.partitionBy("doc_id", "key").orderBy("sent_index")
    return df.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def _able(sent: Column, low: Column) -> Column:
    """Whether a sentence of this key may ask a question, whatever its cue."""
    return F.length(sent).between(*QUESTION_LENGTH) & (sent.endswith("?") | X.contains_one(low, ["we ", "aim", "hypothesi"]))


def _asks(df: DataFrame) -> tuple[Column, Column]:
    """Whether a keyed sentence asks a question, and its signals."""
    low = F.col("key")
    hook, semantic = X.has_any(low, L.QUESTION), _or(df, "semantic_rq", F.lit(False))
    able = _able(F.col("sent"), low)
    return able & (hook | semantic | (_or(df, "discourse", F.lit("")) == "rq")), S.signals(hook, semantic, F.lit(False), F.lit(False))


def research_questions(sentences: DataFrame) -> DataFrame:
    """The first accepted sentence of each key; the gate goes first, so few rows are shuffled."""
    df = _keyed(sentences)
    gate, signals = _asks(df)
    kept = _first(df.where(gate).withColumn("signals", signals))
    evidence = F.struct(F.col("sent").alias("text"), F.col("sent_index"), F.lit(None).cast("string").alias("section"))
    return kept.select("doc_id", X.as_question(F.col("sent")).alias("question"), evidence.alias("evidence"), F.lit(0.8).alias("confidence"), "signals", F.lit("explicit_rq").alias("type"))


def limitations(sentences: DataFrame) -> DataFrame:
    """All that hint at one; neither a length nor a repetition rules any out."""
    model = _or(sentences, "semantic_limit", F.lit(False)) | (_or(sentences, "discourse", F.lit("")) == "limitation")
    kept = sentences.withColumn("model", model).where(F.col("model") | X.has_any(F.lower("sent"), L.LIMIT))
    return kept.select("doc_id", F.col("sent").alias("text"), "sent_index", F.when(F.col("model"), 0.9).otherwise(0.8).alias("confidence"), F.lit("unspecified").alias("limitation_type"), F.lit("limitation").alias("type"))


def _future_candidates(sentences: DataFrame, threshold: float) -> DataFrame:
    df = _keyed(sentences.where(F.length("sent").between(*FUTURE_LENGTH))).withColumn("is_ref", X.looks_like_reference(F.col("sent")))
    low = F.col("key")
    hook, modal, will = X.has_any(low, L.FUTURE), X.has_any(F.concat(F.lit(" "), low, F.lit(" ")), L.MODAL), X.will_infinitive(low)
    semantic, labelled = _or(df, "semantic_future", F.lit(False)), _or(df, "discourse", F.lit("")) == "future"
    score = F.col("ml_score") if "ml_score" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("signals", S.signals(hook, semantic, modal, will, score)).withColumn("labelled", labelled)
    s = F.col("signals")
    rule = (s.hook & (s.modal | s.will_infinitive)) | s.semantic | F.col("labelled")
    return df.withColumn("keep", rule & F.coalesce(s.classifier_score >= threshold, F.lit(True)))


def _by_rules(df: DataFrame) -> bool:
    return not {"semantic_future", "discourse", "ml_score"} & set(df.columns)


def future_directions(sentences: DataFrame, threshold: float = 0.7, context: DataFrame | None = None, by_key: bool = False) -> DataFrame:
    """The first sentence of each key, where it passes the gate.

    The key is settled before the gate. Rules see the key only, so that all rows of a key
    pass or none does, and the gate may go first; with a model it mustn't, unless the caller
    knows that it says the same of all sentences of a key (``by_key``).
    """
    df = _future_candidates(sentences, threshold).where("not is_ref")
    df = _first(df.where("keep")) if by_key or _by_rules(sentences) else _first(df).where("keep")
    s = F.col("signals")
    sure = s.will_infinitive | s.semantic | F.col("labelled") | (F.coalesce(s.classifier_score, F.lit(0.0)) >= 0.85)
    if context is not None:
        df = df.join(context.select("doc_id", "sent_index", "context"), ["doc_id", "sent_index"], "left")
    text = F.coalesce(F.col("context"), F.lit("")) if context is not None else F.lit("")
    return df.select("doc_id", F.col("sent").alias("text"), X.category(F.col("sent")).alias("category"), "sent_index", F.when(sure, 0.9).otherwise(0.8).alias("confidence"), "signals", text.alias("context"), F.lit("future_direction").alias("type"))


def rejected(sentences: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, sent_index, reason, sent): each reference, and the first sentence of each key that fails the gate.

    One pass: references and others are numbered apart by one window.
    """
    df = _future_candidates(sentences, threshold)
    if _by_rules(sentences):  # a key fails as a whole, so the gate may go first
        df = df.where(F.col("is_ref") | ~F.col("keep"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "key", "is_ref").orderBy("sent_index"))
    df = df.withColumn("nth", nth).where(F.col("is_ref") | ((F.col("nth") == 1) & ~F.col("keep")))
    return df.select("doc_id", "sent_index", F.when(F.col("is_ref"), "future_dir_reject_ref").otherwise("future_dir_reject").alias("reason"), "sent")


def _looks_ahead(sent: Column, low: Column) -> Column:
    """The gate of future directions by the rules."""
    hook, modal = X.has_any(low, L.FUTURE), X.has_any(F.concat(F.lit(" "), low, F.lit(" ")), L.MODAL)
    return F.length(sent).between(*FUTURE_LENGTH) & hook & (modal | X.will_infinitive(low)) & ~X.looks_like_reference(sent)


#: For ``sections.explode_parts``: the gates of the rules for questions, limitations and directions, before and after the key is known.
GATES = {
    "rq": (lambda sent: F.length(sent).between(*QUESTION_LENGTH), lambda sent, low: _able(sent, low) & X.has_any(low, L.QUESTION)),
    "lim": (lambda sent: X.has_any(F.lower(sent), L.LIMIT), None),
    "fd": (lambda sent: F.length(sent).between(*FUTURE_LENGTH), _looks_ahead),
}


def from_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, limitations and directions by the rules, from ``sections.explode_parts`` with the parts rq, lim and fd."""
    of = lambda name: parts.where(F.col("part") == name).drop("part")
    return research_questions(of("rq")), limitations(of("lim")), future_directions(of("fd"))


def counted(parts: DataFrame) -> DataFrame:
    """(doc_id, n_rq, n_lim, n_fd, n_steps) by the rules, from ``sections.explode_parts`` with the parts rq, lim and fd.

    One pass over the texts; sentences that no gate lets pass collapse to a row a document
    before the shuffle, which is on the document.
    """
    low, part = F.col("key"), F.col("part")
    lim = X.has_any(F.lower("sent"), L.LIMIT)
    future = _looks_ahead(F.col("sent"), low)
    said = F.lower("sent")
    item = F.when((part == "rq") & _asks(parts)[0], F.struct(F.lit("rq").alias("part"), low.alias("key"), F.lit(0).alias("at"), F.lit(False).alias("step")))
    item = item.when((part == "fd") & future, F.struct(F.lit("fd").alias("part"), low.alias("key"), F.lit(0).alias("at"), F.lit(False).alias("step")))
    item = item.when((part == "lim") & lim, F.struct(part.alias("part"), F.lit("").alias("key"), F.col("sent_index").cast("int").alias("at"), (said.contains("small sample") | said.contains("lack of")).alias("step")))
    one = parts.select("doc_id", item.alias("x")).groupBy("doc_id", "x").agg(F.count("*").alias("n"))
    n = lambda name: F.count_if(F.col("x.part") == name)
    lims = F.slice(F.array_sort(F.collect_list(F.when(F.col("x.part") == "lim", F.struct("x.at", "x.step")))), 1, 5)
    per = one.groupBy("doc_id").agg(n("rq").alias("n_rq"), n("lim").alias("n_lim"), n("fd").alias("n_fd"), F.size(F.filter(lims, lambda x: x["step"])).alias("lacks"))
    return per.select("doc_id", "n_rq", "n_lim", "n_fd", (F.least("n_rq", F.lit(5)) + F.col("lacks")).alias("n_steps"))


def split_valid(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of those they break; ``strict`` raises on the first."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    if strict:
        held = F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(broken, ", ")))).otherwise(F.lit(True))
        return df.where(held), df.limit(0).withColumn("broken", F.array().cast("array<string>"))
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def question_rules() -> dict[str, Column]:
    return {"question": F.length("question") > 0, "evidence": F.length("evidence.text") > 0, "sent_index": F.col("evidence.sent_index") >= 0, "confidence": F.col("confidence").between(0, 1)}


def future_rules() -> dict[str, Column]:
    return {"text": F.length("text") > 0, "category": F.col("category").isin(*L.CATEGORY_NAMES), "sent_index": F.col("sent_index") >= 0, "confidence": F.col("confidence").between(0, 1)}


def limitation_rules() -> dict[str, Column]:
    return {"text": F.length("text") > 0, "confidence": F.col("confidence").between(0, 1)}


def step_rules() -> dict[str, Column]:
    return {"question": F.length("question") > 0, "difficulty": F.col("difficulty").between(0, 1)}
