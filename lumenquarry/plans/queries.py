"""The registered queries over the driver's tables, and their SQL.

The documents hold none of the cue phrases, so each gets a passage by its id (``seeded``),
the same in both engines; texts and tables stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as S
from ..functions import text as X
from ..operators import context, control, extract, match, sections, steps, vectors
from ..sources import labels as label_source
from ..sources import papers

PASSAGES = [
    "We investigate whether this pathway alters recovery in adults.",
    "Future work should examine this mechanism in greater detail.",
    "Limitations\nA limitation is the small sample size of this cohort.",
    "Discussion\nThere is a lack of control data. We could not adjust for age.",
    "Methods\nWe ask whether dosing alters the outcome in adults.",
    "Further studies will validate these structural findings in practice.",
    "It remains unknown whether this generalizes; regulation should be examined.",
    "Future studies should be validated (12) in other species and cohorts.\nFuture studies should be validated [3] in other species and cohorts.",
    "Future work should follow the record at http://example and doi:abc for details.",
    "Future work 1 2 3 4 5 6 should examine the following samples.",
    "The next step is open question territory for this cohort.",
    "Summary\nThe aim of this study is to test recovery, we believe?",
    "Outlook\nIt is unclear whether this may replicate in future cohorts.",
    "Future work should.",
    "Future work should examine this mechanism in greater detail. Future work should examine this mechanism in greater detail.",
    "Plain filler sentence without any relevant cue in it at all.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    passage = F.element_at(F.array(*map(F.lit, PASSAGES)), (F.col("doc_id") % len(PASSAGES) + 1).cast("int"))
    return docs.select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), F.lit(".\n"), passage).alias("text"))


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", sections.split_sections(F.col("text")).alias("s"))


def _questions(spark, sf_dir):
    return extract.research_questions(sections.explode_sentences(_sectioned(spark, sf_dir), sections.question_bucket(F.col("s"))))


def _limits(spark, sf_dir):
    return extract.limitations(sections.explode_sentences(_sectioned(spark, sf_dir), sections.limitation_bucket(F.col("s"))))


def _sentences(spark, sf_dir):
    return sections.explode_sentences(seeded(spark, sf_dir), F.col("text"))


def _future(spark, sf_dir):
    return extract.future_directions(_sentences(spark, sf_dir))


def sentence_split_stats(spark, sf_dir):
    s = X.sentences(F.col("text"))
    per = seeded(spark, sf_dir).select("lang", F.size(s).cast("bigint").alias("n"), F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("c"))
    return per.groupBy("lang").agg(F.sum("n").alias("n_sentences"), F.sum("c").alias("n_chars"))


def section_map(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("doc_id", F.explode_outer("s").alias("section", "body")).where("body <> ''").select("doc_id", "section", F.length("body").cast("bigint").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


def section_sizes(spark, sf_dir):
    return _sectioned(spark, sf_dir).select(F.explode_outer("s").alias("section", "body")).groupBy("section").agg(F.count_if(F.col("body") != "").alias("n_docs"), F.sum(F.length("body")).alias("n_chars"))


def research_questions(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return q.select("doc_id", "question", F.col("evidence.text").alias("evidence"), F.col("evidence.sent_index").cast("bigint").alias("sent_index"), "confidence", F.col("signals.hook").alias("hook"), "type")


def limitations(spark, sf_dir):
    return _limits(spark, sf_dir).select("doc_id", "text", F.col("sent_index").cast("bigint").alias("sent_index"), "confidence", "limitation_type")


def future_directions(spark, sf_dir):
    f = _future(spark, sf_dir)
    return f.select("doc_id", "text", "category", F.col("sent_index").cast("bigint").alias("sent_index"), "confidence", F.col("signals.hook").alias("hook"), F.col("signals.modal").alias("modal"), F.col("signals.will_infinitive").alias("will_inf"))


def rejected_sentences(spark, sf_dir):
    return extract.rejected(_sentences(spark, sf_dir)).select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "reason", "sent")


def fd_by_category(spark, sf_dir):
    return _future(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def signal_strength(spark, sf_dir):
    s = F.col("signals")
    return _future(spark, sf_dir).groupBy(S.strength(s).alias("strength"), S.signal_count(s).alias("signals")).agg(F.count("*").alias("n"))


def actionable_fd(spark, sf_dir):
    return _future(spark, sf_dir).where(S.is_actionable(F.col("confidence"), F.col("category"), F.col("text"))).select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), "category", "confidence")


def high_conf(spark, sf_dir):
    return _future(spark, sf_dir).where(S.is_high_confidence(F.col("confidence"), 0.9)).select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), S.signals_json(F.col("signals")).alias("signals"))


def _steps(spark, sf_dir):
    return steps.next_steps(_questions(spark, sf_dir), _limits(spark, sf_dir))


def next_steps(spark, sf_dir):
    return _steps(spark, sf_dir).select("doc_id", "ordinal", "question", "expected_impact", "difficulty", F.col("links")[0].alias("link"))


def priority_topn(spark, sf_dir):
    return steps.top_steps(_steps(spark, sf_dir), 3).select("doc_id", "rank", "question", "priority")


def _parts(docs: DataFrame) -> DataFrame:
    """The sentences that pass as a question, limitation or direction, from one pass over the texts."""
    docs = docs.select("doc_id", "text", sections.split_sections(F.col("text")).alias("s"))
    s = F.col("s")
    return sections.explode_parts(docs, {"rq": sections.question_bucket(s), "lim": sections.limitation_bucket(s), "fd": F.col("text")}, gates=extract.GATES)


def _counted(spark, sf_dir):
    """All counts of each document."""
    return extract.counted(_parts(seeded(spark, sf_dir)))


def _totals(spark, sf_dir):
    return steps.with_total(_counted(spark, sf_dir))


def doc_rollup(spark, sf_dir):
    return _totals(spark, sf_dir)


def corpus_stats(spark, sf_dir):
    return steps.corpus_totals(_totals(spark, sf_dir))


def run_metrics(spark, sf_dir):
    zero = F.lit(0).cast("bigint")
    return _counted(spark, sf_dir).agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(c).cast("bigint"), zero).alias(n) for c, n in (("n_rq", "rqs"), ("n_steps", "steps"), ("n_fd", "future"))])


def rule_features(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", F.col("sent_index").cast("bigint").alias("sent_index"), X.rule_features(F.col("sent")).alias("f")).select("doc_id", "sent_index", "f.*")


def text_functions(spark, sf_dir):
    t = F.col("text")
    return seeded(spark, sf_dir).select("doc_id", X.cut(t).alias("cut"), X.preview(t).alias("preview"), F.md5(X.dedup_key(t).cast("binary")).alias("key_digest"), F.length(X.as_question(t)).cast("bigint").alias("question_len"), X.looks_like_reference(t).alias("is_reference"))


def context_window(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return context.with_context(turns, vector=None, by="conv_id", order="turn", text="text").select("conv_id", "turn", "context")


def proto_match(spark, sf_dir):
    """Every vector against fixed prototypes."""
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(vectors.best_similarity(F.col("embedding"), PROTOTYPES), 6).alias("best"), vectors.matches_prototypes(F.col("embedding"), PROTOTYPES, 0.25).alias("matches"))


#: Five directions over 64 dimensions, as prototypes whose embeddings a provider would give.
PROTOTYPES = [[round(((i * 7 + p * 13) % 17 - 8) / 8, 3) for i in range(64)] for p in range(5)]


def topk_neighbors(spark, sf_dir):
    out = vectors.nearest(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 2)
    return out.select("label", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


def cosine_pairs(spark, sf_dir):
    out = vectors.pairs_over(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3)
    return out.select("label", "a", "b", F.round("cosine", 6).alias("cosine"))


def strip_tags(spark, sf_dir):
    body = X.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).cast("bigint").alias("n_chars"), F.md5(body.cast("binary")).alias("digest"))


def tei_extract(spark, sf_dir):
    x = papers.tei_fields(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", x.alias("x")).select("page_id", "x.title", F.length("x.abstract").cast("bigint").alias("abstract_len"), F.md5(F.col("x.text").cast("binary")).alias("text_digest"), "x.doi")


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("topic"), "ts", "event_id", F.when(F.col("event_type") == "view", "data").when(F.col("event_type") == "click", "lit").alias("side"), F.col("value").alias("score")).where("side is not null")


def _latest(spark, sf_dir, topic="topic"):
    last = match.latest(_sides(spark, sf_dir).withColumn("topic", F.expr(topic)), ["topic", "side"], ["ts", "event_id"], "score")
    side = lambda s, name: last.where(F.col("side") == s).select("topic", F.col("score").alias(name))
    return side("data", "feasibility_score"), side("lit", "significance_score")


def topic_match(spark, sf_dir):
    d, lit = _latest(spark, sf_dir)
    return d.join(lit, "topic").select("topic", F.round(0.6 * F.col("feasibility_score") + 0.4 * F.col("significance_score"), 3).alias("combined"))


#: A user's day, as there are users on both sides always.
BY_DAY = "topic * 100 + day(ts)"


def unmatched_data(spark, sf_dir):
    d, lit = _latest(spark, sf_dir, BY_DAY)
    return match.unmatched(d, lit)


def unmatched_lit(spark, sf_dir):
    d, lit = _latest(spark, sf_dir, BY_DAY)
    return match.unmatched(lit, d)


def match_fold(spark, sf_dir):
    m = _sides(spark, sf_dir).select("topic", F.struct("ts", "event_id").alias("seq"), "side", "score")
    return match.fold(m).select("topic", "n", F.col("seq.event_id").alias("event_id"), "feasibility", "significance", "combined")


def stub_match(spark, sf_dir):
    topics = spark.createDataFrame([(t,) for t in match.TOPICS], "topic string")
    return match.match_topics(match.stub_data(topics), match.stub_literature(topics)).select("topic", F.col("scores.combined").alias("combined"), F.size("why.pub_trend").cast("bigint").alias("n_counts"))


def rps_sliding(spark, sf_dir):
    return match.sliding_rate(table(spark, sf_dir, "events"), window="1 hour", slide="30 minutes", seconds=3600).select("start", "n", F.round("rps", 9).alias("rps"))


def match_rate(spark, sf_dir):
    return match.tumbling_rate(table(spark, sf_dir, "events")).select("start", "n", F.round("rate", 9).alias("rate"))


def event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def sparkline(spark, sf_dir):
    """Each user's last 24 values as bars."""
    last = match.last_n(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 24)
    per = last.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.round(x["value"], 4)).alias("v"))
    return per.select("user_id", X.sparkline(F.col("v"), 24).alias("bars"))


def enrich_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("bigint").alias("toxic"))


def label_clean(spark, sf_dir):
    """A line of CSV made of each whole document, some of them broken, through the cleaner."""
    k = F.col("doc_id") % 6
    sent = F.regexp_replace("text", r"[\r\n]", " ")
    line = F.when(k == 0, F.concat(F.lit('"'), sent, F.lit('",1'))).when(k == 1, F.concat(sent, F.lit(",2"))).when(k == 2, F.concat(F.lit("# "), sent)).when(k == 3, F.translate(sent, ",", ";")).when(k == 4, F.concat(F.lit("﻿"), sent, F.lit(" , 0 \r"))).otherwise(F.concat(sent, F.lit(",")))
    lines = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    return label_source.clean_lines(lines).select("doc_id", "sentence", "label", "bad")


def labeled_examples(spark, sf_dir):
    """Whole texts as sentences under one of the two names, with labels of all kinds."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" \n"), "text")).otherwise("").alias("sentence"), F.when(F.col("doc_id") % 3 > 0, F.concat("text", F.lit(" \t"))).alias("text"), F.when(F.col("doc_id") % 4 == 0, "1.0").when(F.col("doc_id") % 4 == 1, "yes").when(F.col("doc_id") % 4 == 2, "0").otherwise(None).alias("label"), F.lit("1").alias("requires_new_data"))
    return label_source.examples(raw, keep=["doc_id"])


def token_bucket(spark, sf_dir):
    """Grants of a bucket to each user's events, by the seconds between them."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit(7).alias("want"))
    return control.granted(e, "user_id", ["ts", "event_id"], "at", "want", 10, 0.0).groupBy("user_id").agg(F.sum("granted").alias("granted"), F.sum("granted_part").alias("granted_part"))


def rate_controller(spark, sf_dir):
    """The feeders' rates after each hour, by what was done in it."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg((F.count_if(F.col("event_type") == "view") / 100).alias("data"), (F.count_if(F.col("event_type") == "click") / 100).alias("lit"))
    all_ = e.agg(F.array_sort(F.collect_list(F.struct("h", "data", "lit"))).alias("o"))
    return all_.select(F.posexplode(control.adapt_all(F.col("o"), 4.0, 2.0)).alias("n", "r")).select(F.col("n").cast("bigint").alias("n"), F.round("r.data_rate", 6).alias("data_rate"), F.round("r.lit_rate", 6).alias("lit_rate"))


def report(spark, sf_dir):
    """How well the length of a text tells its quality, and toxic its opposite: counts and AUC."""
    from . import ml

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"), F.col("n_chars").cast("double").alias("score"))
    return ml.report(d)


def stratified_split(spark, sf_dir):
    from . import ml

    return ml.stratified_split(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))).select("doc_id", "is_test")


QUERIES = {f.__name__: f for f in (
    sentence_split_stats, section_map, section_sizes, research_questions, limitations, future_directions, rejected_sentences, fd_by_category, signal_strength, actionable_fd, high_conf, next_steps, priority_topn, doc_rollup, corpus_stats, run_metrics,
    rule_features, text_functions, context_window, proto_match, topk_neighbors, cosine_pairs, strip_tags, tei_extract, topic_match, unmatched_data, unmatched_lit, match_fold, stub_match, rps_sliding, match_rate, event_counts, sparkline,
    enrich_left_join, label_clean, labeled_examples, token_bucket, rate_controller, report, stratified_split,
)}
