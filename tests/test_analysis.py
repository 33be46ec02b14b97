import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import lexicon as L
from lumenquarry.operators import context, control, extract, match, steps, vectors
from lumenquarry.plans import analyze, ml
from lumenquarry.sources import labels, papers
from lumenquarry.streaming import matching

PAPER = {"doi": "", "title": "A", "text": "Future work should examine that mechanism. Our trial has limitations like a small sample.", "abstract": "We ask whether sleep alters recall."}


def sentences(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent_index int, sent string")


def test_golden_paper(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text(json.dumps(PAPER) + "\n\n{broken\n")
    good, bad = papers.read_json_lines(spark, str(path))
    assert (good.count(), bad.count()) == (1, 1)
    a = analyze.analyze(papers.load(spark, str(path)))
    q = a.questions.collect()
    assert [(r["question"], r["evidence"]["sent_index"], r["confidence"]) for r in q] == [("We ask whether sleep alters recall?", 0, 0.8)]
    assert a.limitations.count() == 2 and a.rejected.count() == 1
    f = a.future.first()
    assert (f["text"], f["sent_index"], f["category"], f["confidence"]) == ("Future work should examine that mechanism.", 1, "mechanism", 0.8)
    assert sorted(round(r["priority"], 2) for r in steps.top_steps(a.steps).collect()) == [0.42, 0.42]
    m = a.metrics(1.0).first()
    assert (m["docs"], m["rqs"], m["steps"], m["future"]) == (1, 1, 2, 1)
    a.write(str(tmp_path / "out"))
    text = a.summary().first()["markdown"]
    assert text.startswith("# A\n## Explicit Research Questions\n1. We ask whether sleep alters recall?") and "1. [mechanism] Future work" in text
    assert spark.read.json(str(tmp_path / "out/future_directions.jsonl")).count() == 1


def test_equal_papers_stay_apart(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text((json.dumps(PAPER) + "\n") * 2)
    a = analyze.analyze(papers.load(spark, str(tmp_path / "in.jsonl"))).write(str(tmp_path / "out"))
    m = a.metrics().first()
    assert (m["docs"], m["rqs"], m["steps"], m["future"]) == (2, 2, 4, 2)
    assert spark.read.json(str(tmp_path / "out/limitations.jsonl")).count() == 4 and a.summary().count() == 2


def test_semantic_gates_and_context(spark):
    from plugins import letters

    text = "Further research is needed to see all this now. The cat sat on a mat in the hall then. It remains to be determined whether all is so."
    docs = papers.with_defaults(spark.createDataFrame([(1, "T", "", text, "")], "doc_id long, title string, abstract string, text string, doi string"))
    plain = analyze.analyze(docs).future.collect()
    assert [r["sent_index"] for r in plain] == [2]
    found = analyze.analyze(docs, analyze.Options(embedder=letters, similarity=0.9, context=True, around=0, similar=1)).future.collect()
    assert {r["sent_index"] for r in found} >= {0, 2} and all(r["signals"]["semantic"] and r["confidence"] == 0.9 for r in found)
    assert {r["sent_index"]: r["context"] for r in found}[0].startswith("It remains")


def test_defaults(spark):
    df = papers.with_defaults(spark.createDataFrame([("t", None, "", None)], "title string, abstract string, text string, doi string"))
    r = df.first()
    assert (r["text"], r["abstract"], r["doi"]) == ("t", "", "")


def test_question_dedup_follows_the_gate_and_future_dedup_precedes_it(spark):
    q = extract.research_questions(sentences(spark, "we ask whether this is so (1) at all now", "We ask whether this is so [2] at all now", "we ask"))
    assert [r["evidence"]["sent_index"] for r in q.collect()] == [0]
    s = sentences(spark, "The outcome (1) of all this is not a thing we know", "The outcome (2) of all this is not a thing we know").withColumn("discourse", F.when(F.col("sent_index") == 1, "future"))
    assert extract.future_directions(s).count() == 0  # the first of the key fails, the second is a repetition
    assert extract.rejected(s).count() == 1


def test_model_gate_and_confidence(spark):
    s = sentences(spark, "Future work should examine this in greater detail.", "Future work should explore that in greater detail.").withColumn("ml_score", F.when(F.col("sent_index") == 0, 0.9).otherwise(0.2))
    got = extract.future_directions(s).collect()
    assert [(r["sent_index"], r["confidence"]) for r in got] == [(0, 0.9)]


def test_validation(spark):
    rows = spark.createDataFrame([("a", 0.5), ("", 0.5), ("b", 2.0), (None, None)], "text string, confidence double")
    ok, bad = extract.split_valid(rows, extract.limitation_rules())
    assert ok.count() == 1 and sorted(len(r["broken"]) for r in bad.collect()) == [1, 1, 2]
    with pytest.raises(Exception, match="invalid row"):
        extract.split_valid(rows, extract.limitation_rules(), strict=True)[0].collect()


@pytest.mark.parametrize(("i", "has"), [(0, ["Second."]), (1, ["First.", "Third."]), (2, ["Second."])])
def test_context(spark, i, has):
    s = sentences(spark, "First.", "Second.", "Third.")
    got = context.with_context(s).where(F.col("sent_index") == i).first()["context"]
    assert got == " ".join(has)
    assert context.with_context(s, enabled=False).where(F.col("sent_index") == i).first()["context"] == ""
    assert len(context.with_context(sentences(spark, *["a" * 100] * 3), most=50).first()["context"]) <= 50


def test_similar_sentences_in_context(spark):
    s = sentences(spark, "a", "b", "c").withColumn("v", F.when(F.col("sent_index") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    got = context.with_context(s, around=1, similar=1, vector="v").where("sent_index = 0").first()["context"]
    assert got == "b c"


def test_prototypes(spark):
    v = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 0.0],), ([],), (None,)], "v array<double>")
    got = v.select(vectors.matches_prototypes(F.col("v"), [[1.0, 0.0]], L.SIMILAR).alias("m")).collect()
    assert [r["m"] for r in got] == [True, False, False, False]


@pytest.mark.parametrize(("order", "n"), [("dl", 1), ("ld", 1), ("ddl", 1), ("dlld", 2), ("d", 0), ("", 0)])
def test_fold(spark, order, n):
    rows = [("t", i, "data" if c == "d" else "lit", 0.1 * i) for i, c in enumerate(order)]
    got = match.fold(spark.createDataFrame(rows, "topic string, seq long, side string, score double")).collect()
    assert len(got) == n
    if order == "ddl":
        assert got[0]["feasibility"] == pytest.approx(0.1)


def folded(order):
    """(feasibility, significance) of the matches, by the rule as it is told."""
    d = lit = None
    out = []
    for i, c in enumerate(order):
        d, lit = (i, lit) if c == "d" else (d, i)
        if d is not None and lit is not None:
            out.append((d, lit))
            d = lit = None
    return out


def test_fold_against_a_loop(spark):
    rng = random.Random(3)
    orders = ["".join(rng.choice("dl") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    rows = [(str(k), i, "data" if c == "d" else "lit", float(i)) for k, o in enumerate(orders) for i, c in enumerate(o)]
    got = {}
    for r in match.fold(spark.createDataFrame(rows, "topic string, seq long, side string, score double")).orderBy("topic", "n").collect():
        got.setdefault(r["topic"], []).append((r["feasibility"], r["significance"]))
    assert got == {str(k): folded(o) for k, o in enumerate(orders) if folded(o)}


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)] + [(2, 100, [1.0] * 5), (2, 101, None)], "g int, id long, v array<double>")
    plain = lambda rows: sorted((r["g"], r["id"], r["rank"], r["neighbour"], round(r["cosine"], 9)) for r in rows)
    pairs = lambda rows: sorted((r["g"], r["a"], r["b"], round(r["cosine"], 9)) for r in rows)
    whole, close = plain(vectors.nearest(df, "g", "id", "v", 3).collect()), pairs(vectors.pairs_over(df, "g", "id", "v", 0.5).collect())
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert plain(vectors.nearest(df, "g", "id", "v", 3).collect()) == whole and pairs(vectors.pairs_over(df, "g", "id", "v", 0.5).collect()) == close
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(i % 2, i, n + 1, j, round(float(u[i] @ u[j]), 9)) for i in range(90) for n, j in enumerate(sorted((j for j in range(i % 2, 90, 2) if j != i), key=lambda j: (-round(float(u[i] @ u[j]), 12), j))[:3])]
    assert whole == sorted(want) and len(close) > 50


def test_stub_records(spark):
    t = spark.createDataFrame([(x,) for x in match.TOPICS], "topic string")
    got = match.match_topics(match.stub_data(t), match.stub_literature(t)).collect()
    assert len(got) == 5 and {r["scores"]["combined"] for r in got} == {0.788}


def test_wire(spark):
    lines = spark.createDataFrame([(x,) for x in ("", "no", '{"a":1}', '{"type":"data_result","payload":{"topic":"t","feasibility_score":0.5}}')], "value string")
    got = matching.from_wire(matching.parse(lines)).select("topic", "side", "score").collect()
    assert [(r["topic"], r["side"], r["score"]) for r in got] == [("t", "data", 0.5)]


def test_quotas_are_settings():
    got = control.settings({"max_batch": 32, "token_rate": 0.5, "gpu_frac": 0.25})
    assert got == {"spark.sql.execution.arrow.maxRecordsPerBatch": "32", "maxFilesPerTrigger": "32", "rowsPerSecond": "1", "spark.task.resource.gpu.amount": "0.25"}
    with pytest.raises(ValueError, match="max_batch"):
        control.settings({"other": 1})


def test_buckets_stream_over_batches(spark):
    rows = [(k, float(t), 3) for k in ("a", "b") for t in range(50)]
    df = spark.createDataFrame(rows, "k string, at double, want int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = control.granted(df, "k", ["at"], "at", "want", 4, 1.0).groupBy("k").agg(F.sum("granted").alias("g"), F.sum("granted_part").alias("p")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    steps_ = spark.createDataFrame([([(0.0, 3)] + [(1.0, 3)] * 49,)], "s array<struct<dt:double,want:int>>")
    for name, partial in (("g", False), ("p", True)):
        want = sum(steps_.select(control.token_bucket(F.col("s"), 4, 1.0, partial).alias("x")).first()["x"])
        assert [r[name] for r in got] == [want, want]


def test_buckets_and_rates(spark):
    s = spark.createDataFrame([([(0.0, 3), (0.0, 3), (10.0, 3)],)], "s array<struct<dt:double,want:int>>")
    assert s.select(control.token_bucket(F.col("s"), 4, 1.0).alias("x")).first()["x"] == [3, 0, 3]
    assert s.select(control.token_bucket(F.col("s"), 4, 1.0, True).alias("x")).first()["x"] == [3, 1, 3]
    r = spark.range(1).select(control.adapt(F.lit(4.0), F.lit(2.0), F.lit(2.0), F.lit(1.0)).alias("x")).first()["x"]
    assert (round(r["data_rate"], 4), round(r["lit_rate"], 4)) == (round(3.4 * 1.05, 4), round(2.3 * 1.05, 4))


def test_label_cleaner(spark, tmp_path):
    lines = ["﻿sentence,label", "# note,1", "", "plain words", 'with, comma,1', '"quoted, text",0', "odd,2", "blank,", ' "say ""x""" , 1 ']
    (tmp_path / "in.csv").write_text("\r\n".join(lines) + "\r\n")
    assert labels.clean_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out")) == 1
    got = [(r["sentence"], r["label"]) for r in labels.read_examples(spark, str(tmp_path / "in.csv")).collect()]
    assert ("quoted, text", 0) in got
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').collect()
    assert {(r["sentence"], r["label"]) for r in back} == {("with, comma", "1"), ("quoted, text", "0"), ("odd", None), ("blank", None), ('say ""x""', "1")}


def test_json_examples_drop_bad_labels(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"sentence":"a","label":"1"}\n{"text":" b ","requires_new_data":0}\n{"sentence":"c","label":"x"}\n{"sentence":" "}\nbroken\n')
    got = {(r["sentence"], r["label"]) for r in labels.read_examples(spark, str(tmp_path / "x.jsonl")).collect()}
    assert got == {("a", 1), ("b", 0)}


def test_pdfs(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"1")
    (tmp_path / "two.pdf").write_bytes(b"2")
    tei = "<TEI><title> T </title><abstract><p>abs</p></abstract><body>B<p>C</p></body><idno type=\"DOI\">10.1/x</idno>"
    got = papers.read_pdfs(spark, str(tmp_path), lambda b: tei if b == b"1" else None, lambda b: "plain").collect()
    assert [tuple(r) for r in got] == [("T", "abs", "BC", "10.1/x"), ("two", "", "plain", "")]


def test_classifier(spark, tmp_path):
    rows = [(f"Future work should examine item {i}", 1) for i in range(60)] + [(f"Item {i} was measured in the past", 0) for i in range(40)]
    df = ml.with_features(spark.createDataFrame(rows, "sentence string, label int"))
    split = ml.stratified_split(df, key="sentence")
    assert {(r["label"], r["n"]) for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(1, 12), (0, 8)}
    model = ml.CalibratedClassifier.fit(split.where("not is_test"))
    scored = split.where("is_test").withColumn("score", model.score(F.col("features"))).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    r = ml.report(scored).first()
    assert r["auc"] == 1.0 and r["accuracy"] == 1.0
    model.save(str(tmp_path / "m"))
    assert len(ml.CalibratedClassifier.load(str(tmp_path / "m")).models) == 3


def test_parts_are_gated_before_they_are_rows(spark):
    """One pass finds what three do, repetitions, citations and documents without any included."""
    from lumenquarry.operators import extract, sections
    from lumenquarry.plans import queries as Q

    texts = [*Q.PASSAGES, "", None, "We ask  whether [12] it works in adults? We ask whether it works in adults?", "future\twork should be examined in greater detail here. Future work (3) should be examined in greater detail here."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = Q._parts(docs)
    assert parts.count() < 40 and {r["doc_id"] for r in parts.collect()} == set(range(len(texts)))
    cut = docs.select("doc_id", "text", sections.split_sections(F.col("text")).alias("s"))
    q = extract.research_questions(sections.explode_sentences(cut, sections.question_bucket(F.col("s"))))
    lim = extract.limitations(sections.explode_sentences(cut, sections.limitation_bucket(F.col("s"))))
    f = extract.future_directions(sections.explode_sentences(cut, F.col("text")))
    for mine, whole in zip(extract.from_parts(parts.where("part is not null")), (q, lim, f)):
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, whole.collect())) and whole.count() > 2


@pytest.mark.parametrize("name", ["summary_markdown", "first_papers"])
def test_papers_are_split_once(spark, name):
    """What is shown of papers comes from one pass that is written and read: no plan after it cuts a text."""
    from lumenquarry.plans.records import RECORDS

    plan = RECORDS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[^.!?]" not in plan and "split(" not in plan


def test_first_papers_are_chosen_before_the_work(spark, monkeypatch):
    from lumenquarry.plans import records

    seen = []
    monkeypatch.setattr(records, "staged", lambda df, tag: seen.append(df) or df)
    records.first_papers(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and 0 < seen[0].select("doc_id").distinct().count() <= 5


def test_vectors_stay_in_the_worker(spark):
    """The gate in Python says what the one over vectors says; of the sentences only one bit comes back, and the gate goes before the shuffle."""
    from lumenquarry.plans import analyze, records

    p = [records.letters_of(t) for t in L.PROTOTYPES["future"]]
    said = [*L.PROTOTYPES["future"], "", "123 .", "zzz", "Future work should examine this mechanism.", "Kelvin İ é future studies should examine ß", *[t[:n] for t in L.PROTOTYPES["limit"] for n in (3, 17, 60)]]
    rows = spark.createDataFrame([(t, records.letters_of(t)) for t in said], "sent string, vector array<double>")
    got = analyze.semantic(rows, {"future": p}, 0.93).withColumn("own", analyze.says(F.lower("sent"), records.letters(), p, 0.93)).collect()
    assert all(r["own"] == r["semantic_future"] for r in got) and {r["own"] for r in got} == {True, False}
    plan = records.RECORDS["semantic_future"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan.replace("regexp_replace(", "") and plan.index("Window [") < plan.index("ArrowEvalPython")
