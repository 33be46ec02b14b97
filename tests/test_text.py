import pytest
from pyspark.sql import functions as F

from lumenquarry.functions import lexicon as L
from lumenquarry.functions import scores as S
from lumenquarry.functions import text as X
from lumenquarry.operators import sections


def one(spark, expression, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]).select(expression.alias("x")).first()["x"]


def test_lexicon_sizes():
    assert (len(set(L.FUTURE)), len(L.QUESTION), len(L.LIMIT), len(L.MODAL), len(L.WILL_VERBS)) == (64, 30, 31, 17, 15)


@pytest.mark.parametrize(("mode", "text", "n"), [("smart", "Dr. Smith works at MIT. He studies AI.", 2), ("naive", "Dr. Smith works at MIT. He studies AI.", 3), ("smart", "What?! Really?! Yes!", 3), ("naive", "What?! Really?! Yes!", 5), ("smart", "", 0), ("naive", "", 0), ("smart", "no mark here", 1), ("naive", "no mark here", 1), ("smart", "word " * 10000 + ".", 1), ("smart", "It grew 3.5 cm. Then it stopped.", 2)])
def test_sentences(spark, mode, text, n):
    assert len(one(spark, X.sentences(F.col("t"), mode), t=text)) == n


def test_sentences_of_null_are_none(spark):
    assert one(spark, X.sentences(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("text", "out"), [("a<b>c</b>d", "acd"), ("x > y", "x  y"), ("open <tag", "open "), ("", "")])
def test_strip_tags(spark, text, out):
    assert one(spark, X.strip_tags(F.col("t")), t=text) == out


@pytest.mark.parametrize(("text", "out"), [("foo.", "foo?"), ("foo?", "foo?"), ("foo!", "foo!?"), ("foo..", "foo.?"), (" foo ", "foo?")])
def test_question(spark, text, out):
    assert one(spark, X.as_question(F.col("t")), t=text) == out


def test_key_and_white_space(spark):
    assert one(spark, X.dedup_key(F.col("t")), t=" A (12)  b [3]\tC (12345) ") == "a b c (12345)"
    assert one(spark, X.strip(F.col("t"), True), t=" x ") == "x"
    assert one(spark, X.strip(F.col("t")), t=" x") == " x"


@pytest.mark.parametrize(("text", "out"), [("see et al. 2", False), ("see et al.x", True), ("in (2020)", True), ("1 2 3 4 5 6", True), ("1 2 3 4 5", False), ("https://a", True), ("ISSN here", True)])
def test_reference(spark, text, out):
    assert one(spark, X.looks_like_reference(F.col("t")), t=text) is out


@pytest.mark.parametrize(("text", "out"), [("A structural mechanism", "mechanism"), ("Structure", "structure"), ("regulation that generalizes", "regulation"), ("replicate in other species", "validation"), ("generalizes", "generalization"), ("none", "unspecified")])
def test_category(spark, text, out):
    assert one(spark, X.category(F.col("t")), t=text) == out


def test_cut_and_preview(spark):
    assert one(spark, X.cut(F.col("t"), 5), t="abcdefg") == "abcd…"
    assert one(spark, X.preview(F.col("t"), 5), t="abcdefg") == "ab..."
    assert one(spark, X.cut(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("values", "out"), [([], "     "), ([1.0, 1.0], "██"), ([0.0, 1.0], "▁▇   "), ([9.0, 0.0, 1.0, 2.0, 3.0, 4.0], None)])
def test_sparkline(spark, values, out):
    got = spark.createDataFrame([(values,)], "v array<double>").select(X.sparkline(F.col("v"), 5).alias("x")).first()["x"]
    assert len(got) == (5 if out is None else len(out)) and (out is None or got == out)


def test_features_count_a_phrase_twice(spark):
    f = one(spark, X.rule_features(F.col("t")), t="It should be validated, and will test")
    assert (f["hook_cnt"], f["modal_cnt"], f["will_inf"]) == (2, 2, 1)


def test_signals(spark):
    s = S.signals(F.lit(True), F.lit(False), F.lit(True), F.lit(False), F.lit(0.71))
    text = one(spark, S.signals_json(s))
    assert text == '{"hook":true,"semantic":false,"modal":true,"will_inf":false,"classifier":"ml:0.710"}'
    back = spark.range(1).select(S.signals_from_json(F.lit(text)).alias("s")).select("s", S.strength(F.col("s")).alias("a"), S.signal_count(F.col("s")).alias("n")).first()
    assert (back["s"]["classifier_score"], back["a"], back["n"]) == (0.71, "moderate", 3)


@pytest.mark.parametrize(("a", "b", "out"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([], [1.0], 0.0), ([0.0], [1.0], 0.0), ([3.0, 4.0], [3.0], 0.6), (None, [1.0], 0.0)])
def test_cosine(spark, a, b, out):
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(S.cosine(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert abs(got - out) < 1e-12


def test_sections(spark):
    text = "start\n\n Background noise \nMethods\nwe did\nFuture work and limitations\r\nlast Future plan"
    got = one(spark, sections.split_sections(F.col("t")), t=text)
    assert got == dict.fromkeys(L.SECTION_NAMES, "") | {"introduction": "start\n", "related": "Background noise\n", "methods": "Methods\nwe did\n", "limitations": "Future work and limitations\nlast\n", "future": "Future plan\n"}
    assert set(one(spark, sections.split_sections(F.lit(None).cast("string"))).values()) == {""}


def test_openalex(spark):
    work = '{"id":"W1","title":"T","publication_year":2020,"cited_by_count":3,"concepts":[{"display_name":"c"}],"related_works":[{"id":"W2"}],"authorships":[{"author":{"display_name":"A"}},{"author":{}}]}'
    oa = one(spark, S.openalex(F.col("w")), w=work)
    assert (oa["openalex_id"], oa["year"], oa["concepts"], oa["related_ids"], oa["authors"]) == ("W1", 2020, ["c"], ["W2"], ["A"])
    assert one(spark, S.openalex(F.lit("nothing"))) is None


def test_hints_rule_nothing_out(spark):
    """The searches before an alternation let every phrase pass, alone and within others, and are far fewer."""
    for phrases in (L.FUTURE, L.QUESTION, L.LIMIT, L.MODAL):
        assert all(any(h in p for h in L.hints(phrases)) for p in phrases) and len(L.hints(phrases)) <= len(phrases)
        said = spark.createDataFrame([(f"x{a}y",) for a in phrases] + [(a[1:],) for a in phrases] + [(a.replace(" ", "  "),) for a in phrases] + [("",), ("plain words",)], "t string")
        got = said.select(X.has_any(F.col("t"), phrases).alias("a"), F.col("t").rlike(L.any_of(phrases)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got) and len({r["b"] for r in got}) == 2
    lines = [p for _, needs in L.SECTIONS for w in ("open", "outstanding", "remaining") for p in needs[0].replace("(?:open|outstanding|remaining)", w).split("|")]
    assert "outstanding question" in lines and all(any(h in p for h in sections.HINTS) for p in lines)


def test_white_space_before_a_line_end_that_is_kept(spark):
    """A next-line character isn't white space, so what stands before it isn't at the end."""
    assert one(spark, X.strip(F.col("t")), t=" a \u0085") == "a \u0085"
    assert one(spark, X.dedup_key(F.col("t")), t=" A\t\x0b[1 ] b  ") == "a b  "
    assert one(spark, X.strip(F.lit(None).cast("string"))) is None


def test_dear_patterns_are_tried_after_searches(spark):
    """The alternation of cue phrases comes after plain searches, and the key is worked out once."""
    plan = spark.range(1).select(X.has_any(X.dedup_key(F.concat(F.lit("a"), F.col("id").cast("string"))), L.FUTURE).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" in plan and plan.index("exists(") < plan.index("RLIKE") and plan.count("lower(") == 1
