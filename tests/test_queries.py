import pytest
from sqlcheck import SF, same

import __spark_entry__ as entry
from lumenquarry.plans.queries import QUERIES
from lumenquarry.plans.records_sql import RECORDS_SQL
from lumenquarry.plans.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL | RECORDS_SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, entry.queries()[name], (SQL | RECORDS_SQL)[name]) > 0


@pytest.mark.parametrize(("name", "splits"), [("section_map", 2), ("research_questions", 2), ("limitations", 2), ("doc_rollup", 2), ("run_metrics", 2), ("next_steps", 4)])
def test_texts_are_split_once(spark, name, splits):
    """Sections take two splits, by lines and by marks; steps come from questions and from limitations."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == splits and plan.count("Relation [") == splits // 2


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_fold(spark):
    s = entry.queries()["match_stream"](spark, SF).orderBy("topic", "seq").collect()
    f = QUERIES["match_fold"](spark, SF).collect()
    assert sorted((r["topic"], round(r["combined"], 3)) for r in s) == sorted((str(r["topic"]), r["combined"]) for r in f) and len(s) > 0
