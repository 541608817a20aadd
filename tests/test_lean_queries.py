"""Queries over contracts make the columns and rules that they need, and no others."""

import pytest
from pyspark.sql import functions as F

from clausewood import engine, queries
from clausewood.plans import report
from clausewood.plans.validate import validate
from clausewood.sources.contracts import contracts

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["p2_metadata", "r05_metadata_date_invalid"])
def test_metadata_needs_no_body_and_no_cache(spark, name):
    plan = plan_of(queries.queries()[name](spark, SF))
    assert "InMemoryRelation" not in plan
    assert "AS sections" not in plan and "AS blocks" not in plan


def test_some_rules_give_what_all_rules_give(spark):
    docs = engine.parse(contracts(spark, SF)).cache()
    both = ["doc_id", "rule", "level", "message"]
    every = [tuple(r) for r in report.diagnostics(validate(docs)).select(both).collect()]
    groups = [("metadata-date-invalid", "party-type-invalid"), ("ref-broken", "def-unreferenced", "attachment-unreferenced"), ("heading-skip", "anchor-duplicate"), ("duration-invalid-unit", "party-unknown", "term-undefined"), ("placeholder-type-inconsistent", "frontmatter-invalid-yaml")]
    for rules in groups:
        some = report.diagnostics(validate(docs, rules=rules)).where(F.col("rule").isin(*rules)).select(both).collect()
        want = sorted(r for r in every if r[1] in rules)
        assert {r[1] for r in want} == set(rules)
        assert sorted(tuple(r) for r in some) == want
    docs.unpersist()


def test_contracts_are_dealt_by_their_order(spark):
    """No shuffle of text: the rows that are dealt are those of the tables."""
    found = contracts(spark, SF)
    assert "RepartitionByExpression [o_orderkey" in plan_of(found) and found.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
