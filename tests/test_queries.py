"""Every query with a SQL text agrees with it; the others run."""

from __future__ import annotations

import pytest
from oracle import DATA, check

from lumenfold.plans import capture, coverage, dealt, learning, linking, text

MODULES = (dealt, coverage, learning, text, capture, linking)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, str(DATA)).count()


@pytest.mark.parametrize("name", ["link_mentions", "local_concepts", "reconciled_decisions", "port_decisions", "rule_link", "link_all"])
def test_pieces_of_names_are_not_sent_through_the_driver(spark, name):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert "SortMergeJoin [_g#" in plan and "BroadcastHashJoin [_g#" not in plan


def test_local_concepts_reads_no_text(spark):
    plan = QUERIES["local_concepts"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "title:string" not in plan


def test_requests_and_decisions_meet_in_one_shuffle(spark):
    plan = QUERIES["reconciled_decisions"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Join [chunk_id#" not in plan and plan.count("hashpartitioning(chunk_id#") == 1


def test_requests_of_a_port_are_made_unique_once(spark):
    plan = QUERIES["port_decisions"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "mention.parquet" not in plan


def test_chunks_are_not_sent_through_the_driver(spark):
    of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in of(linking._chunks(spark, str(DATA)))
    assert "BroadcastHashJoin [chunk_id#" not in of(linking.link_all(spark, str(DATA)))
