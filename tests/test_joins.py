"""Joins of source facts: neither texts nor token rows go through the driver, however small their tables are estimated."""

from __future__ import annotations

import pytest

from strataflow.operators import facts
from strataflow.plans.bindings import bind
from strataflow.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"

SOURCE_FACTS = ("semantic_facts", "dynamic_call_flag", "explanation_fields", "extract_calls", "extract_inheritance", "import_externality", "import_target", "module_chunks", "module_summary",
                "placeholder_args", "resolve_inheritance", "signature_arguments", "test_plan", "entity_chunks", "extract_imports")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SOURCE_FACTS)
def test_source_facts_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(QUERIES[name](spark, DATA))


def test_fact_trees_are_not_broadcast(spark):
    assert "BroadcastExchange" not in plan(facts.file_facts(bind(spark, DATA, "code")))
