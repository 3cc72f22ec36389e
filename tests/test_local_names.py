"""Names looked up in the caller's module, and calls by id under another name."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import resolve

ENT = "repository_id string, module string, entity_id string, name string"
CALLS = "repository_id string, caller_id string, callee_id string, callee_name string, call_line int, dynamic boolean"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_local_names_need_one_lookup(spark):
    ent = spark.createDataFrame([("r", "m", "e1", "f"), ("r", "m", "e0", "f"), ("r", "n", "e2", "g"), ("r", "m", "e3", None)], ENT)
    calls = spark.createDataFrame([("r", "e1", None, n, 1, False) for n in ("f", "x.f", "g", None)] + [("r", "e2", None, "a.b.g", 2, False), ("r", "no", None, "f", 3, False)], CALLS)
    rows = resolve.resolve_calls_local(calls, ent)
    assert plan(rows).count("LeftOuter") == 1
    assert {(r.caller_id, r.callee_name, r.resolved_id, r.external) for r in rows.collect()} == {("e1", "f", "e0", False), ("e1", "x.f", "e0", False), ("e1", "g", None, True), ("e1", None, None, True), ("e2", "a.b.g", "e2", False)}
    dotted = ent.unionByName(spark.createDataFrame([("r", "m", "e9", "x.f"), ("r", "m", "e8", "y.z")], ENT))
    got = {(r.caller_id, r.callee_name, r.resolved_id) for r in resolve.resolve_calls_local(calls, dotted).collect()}
    assert got == {("e1", "f", "e0"), ("e1", "x.f", "e9"), ("e1", "g", None), ("e1", None, None), ("e2", "a.b.g", "e2")}


def test_calls_by_id_under_their_own_name_are_compared_with_none(spark):
    ent = spark.createDataFrame([("r", f"m{i}", f"e{i}", f"n{i}") for i in range(5)], ENT)
    calls = spark.createDataFrame([("r", f"e{i}", f"e{i + 1}", f"x.n{i + 1}", i, False) for i in range(4)], CALLS)
    rows = resolve.caller_totals(calls, ent)
    assert "LeftAnti" not in plan(rows) and {(r.entity_id, r.callers, r.modules) for r in rows.collect()} == {(f"e{i}", 1, 1) for i in range(1, 5)}
    other = calls.unionByName(calls.withColumns({"callee_name": F.lit("alias"), "call_line": F.lit(99)}))
    assert {(r.entity_id, r.callers, r.modules) for r in resolve.caller_totals(other, ent).collect()} == {(f"e{i}", 2, 1) for i in range(1, 5)}
