"""Facts of a text that many files hold are read once, and its marks meet their definitions in one pass."""

from __future__ import annotations

import pytest

from strataflow.operators import facts, index
from strataflow.operators import tokens as T
from strataflow.plans import queries

PYTHON = "class A(B):\n    def f(self, a=1):\n        'Doc.'\n        return g(a) if a else C\n"
JAVA = "class A extends B { int n; int f(int x) { return n > 1 ? g(x) : 0; } }\n"
TREE = "repository_id string, path string, file_id int, language string, text string"


@pytest.fixture
def code(spark):
    rows = [(f"r{i}", f"{i}.{language}", i, language, text) for i in range(4) for language, text in (("python", PYTHON), ("java", JAVA))]
    return spark.createDataFrame([*rows, ("r0", "null.py", 9, "python", None), ("r0", "a.go", 10, "go", "func f() {}"), ("r0", "b.go", 11, "go", None)], TREE)


@pytest.fixture
def work(monkeypatch):
    """Numbers of texts lexed, and of passes that look for owners."""
    seen, passes, analysed, owned = [], [], T.analysed, T.owned
    monkeypatch.setattr(T, "analysed", lambda code, *a: ("text" in code.columns and seen.append(code.count())) or analysed(code, *a))
    monkeypatch.setattr(T, "owned", lambda *a: passes.append(1) or owned(*a))
    return seen, passes


def test_chunks_of_copies(code, work):
    rows = index.entity_chunks(code).collect()
    assert work == ([3], [1])
    contents = {language: {(r.qualified_name, r.content) for r in rows if r.path.endswith(language)} for language in ("python", "java")}
    assert contents["python"] == {("A", "A(B)\nfile: A\ninherits: B\nglobals: B"), ("A.f", "f(self, a=1)\nfile: A.f\nDoc.\narguments: self, a\ncalls: g\nglobals: C, g")}
    assert contents["java"] == {("A", "A\nfile: A\ninherits: B"), ("A.f", "f(int x) -> int\nfile: A.f\narguments: x\ncalls: g\nglobals: n")}
    assert sorted((r.repository_id, r.path) for r in rows) == sorted((f"r{i}", f"{i}.{language}") for i in range(4) for language in ("python", "java") for _ in range(2))


def test_trees_of_copies(code, work):
    rows = {r.path: r for r in facts.file_facts(code).collect()}
    assert work == ([3], [1]) and len(rows) == 11
    for i in range(4):
        for language in ("python", "java"):
            one = rows[f"{i}.{language}"]
            assert (one.repository_id, one.language, [e.qualified_name for e in one.entities]) == (f"r{i}", language, ["A", "A.f"]) and one.entities == rows[f"0.{language}"].entities
    for path in ("null.py", "a.go", "b.go"):
        assert rows[path].entities == rows[path].imports == rows[path].module_calls == []


def test_a_round_trip_stores_digests(spark, code, monkeypatch):
    stored, cut = [], queries.cut
    monkeypatch.setattr(queries, "bind", lambda *a: code)
    monkeypatch.setattr(queries, "cut", lambda df, *a: stored.append(df.columns) or cut(df, *a))
    assert {(r.side, r.n) for r in queries.facts_json_roundtrip(spark, "").collect()} == {("left", 0), ("right", 0), ("rejected", 0)}
    assert stored == [["json", "again", "reason"]]


def test_a_round_trip_tells_what_changes(spark, code, monkeypatch):
    """A reader that loses a tree's calls, and one that rejects a text."""
    monkeypatch.setattr(queries, "bind", lambda *a: code)
    read = facts.from_json
    lossy = lambda texts, schema: read(texts.withColumn("json", queries.F.when(queries.F.col("path") == "0.java", "[]").when(queries.F.col("path") == "1.python", queries.F.replace("json", queries.F.lit("Doc."), queries.F.lit("Dog."))).otherwise(queries.F.col("json"))), schema)
    monkeypatch.setattr(facts, "from_json", lambda texts, schema: lossy(texts.withColumn("json0", queries.F.col("json")), schema).withColumn("json", queries.F.col("json0")))
    assert {(r.side, r.n) for r in queries.facts_json_roundtrip(spark, "").collect()} == {("left", 2), ("right", 1), ("rejected", 1)}


def test_explanations_of_copies(spark, code, work, monkeypatch):
    monkeypatch.setattr(queries, "bind", lambda *a: code)
    rows = queries.explanation_fields(spark, "").collect()
    assert work == ([3], [1])
    assert sorted((r.repository_id, r.path, r.inputs, r.dependencies, r.complexity) for r in rows) == sorted((f"r{i}", f"{i}.{x}", *y) for i in range(4) for x, y in (("python", ("self, a", "g", 2)), ("java", ("x", "g", 2))))
