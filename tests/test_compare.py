"""Ordered diffs, trees of facts and checked responses."""

from __future__ import annotations

import json
import random

from strataflow.functions import text as X
from strataflow.operators import compare, facts


def walk(old: list[str], new: list[str]) -> list[tuple]:
    """The ordered walk, line by line."""
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i == len(old) or j < len(new) and old[i] in new and new[j] not in old:
            out.append(("added", j + 1))
            j += 1
        elif j == len(new) or old[i] not in new:
            out.append(("removed", i + 1))
            i += 1
        else:
            out += [("common", i + 1)] if old[i] == new[j] else [("removed", i + 1), ("added", j + 1)]
            i, j = i + 1, j + 1
    return sorted(out)


def test_diff_is_the_ordered_walk(spark):
    rng = random.Random(9)
    pairs = [(i, "\n".join(rng.choices("abcdefgh", k=rng.randrange(1, 12))), "\n".join(rng.choices("abcdefghij", k=rng.randrange(1, 12)))) for i in range(120)] + [(200, "a\nb\nc", "b\nc\na"), (201, "x", "x"), (202, "", "y")]
    got: dict[int, list] = {}
    for r in compare.line_diff(spark.createDataFrame(pairs, "id bigint, old_text string, new_text string")).collect():
        got.setdefault(r.id, []).append((r.change, r.line_no))
    for i, old, new in pairs:
        assert sorted(got[i]) == walk(old.split("\n"), new.split("\n")), (old, new)
        lines = old.split("\n")
        kept = {n: lines[n - 1] for change, n in got[i] if change == "common"}
        added = {n: new.split("\n")[n - 1] for change, n in got[i] if change == "added"}
        rest = iter(kept[n] for n in sorted(kept))
        assert [added[n] if n in added else next(rest) for n in range(1, len(new.split("\n")) + 1)] == new.split("\n")


def test_trees_of_facts_round_trip(spark):
    rows = [("r", "a.py", 1, "python", 'import os\nclass A(B):\n    """Doc "q"."""\n    def f(self, x):\n        return g(x)\ndef g(y):\n    return os\nmain()\n'), ("s", "a.py", 2, "python", ""), ("s", "b.java", 3, "java", "class C { int n; int m() { return n; } }")]
    trees = facts.file_facts(spark.createDataFrame(rows, "repository_id string, path string, file_id int, language string, text string"))
    texts = facts.to_json(trees)
    one = json.loads(texts.filter("repository_id = 'r'").first().json)
    assert [e["qualified_name"] for e in one["entities"]] == ["A", "A.f", "g"] and one["imports"] == [{"line": 1, "module": "os", "local_name": "os", "kind": "normal"}]
    assert one["entities"][0]["docstring"] == 'Doc "q".' and one["entities"][0]["inheritances"] == [{"line": 2, "name": "B", "kind": "extends"}] and one["module_calls"] == [{"line": 8, "name": "main", "resolved": False, "dynamic": False}]
    assert one["entities"][1]["calls"] == [{"line": 5, "name": "g", "resolved": True, "dynamic": False}] and one["entities"][1]["arguments"] == ["self", "x"] and one["entities"][1]["docstring"] is None
    back = facts.from_json(texts, trees.schema)
    assert back.filter("reason IS NOT NULL").count() == 0
    assert sorted(map(str, back.select("facts.*").collect())) == sorted(map(str, trees.collect()))
    bad = spark.createDataFrame([("r", "x", "nope"), ("r", "y", '{"path": "y", "entities": 3, "imports": [], "module_calls": []}'), ("r", "z", "[]")], "repository_id string, path string, json string")
    assert {(r.path, r.reason) for r in facts.from_json(bad, trees.schema).collect()} == {("x", "no JSON"), ("y", "entities is no array"), ("z", "entities is no array")}


def test_responses_need_their_keys(spark):
    rows = [("a", '{"x": 1, "y": "s"}'), ("b", '{"x": "1", "y": "s"}'), ("c", '```json\n{"x": 2.5, "y": "s"}\n```'), ("d", '{"y": "s"}'), ("e", "none"), ("f", '{"x": null, "y": "s"}'), ("g", '{"x": 1, "y": ["s"]}'), ("h", None)]
    got = spark.createDataFrame(rows, "k string, t string").select("k", X.checked_json("t", {"x": "number", "y": "string"}).alias("j")).collect()
    assert {r.k: r.j.reason for r in got} == {"a": None, "b": "x is no number", "c": None, "d": "missing x", "e": "no JSON object", "f": "missing x", "g": "y is no string", "h": "no JSON object"}
    assert all((r.j.json is None) == (r.j.reason is not None) for r in got)


def test_diff_deals_lines_once(spark):
    """Lines of both texts are shuffled once, as digests."""
    rows = compare.line_diff(spark.createDataFrame([(1, "a\nb", "b\nc")], "id bigint, old_text string, new_text string"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
