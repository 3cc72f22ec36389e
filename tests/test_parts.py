"""The lexer hands on only the tokens and columns that a fact reads, as they are among all tokens."""

from __future__ import annotations

import pytest

from strataflow.operators import tokens as T

TEXTS = {"python": "import os\nclass A(B):\n    def f(self, a=1):\n        'Doc.'\n        return g(a) if a else [x for x in (1, 2)]\n",
         "java": "import a.B;\n/** Note. */\nclass A extends B { int n; int f(int x) { return n > 1 ? g(x) : 0; } }\n"}


@pytest.mark.parametrize("part", sorted(T.PARTS))
def test_a_part_is_a_part_of_all_tokens(part):
    held = T.Tokens()
    for path, text in TEXTS.items():
        held.fold({"repository_id": "r", "path": path, "file_id": 1, "language": path}, text)
    rows = lambda *parts: [r for b in held.batches(*parts) for r in b.to_pylist()]
    whole, some = {(r["path"], r["what"] == "comment", r["i"]): r for r in rows()}, rows((part,))
    assert 0 < len(some) < len(whole) and set(some[0]) == set(T.part_schema((part,)).names) < set(T.SCHEMA.names)
    for r in some:
        of = whole[r["path"], r["what"] == "comment", r["i"]]
        assert all(of[c] == r[c] for c in r)
    ends = {p: max(i for q, c, i in whole if q == p and not c) for p in TEXTS}
    assert {p: max(r["i"] for r in some if r["path"] == p and r["what"] != "comment") for p in TEXTS} == ends


@pytest.mark.parametrize("text", ["", "# Only a comment.\n"])
def test_a_batch_without_tokens(text):
    held = T.Tokens()
    held.fold({"repository_id": "r", "path": "p", "file_id": 1, "language": "python"}, text)
    assert [r["what"] for b in held.batches(tuple(T.PARTS)) for r in b.to_pylist()] == ["comment"] * bool(text)
