"""Extraction on hand-written sources: what the lexer must not mistake, and files of the same path in two repositories."""

from __future__ import annotations

import random

import pytest

from strataflow.operators import extract, tokens

PY = '''"""Doc."""
import os, sys as s
from a.b import (c, d as e,
                 f)  # note
from . import g
LIMIT = 3

@deco(1)
class A(B, metaclass=M):
    \'\'\'A thing.

        more
      less
    \'\'\'
    x: int = call(1)

    @property
    def f(self, a, b: int=5, *rest, k=g(), **kw) -> Dict[str, int]:
        "Short."
        s = "not_a_call(1) # no"
        for i, (p, q) in enumerate(self.rows):  # loop(1)
            if a // b and p:
                foo(a).bar(q)[0](1)
        return [z for z in LIMIT if z]

    async def g(self): return self.f(1)

    def h(self):
        def inner(y):
            return y + LIMIT
        try:
            inner(1)
        except ValueError as err:
            raise Foo(err)
        else:
            print(getattr(self, "x")())
        return inner
if LIMIT:
    def hidden():
        never()
main(); other.call(lambda t: t(1),
  2)
'''

JV = """package x;
import java.util.List;
import static a.b.C.*;
/** Top.
 * @param T type
 * of it */
@Service(\"a{b\")
public class Box<T extends Comparable<T>> extends Base<T, List<T>> implements I, J<K, V> {
    private int count = 1, size;
    static final Map<String, Integer> M = make(1);
    // note
    public Box(int a, Map<K, V> m) { super(a); this.count = a; go(); }
    @Override protected <U> List<U> get(final String s, @Nullable int[] xs, String... more) throws E {
        List<?> l = a.b().c(new Foo(1).go(s)); // call(1)
        do { x(); } while (count > 0);
        switch (s) { case \"a\": y(); break; default: z(); }
        Runnable r = new Runnable() { public void run() { inner(); } };
        return s == null ? l : super.get(\"q(1)\");
    }
    abstract void none();
    enum Color { RED(1), GREEN(2) { void no() {} }; final int v; Color(int v) { this.v = v; } }
    record P(int x, int y) { P { check(x); } int sum() { return x + y; } }
    @interface Ann { String value() default \"x\"; }
    interface Shape { double area(); default int two() { return 2; } }
}
"""

SCHEMA = "repository_id string, path string, file_id int, language string, text string"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", "a.py", 1, "python", PY), ("r", "B.java", 2, "java", JV), ("q", "a.py", 3, "python", "def f(b, c): return 1\n"), ("q", "e.py", 4, "python", ""), ("q", "n.py", 5, "python", None), ("q", "x.go", 6, "go", "func f() {")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def facts(files):
    return extract.analyse(files)


def test_definitions(files, facts):
    got = {(r.repository_id, r.qualified_name): (r.kind, r.line_start, r.line_end, r.is_public) for r in extract.definitions(files, facts).collect()}
    assert got == {
        ("q", "f"): ("function", 1, 1, True), ("r", "A"): ("class", 9, 37, True), ("r", "A.f"): ("method", 18, 24, True), ("r", "A.g"): ("method", 26, 26, True), ("r", "A.h"): ("method", 28, 37, True), ("r", "A.h.inner"): ("function", 29, 30, True),
        ("r", "Box"): ("class", 7, 25, True), ("r", "Box.Ann"): ("annotation", 23, 23, False), ("r", "Box.Ann.value"): ("method", 23, 23, True), ("r", "Box.Box"): ("method", 12, 12, True), ("r", "Box.Color"): ("enum", 21, 21, True),
        ("r", "Box.Color.Color"): ("method", 21, 21, True), ("r", "Box.P"): ("record", 22, 22, True), ("r", "Box.P.P"): ("method", 22, 22, True), ("r", "Box.P.sum"): ("method", 22, 22, True), ("r", "Box.Shape"): ("interface", 24, 24, True),
        ("r", "Box.Shape.area"): ("method", 24, 24, True), ("r", "Box.Shape.two"): ("method", 24, 24, False), ("r", "Box.get"): ("method", 13, 19, False), ("r", "Box.none"): ("method", 20, 20, False)}


def test_calls(files, facts):
    got = sorted((r.caller, r.callee_name, r.line, r.dynamic) for r in extract.extract_calls(files, facts).collect())
    assert got == sorted([
        ("Box.Box", "go", 12, False), ("Box.P.P", "check", 22, False), ("Box.get", "a.b", 14, False), ("Box.get", "a.b().c", 14, False), ("Box.get", "inner", 17, False), ("Box.get", "new Foo(1).go", 14, False), ("Box.get", "super.get", 18, False),
        ("Box.get", "x", 15, False), ("Box.get", "y", 16, False), ("Box.get", "z", 16, False), ("", "main", 41, False), ("", "other.call", 41, False), ("", "t", 41, False), ("A", "call", 15, False), ("A", "deco", 8, False), ("A.f", "enumerate", 21, False),
        ("A.f", "foo", 23, False), ("A.f", "foo(a).bar", 23, False), ("A.f", "foo(a).bar(q)[0]", 23, True), ("A.f", "g", 18, False), ("A.g", "self.f", 26, False), ("A.h", "Foo", 34, False), ("A.h", 'getattr(self, "x")', 36, True),
        ("A.h", 'getattr(self, "x")', 36, True), ("A.h", "inner", 32, False), ("A.h", "print", 36, False)])


def test_complexity_and_names(files, facts):
    points = {r.qualified_name: r.complexity for r in extract.cyclomatic_complexity(files, facts).collect()}
    assert {k: v for k, v in points.items() if v > 1} == {"Box.get": 6, "A.f": 6, "A.h": 3}
    assert {(r.module, r.local_name, r.kind, r.line) for r in extract.extract_imports(files, facts).collect()} == {
        ("a.b.C.*", "*", "static", 3), ("java.util.List", "List", "normal", 2), (".", "g", "normal", 5), ("a.b", "c", "normal", 3), ("a.b", "e", "normal", 3), ("a.b", "f", "normal", 3), ("os", "os", "normal", 2), ("sys", "s", "normal", 2)}
    assert {(r.entity, r.parent_name, r.kind) for r in extract.extract_inheritance(files, facts).collect()} == {("Box", "Base<T, List<T>>", "extends"), ("Box", "I", "implements"), ("Box", "J<K, V>", "implements"), ("A", "B", "extends")}
    assert {(r.qualified_name, r.global_name) for r in extract.globals_used(files, facts).collect()} == {
        ("A", "B"), ("A", "M"), ("A", "call"), ("A", "deco"), ("A.f", "Dict"), ("A.f", "LIMIT"), ("A.f", "foo"), ("A.f", "g"), ("A.h", "Foo"), ("A.h", "err"), ("A.h", "inner"), ("A.h.inner", "LIMIT"), ("Box.Box", "count"), ("Box.Color.Color", "v"), ("Box.get", "count")}


def test_signatures_and_documentation(files, facts):
    said = {r.qualified_name: r.signature for r in extract.signatures(files, facts).collect()}
    assert said["A.f"] == "f(self, a, b: int=5, *rest, k=g(), **kw) -> Dict[str, int]" and said["A"] == "A(B, metaclass=M)" and said["Box.get"] == "get(final String s, @Nullable int[] xs) -> List<U>" and said["Box.Box"] == "Box(int a, Map<K, V> m)" and said["Box.P.P"] == "P()"
    args = {}
    for r in sorted(extract.signature_arguments(files, facts).collect(), key=lambda r: r.pos):
        args.setdefault((r.repository_id, r.qualified_name), []).append(r.argument)
    assert args["r", "A.f"] == ["self", "a", "b", "k", "rest", "kw"] and args["q", "f"] == ["b", "c"] and args["r", "Box.get"] == ["s", "xs"] and args["r", "Box.Box"] == ["a", "m"]
    assert {(r.qualified_name, r.description, r.tag, r.tag_text) for r in extract.doc_comments(files, facts).collect()} == {
        ("A", "A thing.\n\n  more\nless", "", ""), ("A.f", "Short.", "", ""), ("Box", "Top.", "param", "T type of it"), ("Box.Box", "note", "", "")}


def test_two_repositories_with_one_path(spark):
    from strataflow.operators import index

    rows = [("a", "m.py", 1, "python", "import os\ndef f(x):\n    return g(x)\n"), ("b", "m.py", 2, "python", "import re\ndef f(y, z):\n    return h(y)\n")]
    got = {(r.repository_id, r.qualified_name): r.content for r in index.entity_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "f"): "f(x)\nfile: f\narguments: x\ncalls: g\nglobals: g", ("b", "f"): "f(y, z)\nfile: f\narguments: y, z\ncalls: h\nglobals: h"}
    whole = {r.repository_id: r.content for r in index.module_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert whole == {"a": "m.py\nlanguage: python\nimports: os\nentities: f", "b": "m.py\nlanguage: python\nimports: re\nentities: f"}


def test_brackets_that_do_not_close(spark):
    rows = [("a", "1.py", 1, "python", "x = (1, [2)]\n"), ("a", "2.py", 2, "python", "x = ')'  # (\n"), ("a", "3.java", 3, "java", "class A { /* } */ }"), ("b", "4.java", 4, "java", "class A { "), ("b", "5.py", 5, "python", "x)\n"), ("b", "6.py", 6, "python", None)]
    assert {tuple(r) for r in extract.quarantine_unparseable(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", 3, 2), ("b", 3, 1)}


def test_tokens_cover_the_source():
    """Random texts of code signs: every sign that is no blank lies in one token, in order, and nothing recurses."""
    rng = random.Random(6)
    signs = ["(", ")", "{", "}", "[", "]", "'", '"', '"""', "#", "//", "/*", "*/", "\n", "  ", "\\", "def f", "class A", "x", "=", ",", ";", ":", "<", ">", "?", "é", "1.5", "@", ".", "new "]
    for language in ("python", "java"):
        for _ in range(300):
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
            held = tokens.Tokens()
            held.fold({"repository_id": "r", "path": "p", "file_id": 1, "language": language}, text)
            found = [(r["pos"], r["tok"]) for b in held.batches() for r in b.to_pylist()]
            assert all(text[at : at + len(tok)] == tok for at, tok in found)
            left = list(text)
            for at, tok in found:
                left[at : at + len(tok)] = " " * len(tok)
            assert "".join(left).replace("\\\n", "").strip() in ("",)
    held = tokens.Tokens()
    held.fold({"repository_id": "r", "path": "p", "file_id": 1, "language": "python"}, '"' + "\\x" * 200_000 + '"' + "(" * 50_000)
    assert len(held.own["tok"]) == 50_001
