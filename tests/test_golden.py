"""Known answers on tiny tables."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from strataflow.functions import paths as P
from strataflow.functions import text as X
from strataflow.operators import extract, graph, index, metrics, resolve, scoring
from strataflow.sources import files as S


def test_line_count(spark):
    rows = spark.createDataFrame([("", 0), ("a", 1), ("a\n", 1), ("a\r\nb\rc\n\n", 4), (None, 0)], "text string, n int")
    assert rows.filter(P.line_count() != F.col("n")).count() == 0


def test_token_estimates(spark):
    rows = spark.createDataFrame([("", 0), (" ", 1), ("abc", 1), ("getUserName", 4), ("a+b", 3), ("ABCdef", 2)], "t string, n int")
    assert [(r.t, r.e) for r in rows.select("t", X.estimate_tokens("t").alias("e")).collect()] == [("", 0), (" ", 1), ("abc", 1), ("getUserName", 3), ("a+b", 3), ("ABCdef", 2)]


def test_risk_of_a_known_graph(spark):
    ent = spark.createDataFrame([("r", "m", "a", "a", "function", 2), ("r", "m", "b", "b", "function", 1), ("r", "n", "c", "c", "function", 1), ("r", "n", "d", "d", "function", 1)], "repository_id string, module string, entity_id string, name string, type string, complexity int")
    calls = spark.createDataFrame([("r", "b", "a", "a", 1, False), ("r", "a", "c", "c", 2, False), ("r", "a", "d", "d", 3, False), ("r", "a", "a", "a", 4, False), ("r", "c", "a", "a", 5, True)],
                                  "repository_id string, caller_id string, callee_id string, callee_name string, call_line int, dynamic boolean")
    assert {(r.entity_id, r.risk) for r in metrics.top_risk(calls, ent).collect()} == {("a", 8), ("b", 2), ("c", 2), ("d", 2)}


def test_cycles_and_components(spark):
    edge = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (5, 1), (6, 6)], "src int, dst int")
    assert {(r.length, r.members) for r in graph.module_cycles(edge, 4).collect()} == {(2, "1,2"), (3, "2,3,4")}
    assert {(r.node, r.component) for r in graph.cyclic_components(edge).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_nothing_to_cover_is_full_coverage(spark):
    runs = spark.createDataFrame([("a", 0, 0), ("b", 1, 2)], "run_id string, tests_passed int, tests_failed int")
    assert {(r.run_id, r.pct) for r in metrics.coverage_percent(runs).collect()} == {("a", 100.0), ("b", 33.33)}


def test_archive_paths_and_limits(spark):
    rows = spark.createDataFrame([("a", 1, "x/../y", 5), ("a", 2, "x/../../y", 5), ("b", 1, "big", 50), ("c", 1, "ok", 1), ("d", 1, "/etc", 1)], "repository_id string, pos int, path string, size bigint")
    got = {r.repository_id: (r.verdict, r.first_bad_path) for r in S.archive_admission(rows, max_bytes=20).collect()}
    assert got == {"a": ("path escapes", "x/../../y"), "b": ("archive too large", "big"), "c": ("ok", None), "d": ("path escapes", "/etc")}


def test_nested_definitions(spark):
    text = "class A:\n    def f(self):\n        def g():\n            return 1\n        return g()\n\n    def h(self, x=1):\n        pass\n\ndef top():\n    return A().f()\n"
    code = spark.createDataFrame([("r", "a.py", 1, "python", text)], "repository_id string, path string, file_id int, language string, text string")
    got = {(r.qualified_name, r.kind, r.line_start) for r in extract.qualified_names(code).collect()}
    assert got == {("A", "class", 1), ("A.f", "method", 2), ("A.f.g", "function", 3), ("A.h", "method", 7), ("top", "function", 10)}
    assert ("A.f", "g", 5) in {(r.caller, r.callee_name, r.line) for r in extract.extract_calls(code).collect()}


def test_replace_facts_keeps_other_repositories(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "repository_id string, x int")
    path = f"file://{tmp_path}/facts"
    S.replace_facts(rows, path)
    kept = S.replace_facts(spark.createDataFrame([("a", 3), ("a", 4)], "repository_id string, x int"), path)
    assert sorted((r.repository_id, r.x) for r in kept.collect()) == [("a", 3), ("a", 4), ("b", 2)]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("y\n")
    got = S.scan_files(S.read_tree(spark, str(tmp_path), "r")).collect()
    assert [(r.path, r.language, r.loc) for r in got] == [("src/a.py", "python", 1)]


def test_shuffled_input_gives_the_same_facts(spark):
    rows = spark.range(200).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repository_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("module"), F.col("id").cast("string").alias("entity_id"), F.concat(F.lit("n"), F.col("id") % 40).alias("name"))
    one, other = resolve.first_entity_by_name(rows), resolve.first_entity_by_name(rows.repartition(13).orderBy(F.rand(3)))
    assert {(r.side, r.n) for r in S.facts_equal(one, other).collect()} == {("left", 0), ("right", 0)}


def test_plans_have_no_cartesian_product(spark):
    from strataflow.plans.queries import QUERIES

    for name in ("callers_of", "impact_report", "resolve_calls_repo", "module_cycles", "safety_score"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_safety_scores_round_half_to_even(spark):
    row = spark.range(1).select(F.bround(F.lit(62.5), 0).alias("a"), F.bround(F.lit(63.5), 0).alias("b")).first()
    assert (row.a, row.b) == (62, 64) and scoring.COMPLETENESS[6] == 5.0


def test_chains_and_long_cycles(spark):
    """A chain of 60 modules, a cycle of 7, and random graphs; in one task and in rounds."""
    rng = random.Random(4)

    def strong(edges):
        """By the definition: two nodes that reach each other."""
        reach = {x: {x} for e in edges for x in e}
        moved = True
        while moved:
            moved = False
            for a, b in edges:
                if not reach[b] <= reach[a]:
                    reach[a] |= reach[b]
                    moved = True
        return {(x, min(y for y in reach[x] if x in reach[y])) for x in reach if any(y != x and x in reach[y] for y in reach[x])}

    chain = [(i, i + 1) for i in range(60)]
    ring = [(100 + i, 100 + (i + 1) % 7) for i in range(7)]
    edge = spark.createDataFrame(chain + ring + [(59, 100)], "src int, dst int")
    assert {(r.node, r.component) for r in graph.cyclic_components(edge).collect()} == {(100 + i, 100) for i in range(7)}
    assert [(r.length, r.members) for r in graph.module_cycles(edge).collect()] == [(7, ",".join(str(100 + i) for i in range(7)))]
    assert graph.module_cycles(spark.createDataFrame(chain, "src int, dst int")).count() == 0
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(20)] + [(20, 21), (21, 22), (22, 23)]
    pairs += [(30, 31), (31, 32), (32, 30), (40, 43), (43, 42), (42, 40), (40, 44), (44, 45), (50, 40)]  # a ring, and a node with a chain back to itself
    frame = spark.createDataFrame(pairs, "src int, dst int")
    want = strong([p for p in pairs if p[0] != p[1]])
    for most in (0, 100_000):
        assert {(r.node, r.component) for r in graph.cyclic_components(frame, most).collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Twenty thousand edges in a row, a long cycle and a ring: rounds grow with the logarithm, where one layer a round would take thousands."""
    edge = (spark.range(20_000).selectExpr("id AS src", "id + 1 AS dst").unionByName(spark.range(3_000).selectExpr("30000 + id AS src", "30000 + (id + 1) % 3000 AS dst"))
            .unionByName(spark.createDataFrame([(20_000, 10_000), (40_001, 40_002), (40_002, 40_001), (20_000, 40_001)], "src bigint, dst bigint")))
    cuts = []
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, done=(): cuts.append(1) or plain(df, done))
    got = {r.component: (r.n, r.a, r.b) for r in graph.cyclic_components(edge, 100).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).collect()}
    assert got == {10_000: (10_001, 10_000, 20_000), 30_000: (3_000, 30_000, 32_999), 40_001: (2, 40_001, 40_002)}
    assert len(cuts) < 80


def test_hashed_vectors_of_known_tokens(spark):
    """md5("get") = b5eda0a74558a342..., md5("user") = ee11cbb19052e40b..., md5("getuser") and md5("id") are worked out here from the digests."""
    tokens = ["getuser", "get", "user", "id", "user_id"]
    digests = {t: hashlib.md5(t.encode()).digest() for t in tokens}
    assert digests["get"][:5].hex() == "b5eda0a745" and digests["user"][:5].hex() == "ee11cbb190"
    assert digests["get"][4] % 2 == 1 and digests["user"][4] % 2 == 0  # so +1 in bucket 0xa7, -1 in bucket 0xb1
    want = {}
    for t in tokens:
        want[digests[t][3]] = want.get(digests[t][3], 0) + (1 if digests[t][4] & 1 else -1)
    norm = sum(v * v for v in want.values()) ** 0.5
    got = {r.bucket: r.weight for r in index.hash_embed(spark.createDataFrame([(1, "getUser user_id getUser")], "id int, text string")).collect()}
    assert {b: round(v, 9) for b, v in got.items()} == {b: round(v / norm, 9) for b, v in want.items() if v} and got[0xA7] > 0 > got[0xB1]


def test_cached_embeddings(spark, tmp_path):
    cache = index.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "+"), (4, None)], "id int, text string")
    first = index.embed_incremental(texts, cache).collect()
    assert len(first) == 2 and not any(r.was_cached for r in first) and sorted(len(r.buckets) for r in first) == [0, 2]
    again = index.embed_incremental(texts.unionByName(spark.createDataFrame([(5, "c")], "id int, text string")), cache).collect()
    assert sorted(r.was_cached for r in again) == [False, True, True] and cache.rows(256).count() == 3
    assert all(r.was_cached for r in index.embed_incremental(texts, cache).collect()) and cache.rows(256).count() == 3
    assert cache.rows(64).count() == 0


def test_approximate_search_is_approximate_and_finds_nine_in_ten(spark):
    """Recall at sf0.1, where vectors have no clusters; few rows are searched in full."""
    from strataflow.plans.bindings import bind

    chunks = bind(spark, "/root/testdata/sf0.1", "chunks")
    queries = chunks.filter("chunk_id % 50 = 0")
    key = lambda df: {(r.query_id, r.chunk_id) for r in df.collect()}
    exact, near = key(index.cosine_topk(queries, chunks)), key(index.ann_topk(queries, chunks))
    assert len(exact & near) >= 0.9 * len(exact) and len(near) == len(exact)
    few = chunks.filter("chunk_id < 60")
    assert key(index.ann_topk(few.filter("chunk_id % 50 = 0"), few, k=30)) == key(index.cosine_topk(few.filter("chunk_id % 50 = 0"), few, k=30))
    assert index.ann_topk(queries.limit(0), chunks).count() == 0


def test_reports_without_cases_lines_or_results(spark):
    from strataflow.sources import reports

    xml = spark.createDataFrame([("a", '<testsuite tests="3"><testcase name="x" time="0.0125"/><testcase name="y" time="1"><error>e</error></testcase></testsuite>'), ("b", '<testsuite tests="2"></testsuite>')], "run_id string, report string")
    assert {tuple(r) for r in reports.parse_test_report(xml).select("run_id", "generated", "name", "status", "duration_ms").collect()} == {("a", 3, "x", "passed", 12), ("a", 3, "y", "failed", 1000), ("b", 2, None, None, None)}
    text = '{"totals": {"percent_covered": 71.428571, "percent_branches_covered": 50.0}, "files": {"a.py": {"missing_lines": [3, 5]}, "b.py": {"missing_lines": []}}}'
    got = {tuple(r) for r in reports.parse_coverage_json(spark.createDataFrame([("a", text), ("b", '{"totals": {}}')], "run_id string, report string")).collect()}
    assert got == {("a", 71.43, 50.0, "a.py", 3), ("a", 71.43, 50.0, "a.py", 5), ("a", 71.43, 50.0, "b.py", None), ("b", 0.0, 0.0, None, None)}
    logs = spark.createDataFrame([("a", 'x\n{"line_coverage": 7}\n{"line_coverage": 8}\n'), ("b", "nothing")], "run_id string, log string")
    assert {(r.run_id, r.line_coverage) for r in reports.coverage_from_log(logs).collect()} == {("a", 8.0), ("b", None)}


def test_penalties_by_impact(spark):
    versions = spark.createDataFrame([(1, "a", "a"), (2, "a,b", "a"), (3, "a", "a")], "proposal_id int, old_params string, new_params string")
    reported = spark.createDataFrame([(1, "MEDIUM", "x"), (1, "MEDIUM", "x"), (1, "LOW", "y"), (2, "HIGH", "z"), (2, "HIGH", "v")], "proposal_id int, impact string, reason string")
    assert {tuple(r) for r in scoring.api_compatibility(versions, reported).collect()} == {(1, 75), (2, 0), (3, 100)}
    assert {tuple(r) for r in scoring.api_compatibility(versions).collect()} == {(1, 100), (2, 60), (3, 100)}


PYTHON_NESTED = '''"""Nested things.

def not_code(x):
    return x
"""
LIMIT: int = 3
names = []


def around(first,
           second=(1, 2),
           *rest):
    """Keep it.

    Second line.
    """
    def within(y):
        return y * LIMIT  # around(1)

    names = within(first)
    return names + other()


def other():
    for names in (1,):
        pass
    return names


class Box(Base, metaclass=Meta):
    class Lid:
        @wrapped(1)
        def shut(self):
            return self._turn() if self else None

        def _turn(self):
            return getattr(self, "x")

    async def open(self):
        return Box.Lid()
'''

JAVA_MODERN = """package a.b;

import java.io.*;
import static java.util.Collections.emptyList;

/**
 * A plan
 * with a price.
 *
 * @param tier the tier
 *   of the plan
 * @return the price
 */
@Deprecated
public class Plan<T extends Money> extends Base<T, List<T>> implements Serializable, Comparable<Plan> {
    private static final Map<String, Integer> SEEN = new HashMap<>();

    Plan(int tier) {
        this.tier = tier;
    }

    @Override public <R> List<R> all(
            int from,
            int to) throws IOException {
        return copy(SEEN, from);
    }

    protected abstract int cost(int n);

    public static class Part {
        public String name() { return "x(y)"; }
    }
}

interface Shape extends Cloneable, Sized {
    double area();
}

enum Color implements Named {
    RED;

    public String hex() {
        return "#f00";
    }
}

record Point(int x, int y) implements Serializable {
    public int sum() { return x > 0 ? x + y : y; }
}

@interface Mark {
    String value() default "x";
}
"""


def test_nested_and_modern_sources(spark):
    """Known answers on sources that no template of the twins has; from the files and from their stored analysis."""
    files = spark.createDataFrame([("r", "p.py", 1, "python", PYTHON_NESTED), ("r", "P.java", 2, "java", JAVA_MODERN), ("r", "e.py", 3, "python", ""), ("s", "p.py", 4, "python", None)],
                                  "repository_id string, path string, file_id int, language string, text string")
    stored = extract.analyse(files)
    got = {(r.path, r.qualified_name): (r.kind, r.parent, r.line_start, r.line_end) for r in extract.definitions(files, stored).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "p.py"} == {
        "around": ("function", "", 10, 21), "around.within": ("function", "around", 17, 18), "other": ("function", "", 24, 27), "Box": ("class", "", 30, 40), "Box.Lid": ("class", "Box", 31, 37),
        "Box.Lid.shut": ("method", "Box.Lid", 33, 34), "Box.Lid._turn": ("method", "Box.Lid", 36, 37), "Box.open": ("method", "Box", 39, 40)}
    assert {k[1]: v[:3] for k, v in got.items() if k[0] == "P.java"} == {
        "Plan": ("class", "", 14), "Plan.Plan": ("method", "Plan", 18), "Plan.all": ("method", "Plan", 22), "Plan.cost": ("method", "Plan", 28), "Plan.Part": ("class", "Plan", 30), "Plan.Part.name": ("method", "Plan.Part", 31),
        "Shape": ("interface", "", 35), "Shape.area": ("method", "Shape", 36), "Color": ("enum", "", 39), "Color.hex": ("method", "Color", 42), "Point": ("record", "", 47), "Point.sum": ("method", "Point", 48), "Mark": ("annotation", "", 51), "Mark.value": ("method", "Mark", 52)}
    assert got["P.java", "Plan"][3] == 33 and got["P.java", "Plan.all"][3] == 26 and got["P.java", "Plan.cost"][3] == 28
    calls = {(r.path, r.caller, r.callee_name) for r in extract.extract_calls(files, stored).collect()}
    assert {c[1:] for c in calls if c[0] == "p.py"} == {("around", "within"), ("around", "other"), ("Box.Lid.shut", "wrapped"), ("Box.Lid.shut", "self._turn"), ("Box.Lid._turn", 'getattr(self, "x")'), ("Box.open", "Box.Lid")}
    assert ("P.java", "Plan.all", "copy") in calls and not any(c[2] == "y" for c in calls)
    assert {(r.caller, r.line) for r in extract.dynamic_call_flag(files).collect()} == {("Box.Lid._turn", 37)}
    assert {(r.entity, r.parent_name, r.kind) for r in extract.extract_inheritance(files, stored).collect()} == {
        ("Box", "Base", "extends"), ("Plan", "Base<T, List<T>>", "extends"), ("Plan", "Serializable", "implements"), ("Plan", "Comparable<Plan>", "implements"), ("Shape", "Cloneable", "extends"), ("Shape", "Sized", "extends"),
        ("Color", "Named", "implements"), ("Point", "Serializable", "implements")}
    assert {(r.qualified_name, r.global_name) for r in extract.globals_used(files, stored).collect()} == {
        ("around", "other"), ("around", "within"), ("around.within", "LIMIT"), ("Box", "Base"), ("Box", "Meta"), ("Box.Lid.shut", "wrapped"), ("Box.open", "Box"), ("Plan.all", "SEEN")}
    args = [(r.qualified_name, r.argument) for r in extract.signature_arguments(files, stored).orderBy("path", "qualified_name", "pos").collect()]
    assert [a for q, a in args if q == "Plan.all"] == ["from", "to"] and [a for q, a in args if q == "around"][:2] == ["first", "second"]
    docs = {(r.qualified_name, r.description, r.tag, r.tag_text) for r in extract.doc_comments(files, stored).collect()}
    assert docs == {("around", "Keep it.\n\nSecond line.", "", ""), ("Plan", "A plan with a price.", "param", "tier the tier of the plan"), ("Plan", "A plan with a price.", "return", "the price")}
    assert {(r.module, r.kind) for r in extract.extract_imports(files, stored).collect()} == {("java.io.*", "normal"), ("java.util.Collections.emptyList", "static")}
    assert {(r.qualified_name, r.complexity) for r in extract.cyclomatic_complexity(files, stored).collect() if r.qualified_name in ("Point.sum", "other", "around")} == {("Point.sum", 2), ("other", 2), ("around", 1)}
    assert {tuple(r) for r in extract.extract_calls(files).collect()} == {tuple(r) for r in extract.extract_calls(files, stored).collect()}


def test_large_files_take_no_quadratic_time(spark):
    """Four thousand functions in one file: their ranges come from windows, not from pairs of lines."""
    text = "".join(f"def f{i}(a):\n    if a:\n        return g{i}(a)\n" for i in range(4000))
    code = spark.createDataFrame([("r", "a.py", 1, "python", text)], "repository_id string, path string, file_id int, language string, text string")
    rows = extract.extract_calls(code).collect()
    assert len(rows) == 4000 and all(r.caller == r.callee_name.replace("g", "f") and r.line == 3 * int(r.caller[1:]) + 3 for r in rows)
