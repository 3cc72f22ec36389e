"""Near-duplicate groups against an exhaustive comparison of plain shingle sets."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from strataflow.llm.components import components
from strataflow.llm.near_dup import drop_near_copies, near_groups

DATA = "/root/testdata/{}/documents.parquet"


def plain_set(text, k):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    """doc_id -> (set size, least id of the component), by all pairs that share a shingle."""
    sets = {i: plain_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = set()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_given_documents_match_all_pairs(spark):
    for k, percent, sf in ((3, 85, "sf0.01"), (5, 80, "sf0.001")):
        docs = spark.read.parquet(DATA.format(sf))
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert result(near_groups(docs, k, percent)) == brute(rows, k, percent)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_large_group_near_the_threshold(spark):
    """A chain of copies, each near the next but not the first, and a group larger than any leaf."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**5)}" for _ in range(120)]
    rows = [(i, " ".join(edited(base, rng, rng.randrange(5)))) for i in range(300)]
    words = [f"v{rng.randrange(10**5)}" for _ in range(100)]
    for i in range(300, 340):
        rows.append((i, " ".join(words)))
        words = edited(words, rng, 2)
    rows += [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(340, 380)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(near_groups(docs, 3, 85)) == brute(rows, 3, 85)


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "A b", 4), (5, "a  B", 5), (6, "a b c", 6), (6, "a b c", 6), (7, "a " * 50_000, 7), (8, "a a a", 8), (9, "a b", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rep int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(docs, 3, 85).orderBy("doc_id").collect()]
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True)]
    kept = drop_near_copies(docs.withColumn("near_key", F.lit(0)), 3, 85)
    assert kept.columns == ["doc_id", "text", "rep", "near_key"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 6, 7, 9]
    assert near_groups(docs.limit(0)).count() == 0


def test_one_doc_id_with_several_texts(spark):
    rng = random.Random(6)
    texts = [[f"{c}{rng.randrange(10**5)}" for _ in range(80)] for c in "abc"]
    near = lambda i: " ".join(edited(texts[i], rng, 1))
    rows = [(1, near(0)), (1, near(1)), (2, near(0)), (3, near(1)), (4, near(2)), (None, near(2)), (None, near(2)), (None, "alone in this"), (None, "alone in this"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_groups(docs, 3, 85).collect()))
    assert got == [(0, 0, True)] * 3 + [(0, 4, False)] * 2 + [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    kept = drop_near_copies(docs, 3, 85).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 0, 1, 1, 4] and near_groups(docs.repartition(7), 3, 85).filter("NOT kept").count() == 4


def test_components_by_rounds_and_at_once(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    for most in (0, 30, 100_000):
        assert {r.id: r.component for r in components(frame, edges_a_task=most).collect()} == want
    assert components(frame.limit(0)).count() == 0
