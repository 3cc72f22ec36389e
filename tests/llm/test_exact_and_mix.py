"""Exact deduplication, mixing, token counts and decontamination on small tables."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers as public
import pytest

from strataflow.llm.decontaminate import contained_items, drop_contaminated, sketch_need, sketch_size
from strataflow.llm.exact_dedup import DigestIndex, dedup_groups, drop_copies
from strataflow.llm.source_mix import mix
from strataflow.llm.token_counts import CACHE_SCHEMA, TokenCache, json_counter, token_counts, tokenizer_version

ODD = [(1, None, "b"), (2, "", "b"), (3, " \n\t", None), (4, "a b", "a"), (5, "ab", "a"), (6, "a  b ", "a"), (6, "a  b ", "a"), (7, "x " * 30_000, "c"), (8, "a b", "")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, 9) for r in ODD], "doc_id bigint, text string, source string, digest int")


def test_groups_of_equal_texts(odd):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256[:4]) for r in dedup_groups(odd).collect())
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:4]
    assert got == [(1, 3, 3, False, h("")), (2, 3, 3, False, h("")), (3, 3, 3, True, h("")), (4, 6, 4, False, h("ab")), (5, 6, 4, False, h("ab")),
                   (6, 6, 4, False, h("ab")), (6, 6, 4, True, h("ab")), (7, 7, 1, True, h("x" * 30_000)), (8, 8, 1, True, h("a b"))]
    assert dedup_groups(odd.limit(0)).count() == 0


def test_one_row_of_each_text_stays(odd):
    kept = drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8]


def test_one_row_is_kept_where_a_doc_id_has_several_texts(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "ab"), (2, "ab"), (None, "x"), (None, "x"), (3, "x")], "doc_id bigint, text string")
    index = DigestIndex(spark)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in dedup_groups(rows, index).collect()) == [("1", 1, 3, False), ("1", 1, 3, True), ("2", 1, 3, False), ("3", None, 3, False), ("None", None, 3, False), ("None", None, 3, True)]
    assert [(r.doc_id, r.text) for r in drop_copies(rows).orderBy("text").collect()] == [(1, "a b"), (None, "x")]
    later = spark.createDataFrame([(1, "a b"), (9, " a  b"), (3, "x"), (4, "new")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup_groups(later, index).collect()) == [(1, 9, 5, False), (3, None, 4, False), (4, 4, 1, True), (9, 9, 5, True)]


def test_later_batches_meet_the_index(spark, odd):
    index = DigestIndex(spark)
    assert drop_copies(odd, index).count() == 4
    later = spark.createDataFrame([(20, "A B", "a"), (21, "ab\n", "a"), (22, "new", "a")], "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in drop_copies(later, index).collect()) == [20, 22]
    assert drop_copies(later, index).count() == 0 and index.rows().count() == 6


def targets_by_filling(sizes, weights=(5, 2, 1)):
    """Shares by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = sum(w[s] for s in order if s not in fixed)
        over = [s for s in order if s not in fixed and w[s] * rest / free > 2 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: w[s] * rest / free for s in order if s not in fixed}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix_against_round_by_round_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8) * 20)), rng.choice(["s1", "s10", "s2", "ä", None, "z"])) for i in range(400)]
    rows += [(1000, "v " * 40_000, "s1"), (1001, None, "s2"), (1002, "", "s2"), (1003, "a b", "only")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(docs).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets_by_filling(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-9
        assert 0 <= r.taken <= 2 * r.size and (r.first_slot is None) == (r.taken == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(7)).collect()))


def test_mix_interleaves_by_weight(spark):
    docs = spark.createDataFrame([(i, "w " * 64, f"s{i % 3}") for i in range(600)], "doc_id bigint, text string, source string")
    rows = [r for r in mix(docs, block_words=64).collect() if r.first_slot is not None]
    half = sorted(rows, key=lambda r: r.first_slot)[: len(rows) // 2]
    for s in ("s0", "s1", "s2"):
        a, b = sum(r.source == s for r in half), sum(r.source == s for r in rows)
        assert abs(a / b - len(half) / len(rows)) < 0.25
    assert mix(docs.limit(0)).count() == 0


def test_mix_edge_rows(odd):
    got = {(r.doc_id, r.size) for r in mix(odd).collect()}
    assert (1, 0) in got and (7, 30_000) in got and mix(odd).count() == len(ODD)


def counter(fast=True):
    path = public.path("byte_bpe_50k.json")
    return path, json_counter(path, public.path("byte_bpe_50k.tiktoken") if fast else None, public.PATTERN, ("<|endoftext|>",))


def test_counts_are_those_of_the_library(spark):
    rng = random.Random(2)
    signs = "abc \n\tÄß.,'ñ123<|>  漢😀é́\x85\x1c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["a<|endoftext|>b", "<|endoftext|>", "it's we'll  x", " " * 5000]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert counter()[1](texts) == counter(False)[1](texts)


def test_cache_encodes_only_misses(spark, odd):
    path, count = counter()
    cache, version = TokenCache(spark), tokenizer_version(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, version, count, cache).collect()}
    plain = counter(False)[1]
    assert all(got[i] == (len((t or "").encode()), plain([t or ""])[0], plain([t or ""])[0] > 1024) for i, t, _ in ODD)
    assert cache.rows(version).count() == len({t or "" for _, t, _ in ODD})

    def fail(texts):
        raise AssertionError("nothing is left to encode")

    assert token_counts(odd, version, fail, cache).count() == len(ODD)
    cache.append(spark.createDataFrame(cache.rows(version).collect(), CACHE_SCHEMA))  # a second writer had the same misses
    again = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, version, fail, cache).collect()}
    assert again == got and token_counts(odd, version, fail, cache).count() == len(ODD)
    assert token_counts(odd.limit(0), version, count).count() == 0


def test_containment_against_plain_sets(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(150):
        body = [word() for _ in range(rng.randrange(300))]
        if d % 3 == 0:
            passage = items[rng.randrange(30)][1].upper().split()
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "zz"
            body[5:5] = passage
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), (502, items[3][1])]

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    want = set()
    sets = {i: shingles(t) for i, t in items}
    for d, text in docs:
        s = shingles(text)
        want |= {(d, i, len(g & s)) for i, g in sets.items() if g and 100 * len(g & s) >= 80 * len(g)}
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = contained_items(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id, r.n_common) for r in got.collect()} == want and len(want) > 10
    left = drop_contaminated(frame.withColumnRenamed("doc_id", "DOC_ID").withColumnRenamed("DOC_ID", "doc_id"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_sketches_exceed_what_a_contained_item_may_lack():
    for n in range(1, 500):
        assert n - -(-80 * n // 100) < sketch_size(n, 80) <= n and 1 <= sketch_need(n, 80) == sketch_size(n, 80) - (n - -(-80 * n // 100))


def test_contamination_of_rows_without_doc_id(spark):
    rng = random.Random(7)
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    docs = spark.createDataFrame([(None, f"so {passage} it is", 1), (None, "clean words of a text", 2), (3, passage, 3), (4, "x " * 200_000 + passage, 4), (None, None, 5), (3, "other text of that id", 6)], "doc_id bigint, text string, part int")
    items = spark.createDataFrame([(1, passage), (1, passage), (None, "clean words of a text"), (2, None)], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_common) for r in contained_items(docs, items).collect())
    assert got == [(0, 1, 36), (3, 1, 36), (4, 1, 36)]
    assert sorted(r.part for r in drop_contaminated(docs, items).collect()) == [2, 5] and drop_contaminated(docs, items).columns == docs.columns
    assert contained_items(docs, items.limit(0)).count() == 0 == contained_items(docs.limit(0), items).count()


def test_rows_without_doc_id_are_mixed_as_in_sql(spark):
    import duckdb

    from strataflow.llm.source_mix import OP3_SQL

    rows = [(None if i % 3 == 0 else i, "w " * (i * 7 % 90), f"s{i % 2}") for i in range(300)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).drop("source").collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert len(got) == 300 and sorted(map(tuple, got), key=key) == sorted(db.execute(OP3_SQL).fetchall(), key=key)


def test_groups_are_exact_over_batches(spark):
    index = DigestIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup_groups(frame(rows), index).collect())
    assert groups([(5, "a b"), (9, "c")]) == [(5, 5, 1, True), (9, 9, 1, True)]
    assert groups([(6, "a  b"), (7, "ab")]) == [(6, 6, 3, True), (7, 6, 3, False)]
    assert groups([(4, "a  b"), (8, "d"), (9, "c")]) == [(4, 4, 4, True), (8, 8, 1, True), (9, 9, 2, True)]
    assert index.rows().count() == 3 and groups([]) == []


def test_mix_of_documents_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, " \n", "a"), (None, None, "b")], "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken, r.first_slot) for r in mix(docs).collect()} == {(i, 0, 0.0, 0, None) for i in (1, 2, 3, None)}
