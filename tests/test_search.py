"""Searches against brute force: products in tiles, and the inverted file on clustered vectors."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from strataflow.operators import index, ivf


def clustered(n: int, centres: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, 32))
    x = c[rng.integers(0, centres, n)] + 0.25 * rng.standard_normal((n, 32))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id bigint, w array<double>")


def test_inverted_file_scans_few_codes_and_takes_new_rows(spark, tmp_path):
    x = clustered(8000, 150, 1)
    rows = frame(spark, x)
    built = ivf.IvfIndex.create(rows.filter("id < 6000"), f"file://{tmp_path}/ivf")
    built.append(rows.filter("id >= 6000"))
    opened = ivf.IvfIndex(spark, f"file://{tmp_path}/ivf")
    assert opened.codes().count() == 8000 and opened.codes().select("chunk_id").distinct().count() == 8000
    asked = rows.filter("id % 80 = 0")
    got: dict[int, set[int]] = {}
    for r in ivf.search(opened, asked, rows).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    scores = x @ x.T
    np.fill_diagonal(scores, -2)
    hits = sum(len(got[q] & set(np.argsort(-scores[q])[:10].tolist())) for q in range(0, 8000, 80))
    assert hits >= 0.9 * 1000
    read = opened.candidates(asked, 10**6, spread=1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n")).first()[0]
    assert read < 0.15 * 8000


def test_products_in_tiles_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, sorted(rng.sample(range(256), rng.randrange(1, 30)))) for i in range(700)]
    rows = [(i, b, [rng.choice([-1.0, 1.0]) / len(b) ** 0.5 for _ in b]) for i, b in rows] + [(1000 + i, [3, 4], [0.6, 0.8]) for i in range(200)]
    table = spark.createDataFrame(rows, "id bigint, b array<int>, w array<double>")
    got = index._best_rows(table.filter("id % 50 = 0"), table, 10, 256, linked=True).collect()
    want = []
    for q, b, w in rows:
        if q % 50 == 0:
            mine = dict(zip(b, w))
            scored = [(-round(sum(mine.get(x, 0.0) * y for x, y in zip(c, v)), 4) + 0.0, i) for i, c, v in rows if i != q and set(c) & set(b)]
            want += [(q, i, r + 1, -s + 0.0) for r, (s, i) in enumerate(sorted(scored)[:10])]
    assert {(r.query_id, r["rank"]): r.score for r in got} == {(q, r): s for q, i, r, s in want}
    assert sum((r.query_id, r.row_id) in {(q, i) for q, i, _, _ in want} for r in got) >= 0.98 * len(want)  # halves may round apart
    assert index._best_rows(table.limit(0), table, 10, 256, linked=True).count() == 0 and index._best_rows(table.filter("id = 0"), table.limit(0), 10, 256, linked=True).count() == 0


def test_a_query_meets_a_shard_once_and_takes_its_best_codes(spark, tmp_path, monkeypatch):
    """Copies of a vector are ties by id, also over the tiles of a cell; before, each cell and share handed on rows of its own."""
    monkeypatch.setattr(ivf, "TILE", 64)
    monkeypatch.setattr(ivf, "PIECE", 7)
    x = np.concatenate([clustered(1500, 5, 3), np.repeat(clustered(1, 1, 4), 500, axis=0)])[np.random.default_rng(5).permutation(2000)]
    rows = frame(spark, x)
    built = ivf.IvfIndex.create(rows, f"file://{tmp_path}/ivf", sample=400, parts=8)
    book, asked = built.codebook, rows.filter("id % 40 = 0")
    cell, codes = book.encode(x)
    for most, shards in ((1, 1), (11, 3), (600, 2)):
        per_query: dict[int, int] = {}
        for r in built.scored(asked, most, spread=shards).collect():
            per_query[r.query_id] = per_query.get(r.query_id, 0) + 1
        got: dict[int, list[int]] = {}
        for r in built.candidates(asked, most, spread=shards).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert len(got) == 50
        for q, found in got.items():
            assert per_query[q] <= shards * most
            read = np.flatnonzero(np.isin(cell, ivf.nearest(x[q : q + 1], book.cells, book.probes)[0]))
            near = x[q] @ book.cells[cell[read]].T + sum((b @ x[q, p * book.width : (p + 1) * book.width])[codes[read, p]] for p, b in enumerate(book.books))
            assert found == read[np.lexsort((read, -near.round(12)))][:most].tolist()


def test_codes_are_as_fine_in_many_dimensions(spark):
    """Sixteen codes of eight coordinates each found fewer than nine in ten."""
    x = np.random.default_rng(6).standard_normal((6000, 128))
    chunks = frame(spark, x).withColumnsRenamed({"id": "chunk_id", "w": "embedding"})
    got = {(r.query_id, r.chunk_id) for r in index.ann_topk(chunks.filter("chunk_id % 50 = 0"), chunks).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = x[::50] @ x.T
    scores[np.arange(120), np.arange(0, 6000, 50)] = -2
    assert len(got) == 1200 and sum((50 * i, int(j)) in got for i, s in enumerate(scores) for j in np.argsort(-s)[:10]) >= 0.9 * 1200


def test_a_vector_is_scaled_by_one_norm(spark):
    """The norm was made anew for each coordinate: a vector of 20000 took minutes."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, [1.0, None]), (5, [1.0] * 20000)], "chunk_id bigint, embedding array<float>")
    began = time.monotonic()
    got = {r.id: r.w for r in index._vectors(rows).collect()}
    assert time.monotonic() - began < 30
    assert got[1] == [3 / 5, 4 / 5] and got[2] == [0.0, 0.0] and got[3] == [] and got[4] == [None, None] and got[5] == [1 / 20000**0.5] * 20000
