"""Searches whose queries and tiles go in several pieces."""

from __future__ import annotations

import numpy as np

from strataflow.operators import index


def test_pieces_find_what_all_pairs_find(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16))
    x[400:430] = x[7]  # equal scores go by id
    x[5], x[650, 3] = 0, np.nan  # a row that is not a number scores nothing, and hides none of its tile
    x = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) == 0, 1, np.linalg.norm(x, axis=1, keepdims=True))
    table = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(x)], "id bigint, b array<int>, w array<double>")
    for name, value in {"TILE": 64, "BLOCK_QUERIES": 100, "PIECE_QUERIES": 7, "PIECE_PAIRS": 5}.items():
        monkeypatch.setattr(index, name, value)
    got = {(r.query_id, r["rank"]): (r.score, r.row_id) for r in index._best_rows(table.filter("id % 3 = 1"), table, 6, 16, linked=False).collect()}
    want = {}
    for q in range(1, 900, 3):
        s = np.round(x @ x[q], 4)
        ranked = sorted((-s[i], i) for i in range(900) if i != q and not np.isnan(s[i]))[:6]
        want |= {(q, n + 1): (-a + 0.0, i) for n, (a, i) in enumerate(ranked)}
    assert got.keys() == want.keys()
    assert all(abs(got[at][0] - want[at][0]) < 1.01e-4 for at in want) and sum(got[at] == want[at] for at in want) >= 0.98 * len(want)  # halves may round apart
