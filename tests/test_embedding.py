"""Hashed vectors are made within a text's row."""

from __future__ import annotations

import hashlib
import random
import re

from strataflow.operators import index


def vector(text: str, dims: int) -> dict[int, float]:
    words = re.findall(r"[a-zA-Z0-9_]+", text)
    parts = [p for w in words for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", w)]
    sums: dict[int, int] = {}
    for token in {w.lower() for w in words + parts}:
        h = hashlib.md5(token.encode()).digest()
        b = int.from_bytes(h[:4], "big") % dims
        sums[b] = sums.get(b, 0) + (1 if h[4] % 2 else -1)
    norm = sum(s * s for s in sums.values()) ** 0.5
    return {b: s / norm for b, s in sums.items() if s}


def test_vectors_need_no_shuffle_and_are_those_of_the_tokens(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["getUser", "a_b", "x1", "HTTPServer", f"w{rng.randrange(900)}"]) for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [(100, ""), (101, None), (102, "+ -")]
    table = spark.createDataFrame(texts, "id int, text string")
    for dims in (7, 256):
        rows = index.hash_embed(table, dims)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        got: dict[int, dict] = {}
        for r in rows.collect():
            got.setdefault(r.id, {})[r.bucket] = r.weight
        want = {i: vector(t or "", dims) for i, t in texts}
        assert got == {i: v for i, v in want.items() if v}
