"""Columns over words: what they cost and give."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from strataflow.functions import text as X


def test_cover_ratio_reads_a_text_once(spark):
    """Forty expected words cost about what one costs; the text was normalised for each of them."""
    rows = spark.range(8).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("t"))
    rows.cache().count()

    def seconds(n: int) -> float:
        began = time.perf_counter()
        want = F.split(F.concat_ws(" ", F.lit("w1"), *(F.concat(F.lit(f"v{k}x"), F.substring("t", 1, 2)) for k in range(n - 1))), " ")
        assert {round(r[0], 4) for r in rows.select(X.cover_ratio(want, X.normal_words("t"))).collect()} == {round(1 / n, 4)}
        return time.perf_counter() - began

    seconds(1)
    one, forty = min(seconds(1) for _ in range(2)), min(seconds(40) for _ in range(2))
    assert forty < 5 * one + 1
