"""Models that fail: calls are tried again, logged, and end no job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataflow.functions import plug


def flaky():
    calls = []

    def model(texts):
        calls.append(1)
        if len(calls) % 3 == 0:
            raise ConnectionError("busy")
        if "poison" in texts:
            raise ValueError("never")
        return [[float(len(t))] for t in texts]

    return model


def test_a_model_that_fails_each_third_call_gives_every_row_once(spark, tmp_path):
    texts = spark.range(200).select("id", F.concat(F.lit("t"), F.col("id") % 150).alias("text")).unionByName(spark.createDataFrame([(500, None)], "id bigint, text string"))
    got = plug.embed_with(texts, flaky(), batch=7, pause=0.001)
    rows = got.collect()
    assert sorted(r.id for r in rows) == [*range(200), 500] and all(r.error is None and r.embedding == [float(len(f"t{r.id % 150}"))] for r in rows if r.id < 200)
    log = f"file://{tmp_path}/log"
    bad = texts.unionByName(spark.createDataFrame([(900, "poison")], "id bigint, text string"))
    first = {r.id: r for r in plug.embed_with(bad, flaky(), batch=1, pause=0.001, log=log).collect()}
    assert first[900].embedding is None and "never" in first[900].error and first[900].tries == 3 and sum(r.error is not None for r in first.values()) == 1

    def last(batch):
        if batch != ["poison"]:
            raise AssertionError("called again")
        return [[7.0]]

    again = {r.id: r for r in plug.embed_with(bad, last, batch=1, pause=0.001, log=log).collect()}
    assert again[900].embedding == [7.0] and again[900].error is None and len(again) == 202 and all(again[i].embedding == first[i].embedding for i in range(200))


def test_failures_of_a_responder_are_rows(spark):
    prompts = spark.createDataFrame([(1, 1, "s", "a"), (1, 2, "s", "b"), (2, 1, None, "a"), (2, 2, "s", "a")], "conv_id bigint, turn bigint, system string, prompt string")

    def answer(system, prompt):
        if prompt == "b":
            raise TimeoutError("slow")
        return f"{system}:{prompt}"

    got = {(r.conv_id, r.turn): (r.response, r.error) for r in plug.respond_with(prompts, answer, tries=2, pause=0.001).collect()}
    assert got == {(1, 1): ("s:a", None), (1, 2): (None, "TimeoutError: slow"), (2, 1): ("None:a", None), (2, 2): ("s:a", None)}


def test_attempts_are_counted():
    assert plug.attempted(lambda: [1], 1, 3, 0) == ([1], None, 1)
    found, error, n = plug.attempted(lambda: [1], 2, 2, 0)
    assert found == [None, None] and "1 results" in error and n == 2
    with pytest.raises(KeyboardInterrupt):
        plug.attempted(lambda: (_ for _ in ()).throw(KeyboardInterrupt), 1, 2, 0)
