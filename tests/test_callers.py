"""Caller counts without the product of calls and entities."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataflow.operators import resolve


def test_totals_are_the_sizes_of_the_listing(spark):
    rng = random.Random(8)
    ent = [(f"r{i % 2}", f"m{rng.randrange(5)}", f"e{i}", rng.choice(["run", "stop", f"n{i}"])) for i in range(60)]
    calls = []
    for _ in range(400):
        caller, callee = rng.choice(ent), rng.choice(ent)
        calls.append((caller[0], caller[2], rng.choice([callee[2], None]), rng.choice([callee[3], f"x.{callee[3]}", "nowhere"]), rng.randrange(4), False))
    ent_, calls_ = spark.createDataFrame(ent, "repository_id string, module string, entity_id string, name string"), spark.createDataFrame(calls, "repository_id string, caller_id string, callee_id string, callee_name string, call_line int, dynamic boolean")
    want = {(r.repository_id, r.entity_id): (r.n, r.m) for r in resolve.callers_of(calls_, ent_).groupBy("repository_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("caller_module").alias("m")).collect()}
    assert {(r.repository_id, r.entity_id): (r.callers, r.modules) for r in resolve.caller_totals(calls_, ent_).collect()} == want


def test_a_hot_name_costs_no_product(spark):
    """Ten thousand entities of one name and fifty thousand calls of it: half a billion pairs, counted without them."""
    ent = spark.range(10_000).select(F.lit("r").alias("repository_id"), F.concat(F.lit("m"), F.col("id") % 50).alias("module"), F.concat(F.lit("e"), "id").alias("entity_id"), F.lit("get").alias("name"))
    calls = spark.range(50_000).select(F.lit("r").alias("repository_id"), F.concat(F.lit("e"), F.col("id") % 10_000).alias("caller_id"), F.lit(None).cast("string").alias("callee_id"), F.lit("x.get").alias("callee_name"), F.col("id").cast("int").alias("call_line"), F.lit(False).alias("dynamic"))
    row = resolve.caller_totals(calls, ent).agg(F.count(F.lit(1)).alias("n"), F.min("callers").alias("a"), F.max("callers").alias("b"), F.max("modules").alias("m")).first()
    assert tuple(row) == (10_000, 50_000, 50_000, 50)
