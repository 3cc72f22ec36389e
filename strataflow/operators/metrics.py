"""Fan-in and fan-out, risk, impact and test-run figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.operators.resolve import callees_of, caller_totals


def edges(calls: DataFrame) -> DataFrame:
    """Call edges: resolved, not dynamic, no self calls; several calls are several edges."""
    return calls.filter("callee_id IS NOT NULL AND NOT dynamic AND caller_id <> callee_id").select("repository_id", F.col("caller_id").alias("source"), F.col("callee_id").alias("target"))


def caller_counts(calls: DataFrame) -> DataFrame:
    return edges(calls).groupBy("repository_id", F.col("target").alias("entity_id")).agg(F.count(F.lit(1)).alias("callers"))


def fan_in_out(calls: DataFrame) -> DataFrame:
    """One aggregation over both ends of each edge: hot entities are summed before the shuffle."""
    ends = edges(calls).select("repository_id", F.explode(F.array(F.struct(F.col("target").alias("entity_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("entity_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("repository_id", F.col("e.entity_id").alias("entity_id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def risk_score(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """complexity * (in + out + 1) of every entity with an edge."""
    return (ent.join(fan_in_out(calls), ["repository_id", "entity_id"])
            .select("repository_id", "entity_id", "name", "type", "complexity", F.col("in_degree").alias("callers"), (F.col("complexity") * (F.col("in_degree") + F.col("out_degree") + 1)).alias("risk")))


def top_risk(calls: DataFrame, ent: DataFrame, k: int = 10) -> DataFrame:
    """The k riskiest entities of each repository; ties by id."""
    w = W.partitionBy("repository_id").orderBy(F.desc("risk"), "entity_id")
    return risk_score(calls, ent).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("repository_id", "entity_id", "complexity", "risk", "rank")


def high_risk_listing(calls: DataFrame, ent: DataFrame, k: int = 10) -> DataFrame:
    """Functions, methods and classes among the riskiest, ordered by complexity, callers and name."""
    w = W.partitionBy("repository_id").orderBy(F.desc("risk"), "entity_id")
    best = risk_score(calls, ent).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).filter(F.col("type").isin("function", "method", "class"))
    order = W.partitionBy("repository_id").orderBy(F.desc("complexity"), F.desc("callers"), "name", "entity_id")
    return best.select("repository_id", F.row_number().over(order).alias("pos"), "entity_id", "name", "complexity", "callers")


def high_risk_flag(calls: DataFrame, ent: DataFrame, k: int = 10, limit: int = 10) -> DataFrame:
    best = top_risk(calls, ent, k).select("repository_id", "entity_id", F.lit(True).alias("top"))
    return ent.join(best, ["repository_id", "entity_id"], "left").select("repository_id", "entity_id", (F.coalesce("top", F.lit(False)) | (F.col("complexity") >= limit)).alias("flag"))


def neighbor_lists(calls: DataFrame) -> DataFrame:
    """Distinct neighbours of each entity, a row each: direction (in: callers, out: callees), kind, calls between the two, and the entity's degree in that direction.

    Rows instead of lists, so that an entity with very many neighbours fills no single value.
    """
    pairs = edges(calls).groupBy("source", "target").agg(F.count(F.lit(1)).alias("calls"))
    side = lambda me, other, word: pairs.select(F.col(me).alias("entity_id"), F.lit(word).alias("direction"), F.col(other).alias("neighbor"), F.lit("call").alias("kind"), "calls")
    both = side("target", "source", "in").unionByName(side("source", "target", "out"))
    degree = both.groupBy("entity_id", "direction").agg(F.count(F.lit(1)).alias("degree"))
    return both.join(degree, ["entity_id", "direction"])


def capped_callers(calls: DataFrame, ent: DataFrame, k: int = 20) -> DataFrame:
    """At most k ``module:line`` callers per called entity, in order of place."""
    place = F.concat_ws(":", "module", F.lpad(F.col("call_line").cast("string"), 5, "0"))
    rows = calls.filter("callee_id IS NOT NULL").join(ent.select(F.col("entity_id").alias("caller_id"), "module"), "caller_id").select(F.col("callee_id").alias("entity_id"), place.alias("place"), "caller_id").distinct()
    w = W.partitionBy("entity_id").orderBy("place", "caller_id")
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("place")), ",").alias("callers"))


def impact_report(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Callers, distinct caller modules, callees, impact level and reason of every entity."""
    made = callees_of(calls, ent).groupBy("repository_id", "entity_id").agg(F.count(F.lit(1)).alias("callees"))
    per = caller_totals(calls, ent)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    all_ = ent.join(per, ["repository_id", "entity_id"], "left").join(made, ["repository_id", "entity_id"], "left").select("repository_id", "entity_id", "complexity", none("callers"), none("modules"), none("callees"))
    high = (F.col("callers") >= 3) | (F.col("modules") >= 2) | (F.col("callers") >= 1) & (F.col("complexity") >= 10)
    medium = (F.col("callers") >= 1) | (F.col("complexity") >= 5)
    # The texts of the three levels.
    reason = (F.when(high, F.format_string("%d callers across %d modules depend on this function's behavior and error semantics.", "callers", "modules"))
              .when(medium, F.concat(F.format_string("%d caller in %d ", "callers", "modules"), F.when(F.col("modules") == 1, "module").otherwise("modules"), F.lit(" depends on this function.")))
              .otherwise("No callers in this repository depend on this function; low impact risk."))
    return all_.select("repository_id", "entity_id", "callers", "modules", "callees", F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW").alias("impact"), reason.alias("reason"))


def distinct_modules(calls: DataFrame, ent: DataFrame) -> DataFrame:
    return caller_totals(calls, ent).select("repository_id", "entity_id", "modules")


def impact_level(calls: DataFrame, ent: DataFrame) -> DataFrame:
    return impact_report(calls, ent).select("repository_id", "entity_id", "callers", "modules", "impact")  # callees are pruned


def test_run_stats(cases: DataFrame, target: float = 60.0) -> DataFrame:
    """Generated, passed and failed cases of each run; the target needs that share and no failure."""
    ok = F.col("status") == "passed"
    n = cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("generated"), F.count_if(ok).alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return n.withColumn("target_reached", (F.col("failed") == 0) & (100.0 * F.col("passed") / F.col("generated") >= target))


def failed_test_list(cases: DataFrame) -> DataFrame:
    return cases.filter("status = 'failed'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_failed"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("#", "name", F.col("event_id").cast("string")))), ",").alias("failed_names"))


def coverage_percent(runs: DataFrame) -> DataFrame:
    """covered / (covered + missed) in per cent, two digits, half to even; 100 where there is nothing to cover."""
    total = F.col("tests_passed") + F.col("tests_failed")
    return runs.select("run_id", F.when(total == 0, 100.0).otherwise(F.bround(F.col("tests_passed") * 100 / total, 2)).alias("pct"))


def run_display(runs: DataFrame) -> DataFrame:
    pct = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("line_coverage").cast("double")))
    return runs.select("run_id", F.when(F.col("tests_failed") == 0, "PASSED").otherwise("FAILED").alias("label"), F.round(pct, 1).alias("pct"))


def latest_run(runs: DataFrame) -> DataFrame:
    w = W.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(w)).filter("n = 1").select("repository_id", "run_id", "tests_generated", "tests_passed", "tests_failed", "created_at")


def latest_analysis(stages: DataFrame) -> DataFrame:
    best = F.max(F.struct("ts", "event_id", "stage", "state")).alias("b")
    return stages.groupBy("analysis_id").agg(best).select("analysis_id", "b.event_id", "b.stage", "b.state")


# Fixed value: the stages of an analysis, in order.
STAGES = ("uploaded", "scanned", "parsing", "aggregating", "graph", "index")


def current_stage(stages: DataFrame) -> DataFrame:
    """The first stage whose latest state is not done; ``completed`` if all are."""
    latest = stages.groupBy("analysis_id", "stage").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    done = latest.groupBy("analysis_id").agg(F.collect_set(F.when(F.col("state") == "done", F.col("stage"))).alias("done"))
    first = F.filter(F.array(*map(F.lit, STAGES)), lambda s: ~F.array_contains("done", s))
    return done.select("analysis_id", F.coalesce(F.get(first, F.lit(0)), F.lit("completed")).alias("current_stage"))


def recent_repositories(runs: DataFrame, n: int = 50) -> DataFrame:
    newest = runs.groupBy("repository_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "repository_id").limit(n)
    return newest.withColumn("rank", F.row_number().over(W.orderBy(F.desc("created_at"), "repository_id")))


def coverage_progress(runs: DataFrame, target: float = 60.0, max_iterations: int = 3) -> DataFrame:
    """Coverage by iteration up to the first one at target (or the last allowed), gain and best so far."""
    w = W.partitionBy("repository_id").orderBy("created_at", "run_id")
    rows = runs.select("repository_id", "run_id", "created_at", F.col("line_coverage").cast("double").alias("coverage")).withColumn("iteration", F.row_number().over(w))
    rows = rows.withColumn("gain", F.col("coverage") - F.lag("coverage").over(w)).withColumn("best", F.max("coverage").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("first_reached", F.min(F.when(F.col("coverage") >= target, F.col("iteration"))).over(W.partitionBy("repository_id")))
    stop = F.least(F.coalesce("first_reached", F.lit(max_iterations)), F.lit(max_iterations))
    return rows.filter(F.col("iteration") <= stop).select("repository_id", "iteration", F.round("coverage", 4).alias("coverage"), F.round("gain", 4).alias("gain"), F.round("best", 4).alias("best"), "first_reached")


def coupling_issues(ent: DataFrame, limit: int = 8, k: int = 10) -> DataFrame:
    """Up to k entities per repository whose complexity is at least ``limit``, in order of id."""
    w = W.partitionBy("repository_id").orderBy("entity_id")
    # Fixed value: the text of an issue.
    detail = F.format_string("%s.%s couples execution with high complexity (%d)", "module", "name", "complexity")
    return ent.filter(F.col("complexity") >= limit).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("repository_id", F.lit("coupling").alias("kind"), F.lit("medium").alias("severity"), detail.alias("detail"), "entity_id")
