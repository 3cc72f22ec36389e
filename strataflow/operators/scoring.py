"""Refactor safety, behaviour verdicts and explanation quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import text as X
from strataflow.operators.metrics import capped_callers, latest_run


def params(column: str) -> F.Column:
    """Parameter names without self and cls."""
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda p: ~p.isin("", "self", "cls"))


def param_set_diff(versions: DataFrame) -> DataFrame:
    return versions.select("proposal_id", F.explode(F.array_distinct(F.array_except(params("old_params"), params("new_params")))).alias("removed"))


def breaking_changes(versions: DataFrame, calls: DataFrame, ent: DataFrame) -> DataFrame:
    """HIGH changes: another number of parameters, else parameters removed or renamed; with up to 20 callers."""
    old, new = params("old_params"), params("new_params")
    gone = F.array_sort(F.array_except(old, new))
    reason = (F.when(F.size(old) != F.size(new), F.format_string("Parameter count changed from %d to %d.", F.size(old), F.size(new)))
              .when(F.size(gone) > 0, F.concat(F.lit("Parameters removed or renamed: "), F.array_join(gone, ", "), F.lit("."))))
    found = versions.withColumn("reason", reason).filter("reason IS NOT NULL")
    return found.join(capped_callers(calls, ent), "entity_id", "left").select("proposal_id", "entity_id", F.lit("HIGH").alias("impact"), "reason", F.coalesce("callers", F.lit("")).alias("affected_callers"))


# Fixed value: what a breaking change costs by its impact.
PENALTIES = {"HIGH": 40, "MEDIUM": 20, "LOW": 5}


def api_compatibility(versions: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """100 less the penalties of all breaking changes: of the signature (HIGH), and ``reported`` ones (proposal_id, impact, reason), each reason once."""
    old, new = params("old_params"), params("new_params")
    breaks = (F.size(old) != F.size(new)) | (F.size(F.array_except(old, new)) > 0)
    rows = versions.select("proposal_id", F.when(breaks, PENALTIES["HIGH"]).otherwise(0).alias("own"))
    if reported is None:
        return rows.select("proposal_id", F.greatest(F.lit(0), F.lit(100) - F.col("own")).alias("api_compatibility"))
    cost = F.coalesce(F.create_map(*(F.lit(x) for pair in PENALTIES.items() for x in pair))[F.col("impact")], F.lit(PENALTIES["LOW"]))
    more = reported.groupBy("proposal_id", "reason").agg(F.max(cost).alias("cost")).groupBy("proposal_id").agg(F.sum("cost").alias("cost"))
    return rows.join(more, "proposal_id", "left").select("proposal_id", F.greatest(F.lit(0), (F.lit(100) - F.col("own") - F.coalesce("cost", F.lit(0))).cast("int")).alias("api_compatibility"))


def test_compatibility(versions: DataFrame, runs: DataFrame, target: float = 60.0) -> DataFrame:
    """100, 80 or 30 by the newest bound run, 0 without one; with confidence and behaviour."""
    newest = latest_run(runs).select(F.col("repository_id").alias("run_repository_id"), "tests_failed", (100.0 * F.col("tests_passed") / F.col("tests_generated")).alias("coverage"))
    rows = versions.join(newest, "run_repository_id", "left")
    none, passed = F.col("tests_failed").isNull(), F.col("tests_failed") == 0
    reached = passed & (F.col("coverage") >= target)
    case = lambda a, b, c, d: F.when(none, d).when(reached, a).when(passed, b).otherwise(c)
    return rows.select("proposal_id", case(100, 80, 30, 0).alias("test_compatibility"), case(95, 80, 50, 35).alias("confidence_score"), case("high", "high", "medium", "low").alias("confidence_level"),
                       case("BEHAVIOR_PRESERVED", "BEHAVIOR_PRESERVED", "BEHAVIOR_MUTATED", "UNVERIFIED").alias("behavior_status"))


def dependency_impact(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """max(40, 100 - min(60, 12 callers + 2 complexity)) of every entity."""
    n = calls.filter("callee_id IS NOT NULL").groupBy(F.col("callee_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("callers"))
    rows = ent.join(n, "entity_id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    return rows.select("entity_id", "complexity", "callers", F.greatest(F.lit(40), 100 - F.least(F.lit(60), F.col("callers") * 12 + F.col("complexity") * 2)).alias("dependency_impact"))


def behavioral_risk(versions: DataFrame, ent: DataFrame) -> DataFrame:
    """max(30, 100 - min(70, 5 complexity + 15 differences)) of every proposal with a known entity."""
    rows = versions.join(ent.select("entity_id", "complexity"), "entity_id")
    return rows.select("proposal_id", F.greatest(F.lit(30), 100 - F.least(F.lit(70), F.col("complexity") * 5 + F.col("behavioral_diffs") * 15)).alias("behavioral_risk"))


def safety_score(versions: DataFrame, runs: DataFrame, calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Weighted total (half to even), risk level and ordered recommendations of every proposal."""
    rows = (versions.select("proposal_id", "entity_id").join(api_compatibility(versions), "proposal_id").join(test_compatibility(versions, runs), "proposal_id")
            .join(behavioral_risk(versions, ent), "proposal_id").join(dependency_impact(calls, ent), "entity_id"))
    total = F.bround((F.col("api_compatibility") * 35 + F.col("test_compatibility") * 25 + F.col("dependency_impact") * 20 + F.col("behavioral_risk") * 20) / F.lit(100), 0).cast("int")
    rows = rows.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    level = F.when((F.col("total") >= 80) & (F.col("confidence_level") != "low"), "low").when(F.col("total") >= 50, "medium").otherwise("high")
    said = F.filter(F.array(
        F.when(F.col("test_compatibility") == 0, "CAUTION: No test suite executed against this refactor. Test compatibility is UNKNOWN (0%)."),
        F.when(F.col("api_compatibility") < 80, "Review API signature changes to maintain backward compatibility with callers."),
        F.when(F.col("dependency_impact") < 70, F.format_string("Entity has %d callers; verify dependent modules after refactor.", "callers")),
        F.when(F.col("behavioral_risk") < 70, "High complexity or behavioral changes detected; run full regression test suite.")), lambda x: x.isNotNull())
    text = F.when(F.size(said) == 0, "Refactor proposal carries low risk; behavior is well-preserved.").otherwise(F.array_join(said, " | "))
    return rows.select("proposal_id", "total", "confidence_score", level.alias("risk_level"), "behavior_status", text.alias("recommendations"))


def behavior_verdict(versions: DataFrame, runs: DataFrame, target: float = 60.0) -> DataFrame:
    """UNVERIFIED, MUTATED or PRESERVED with its message, by the newest bound run."""
    newest = latest_run(runs).select(F.col("repository_id").alias("run_repository_id"), "tests_failed", "tests_passed", (100.0 * F.col("tests_passed") / F.col("tests_generated")).alias("coverage"))
    rows = versions.join(newest, "run_repository_id", "left")
    none, bad = F.col("tests_failed").isNull(), F.col("tests_failed") > 0
    good = (F.col("coverage") >= target) & (F.col("tests_passed") > 0)
    verdict = F.when(none, "UNVERIFIED").when(bad, "BEHAVIOR_MUTATED").otherwise("BEHAVIOR_PRESERVED")
    said = (F.when(none, "No sandbox test run executed against this refactor proposal.").when(bad, F.format_string("Refactor test execution failed (status=failed, failed=%d).", "tests_failed"))
            .when(good, F.format_string("Behavior preserved: All %d tests passed with target coverage reached.", "tests_passed")).otherwise(F.format_string("Behavior preserved: %d tests passed successfully.", "tests_passed")))
    return rows.select("proposal_id", verdict.alias("verdict"), said.alias("message"))


# Anchors of the second evaluator and the completeness of n covered facts.
ANCHORS = (("transaction", "net", "fee"), ("amount", "fee_rate"), ("round", "net", "float"), ("valueerror", "exception", "raise"), ("fee", "net", "="), ("amount", "<=", "if "))
COMPLETENESS = (0.0, 0.8, 1.7, 2.5, 3.3, 4.2, 5.0)


def _categories(expected: str) -> list[F.Column]:
    """The expected words, dealt by position to six categories, without stopwords and repeats."""
    all_ = F.filter(F.split(X.normalize(expected), " "), lambda w: w != "")
    stop = F.array(*map(F.lit, X.STOPWORDS))

    def dealt(c: int) -> F.Column:
        return F.array_except(F.filter(all_, lambda w, i: i % 6 == c), stop)

    return [dealt(c) for c in range(6)]


def scored_claims(claims: DataFrame) -> DataFrame:
    """Both evaluators on (expected, response): accuracy, completeness, clarity and overall of A and B."""
    # words are made once per row, not once per category
    rows = claims.select("file_id", "item_id", "response", X.normalize("response").alias("norm"), X.normal_words("response").alias("found"), *(c.alias(f"e{i}") for i, c in enumerate(_categories("expected"))))
    # the long list of a response's words is met twice, not twice per category
    want = F.array_distinct(F.flatten(F.array(*(f"e{i}" for i in range(6)))))
    start = lambda ws: F.array_distinct(F.transform(F.filter(ws, lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4)))
    rows = rows.withColumn("want", want).withColumn("starts", start("found"))
    rows = rows.withColumn("exact", F.array_intersect("want", "found")).withColumn("begun", F.array_intersect(start(F.filter("want", lambda w: F.length(w) > 4)), "starts"))
    hit = lambda w: F.array_contains("exact", w) | (F.length(w) > 4) & F.array_contains("begun", F.substring(w, 1, 4))
    ratio = lambda e: F.when(F.size(e) == 0, 1.0).otherwise(F.size(F.filter(e, hit)) / F.size(e))
    covered = sum(((ratio(f"e{i}") >= 0.5).cast("int") for i in range(6)), F.lit(0))
    anchored = sum((X.has_any(F.col("norm"), a).cast("int") for a in ANCHORS), F.lit(0))
    blank, marked, n = F.col("response") == "", X.has_any(F.lower("response"), X.PLACEHOLDERS), F.length("response")
    clarity_a = 5 - F.when(blank, 2).otherwise(0) - F.when(marked, 6).otherwise(0) - F.when((n < 15) | (n > 300), 1).otherwise(0)
    clarity_b = 3.0 + F.when(F.col("norm").contains("="), 1).otherwise(0) + F.when(X.has_any(F.col("norm"), ("valueerror", "exception")), 1).otherwise(0) + F.when(X.has_any(F.col("norm"), ("round", "2", "net")), 0.5).otherwise(0.0)
    clamp = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(5.0), x.cast("double")))
    rows = rows.select("file_id", "item_id", covered.alias("covered"), anchored.alias("anchored"), clamp(clarity_a).alias("clarity_a"), clamp(clarity_b).alias("clarity_b"))
    curve = F.array(*map(F.lit, COMPLETENESS))
    rows = rows.withColumn("completeness", F.get(curve, F.col("covered"))).withColumn("accuracy_a", F.bround(F.col("covered") * 5.0 / 6.0, 2)).withColumn("accuracy_b", F.bround(F.col("anchored") * 5.0 / 6.0, 2))
    overall = lambda e: F.bround((F.col(f"accuracy_{e}") + F.col("completeness") + F.col(f"clarity_{e}")) / 3.0, 4)
    return rows.withColumn("overall_a", overall("a")).withColumn("overall_b", overall("b"))


def _one(claims: DataFrame, e: str) -> DataFrame:
    return scored_claims(claims).select("file_id", "item_id", F.col(f"accuracy_{e}").alias("accuracy"), "completeness", F.col(f"clarity_{e}").alias("clarity"), F.col(f"overall_{e}").alias("overall"))


def evaluate_coverage(claims: DataFrame) -> DataFrame:
    return _one(claims, "a")


def evaluate_anchors(claims: DataFrame) -> DataFrame:
    return _one(claims, "b")


def evaluator_agreement(claims: DataFrame) -> DataFrame:
    s = scored_claims(claims)
    d = lambda x: F.bround(F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")), 4)
    return s.select("file_id", "item_id", d("overall").alias("overall_diff"), d("accuracy").alias("accuracy_diff"), d("clarity").alias("clarity_diff"), (F.abs(F.col("overall_a") - F.col("overall_b")) <= 1.0).alias("within_one"))


def quality_summary(claims: DataFrame) -> DataFrame:
    """One row: grounded share, mean scores of both evaluators, shares of exact and near agreement."""
    s = scored_claims(claims).join(claims.select("file_id", "item_id", ((F.col("line_start") > 0) & (F.col("line_start") <= F.col("line_end"))).alias("grounded")), ["file_id", "item_id"])
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 4)
    gap = F.abs(F.col("overall_a") - F.col("overall_b"))
    return s.agg(share(F.col("grounded")).alias("grounding_pct"), F.round(F.avg((F.col("accuracy_a") + F.col("accuracy_b")) / 2), 3).alias("accuracy"), F.round(F.avg("completeness"), 3).alias("completeness"),
                 F.round(F.avg((F.col("clarity_a") + F.col("clarity_b")) / 2), 3).alias("clarity"), share(gap == 0).alias("exact_pct"), share(gap <= 1.0).alias("within_one_pct"))
