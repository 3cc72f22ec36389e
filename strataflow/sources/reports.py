"""Test reports, coverage reports and logs as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = "struct<_message: string, _type: string, _VALUE: string>"
_CASE = f"struct<_name: string, _time: string, failure: array<{_MARK}>, error: array<{_MARK}>>"
JACOCO = """counter array<struct<_type: string, _missed: double, _covered: double>>,
  package array<struct<_name: string, sourcefile: array<struct<_name: string, line: array<struct<_nr: int, _mi: int>>>>>>"""


def junit_schema(nesting: int) -> str:
    """A root that holds suites, ``nesting`` of them inside each other, and groups of suites."""
    suite = f"struct<_tests: string, testcase: array<{_CASE}>>"
    for _ in range(nesting - 1):
        suite = f"struct<_tests: string, testcase: array<{_CASE}>, testsuite: array<{suite}>>"
    return f"testsuite array<{suite}>, testsuites array<struct<testsuite: array<{suite}>>>"


def _xml(report: str) -> F.Column:
    """The documents of a text, without declarations, under one root."""
    return F.concat(F.lit("<root>"), F.regexp_replace(F.coalesce(report, F.lit("")), r"<\?xml[^>]*\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", ""), F.lit("</root>"))


def parse_test_report(reports: DataFrame, nesting: int = 4) -> DataFrame:
    """Cases of JUnit texts (run_id, report): name, status (failure or error: failed), duration in ms, and the number of tests that the suites declare (of cases where none is declared).

    A report is any number of documents with ``<testsuites>`` or ``<testsuite>`` roots, suites inside each other up to ``nesting`` deep; a suite
    whose number of tests is no number is left out. A report without cases, or one that is no XML, has one row without name.
    """
    x = reports.select("run_id", F.from_xml(_xml("report"), junit_schema(nesting)).alias("x"))
    empty = lambda c: F.coalesce(c, F.array())
    level = F.concat(empty(F.col("x.testsuite")), empty(F.flatten(F.transform("x.testsuites", lambda g: empty(g["testsuite"])))))
    rows, found = x.select("run_id", level.alias("suites")), []
    for depth in range(nesting):
        found.append(rows.select("run_id", F.explode("suites").alias("s")).select("run_id", F.coalesce("s._tests", F.lit("0")).try_cast("bigint").alias("tests"), F.col("s.testcase").alias("cases")))
        if depth + 1 < nesting:
            rows = rows.select("run_id", F.flatten(F.transform("suites", lambda s: empty(s["testsuite"]))).alias("suites"))
    suites = reduce(DataFrame.unionByName, found).filter("tests IS NOT NULL")
    sums = suites.groupBy("run_id").agg(F.sum("tests").alias("declared"), F.sum(F.greatest(F.size("cases"), F.lit(0))).alias("cases_found"))
    cases = suites.select("run_id", F.explode("cases").alias("c"))
    ms = F.bround(F.coalesce(F.coalesce("c._time", F.lit("0")).try_cast("double"), F.lit(0.0)) * 1000).cast("bigint")
    failed = (F.size("c.failure") > 0) | (F.size("c.error") > 0)
    cases = cases.select("run_id", F.coalesce("c._name", F.lit("unknown")).alias("name"), F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise("passed").alias("status"), ms.alias("duration_ms"))
    generated = F.when(F.col("declared") > 0, F.col("declared")).otherwise(F.coalesce("cases_found", F.lit(0))).cast("bigint")
    return reports.select("run_id").distinct().join(sums, "run_id", "left").join(cases, "run_id", "left").select("run_id", generated.alias("generated"), "name", "status", "duration_ms")


def read_test_cases(spark: SparkSession, path: str) -> DataFrame:
    """(report, name, status, duration_ms) of all cases of JUnit files, by Spark's XML source: a large file is split between its cases, at any nesting."""
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(f"_name string, _time string, failure array<{_MARK}>, error array<{_MARK}>").load(path)
    failed = (F.size("failure") > 0) | (F.size("error") > 0)
    ms = F.bround(F.coalesce(F.col("_time").try_cast("double"), F.lit(0.0)) * 1000).cast("bigint")
    return rows.select(F.input_file_name().alias("report"), F.coalesce("_name", F.lit("unknown")).alias("name"), F.when(F.coalesce(failed, F.lit(False)), "failed").otherwise("passed").alias("status"), ms.alias("duration_ms"))


def parse_coverage_json(reports: DataFrame) -> DataFrame:
    """(run_id, line_coverage, branch_coverage, file, line) of coverage JSON: a row per missing line, one without line for a file that misses none, one without file for a run without files."""
    j = F.from_json("report", "totals struct<percent_covered: double, percent_branches_covered: double>, files map<string, struct<missing_lines: array<int>>>")
    files = reports.select("run_id", j.alias("j")).select("run_id", *(F.bround(F.coalesce(f"j.totals.{a}", F.lit(0.0)), 2).alias(b) for a, b in (("percent_covered", "line_coverage"), ("percent_branches_covered", "branch_coverage"))), F.explode_outer("j.files").alias("file", "f"))
    return files.select("run_id", "line_coverage", "branch_coverage", "file", F.explode_outer("f.missing_lines").alias("line"))


def parse_jacoco_xml(reports: DataFrame) -> DataFrame:
    """(run_id, line_coverage, branch_coverage, file, line) of JaCoCo texts: percentages of the report's own counters (100 for nothing to cover or no counter), a row per line with missed instructions.

    A report that misses no line, or is no XML, has one row without file and line.
    """
    bare = F.regexp_replace(F.coalesce("report", F.lit("")), r"<\?xml[^>]*\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "")
    x = reports.select("run_id", F.from_xml(bare, JACOCO).alias("x"))
    one = lambda kind: F.element_at(F.filter("x.counter", lambda c: c["_type"] == kind), -1)
    last = lambda kind: F.when(F.size(F.filter("x.counter", lambda c: c["_type"] == kind)) > 0, one(kind))
    pct = lambda c: F.when(F.coalesce(c["_missed"] + c["_covered"], F.lit(0.0)) == 0, 100.0).otherwise(F.bround(100.0 * c["_covered"] / (c["_missed"] + c["_covered"]), 2))
    missed = x.select("run_id", F.explode("x.package").alias("p")).select("run_id", F.explode("p.sourcefile").alias("f")).select("run_id", F.col("f._name").alias("file"), F.explode("f.line").alias("n"))
    missed = missed.filter("n._mi > 0").select("run_id", "file", F.col("n._nr").alias("line"))
    totals = x.select("run_id", pct(last("LINE")).alias("line_coverage"), pct(last("BRANCH")).alias("branch_coverage"))
    return totals.join(missed, "run_id", "left").select("run_id", "line_coverage", "branch_coverage", "file", "line")


def coverage_from_log(logs: DataFrame) -> DataFrame:
    """Coverage of the last line of a log that is JSON once colours are removed; null for a log without one."""
    lines = logs.select("run_id", F.posexplode(F.split("log", "\n")).alias("i", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "\u001b\\[[0-9;]*m", "")))
    good = lines.filter(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull())
    last = good.groupBy("run_id").agg(F.max_by("line", "i").alias("line"))
    return logs.select("run_id").distinct().join(last, "run_id", "left").select("run_id", F.get_json_object("line", "$.line_coverage").cast("double").alias("line_coverage"))


def uncovered_lines_by_file(coverage: DataFrame) -> DataFrame:
    return coverage.filter("line IS NOT NULL").groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("line")), ",").alias("lines"))
