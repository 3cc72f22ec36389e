"""Reports as test runners write them, and addresses of clone URLs."""

from __future__ import annotations

from strataflow.sources import files, reports


def test_reports_with_groups_several_suites_and_nesting(spark, tmp_path):
    one = '<?xml version="1.0" encoding="utf-8"?><testsuites name="t"><testsuite tests="2"><testcase classname="c" name="a" time="0.5"/><testcase name="b" time="x"><failure message="m">t</failure></testcase></testsuite><testsuite tests="1"><testcase><error/></testcase></testsuite></testsuites>'
    nested = '<testsuite tests="1"><testcase name="o"/><testsuite tests="2"><testcase name="i"><failure/></testcase><testsuite tests="0"><testcase name="d" time="1"/></testsuite></testsuite></testsuite>'
    two = '<?xml version="1.0"?><testsuite tests="1"><testcase name="p"/></testsuite>\n<?xml version="1.0"?><testsuite tests="4"><testcase name="q"><skipped/></testcase></testsuite>'
    rows = [("a", one), ("b", nested), ("c", two), ("d", "no xml <"), ("e", None), ("f", '<testsuite tests="many"><testcase name="x"/></testsuite>'), ("g", "<testsuites/>"), ("h", '<testsuite><testcase name="x"/></testsuite>')]
    got = {(r.run_id, r.generated, r.name, r.status, r.duration_ms) for r in reports.parse_test_report(spark.createDataFrame(rows, "run_id string, report string")).collect()}
    assert got == {("a", 3, "a", "passed", 500), ("a", 3, "b", "failed", 0), ("a", 3, "unknown", "failed", 0), ("b", 3, "o", "passed", 0), ("b", 3, "i", "failed", 0), ("b", 3, "d", "passed", 1000), ("c", 5, "p", "passed", 0), ("c", 5, "q", "passed", 0),
                   ("d", 0, None, None, None), ("e", 0, None, None, None), ("f", 0, None, None, None), ("g", 0, None, None, None), ("h", 1, "x", "passed", 0)}
    (tmp_path / "r.xml").write_text(nested)
    assert {(r.name, r.status, r.duration_ms) for r in reports.read_test_cases(spark, f"file://{tmp_path}/r.xml").collect()} == {("o", "passed", 0), ("i", "failed", 0), ("d", "passed", 1000)}


def test_coverage_by_source_file_and_without_counters(spark):
    full = ('<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//X//DTD" "report.dtd"><report name="x"><sessioninfo id="s"/><package name="p"><class name="p/A"><counter type="LINE" missed="7" covered="0"/></class>'
            '<sourcefile name="A.java"><line nr="3" mi="2" ci="0"/><line nr="4" mi="0" ci="1"/></sourcefile><sourcefile name="B.java"><line nr="3" mi="1"/></sourcefile></package>'
            '<package name="q"><sourcefile name="C.java"/></package><counter type="LINE" missed="1" covered="2"/><counter type="BRANCH" missed="3" covered="1"/></report>')
    rows = [("a", full), ("b", '<report><counter type="LINE" missed="0" covered="5"/></report>'), ("c", "<report/>"), ("d", "oops")]
    got = {tuple(r) for r in reports.parse_jacoco_xml(spark.createDataFrame(rows, "run_id string, report string")).collect()}
    assert got == {("a", 66.67, 25.0, "A.java", 3), ("a", 66.67, 25.0, "B.java", 3), ("b", 100.0, 100.0, None, None), ("c", 100.0, 100.0, None, None), ("d", 100.0, 100.0, None, None)}


def test_addresses_outside_of_public_use(spark):
    closed = ["http://[::1]/x", "http://[fd00::1]:80/", "http://198.18.0.1/", "http://192.0.2.7/", "http://10.1.2.3", "http://127.9.9.9/", "http://169.254.1.1", "http://172.31.0.1", "http://192.0.0.5", "http://198.51.100.1", "http://203.0.113.9", "http://239.1.1.1", "http://255.255.255.255",
              "http://[fe80::1]/", "http://[ff02::1]/", "http://[2001:db8::1]/", "http://[::ffff:10.0.0.1]/", "http://[2002::1]/", "http://[3fff:fff::]/", "http://user:pw@10.0.0.1/", "http://999.1.1.1/", "http://[::]/"]
    other = {"http://8.8.8.8/a": "ok", "https://[2606:4700::1111]/a": "ok", "http://172.32.0.1": "ok", "http://192.0.1.1": "ok", "https://x.example/y": "ok", "http://localhost:1/": "host", "http://a.local/": "host", "ftp://x/": "scheme", "": "empty", "http:///x": "host", "http://[2001:4860:4860::8888]/": "ok"}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*closed, *other])], "page_id bigint, url string")
    got = {r.page_id: (r.verdict, r.reason) for r in files.url_admission(rows).collect()}
    for i, url in enumerate(closed):
        assert got[i][0] == "reject", url
    assert {u: got[len(closed) + i][1] for i, u in enumerate(other)} == other
