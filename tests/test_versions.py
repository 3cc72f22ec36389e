"""Versioned tables and ingestion over several micro-batches."""

from __future__ import annotations

import pytest

from strataflow.sources.versions import VersionedTable
from strataflow.streaming import status


def rows_of(table, version=None):
    return sorted((r.k, r.x) for r in table.read(version).collect())


def test_commits_replace_delete_and_stay_readable(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k string, x int", "k")
    frame = lambda *rows: spark.createDataFrame(rows, "k string, x int")
    assert table.version() == 0 and rows_of(table) == []
    table.stage(0, frame(("a", 1), ("b", 2)))
    table.stage(0, frame(("a", 1), ("b", 3)))  # a repeated batch
    assert rows_of(table) == [] and table.staged() == [0]
    assert table.commit([0]) == 1 and rows_of(table) == [("a", 1), ("b", 3)] and table.staged() == []
    assert table.commit([0]) == 1  # committed already
    table.stage(1, frame(("a", 5)))
    table.stage(2, frame(("a", 6), ("c", 7)))
    assert table.commit([1, 2], replace=True) == 2 and rows_of(table) == [("a", 5), ("a", 6), ("b", 3), ("c", 7)]
    assert table.commit([], delete=frame(("b", 0), ("c", 0))) == 3 and rows_of(table) == [("a", 5), ("a", 6)]
    table.stage(3, frame(("b", 9)))
    assert table.commit([3]) == 4 and rows_of(table) == [("a", 5), ("a", 6), ("b", 9)]
    assert rows_of(table, 1) == [("a", 1), ("b", 3)] and rows_of(table, 2) == [("a", 5), ("a", 6), ("b", 3), ("c", 7)]
    assert table.compact() == 5 and rows_of(table) == [("a", 5), ("a", 6), ("b", 9)] and table.commit([3]) == 5


def test_a_killed_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k string, x int", "k")
    table.stage(0, spark.createDataFrame([("a", 1)], "k string, x int"))
    table.commit([0])
    table.stage(1, spark.createDataFrame([("a", 2)], "k string, x int"))

    def killed(commits):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.commit([1], replace=True)
    assert rows_of(table) == [("a", 1)] and table.staged() == [1]
    monkeypatch.undo()
    table.commit(table.staged(), replace=True)
    assert rows_of(table) == [("a", 2)]


def test_a_repository_in_three_micro_batches_keeps_all_files(spark, tmp_path):
    folder, out, schema = f"file://{tmp_path}/docs", f"file://{tmp_path}/facts", "doc_id bigint, source string, text string"
    for rows in ([(1, "a", "x\ny"), (2, "b", "z")], [(3, "a", "q")], [(4, "a", None), (5, None, "r")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert {(r.repository_id, r.file_count) for r in status.ingest_files(stream, out).collect()} == {("a", 3), ("b", 1), (None, 1)}
    assert {(r.repository_id, r.file_count) for r in status.ingest_files(stream, out).collect()} == {("a", 3), ("b", 1), (None, 1)}
