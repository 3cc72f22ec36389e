"""Streams in several batches, replayed and restarted."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from strataflow.streaming import status

DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Appends rows (analysis_id, event_id, hours, kind) as a file and gives the stream over all files."""
    folder = tmp_path / "events"
    folder.mkdir()

    def put(*rows):
        at = [(a, e, DAY + datetime.timedelta(hours=h), k) for a, e, h, k in rows]
        spark.createDataFrame(at, "analysis_id bigint, event_id bigint, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"file://{folder}")
        return spark.readStream.schema("analysis_id bigint, event_id bigint, ts timestamp, kind string").parquet(f"file://{folder}")

    return put


def test_guard_over_batches_replays_and_restarts(feed, tmp_path):
    out = f"file://{tmp_path}/guard"
    judged = lambda stream: {(r.analysis_id, r.event_id): r.accepted for r in status.duplicate_guard(stream, out).collect()}
    assert judged(feed((1, 1, 0, "start"), (1, 2, 1, "start"), (2, 3, 0, "start"), (2, 4, 1, "end"), (2, 5, 2, "start"), (3, 6, 0, "progress"))) == {(1, 1): True, (1, 2): False, (2, 3): True, (2, 5): True}
    # the job starts anew from its checkpoint: what was open still is, and redelivered events count once
    got = judged(feed((1, 2, 1, "start"), (1, 7, 3, "start"), (2, 8, 4, "end"), (2, 9, 5, "start"), (3, 10, 6, "start")))
    assert got == {(1, 1): True, (1, 2): False, (2, 3): True, (2, 5): True, (1, 7): False, (2, 9): True, (3, 10): True}
    assert judged(feed((9, 90, 7, "end"))) == got


def test_guard_forgets_keys_without_events(feed, tmp_path):
    out = f"file://{tmp_path}/guard"
    judged = lambda stream: {r.event_id: r.accepted for r in status.duplicate_guard(stream, out, keep_days=2).collect()}
    assert judged(feed((1, 1, 0, "start"))) == {1: True}
    assert judged(feed((2, 2, 24 * 9, "start"))) == {1: True, 2: True}
    assert judged(feed((1, 3, 24 * 10, "start"))) == {1: True, 2: True, 3: True}


def test_latest_stage_over_batches(spark, feed, tmp_path):
    out = f"file://{tmp_path}/stages"
    latest = lambda stream: {(r.analysis_id, r.stage): r.state for r in status.stage_status(stream.withColumn("stage", F.lit("index")).withColumnRenamed("kind", "state"), out).collect()}
    assert latest(feed((1, 1, 5, "done"), (2, 2, 1, "running"))) == {(1, "index"): "done", (2, "index"): "running"}
    # an older event that comes late changes nothing
    assert latest(feed((1, 3, 4, "error"), (2, 4, 2, "done"))) == {(1, "index"): "done", (2, "index"): "done"}
    assert latest(feed((3, 5, 0, "running"))) == {(1, "index"): "done", (2, "index"): "done", (3, "index"): "running"}
    # each micro-batch wrote only the keys it changed
    written = [spark.read.parquet(f"file://{p}").count() for p in sorted((tmp_path / "stages" / "staged").iterdir())]
    assert written[-1] == 1 and len(written) == 3


def test_ingestion_replaces_a_repository(spark, tmp_path):
    folder, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/facts"
    schema = "doc_id bigint, source string, text string"

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return {(r.repository_id, r.file_count, r.loc) for r in status.ingest_files(spark.readStream.schema(schema).parquet(folder), out).collect()}

    assert put((1, "a", "x\ny"), (2, "b", "z")) == {("a", 1, 2), ("b", 1, 1)}
    assert put((3, "a", "q"), (4, "a", "r")) == {("a", 2, 2), ("b", 1, 1)}


def test_many_batches_are_compacted(spark, feed, tmp_path, monkeypatch):
    monkeypatch.setattr(status, "COMPACT", 2)
    out = f"file://{tmp_path}/runs"
    runs = lambda stream: {r.repository_id: (r.run_id, r.status) for r in status.latest_runs(stream.select(F.col("analysis_id").cast("string").alias("repository_id"), F.col("event_id").cast("string").alias("run_id"), F.col("kind").alias("status"), "event_id", "ts"), out).collect()}
    want = {}
    for i in range(5):
        want[str(i % 3)] = (str(10 + i), f"s{i}")
        assert runs(feed((i % 3, 10 + i, i, f"s{i}"))) == want


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    """A table is one file or a folder of files; a stream of a folder read nothing before."""
    from strataflow.plans.queries import QUERIES

    docs = spark.createDataFrame([(1, "a\nb", "en", "s", 3), (2, "c", "en", "s", 1), (3, "d", "en", "t", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["stream_ingest_files"](spark, str(tmp_path)).collect()} == {("s", 2, 3), ("t", 1, 1)}
