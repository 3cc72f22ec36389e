"""Structured Streaming jobs; each has a batch twin with equal rows.

Streams are read from files and run until what is there is processed (``availableNow``); results go to a
table folder, so a restart continues from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from strataflow.functions.paths import line_count
from strataflow.sources.versions import VersionedTable


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder as a stream; the table is one file or a folder of files."""
    at = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    stream = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(at)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _run(stream: DataFrame, out: str) -> DataFrame:
    """Run to the end of what is there, from the checkpoint beside ``out`` if there is one; the rows of all micro-batches.

    Each micro-batch writes a folder of its own, named by its epoch, so a repeated epoch replaces what it wrote before.
    """
    spark = stream.sparkSession
    query = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
             .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start())
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", IntegerType())])).parquet(out).select(*stream.columns)


#: Versions after which the live rows are written as one folder.
COMPACT = 20


def _upsert(stream: DataFrame, out: str, key: list[str]) -> DataFrame:
    """Run a keyed aggregation in update mode: each micro-batch writes only the keys it changed, as one commit that replaces their older rows.

    The commit bears the batch's number, so a repeated batch changes nothing; a killed one leaves the version before it.
    """
    spark, columns = stream.sparkSession, stream.columns
    keyed = stream.withColumn("_row_key", F.to_json(F.struct(*key)))
    table = VersionedTable(spark, out, keyed.schema, "_row_key")

    def write(batch: DataFrame, epoch: int) -> None:
        table.stage(epoch, batch)
        if table.commit([epoch], replace=True) % COMPACT == 0:
            table.compact()

    query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return table.read().select(*columns)


def stage_status(stages: DataFrame, out: str) -> DataFrame:
    """Latest state per (analysis, stage), kept up to date by a stateful aggregation."""
    latest = stages.groupBy("analysis_id", "stage").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return _upsert(latest, out, ["analysis_id", "stage"])


def latest_runs(cases: DataFrame, out: str) -> DataFrame:
    """Newest case per repository: its run, name and status."""
    latest = cases.groupBy("repository_id").agg(F.max(F.struct("ts", "event_id", "run_id", "status")).alias("b"))
    return _upsert(latest.select("repository_id", F.col("b.run_id").alias("run_id"), F.col("b.event_id").alias("event_id"), F.col("b.status").alias("status")), out, ["repository_id"])


def _guard(keep_ms: int):
    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_, latest = state.get if state.exists else (False, 0)
        rows = pd.concat(list(parts), ignore_index=True).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["kind"], strict=True):
            if kind == "start":
                out.append((int(key[0]), int(event_id), not open_))
                open_ = True
            elif kind == "end":
                open_ = False
        latest = max(latest, int(rows["ts"].max().timestamp() * 1000))
        state.update((open_, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=["analysis_id", "event_id", "accepted"])

    return judge


def duplicate_guard(events: DataFrame, out: str, delay: str = "1 day", keep_days: int = 30) -> DataFrame:
    """Starts of each key with whether no accepted start was still open; done and failed reopen the key.

    Input: analysis_id, event_id, ts, kind (start, end or anything else, which changes nothing). Redelivered events are
    dropped within ``delay``. Events are judged in order of time within a micro-batch; a key that saw none for
    ``keep_days`` is forgotten. A key's events of one micro-batch are held at once: bound it by the source's
    ``maxFilesPerTrigger``.
    """
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    judged = once.groupBy("analysis_id").applyInPandasWithState(_guard(keep_days * 86_400_000), "analysis_id bigint, event_id bigint, accepted boolean", "open boolean, latest bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return _run(judged, out)


FACTS = "repository_id string, file_id bigint, loc bigint, sha256 string"


def ingest_files(documents: DataFrame, out: str) -> DataFrame:
    """New files replace their repository's facts; totals per repository.

    Micro-batches are staged by their number; when the stream has come to its end, all that is staged becomes one version, so a
    repository whose files come in several micro-batches is replaced once, by all of them. A run that is killed leaves the old version; the
    next one commits what both have staged.
    """
    facts = documents.select(F.col("source").alias("repository_id"), F.col("doc_id").cast("bigint").alias("file_id"), line_count().cast("bigint").alias("loc"), F.sha2("text", 256).alias("sha256"))
    table = VersionedTable(documents.sparkSession, out, FACTS, "repository_id")
    query = (facts.writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
             .foreachBatch(lambda batch, epoch: table.stage(epoch, batch)).start())
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    table.commit(table.staged(), replace=True)
    return table.read().groupBy("repository_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("loc").alias("loc"))
