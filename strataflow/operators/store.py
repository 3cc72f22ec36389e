"""Tables in the folder that driver and executors share: lineage cuts and stored intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``, removed when the driver ends; only a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="strataflow-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; nothing happens once the session has ended."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        return


def sorted_join(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is sorted and merged.

    Texts that expressions make, and rows of well packed tables, are estimated far below their size; broadcast, they would fill the driver.
    """
    return rows.hint("merge")


def cut(df: DataFrame, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The same rows from a table in the shared folder, so that lineage ends there. ``done`` are cut frames that nothing reads any more: they go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    for old in done:
        if where := getattr(old, "cut_at", None):
            remove(spark, where)
    return out
