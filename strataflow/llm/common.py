"""Helpers shared by the training-data operators: the shared folder, lineage cuts, words and shingles."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule in this subpackage (ASCII only), as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: The smallest bigint; stands for a null id where ids are join keys.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may lack that setting; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataflow-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        return


def stage(df: DataFrame, name: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The same rows written once as Parquet in the shared folder and read again (columnar, compressed).

    ``done`` are staged frames that nothing reads any more once these rows are written: their files go.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    release(*done)
    return out


def release(*staged: DataFrame) -> None:
    """Remove the files of staged frames whose readers have all been written."""
    for df in staged:
        if path := getattr(df, "staged_at", None):
            _remove(df.sparkSession, path)


#: Arrow batches of a session whose sizes are Spark's own: a worker holds a batch several times over, as Arrow, as objects and in results.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def bound_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches small; sizes that its owner has set stay."""
    for key, (default, small) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)


def lean(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for ``mapInPandas``, after which the worker hands back to the system what ``run`` has freed: workers live on, through other stages."""

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return whole


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
