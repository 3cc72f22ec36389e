"""Exact deduplication through a persistent digest index.

The index is a table with one row per distinct normalised text, bucketed and sorted by its SHA-256, so
that each new batch meets it in a sort-merge anti-join without moving the index; what is new is appended.
Texts of a later batch that the index knows are appended to a second table (digest, best row, count); readers
reduce both by digest, so the row that stays and the size of a group are exact over all batches so far.
A batch that is given twice counts twice.

Defined cases: null text counts as empty; texts are equal when identical after deleting the ASCII white
space ``[\\x20\\x09-\\x0D]``; of equal texts the longest original (in code points), then the smallest
``doc_id`` (null first), stays, as one row: repeated rows with one ``doc_id`` and text count as copies of each other;
an empty table gives an empty result; extra columns are ignored by ``dedup_groups`` and kept by
``drop_copies``. ``drop_copies`` passes a text on once: what an earlier batch passed on does not pass again, even if a
later copy is longer.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import NO_ID, SPACE, fresh_name, scratch_path, stage, text_of

INDEX_SCHEMA = "digest binary, keep_id bigint, n_chars int, group_size bigint"


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 (32 bytes) of the text without its white space, in UTF-8."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), f"{SPACE}+", ""), 256))


class DigestIndex:
    """A bucketed table of the digests seen so far.

    ``buckets`` fixes the width of the anti-join; choose it so that a bucket of the index fits an
    executor's memory when sorted (about 100 million rows of 60 bytes in 4096 buckets is 1.5 MB each).
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "digest-index")
        if not table:
            atexit.register(self._forget)
        for name, where in self._tables():
            if not spark.catalog.tableExists(name):
                self._write(spark.createDataFrame([], INDEX_SCHEMA), name, where)

    def _tables(self) -> tuple[tuple[str, str], tuple[str, str]]:
        return (self.table, self.path), (f"{self.table}_more", f"{self.path}-more")

    def _forget(self) -> None:
        try:
            for name, _ in self._tables():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM may be gone already
            return

    def _write(self, rows: DataFrame, table: str, path: str) -> None:
        (rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", path).mode("append").saveAsTable(table))

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (distinct digests) that the index lacks: a sort-merge anti-join on the buckets."""
        known = self.spark.table(self.table).select("digest").hint("merge")
        return batch.join(known, "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Add a staged batch of distinct digests: what is new to the index, the rest to its second table."""
        (table, path), (more, more_path) = self._tables()
        if not self.spark.table(table).isEmpty():
            known = self.spark.table(table).select("digest").hint("merge")
            self._write(batch.join(known, "digest", "left_semi").repartition(self.buckets, "digest"), more, more_path)
        self._write(self.unseen(batch).repartition(self.buckets, "digest"), table, path)

    def rows(self) -> DataFrame:
        """One row per digest, as plain files: a join with a hot digest may then be dealt anew by adaptive execution."""
        first, more = (self.spark.read.schema(INDEX_SCHEMA).parquet(path) for _, path in self._tables())
        if more.isEmpty():
            return first
        return stage(reduced(first.unionByName(more)), "digest-index-now")


def reduced(rows: DataFrame) -> DataFrame:
    """One row per digest of index rows from several batches: the best row and the size of the whole group."""
    best = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("keep_id")))
    return (rows.groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
            .select("digest", "best.keep_id", (-F.col("best.longest")).alias("n_chars"), "group_size"))


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_chars (code points) and a number of its own of every row; the only pass over the texts. Stage it: the numbers are not drawn twice alike."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest().alias("digest"), F.length(text_of()).alias("n_chars"), F.monotonically_increasing_id().alias("row"))


def digest_batch(digested: DataFrame) -> DataFrame:
    """One row per digest with the row that stays; hot digests are summed before the shuffle."""
    best = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id"), F.col("row")))
    return (digested.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.longest")).alias("n_chars"), "group_size", F.col("best.row").alias("row")))


def buckets_for(rows: int) -> int:
    """Buckets of an index of so many rows: about two million each, which sort within a task."""
    return max(32, -(-rows // 2_000_000))


def dedup_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256; groups count all batches that ``index`` has seen.

    One row of a group is kept at most: the best of this batch, unless an earlier batch has a better one.
    """
    digested = stage(digest_rows(docs), "digests")
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(digested.count()))
    before = index.rows()
    before = None if before.isEmpty() else stage(before.select("digest", F.struct((-F.col("n_chars")).alias("longest"), F.col("keep_id")).alias("old")), "digest-index-before")
    batch = stage(digest_batch(digested), "digest-batch")
    index.append(batch.drop("row"))
    found = index.rows().select("digest", "keep_id", "group_size").join(batch.select("digest", "row", F.struct((-F.col("n_chars")).alias("longest"), F.col("keep_id")).alias("new")).hint("merge"), "digest")
    best = F.lit(True)
    if before is not None:
        found, best = found.join(before.hint("merge"), "digest", "left"), F.col("old").isNull() | (F.col("new") <= F.col("old"))
    found = found.select("digest", "keep_id", "group_size", F.when(best, F.col("row")).alias("kept_row"))
    return digested.join(found.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows that stay, one per distinct text, with all columns of ``docs``."""
    digested = stage(digest_rows(docs), "digests")
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(digested.count()))
    batch = stage(digest_batch(digested).drop("row"), "digest-batch", done=(digested,))
    fresh = stage(index.unseen(batch), "fresh-digests")
    index.append(batch)
    key_id, key_digest, key_size = (fresh_name(docs, f"dedup_{c}") for c in ("key", "digest", "size"))
    keys = [key_id, key_digest, key_size]
    stays = fresh.select(F.coalesce("keep_id", F.lit(NO_ID)).alias(key_id), F.col("digest").alias(key_digest), F.col("n_chars").alias(key_size))
    keyed = docs.withColumns({key_id: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), key_digest: text_digest(), key_size: F.length(text_of())})
    return keyed.join(stays, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
