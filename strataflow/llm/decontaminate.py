"""Benchmark decontamination: a size-partitioned MinHash containment search with exact verification.

An item is contained in a document when at least ``percent`` per cent of the item's distinct k-word
shingles occur in the document, however long that is.

1. Items are partitioned by size (powers of two of their shingle count). An item's sketch is its bottom-s
   MinHash: its s least fingerprints, with s fixed by the partition's largest size. At most so many of them
   can be missing as a contained item may lack, so an item's ``need`` is the number of sketch values that its
   documents must have; it is one at least: the search loses nothing.
2. Each partition has two bitmaps, of its sketches and of all its shingles, built by an aggregation. A document is
   searched partition by partition: it goes on only with those whose least ``need`` its shingles meet in the sketch
   bitmap, and sends its shingles that pass the other one.
3. A shuffle join on (partition, fingerprint) counts sketch values and shingles by document and item: items
   below their ``need`` are no candidates, the others are verified by exact shingle containment.

A bitmap has about 16 bits per shingle of its partition, and ``MOST_BITS`` (8 MB) at most: with more items it only lets
more through to the join.

Defined cases: null or wordless texts match nothing; fewer than k words are one shingle, the whole
sequence; repeated rows with one ``doc_id`` are one document; rows without ``doc_id`` are told apart by their text; repeated
items with one ``item_id`` are one item, items without it are ignored; empty tables give empty results; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import NO_ID, bound_batches, fresh_name, lean, stage, text_of
from strataflow.llm.shingles import WordHashes, shingle_set, shingle_stream

MOST_BITS = 26  # of a bitmap's address
ITEM_ROWS = "item_id bigint, part int, h bigint, n_item bigint, need bigint, in_sketch boolean"


def sketch_size(n: int, percent: int) -> int:
    """Fingerprints in the sketch of an item of ``n`` shingles: enough for the largest item of its partition."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest * (100 - percent) // 100 + 1)


def sketch_need(n: int, percent: int) -> int:
    """Sketch values that a document must have if it contains ``percent`` per cent of an item of ``n`` shingles."""
    return sketch_size(n, percent) - n * (100 - percent) // 100


def item_rows(items: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per item and distinct shingle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            for item_id, text in zip(part["item_id"], part["text"], strict=True):
                s = shingle_set(text, k, hashes)
                if len(s):
                    first = np.arange(len(s)) < sketch_size(len(s), percent)
                    yield pd.DataFrame({"item_id": item_id, "part": len(s).bit_length(), "h": s.view(np.int64), "n_item": len(s), "need": sketch_need(len(s), percent), "in_sketch": first})

    return items.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text")).filter("item_id IS NOT NULL").mapInPandas(run, ITEM_ROWS)


def bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the low bits of column h, sized for ``n`` of them; its cells reach the driver in pieces of 4 KB."""
    bits = min(max((16 * n).bit_length(), 15), MOST_BITS)
    cell = F.col("h").bitwiseAND((1 << bits) - 1) + 1
    rows = (hashes.groupBy(F.bitmap_bucket_number(cell).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect())
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        start = (row.bucket - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def meets(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """Which fingerprints a bitmap lets through."""
    cell = (fingerprints & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[cell >> 3] & np.left_shift(1, cell & 7)) > 0


def size_partitions(known: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(part, least need, sketch bitmap, bitmap) of each size partition; there are as many as an item's size has bits."""
    sizes = known.groupBy("part").agg(F.min("need").alias("need"), F.count(F.lit(1)).alias("n"), F.sum(F.col("in_sketch").cast("bigint")).alias("n_sketch")).orderBy("part").collect()
    return [(r.part, r.need, bitmap(known.filter((F.col("part") == r.part) & F.col("in_sketch")).select("h"), r.n_sketch), bitmap(known.filter(F.col("part") == r.part).select("h"), r.n)) for r in sizes]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (``NO_ID`` where it is missing), text_hash (0 where it is not) and text."""
    text, doc_id = text_of(), F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(0).alias("text_hash"), text.alias("text"))


def _contained(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    known = stage(item_rows(items, k, percent).distinct(), "items")
    # most shingles of a document are in no item: one bitmap of all ends them before the partitions are searched
    searched = docs.sparkSession.sparkContext.broadcast((bitmap(known.select("h"), known.count()), size_partitions(known)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, (anywhere, partitions) = WordHashes(), searched.value
        for rows in parts:
            out = []
            for doc_id, text_hash, text in zip(rows["doc_id"], rows["text_hash"], rows["text"], strict=True):
                s = shingle_stream(text, k, hashes)
                s = s[meets(anywhere, s)]
                for part, need, sketch, every in partitions if len(s) else ():
                    of_part = s[meets(every, s)]
                    if len(of_part) and len(np.unique(of_part[meets(sketch, of_part)])) >= need:
                        out.append((doc_id, text_hash, part, np.unique(of_part).view(np.int64)))
            if out:
                ids, texts, of, found = zip(*out, strict=True)
                n = [len(x) for x in found]
                yield pd.DataFrame({"doc_id": np.repeat(ids, n), "text_hash": np.repeat(texts, n), "part": np.repeat(of, n), "h": np.concatenate(found)})

    hits = keyed(docs).mapInPandas(lean(run), "doc_id bigint, text_hash bigint, part int, h bigint").join(known, ["part", "h"])
    in_sketch = F.count_distinct(F.when(F.col("in_sketch"), F.col("h")))
    return (hits.groupBy("doc_id", "text_hash", "item_id", "n_item", "need").agg(in_sketch.alias("met"), F.count_distinct("h").alias("n_common"))
            .filter((F.col("met") >= F.col("need")) & (F.col("n_common") * 100 >= F.col("n_item") * percent)))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_common, containment) of items contained in documents."""
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return _contained(docs, items, k, percent).select(doc_id, "item_id", "n_item", "n_common", F.round(F.col("n_common") / F.col("n_item"), 4).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item, with all columns of ``docs``."""
    key, text_key = fresh_name(docs, "leak_key"), fresh_name(docs, "leak_text")
    leaks = stage(_contained(docs, items, k, percent).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key)).distinct(), "leaks")
    doc_id = docs["doc_id"].cast("bigint")
    same = (F.coalesce(doc_id, F.lit(NO_ID)) == leaks[key]) & (F.when(doc_id.isNull(), F.xxhash64(text_of(docs["text"]))).otherwise(0) == leaks[text_key])
    return docs.join(leaks, same, "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contained_items(read("documents"), read("benchmark"))


OP6_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts),
starts AS (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT kind, id, array_to_string(w[p:p + 4], ' ') AS g FROM starts),
sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_common, round(count(*) / any_value(n_item), 4) AS containment
FROM shingles d JOIN shingles i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.item_id = i.id
GROUP BY d.id, i.id HAVING count(*) * 100 >= any_value(n_item) * 80
"""
