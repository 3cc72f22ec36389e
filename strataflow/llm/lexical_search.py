"""Ranked lexical search as dense blocked matrix products: items times vocabulary times documents.

Items are dealt into blocks by hash. A block's terms are its compact vocabulary, so that a document is only the
counts of those terms. Documents go by in tiles: for each tile of the vocabulary, the item weights (items x terms)
are multiplied with the document impacts (terms x documents) in float64. All entries are whole numbers, and a tile of the
vocabulary is so narrow that no sum of products in it can reach 2^53: each product is exact, and tiles are added as 64-bit
integers. Each task keeps the best k documents per item over all its tiles by (score down, doc_id up); a tile hands on
every document that ties with its k-th, so ties are decided by doc_id alone. Tasks' bests are merged in two steps.

Passes per block: one over the texts (counts of the block's terms, written), one over the counts for document
frequencies, one for the products. What tasks hold: one block's terms (about ``BLOCK_TERMS``), tiles of
``TILE`` x ``TILE`` doubles, and the scores of one tile for one block's items. What reaches the driver: one block's items.

Scoring: terms are the maximal runs of ASCII letters and digits and of all signs beyond ASCII, only A-Z lower-cased. N
counts the documents with a term, L all their terms, n a document's terms, df the documents that hold a term, tf its
occurrences; w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 100 - b + (b n N) div L with b = 90, and the score sums
w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, once each.

Defined cases: null and empty texts have no terms and never match; rows of one item_id are one item with the terms of all
of them (also for a null item_id); rows that repeat are documents of their own; a null doc_id comes after all others in a
tie; items without a match have no row; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches, release, stage

#: Every byte of a term, with A-Z lower-cased; all other bytes are blanks. Bytes from 0x80 make up the signs beyond ASCII.
_TERM_BYTES = bytes(b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256)).lower()
PIECE = 1 << 20  # bytes of a text that are split at once
TILE = 1024
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 16
FULL = 10**6  # no impact reaches it: 10^9 tf < 10^6 (1000 tf + 8 m)
COUNTS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in pieces cut at blanks."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct item_id, term."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in terms_of(text or b""):
                    found = list(set(piece))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(split, "item_id bigint, term binary").distinct()


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), and the counts of the vocabulary's terms by their place in it, per document."""
    packed = b" ".join(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(packed.split())}
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1):
                n, found = 0, []
                for piece in terms_of(text.as_py() or b""):
                    n += len(piece)
                    here = np.fromiter((p for p in map(place.get, piece) if p is not None), np.int32)
                    found.append(np.unique(here, return_counts=True))
                if len(found) > 1:
                    ids, at = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
                    found = [(ids, np.bincount(at, np.concatenate([c for _, c in found]), len(ids)).astype(np.int64))]
                ids, counts = found[0] if found else ((), ())
                sizes.append(n)
                terms.append(ids)
                tfs.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(count, COUNTS)


class Best:
    """The best k documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.id, self.null = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Take in a tile's scores (items x documents); all that tie with an item's k-th go on to the comparison of ids."""
        least = self.least
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, at = np.nonzero(scores >= least[:, None])
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[item, at]])
        doc, none = np.concatenate([self.id, ids[at]]), np.concatenate([self.null, null[at]])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, full = order[place < self.k], item[place < self.k], item[place == self.k - 1]
        self.item, self.score, self.id, self.null = item, score[order], doc[order], none[order]
        self.least[full] = self.score[np.searchsorted(item, full, "right") - 1]


def tile_scores(n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray, totals: tuple[int, int], items: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_items: int, width: int) -> np.ndarray:
    """Scores of a tile of documents for all items (items x documents), summed over the tiles of the vocabulary."""
    n_docs, n_words = totals
    m = np.array([10 + (90 * int(x) * n_docs) // n_words for x in n], np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    impact = (10**9 * tfs) // (1000 * tfs + 8 * m[doc])
    order = np.argsort(terms // width, kind="stable")
    doc, terms, impact = doc[order], terms[order], impact[order]
    ends = np.searchsorted(terms // width, np.arange(len(items) + 1))
    out = np.zeros((n_items, len(n)), np.int64)
    left, right = np.zeros((n_items, width)), np.zeros((width, len(n)))
    for t, (item, term, weight) in enumerate(items):
        here = slice(ends[t], ends[t + 1])
        if ends[t] == ends[t + 1]:
            continue
        left[item, term] = weight
        right[terms[here] - t * width, doc[here]] = impact[here]
        out += (left @ right).astype(np.int64)
        left[item, term] = 0
        right[terms[here] - t * width, doc[here]] = 0
    return out


def _ranked_block(docs: DataFrame, pairs: list, k: int) -> DataFrame:
    """item_id, doc_id, score: each task's best documents for one block of items."""
    vocabulary = sorted({bytes(r.term) for r in pairs})
    place = {t: i for i, t in enumerate(vocabulary)}
    item_ids = sorted({r.item_id for r in pairs}, key=lambda i: (i is None, i))
    item_place = {i: p for p, i in enumerate(item_ids)}
    counts = stage(term_counts(docs, vocabulary), "term-counts")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    df = {r.term: r["count"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    width = int(min(TILE, (2**53 - 1) // (FULL * max(1, int(weight.max())))))
    by_item = np.array([item_place[r.item_id] for r in pairs])
    by_term = np.array([place[bytes(r.term)] for r in pairs])
    tiles = []
    for lo in range(0, len(vocabulary), width):
        here = (by_term >= lo) & (by_term < lo + width)
        tiles.append((by_item[here], by_term[here] - lo, weight[by_term[here]].astype(np.float64)))
    totals = (total.docs, total.words)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(item_ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                tile = batch.slice(at, TILE)
                ids, lists = tile.column(0), tile.column(2)
                offsets = np.asarray(lists.offsets)
                terms, tfs = (np.asarray(tile.column(c).flatten()) for c in (2, 3))
                scores = tile_scores(np.asarray(tile.column(1)), offsets - offsets[0], terms, tfs, totals, tiles, len(item_ids), width)
                best.add(scores, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))
        yield pa.RecordBatch.from_arrays([pa.array([item_ids[i] for i in best.item], pa.int64()), pa.array(best.id, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], ["item_id", "doc_id", "score"])

    ranked = stage(counts.filter("size(terms) > 0").mapInArrow(rank, "item_id bigint, doc_id bigint, score bigint"), "ranked", done=(counts,))
    return ranked


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    pairs = stage(item_terms(items), "item-terms")
    total = pairs.agg(F.count_distinct(F.coalesce("item_id", F.lit(-1))).alias("items"), F.count(F.lit(1)).alias("pairs")).first()
    blocks = max(1, math.ceil(total["items"] / block_items), math.ceil(total["pairs"] / block_terms))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_ranked_block(docs, rows, k) for b in range(blocks) if (rows := dealt.filter(F.col("block") == b).collect())]
    release(pairs)
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    ranked = reduce(DataFrame.unionByName, found)
    first = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # Tasks' bests per item first by a share of the documents, then all: no task meets the bests of all tasks for a hot item.
    shares = W.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*first)
    near = ranked.withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*first))).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT d, doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS raw FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
tf AS (SELECT d, any_value(doc_id) AS doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf FROM t GROUP BY d, 3),
size AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
q AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT item_id, d, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN size USING (d), total GROUP BY item_id, d)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
