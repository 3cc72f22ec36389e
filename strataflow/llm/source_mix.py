"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

1. Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share
   ``volume`` times all words; a target stops at ``cap`` times its source's size and the excess is shared
   again by weight (closed form: sources sorted by size/weight, the capped ones are a prefix).
2. Stream: each source's documents lie in shuffled (hashed) order on a line of words; the line repeats
   after its end, and is cut into blocks of ``block_words``.
3. Schedule: point ``k * golden mod 2**31`` of slot ``k`` falls into the cumulative target weights and so
   picks a source; the rank of the slot within its source names the block that it takes. Blocks that the
   schedule ranks do not reach are appended after its end, so each source gives floor(target) words.

Prefix sums and ranks are made in two levels (hash ranges, then rows; slot chunks, then slots), so no
source, however large, is gathered in one task.

Defined cases: null text has size 0; null source is one source, last; rows without doc_id end the line of their
source, by size; documents without words take 0, and tables without any word have targets of 0;
repeated rows are separate documents; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.llm.common import WORD, stage, text_of

#: 2**31 divided by the golden ratio, rounded to an odd number: its multiples mod 2**31 are a permutation.
GOLDEN, CIRCLE_BITS, CELL_BITS = 1327217885, 31, 10
#: Sources up to this number are broadcast (a row is under 200 bytes); beyond it they are shuffled.
BROADCAST_SOURCES = 20_000


def word_count(text="text"):
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle key; the only pass over the texts."""
    size, any_of_16 = word_count(), F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, 1)
    # "z" is beyond every digest; rows of one size without doc_id are alike, so any order of them will do
    unnamed = F.concat(F.lit("z"), F.lpad(size.cast("string"), 19, "0"), any_of_16)
    return docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), unnamed).alias("h"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), volume: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per source: source_no, source, source_size, target, need and its stretch of the circle.

    The windows run over one row per source, not over documents.
    """
    twice = int(round(2 * volume))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy(F.col("source_size") / F.col("w"), "source_no")
    whole = W.partitionBy()
    ranked = (by_source.withColumn("source_no", F.row_number().over(order) - 1)
              .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("bigint"))
              .withColumn("total", F.sum("source_size").over(whole))
              .withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * cap).over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("w_left", F.sum("w").over(ratio.rowsBetween(0, W.unboundedFollowing)))
              .withColumn("capped", (F.col("total") * twice - F.col("capped_before") * 2) / F.col("w_left") >= F.col("source_size") * (2 * cap) / F.col("w")))
    open_w, full = F.when(~F.col("capped"), F.col("w")), F.when(F.col("capped"), F.col("source_size") * cap)
    rest = F.col("total") * twice - F.coalesce(F.sum(full).over(whole), F.lit(0)) * 2
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(
        (F.col("w") * F.col("rest")).cast("double") / (2.0 * F.col("w_open")))
    shared = (ranked.withColumn("rest", rest).withColumn("w_open", F.sum(open_w).over(whole)).withColumn("target", target)
              .withColumn("need", F.floor("target").cast("bigint")))
    upto = W.orderBy("source_no")
    before = F.coalesce(F.sum("need").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # without words there is no circle: all stretches are empty
    point = lambda words: F.coalesce(F.floor(words * float(1 << CIRCLE_BITS) / F.nullif("need_total", F.lit(0))), F.lit(0)).cast("bigint")
    return (shared.withColumn("need_total", F.sum("need").over(whole)).withColumn("before", before)
            .withColumn("lo", point(F.col("before"))).withColumn("hi", point(F.col("before") + F.col("need")))
            .select("source_no", "source", "source_size", "target", "need", "need_total", "lo", "hi"))


def schedule(spark: SparkSession, targets: DataFrame, n_slots: int) -> DataFrame:
    """One row per slot: source_no, slot and rank (from 0) among its source's slots."""
    shift = CIRCLE_BITS - CELL_BITS
    a_chunk = max(4096, isqrt(n_slots))  # slots in a chunk and chunks: both levels grow with the root of the volume
    circle = 1 << CIRCLE_BITS
    cells = targets.filter("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    slots = (spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") % circle) * GOLDEN % circle).alias("point"))
             .withColumn("cell", F.shiftright("point", shift)))
    drawn = slots.join(cells, "cell").filter("point >= lo AND point < hi").select("source_no", "slot", F.floor(F.col("slot") / a_chunk).alias("chunk"))
    base = W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = (drawn.groupBy("source_no", "chunk").count()
              .select("source_no", "chunk", F.coalesce(F.sum("count").over(base), F.lit(0)).alias("base")))
    within = W.partitionBy("source_no", "chunk").orderBy("slot")
    return (drawn.join(chunks, ["source_no", "chunk"])
            .select("source_no", "slot", (F.col("base") + F.row_number().over(within) - 1).alias("rank")))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), volume: float = 1.5, cap: int = 2, block_words: int = 256) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot (null if not taken)."""
    spark = docs.sparkSession
    sizes = stage(sized(docs), "sizes")
    targets = stage(source_targets(sizes, weights, volume, cap), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    total = targets.agg(F.max("need_total")).first()[0] or 0
    n_slots = -(-total // block_words)
    # hash ranges of a source, and rows in one: both levels grow with the root of the number of rows
    digits = max(3, (isqrt(sizes.count()).bit_length() + 3) // 4)
    per_source = targets.select("source_no", F.col("source").alias("of"), "source_size", "target", "need")
    per_source = F.broadcast(per_source) if small else per_source.hint("merge")
    numbered = (sizes.join(per_source, sizes.source.eqNullSafe(per_source["of"])).drop("of")
                .withColumn("bucket", F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.substring("h", 1, digits))))
    starts = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
               .select("source_no", "bucket", F.coalesce(F.sum("words").over(starts), F.lit(0)).alias("start")))
    line = W.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size")
    placed = (numbered.join(buckets, ["source_no", "bucket"])
              .withColumn("row", F.row_number().over(line))
              .withColumn("at", F.col("start") + F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")))
    laps = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda lap: F.struct(
        (F.col("at") + lap * F.col("source_size")).alias("from"),
        F.least(F.col("at") + lap * F.col("source_size") + F.col("size"), F.col("need")).alias("to")))
    pieces = F.flatten(F.transform(F.filter(laps, lambda lap: lap["from"] < lap["to"]), lambda lap: F.transform(
        F.sequence(F.floor(lap["from"] / block_words), F.floor((lap["to"] - 1) / block_words)),
        lambda r: F.struct(r.alias("rank"), (F.least(lap["to"], (r + 1) * block_words) - F.greatest(lap["from"], r * block_words)).alias("words")))))
    keep = ["source_no", "bucket", "row", "doc_id", "source", "size", "source_size", "target"]
    cut_up = placed.select(*keep, F.explode_outer(pieces).alias("piece")).select(*keep, "piece.rank", "piece.words")
    taken = cut_up.join(schedule(spark, targets, n_slots), ["source_no", "rank"], "left")
    first = F.min(F.when(F.col("words").isNotNull(), F.coalesce("slot", F.lit(n_slots) + F.col("rank"))))
    return (taken.groupBy(*keep).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), first.alias("first_slot"))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s2),
s4 AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
              sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM s3),
s5 AS (SELECT *, CAST(3 * total - 2 * capped_before AS DOUBLE) / w_left >= CAST(4 * source_size AS DOUBLE) / w AS capped FROM s4),
s6 AS (SELECT *, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(w * (3 * total - 2 * coalesce(sum(2 * source_size) FILTER (capped) OVER (), 0)) AS DOUBLE) / (2.0 * sum(w) FILTER (NOT capped) OVER ()) END AS target FROM s5),
s7 AS (SELECT source_no, source, source_size, target, CAST(floor(target) AS BIGINT) AS need FROM s6),
s8 AS (SELECT *, CAST(sum(need) OVER () AS BIGINT) AS need_total, CAST(coalesce(sum(need) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bef FROM s7),
targets AS (SELECT *, CAST(floor(bef * 2147483648.0::DOUBLE / nullif(need_total, 0)) AS BIGINT) AS lo, CAST(floor((bef + need) * 2147483648.0::DOUBLE / nullif(need_total, 0)) AS BIGINT) AS hi FROM s8),
slots AS (SELECT k AS slot, ((k % 2147483648) * 1327217885) % 2147483648 AS point FROM range(CAST((SELECT (max(need_total) + 255) // 256 FROM targets) AS BIGINT)) t(k)),
ranked AS (SELECT source_no, slot, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank FROM slots JOIN targets ON point >= lo AND point < hi),
placed AS (SELECT d.doc_id, t.source_no, d.size, t.source_size, t.target, t.need,
             row_number() OVER (PARTITION BY t.source_no ORDER BY h, d.doc_id, d.size) AS rn,
             CAST(sum(d.size) OVER (PARTITION BY t.source_no ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS pos
           FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
laps AS (SELECT *, pos + lap * source_size AS a, least(pos + lap * source_size + size, need) AS b FROM placed, (VALUES (0), (1)) l(lap)),
pieces AS (SELECT source_no, rn, r AS rank, least(b, (r + 1) * 256) - greatest(a, r * 256) AS words
           FROM (SELECT *, unnest(range(a // 256, (b - 1) // 256 + 1)) AS r FROM laps WHERE a < b)),
taken AS (SELECT p.source_no, p.rn, CAST(sum(words) AS BIGINT) AS taken,
            min(coalesce(slot, (SELECT (max(need_total) + 255) // 256 FROM targets) + p.rank)) AS first_slot
          FROM pieces p LEFT JOIN ranked USING (source_no, rank) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM placed LEFT JOIN taken USING (source_no, rn)
"""
