"""Hard-negative mining by inner products with coordinate pruning over length buckets.

Rows are range-sorted by length and packed into buckets of at most ``BUCKET`` rows with much the same length. A bucket
holds its whole-number vectors, its greatest length, and for each coordinate the list of its rows sorted by the value of that
coordinate in the normalised vector. For an anchor and the least score that still matters, a bucket whose length cannot
reach that score is skipped. Else the needed cosine gives each coordinate a feasible range around the anchor's own
value; the ranges of the anchor's strongest (focus) coordinates are found in the sorted lists, and the rows that lie
in all of them are the candidates, whose scores are then computed exactly. Where the lists would leave most of a bucket,
the bucket is multiplied as a whole instead, which the same exact step then sifts. The least score rises with what is found.

Anchors with one vector and label ask once, as a class. Of rows with one vector and label only the first few by id
can be a result (they have one score), so only these are packed. Classes are dealt into blocks and buckets into groups by
count, and each pair of block and group is one bounded group of a cogroup: both hold at most about ``AREA`` components,
buckets are copied once per block and anchors once per group. Each pair hands on its best few per class, which are
ranked together. The first search finds positives; the second has their scores and finds, for each, the best rows of
another label inside its window.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a
component is floor(256 x) and saturates at 2^26 either way (|x| of 262144); a vector that is shorter than another (or empty) counts as
filled up with zeros; rows with a null vec_id are no anchors and come after all others in a tie; rows that repeat are rows of their
own, and an anchor leaves out one row with its own vec_id, vector and label: itself; anchors without positives and
positives without negatives have no row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches, stage

BUCKET = 1 << 14  # rows of a bucket; their places fit 16 bits
AREA = 1 << 22  # components of a group of buckets, and of a block of anchors
FOCUS = 4
MOST = 1 << 26
BUCKET_ROWS = "grp int, top double, dim int, ids binary, noid binary, labels binary, vectors binary, lists binary"
FOUND = "class bigint, goal int, score bigint, vec_id bigint, own boolean"


def usable(embeddings: DataFrame, vector: str = "embedding", flip: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part; labels of ids divisible by ``flip`` are moved on by one."""
    x = F.col(vector).cast("array<double>")
    good = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c, F.lit(-float(MOST))), F.lit(float(MOST))) * 256), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % flip == 0, (label + 1) % classes).otherwise(label) if flip else label
    # Zeros at the end go, so that vectors that differ only in them are one.
    last = F.size("v") + 1 - F.array_position(F.reverse(F.transform("v", lambda c: c != 0)), True)
    return (embeddings.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"), whole.alias("v"))
            .withColumn("v", F.slice("v", F.lit(1), last.cast("int"))))


def _length(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c))


def pack(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    """A matrix of the vectors, filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def buckets(rows: DataFrame, groups: int, most: int) -> DataFrame:
    """Packed length buckets of at most ``most`` rows in ``groups`` ranges of length."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[tuple]) -> dict:
            ids, labels, vectors, groups = zip(*held)
            dim = max(1, *map(len, vectors))
            m = pack(vectors, dim)
            size = np.sqrt((m * m).sum(axis=1))
            lists = np.argsort(m / np.maximum(size, 1e-300)[:, None], axis=0, kind="stable").T.astype(np.uint16)
            return {"grp": groups[0], "top": float(size.max()), "dim": dim, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "noid": np.array([i is None for i in ids]).tobytes(),
                    "labels": np.array(labels, np.int64).tobytes(), "vectors": m.astype(np.int32).tobytes(), "lists": lists.tobytes()}

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v", "grp"))):
                if held and (len(held) == most or held[0][3] != row[3]):
                    yield pa.RecordBatch.from_pylist([packed(held)], PACKED)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([packed(held)], PACKED)

    spread = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(1 << 30))
    # Spread makes rows of one length divisible; a range is one partition, in which rows come by length.
    ranged = rows.withColumn("length", _length("v")).withColumn("spread", spread).repartitionByRange(groups, F.desc("length"), "spread").sortWithinPartitions(F.desc("length"), "spread")
    return ranged.select("vec_id", "label", "v", F.spark_partition_id().alias("grp")).mapInArrow(build, BUCKET_ROWS)


PACKED = pa.schema([("grp", pa.int32()), ("top", pa.float64()), ("dim", pa.int32()), ("ids", pa.binary()), ("noid", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("lists", pa.binary())])


class Bucket:
    """A bucket's arrays, and the candidates of an anchor in it."""

    def __init__(self, row) -> None:
        self.ids, self.noid = np.frombuffer(row.ids, np.int64), np.frombuffer(row.noid, bool)
        self.labels = np.frombuffer(row.labels, np.int64)
        self.m = np.frombuffer(row.vectors, np.int32).reshape(len(self.ids), row.dim)
        self.lists = np.frombuffer(row.lists, np.uint16).reshape(row.dim, len(self.ids))
        self.size = np.sqrt((self.m.astype(np.float64) ** 2).sum(axis=1))
        self.top = row.top
        self.sorted: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        """The normalised values of a coordinate in the order of its list."""
        if f not in self.sorted:
            at = self.lists[f]
            self.sorted[f] = self.m[at, f] / np.maximum(self.size[at], 1e-300)
        return self.sorted[f]

    def candidates(self, q: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows that may score ``least`` or more with an anchor; None where the lists leave most of the bucket."""
        need = least / max(length * self.top, 1e-300)
        if need > 1 + 1e-9:
            return np.empty(0, np.int64)
        if need <= 0:
            return None  # rows of any direction and length may do
        unit = q / length
        focus = [f for f in np.argsort(-np.abs(unit))[:FOCUS] if f < self.m.shape[1]]
        found, seen = [], len(self.ids)
        for f in focus:
            # A unit vector within the needed cosine of ``unit`` has its coordinate between these; shorter rows need more.
            spread = math.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - min(need, 1.0) ** 2)))
            low = -1.0 if -unit[f] >= need else unit[f] * need - spread
            high = 1.0 if unit[f] >= need else unit[f] * need + spread
            v = self.values(f)
            lo, hi = np.searchsorted(v, low - 1e-9), np.searchsorted(v, high + 1e-9, "right")
            if hi - lo < len(v):
                found.append(self.lists[f][lo:hi])
                seen = min(seen, hi - lo)
        if 2 * seen > len(self.ids):
            return None
        hits = np.bincount(np.concatenate(found), minlength=len(self.ids))
        return np.nonzero(hits == len(found))[0]


def exact(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; by BLAS where lengths bound all partial sums below 2^53."""
    rows, dim = m if m.ndim == 2 else m[None], min(m.shape[-1], q.shape[-1])
    a, b = rows[:, :dim], q[..., :dim]
    limit = math.sqrt(float((a.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) * math.sqrt(float((b.astype(np.float64) ** 2).sum(axis=-1).max(initial=0)))
    if limit < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Goals:
    """Per class and goal (a window of scores), the best k rows so far."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray) -> None:
        self.k, self.low, self.high = k, low, high
        self.rows: list[np.ndarray] = [np.empty((0, 4), np.int64) for _ in low]  # score, no id, id, own

    def least(self) -> int:
        """The least score that any goal still takes (a tie may bring a smaller id); the greatest integer if there is no goal."""
        return min((max(int(lo), int(r[-1, 0])) if len(r) == self.k else int(lo) for lo, r in zip(self.low, self.rows)), default=2**63 - 1)

    def add(self, scores: np.ndarray, noid: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        for g, rows in enumerate(self.rows):
            low = self.low[g] if len(rows) < self.k else max(self.low[g], rows[-1, 0])
            take = (scores >= low) & (scores <= self.high[g])
            n = int(take.sum())
            if n == 0:
                continue
            s, b, i, o = scores[take], noid[take], ids[take], own[take]
            if n > self.k:
                tied = s >= np.partition(s, -self.k)[-self.k]
                s, b, i, o = s[tied], b[tied], i[tied], o[tied]
            rows = np.concatenate([rows, np.stack([s, b, i, o], axis=1).astype(np.int64)])
            self.rows[g] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]


def search(classes: DataFrame, packed: DataFrame, blocks: int, groups: int, k: int, same: bool) -> DataFrame:
    """class, goal, score, vec_id, own: each class's best k rows per goal within each block and group, of its own label or of others.

    ``classes`` has class, label, v, lows and highs (one window of scores a goal).
    """
    def mine(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked = [(c, label, np.asarray(v, np.int64), Goals(k, np.asarray(lows, np.int64), np.asarray(highs, np.int64)))
                 for c, label, v, lows, highs in zip(left["class"], left["label"], left["v"], left["lows"], left["highs"])]
        lengths = [math.sqrt(float((v.astype(np.float64) ** 2).sum())) for _, _, v, _ in asked]
        for row in right.sort_values("top", ascending=False).itertuples():
            bucket, dense = Bucket(row), []
            for at, (_, label, v, goals) in enumerate(asked):
                found = bucket.candidates(v, lengths[at], goals.least())
                if found is None:
                    dense.append(at)
                elif len(found := found[(bucket.labels[found] == label) == same]):
                    judge(bucket, found, v, goals, exact(bucket.m[found], v))
            for lo in range(0, len(dense), 64):
                part = dense[lo : lo + 64]
                dim = max(len(asked[at][2]) for at in part)
                scores = exact(bucket.m, pack([asked[at][2] for at in part], dim).astype(np.int64))
                for col, at in enumerate(part):
                    _, label, v, goals = asked[at]
                    found = np.nonzero(scores[:, col] >= goals.least())[0]
                    found = found[(bucket.labels[found] == label) == same]
                    if len(found):
                        judge(bucket, found, v, goals, scores[found, col])
        out = [(c, g, int(s), int(i) if not b else None, bool(o)) for c, _, _, goals in asked for g, rows in enumerate(goals.rows) for s, b, i, o in rows]
        table = pd.DataFrame(out, columns=["class", "goal", "score", "vec_id", "own"])
        table["vec_id"] = pd.array([r[3] for r in out], "Int64")
        return table

    dealt = classes.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.groupBy("block", "grp").cogroup(held.groupBy("block", "grp")).applyInPandas(mine, FOUND)


def judge(bucket: Bucket, found: np.ndarray, v: np.ndarray, goals: Goals, scores: np.ndarray) -> None:
    """Hand exact scores on, with a mark at rows that have the anchor's own vector."""
    dim = min(len(v), bucket.m.shape[1])
    own = np.zeros(len(found), bool)
    near = np.nonzero(scores == int(v @ v))[0]
    if len(near):
        rows = bucket.m[found[near]]
        own[near] = (rows[:, :dim] == v[:dim]).all(axis=1) & (rows[:, dim:] == 0).all(axis=1) & (not v[dim:].any())
    goals.add(scores, bucket.noid[found], bucket.ids[found], own)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k rows per class and goal over all groups."""
    order = W.partitionBy("class", "goal").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 50, flip: int = 7, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors whose vec_id is divisible by ``every``.

    A negative scores ``low`` to ``high`` percent of the positive.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    rows = usable(embeddings, flip=flip)
    keep = max(n_positives + 1, n_negatives)
    firsts = W.partitionBy("v", "label").orderBy(F.asc_nulls_last("vec_id"))
    table = stage(rows.withColumn("place", F.row_number().over(firsts)).filter(F.col("place") <= keep).drop("place"), "vectors")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    classes = stage(anchors.select("v", "label").distinct().withColumn("class", F.monotonically_increasing_id()), "anchor-classes")
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    dim = max(1, size.dim)
    # Groups and blocks by count; so many groups at least that all cores have work.
    groups = max(1, math.ceil(size["rows"] * dim / AREA), min(2 * spark.sparkContext.defaultParallelism, math.ceil(size["rows"] / 512)))
    blocks = max(1, math.ceil(classes.count() * dim * 16 / AREA))
    packed = stage(buckets(table, groups, max(64, min(BUCKET, (1 << 20) // dim))), "length-buckets", done=(table,))
    groups = 1 + (packed.agg(F.max("grp")).first()[0] or 0)

    any_score = classes.withColumns({"lows": F.array(F.lit(-(2**63)).cast("bigint")), "highs": F.array(F.lit(2**63 - 1).cast("bigint"))})
    near = stage(_best(search(any_score, packed, blocks, groups, n_positives + 1, same=True), n_positives + 1)
                 .groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id", "own"))).alias("near")), "positives")
    # Windows of scores: a goal for each different score of a class's positives.
    # A class's only row with its own vector is the anchor itself, no positive.
    copies = F.size(F.filter("near", lambda r: r["own"])) > 1
    scores = F.array_distinct(F.transform(F.filter("near", lambda r: copies | ~r["own"]), lambda r: r["score"]))
    goals = near.select("class", scores.alias("scores")).selectExpr(
        "class", "scores", f"transform(scores, s -> if(s < 0, {2**63 - 1}, (s * {low} + 99) div 100)) AS lows", f"transform(scores, s -> if(s < 0, -1, s * {high} div 100)) AS highs")
    goals = classes.join(goals, "class")
    far = stage(_best(search(goals.drop("scores"), packed, blocks, groups, n_negatives, same=False), n_negatives)
                .join(goals.select("class", F.posexplode("scores").alias("goal", "positive_score")), ["class", "goal"]).select("class", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")

    # Each anchor leaves itself out: one row with its own vector and id.
    asked = anchors.join(classes, ["v", "label"]).select("class", F.col("vec_id").alias("anchor_id")).join(near, "class")
    itself = F.array_position(F.transform("near", lambda r: r["own"] & r["vec_id"].eqNullSafe(F.col("anchor_id"))), F.lit(True))
    others = asked.select("class", "anchor_id", F.explode(F.slice(F.filter("near", lambda r, i: i + 1 != itself), 1, n_positives)).alias("p")).select(
        "class", "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return others.join(far, ["class", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other_id, b.r AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, other_id AS positive_id, b AS p, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, other_id) <= 3
"""
