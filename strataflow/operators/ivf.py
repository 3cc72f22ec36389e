"""Approximate search: an inverted file of coarse cells with product-quantised codes, kept as a table.

The index is built once and appended to. Each vector (of length one) goes to its nearest cell; what is left between it and the
cell's centre is cut into sub-vectors, and each is coded by the nearest of 256 entries of a codebook. Posting lists are the codes
of a cell. A query visits its nearest cells, scores their codes by table lookups, and the best are ranked again by their true cosine.
Queries go in blocks and codes in shards; each block meets each shard in one bounded task, which hands on the best of each query only.
Cells and codebooks are fitted on a bounded sample of rows (by hash). The number of cells to visit is measured on that sample: as
many as hold ``recall`` of the true neighbours of some of its rows; data without clusters thus visits most cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W



CODES = "cell int, chunk_id bigint, code binary"
SAMPLE = 20_000  # rows that cells and codebooks are fitted on
TRIED = 200  # of these, rows whose neighbours tell how many cells to visit
#: Codes of a shard at most, and of one that is cut further to give each core a task; queries of a block, likewise.
SHARD_ROWS, LEAST_ROWS, BLOCK_QUERIES, LEAST_QUERIES = 1 << 18, 1 << 13, 1 << 14, 1 << 8
#: Codes and queries scored at once.
TILE, PIECE = 1024, 512


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    d = (centres**2).sum(axis=1) - 2 * x @ centres.T
    if k == 1:
        return d.argmin(axis=1)[:, None]
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    part = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most k centres of the rows."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Codebook:
    """Cells, codebooks of the sub-vectors, and how many cells a query visits."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray], probes: int) -> None:
        self.cells, self.books, self.probes = cells, books, probes
        self.width = books[0].shape[1]

    @classmethod
    def fit(cls, x: np.ndarray, k: int, recall: float, parts: int, seed: int) -> Codebook:
        rng = np.random.default_rng(seed)
        x = x[np.isfinite(x).all(axis=1)] if np.isfinite(x).all(axis=1).any() else np.zeros((1, x.shape[1]))
        dims = -(-x.shape[1] // parts) * parts
        x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
        cells = k_means(x, max(1, int(len(x) ** 0.5)), rng)
        rest = x - cells[nearest(x, cells)[:, 0]]
        width = dims // parts
        books = [k_means(rest[:, p * width : (p + 1) * width], 256, rng, 6) for p in range(parts)]
        tried = x[rng.choice(len(x), min(TRIED, len(x)), replace=False)]
        near = np.argsort(-(tried @ x.T), axis=1)[:, 1 : k + 1]
        order, own = nearest(tried, cells, len(cells)), nearest(x, cells)[:, 0]
        place = np.argsort(order, axis=1)
        depth = np.sort(np.take_along_axis(place, own[near], 1).ravel()) if near.size else np.zeros(1, int)
        return cls(cells, books, int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.cells.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row."""
        x = self.pad(x)
        cell = nearest(x, self.cells)[:, 0]
        rest = x - self.cells[cell]
        return cell, np.stack([nearest(rest[:, p * self.width : (p + 1) * self.width], book)[:, 0] for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def best(self, q: np.ndarray, cell: np.ndarray, ids: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of a query, id, approximate product, and codes that the query read: of each query the ``most`` best rows in the cells it visits, ties by id.

        Rows are put in order of their cells, and tiles of a cell are multiplied in single precision with the queries that visit it. What is not
        below a query's worst so far, with room for the error, is scored by lookups in double precision.
        """
        order = np.lexsort((ids, cell))
        cell, ids, codes = cell[order], ids[order], codes[order]
        starts = np.unique(np.concatenate([np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), np.arange(0, len(cell), TILE)]))
        n_in = np.bincount(cell, minlength=len(self.cells))
        length = np.sqrt((self.cells**2).sum(axis=1).max()) + np.sqrt(sum((b**2).sum(axis=1).max() for b in self.books))
        single = [b.astype(np.float32) for b in self.books]
        out = []
        for first in range(0, len(q), PIECE):
            piece = self.pad(q[first : first + PIECE])
            flat, room = piece.astype(np.float32), 1e-6 + 2.0**-22 * piece.shape[1] * length * np.sqrt((piece**2).sum(axis=1))
            tables = [piece[:, p * self.width : (p + 1) * self.width] @ b.T for p, b in enumerate(self.books)]
            centre, visits = piece @ self.cells.T, np.zeros((len(piece), len(self.cells)), bool)
            np.put_along_axis(visits, nearest(piece, self.cells, self.probes), True, axis=1)
            worst, worst_id = np.full(len(piece), -np.inf), np.full(len(piece), np.iinfo(np.int64).max)
            held, n_held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0

            def shrink() -> None:
                row, at, s = (np.concatenate(x) for x in zip(*held, strict=True))
                by = np.lexsort((ids[at], -s, row))
                row, at, s = row[by], at[by], s[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == most - 1
                worst[row[last]], worst_id[row[last]] = s[last], ids[at[last]]
                held[:] = [(row[place < most], at[place < most], s[place < most])]

            for lo, hi in zip(starts, [*starts[1:], len(cell)], strict=True):
                rows = np.flatnonzero(visits[:, cell[lo]])
                if not len(rows):
                    continue
                x = self.cells[cell[lo]].astype(np.float32) + np.concatenate([b[codes[lo:hi, p]] for p, b in enumerate(single)], axis=1)
                raw = flat[rows] @ x.T
                least = worst[rows] - room[rows]
                new = np.flatnonzero(np.isneginf(least))
                if len(new) and hi - lo > most:
                    least[new] = np.partition(raw[new], -most, axis=1)[:, -most] - 2 * room[rows[new]]
                row, at = np.nonzero(raw >= least[:, None].astype(np.float32))
                row, at = rows[row], at + lo
                s = centre[row, cell[lo]] + sum(t.take(row * t.shape[1] + c) for t, c in zip(tables, np.ascontiguousarray(codes[at].T), strict=True))
                take = (s > worst[row]) | ((s == worst[row]) & (ids[at] < worst_id[row]))
                held.append((row[take], at[take], s[take]))
                n_held += np.count_nonzero(take)
                if n_held > 4 * most * len(piece):
                    shrink()
                    n_held = len(held[0][0])
            shrink()
            row, at, s = held[0]
            out.append((row + first, ids[at], s, (visits @ n_in)[row]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def to_json(self) -> str:
        return json.dumps({"cells": self.cells.tolist(), "books": [b.tolist() for b in self.books], "probes": self.probes})

    @classmethod
    def from_json(cls, text: str) -> Codebook:
        j = json.loads(text)
        return cls(np.array(j["cells"]), [np.array(b) for b in j["books"]], j["probes"])


def fit(vectors: DataFrame, k: int = 10, recall: float = 0.97, parts: int | None = None, sample: int = SAMPLE, seed: int = 11) -> Codebook:
    """Cells and codebooks from at most about ``sample`` of the vectors (id, w), taken by hash: the only rows that reach the driver.

    A sub-vector has two coordinates, unless ``parts`` is given: with four, recall falls below 0.9 in 600000 vectors without clusters.
    """
    n = vectors.count()
    limit = 1 << 62 if n <= sample else (sample << 62) // n
    rows = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 62)) < limit).select("id", "w").collect()
    x = np.array([r.w for r in sorted(rows, key=lambda r: r.id)], np.float64) if rows else np.zeros((1, 1))
    return Codebook.fit(x, k, recall, min(parts or -(-x.shape[1] // 2), x.shape[1]), seed)


class IvfIndex:
    """Codes by cell below ``path``: written by ``create``, extended by ``append``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.codebook = Codebook.from_json(spark.read.option("wholetext", True).text(f"{path}/codebook").first()[0])

    @classmethod
    def create(cls, vectors: DataFrame, path: str, **options) -> IvfIndex:
        spark, book = vectors.sparkSession, fit(vectors, **options)
        spark.createDataFrame([(book.to_json(),)], "value string").coalesce(1).write.text(f"{path}/codebook")
        index = cls(spark, path)
        index.append(vectors)
        return index

    def append(self, vectors: DataFrame) -> None:
        """Code vectors (id, w) and add them to their cells' posting lists; no row is moved."""
        book = self.codebook

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    cell, codes = book.encode(np.stack(part["w"].to_numpy()))
                    yield pd.DataFrame({"cell": cell.astype(np.int32), "chunk_id": part["id"], "code": [c.tobytes() for c in codes]})

        vectors.select("id", "w").mapInPandas(run, CODES).write.mode("append").parquet(f"{self.path}/codes")

    def codes(self) -> DataFrame:
        return self.spark.read.schema(CODES).parquet(f"{self.path}/codes")

    def scored(self, queries: DataFrame, most: int, spread: int | None = None) -> DataFrame:
        """(query_id, chunk_id, near, scanned): the ``most`` best by code of each query in each shard, of its nearest cells; ``scanned`` counts the codes it read there.

        Shards (``spread`` of them, else as many as the codes fill) are dealt by hash, so a large cell is no single task.
        """
        book, held = self.codebook, self.codes()
        n_rows, n_queries, cores = held.count(), queries.count(), self.spark.sparkContext.defaultParallelism
        shards = spread or max(1, -(-n_rows // SHARD_ROWS), min(cores, -(-n_rows // LEAST_ROWS)))
        blocks = max(1, -(-n_queries // BLOCK_QUERIES), min(-(-2 * cores // shards), -(-n_queries // LEAST_QUERIES)))

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": np.empty(0, np.int64), "chunk_id": np.empty(0, np.int64), "near": np.empty(0), "scanned": np.empty(0, np.int64)})
            left = left.sort_values("id")  # the same pieces in every shard, so equal codes score the same to the last digit
            codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            row, ids, near, scanned = book.best(np.stack(left["w"].to_numpy()), right["cell"].to_numpy(), right["chunk_id"].to_numpy(), codes, most)
            return pd.DataFrame({"query_id": left["id"].to_numpy()[row], "chunk_id": ids, "near": near, "scanned": scanned})

        asked = queries.select("id", "w", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        held = held.select("*", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInPandas(score, "query_id bigint, chunk_id bigint, near double, scanned bigint")

    def candidates(self, queries: DataFrame, most: int, spread: int | None = None) -> DataFrame:
        """``scored`` with the place, the ``most`` best of each query over all shards, ties by id."""
        found = self.scored(queries, most, spread)
        return found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id"))).filter(F.col("place") <= most)


def search(index: IvfIndex, queries: DataFrame, vectors: DataFrame, k: int = 10, again: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best ``again`` * k candidates by code, ranked by true cosine; a row is none for itself."""
    near = index.candidates(queries, again * k + 1).filter("query_id <> chunk_id").select("query_id", "chunk_id")
    pairs = near.join(vectors.select(F.col("id").alias("chunk_id"), F.col("w").alias("c")), "chunk_id").join(queries.select(F.col("id").alias("query_id"), F.col("w").alias("q")), "query_id")
    score = F.round(F.aggregate(F.zip_with("q", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 4)
    rows = pairs.select("query_id", "chunk_id", score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)
