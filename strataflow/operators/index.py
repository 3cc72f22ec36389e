"""Chunks, hashed embeddings and similarity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions.paths import is_test_file
from strataflow.functions.text import hashed_vector
from strataflow.operators import extract as X
from strataflow.operators import ivf
from strataflow.operators.store import cut, scratch, sorted_join
from strataflow.operators.tokens import KEY

CLASS_KINDS = ("class", "interface", "enum", "record", "annotation")


def module_chunks(code: DataFrame) -> DataFrame:
    """Text of each file: path, language, imported modules, top-level entities; empty parts are left out."""
    facts = X.analyse(code, "imports")
    imports = X.extract_imports(code, facts).groupBy(*KEY).agg(F.collect_set("module").alias("imports"))
    tops = X.definitions(code, facts).filter("parent = ''").groupBy(*KEY).agg(F.collect_list("qualified_name").alias("tops"))
    rows = code.select(*KEY, "language").join(sorted_join(imports), KEY, "left").join(sorted_join(tops), KEY, "left")
    part = lambda label, c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.sort_array(c), ", ")))
    return rows.select(*KEY, F.concat_ws("\n", "path", F.concat(F.lit("language: "), "language"), part("imports", "imports"), part("entities", "tops")).alias("content"))


def entity_chunks(code: DataFrame) -> DataFrame:
    """Text of each entity: signature, qualified name, documentation, arguments, called, inherited and global names.

    All facts are tagged and grouped once by entity, so they meet in one shuffle. Texts that several files hold are read once.
    """
    files, code = X.distinct_texts(code)
    facts = X.analyse(code, "parameters", "signatures", "strings", "calls", "inheritance", "names")
    tag = lambda df, name, value, what: df.select(*KEY, F.col(name).alias("qualified_name"), F.lit(what).alias("what"), value.alias("value"))
    parameters = cut(X.parameters(code, facts))
    said = (tag(X.signatures(code, facts, parameters), "qualified_name", F.col("signature"), "signature")
            .unionByName(tag(X.docstrings(code, facts), "qualified_name", F.col("doc"), "doc"))
            .unionByName(tag(X.arguments(parameters), "qualified_name", F.format_string("%08d%s", "pos", "argument"), "arguments"))
            .unionByName(tag(X.extract_calls(code, facts).filter("caller <> ''"), "caller", F.col("callee_name"), "calls"))
            .unionByName(tag(X.extract_inheritance(code, facts), "entity", F.col("parent_name"), "inherits"))
            .unionByName(tag(X.globals_used(code, facts), "qualified_name", F.col("global_name"), "globals")))
    one = lambda what: F.min(F.when(F.col("what") == what, F.col("value"))).alias(what)
    several = lambda what: F.sort_array(F.collect_set(F.when(F.col("what") == what, F.col("value")))).alias(what)
    rows = said.groupBy(*KEY, "qualified_name").agg(one("signature"), one("doc"), *map(several, ("arguments", "calls", "inherits", "globals")))
    rows = rows.withColumn("arguments", F.transform("arguments", lambda a: F.substring(a, 9, 1 << 30)))
    part = lambda label: F.when(F.size(label) > 0, F.concat(F.lit(f"{label}: "), F.array_join(label, ", ")))
    content = F.concat_ws("\n", "signature", F.concat(F.lit("file: "), "qualified_name"), "doc", *map(part, ("arguments", "calls", "inherits", "globals")))
    return X.in_files(files, rows.select(*KEY, "qualified_name", content.alias("content"))).drop("language")


def chunk_levels(code: DataFrame) -> DataFrame:
    """Level of each entity (class kinds, else function) and file (module); test files have none."""
    kept = code.filter(~is_test_file())
    ents = X.definitions(kept).select(*KEY, F.col("qualified_name").alias("chunk"), F.when(F.col("kind").isin(*CLASS_KINDS), "class").otherwise("function").alias("level"))
    return ents.unionByName(kept.select(*KEY, F.col("path").alias("chunk"), F.lit("module").alias("level")))


def hash_embed(texts: DataFrame, dims: int = 256) -> DataFrame:
    """Sparse unit vectors (id, bucket, weight) of texts (id, text), a row per text: see ``hashed_vector``."""
    return texts.select("id", F.inline_outer(hashed_vector("text", dims))).filter("bucket IS NOT NULL")  # a plain inline is given a filter that makes the vector twice


CACHE_SCHEMA = "content_hash string, dims int, buckets array<struct<bucket: bigint, weight: double>>"


class EmbeddingCache:
    """Vectors by content hash and number of dimensions: Parquet files below ``path`` to which runs only append."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)

    def rows(self, dims: int) -> DataFrame:
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).filter(F.col("dims") == dims).select("content_hash", "buckets")


def embed_incremental(texts: DataFrame, cache: EmbeddingCache, dims: int = 256) -> DataFrame:
    """(content_hash, was_cached, buckets) of all distinct texts; only those that the cache lacks are embedded, once each, and appended."""
    texts = texts.filter("text IS NOT NULL").select("text", F.sha2("text", 256).alias("content_hash"))
    known = cut(cache.rows(dims).select("content_hash").join(texts.select("content_hash").distinct(), "content_hash", "left_semi").distinct())
    missing = texts.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("text").alias("text"))
    found = missing.select("content_hash", F.lit(dims).alias("dims"), hashed_vector("text", dims).alias("buckets"))  # texts without tokens are cached as empty
    found.write.mode("append").parquet(cache.path)
    rows = cache.rows(dims).dropDuplicates(["content_hash"]).join(known.withColumn("known", F.lit(True)), "content_hash", "left")
    return texts.select("content_hash").distinct().join(rows, "content_hash").select("content_hash", F.coalesce("known", F.lit(False)).alias("was_cached"), "buckets")


def _unit(v: str = "embedding") -> F.Column:
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.zip_with(x, F.array_repeat(F.when(norm == 0, 1.0).otherwise(norm), F.size(x)), lambda e, n: e / n)  # within a transform the norm is made anew for each element


#: Rows of a tile, rows of a group of tiles, and queries of a block.
TILE, GROUP_ROWS, BLOCK_QUERIES = 1024, 1 << 16, 1 << 14
#: Queries multiplied with a tile at once, and pairs scored at once.
PIECE_QUERIES, PIECE_PAIRS = 2048, 8192
TILE_ROWS = "grp int, ids binary, m binary"
SCORED = "query_id bigint, row_id bigint, score double"


def _dense(buckets: list, weights: list, dims: int) -> np.ndarray:
    """A matrix of sparse vectors, given as lists of buckets and weights; a vector without buckets is dense already."""
    out = np.zeros((len(weights), dims))
    for row, b, w in zip(out, buckets, weights, strict=True):
        row[np.asarray(b, np.int64) if b is not None else slice(0, len(w))] = w
    return out


def _tiles(vectors: DataFrame, dims: int, groups: int) -> DataFrame:
    """Packed tiles of vectors (id, b, w), ``groups`` groups by hash; rows of a group lie by their greatest coordinate, so that tiles differ in what they can score."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def tile() -> pa.RecordBatch:
            ids, b, w, grp = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({"grp": pa.array([grp[0]], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "m": [_dense(b, w, dims).tobytes()]})

        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("id", "b", "w", "grp")), strict=True):
                if held and (len(held) == TILE or held[0][3] != row[3]):
                    yield tile()
                    held = []
                held.append(row)
        if held:
            yield tile()

    top = F.array_position("w", F.array_max("w"))
    spread = vectors.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("top", F.when(F.col("b").isNull(), top).otherwise(F.get("b", (top - 1).cast("int"))))
    return spread.repartition(groups, "grp").sortWithinPartitions("grp", "top", "id").select("id", "b", "w", "grp").mapInArrow(pack, TILE_ROWS)


def _best_rows(queries: DataFrame, vectors: DataFrame, k: int, dims: int, linked: bool) -> DataFrame:
    """(query_id, row_id, score, rank): the k rows of greatest product per query, scores rounded to four digits, ties by id; a row is none for itself.

    Queries go in blocks and rows in groups of tiles, and each block meets each group in one bounded task. Before a tile is
    multiplied, the greatest and least value of each coordinate in it bound what a query can score there; only queries whose
    k-th score so far is not above the bound are multiplied with it. Products in single precision tell which pairs may be among the
    best, with room for their error; these pairs alone are scored in double precision. ``linked``: rows that share no coordinate with a query are none for it.
    """
    n_rows, n_queries = vectors.count(), queries.count()
    groups = max(1, -(-n_rows // GROUP_ROWS), min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TILE)))
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    tiles = cut(_tiles(vectors, dims, groups))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"query_id": np.empty(0, np.int64), "row_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(left) or not len(right):
            return found
        q, q_ids = _dense(left["b"], left["w"], dims), left["id"].to_numpy(np.int64)
        single, up, down = q.astype(np.float32), np.maximum(q, 0), np.minimum(q, 0)
        best, best_ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        packed = [(np.frombuffer(i, np.int64), np.frombuffer(m).reshape(-1, dims)) for i, m in zip(right["ids"], right["m"], strict=True)]
        lengths = [np.sqrt(np.fmax.reduce((x**2).sum(axis=1))) for x in (q, *(m for _, m in packed))]
        room = 1e-4 + 2.0**-22 * dims * np.nan_to_num(lengths[0] * np.fmax.reduce(lengths[1:]))  # rounding to four digits, and single precision
        bounds = np.stack([up @ np.fmax.reduce(m) + down @ np.fmin.reduce(m) for _, m in packed], axis=1)

        def keep(row: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
            """Merge pairs into the best of their queries."""
            rows = np.unique(row)
            row, s, ids = np.concatenate([np.repeat(rows, k), row]), np.concatenate([best[rows].ravel(), s]), np.concatenate([best_ids[rows].ravel(), ids])
            order = np.lexsort((ids, -s, row))
            row, s, ids = row[order], s[order], ids[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            first = place < k
            best[row[first], place[first]], best_ids[row[first], place[first]] = s[first], ids[first]

        for t in np.argsort(-bounds.max(axis=0)):
            ids, m = packed[t]
            flat = m.T.astype(np.float32)
            near = np.nonzero(bounds[:, t] + room >= best[:, -1])[0]
            for piece in np.split(near, range(PIECE_QUERIES, len(near), PIECE_QUERIES)):
                raw = single[piece] @ flat
                least = best[piece, -1] - room
                new = np.nonzero(np.isneginf(least))[0]
                if len(new) and len(ids) > k:  # the tile's own k-th product, itself left out, bounds what can be among the best; unlinked rows have a product of nought
                    kth = np.partition(np.nan_to_num(raw[new], nan=-np.inf), -k - 1, axis=1)[:, -k - 1].astype(np.float64)
                    least[new] = np.where(kth > room, kth - 2 * room, -np.inf) if linked else kth - 2 * room
                at_row, at = np.nonzero(raw >= least[:, None].astype(np.float32))
                for lo in range(0, len(at), PIECE_PAIRS):
                    row, col = piece[at_row[lo : lo + PIECE_PAIRS]], at[lo : lo + PIECE_PAIRS]
                    left_, right_ = q[row], m[col]
                    exact = np.einsum("ij,ij->i", left_, right_)
                    s = np.copysign(np.floor(np.abs(exact) * 1e4 + 0.5) / 1e4, exact) + 0.0
                    take = (s >= best[row, -1]) & (ids[col] != q_ids[row])
                    if linked:
                        take[s == 0] &= ((left_[s == 0] != 0) & (right_[s == 0] != 0)).any(axis=1)
                    if take.any():
                        keep(row[take], s[take], ids[col[take]])
        full = best > -np.inf
        return pd.DataFrame({"query_id": np.broadcast_to(q_ids[:, None], best.shape)[full], "row_id": best_ids[full], "score": best[full]})

    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scored = asked.groupBy("block", "grp").cogroup(held.groupBy("block", "grp")).applyInPandas(search, SCORED)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _vectors(chunks: DataFrame) -> DataFrame:
    return chunks.filter("embedding IS NOT NULL").select(F.col("chunk_id").alias("id"), F.lit(None).cast("array<int>").alias("b"), _unit().alias("w"))


def _dims(vectors: DataFrame) -> int:
    return vectors.agg(F.coalesce(F.max(F.size("w")), F.lit(1))).first()[0] or 1


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k chunks of greatest cosine per query, ties by id: every query against every chunk, in blocks."""
    rows = _vectors(chunks)
    return _best_rows(_vectors(queries), rows, k, _dims(rows), linked=False).select("query_id", F.col("row_id").alias("chunk_id"), "score", "rank")


def ann_topk(queries: DataFrame, chunks: DataFrame, k: int = 10, path: str | None = None, again: int = 10) -> DataFrame:
    """Approximate neighbours by an inverted file with product-quantised codes (``ivf``), built at ``path`` or in a scratch folder; a query with fewer than k of them is searched in full."""
    spark, vectors, asked = chunks.sparkSession, cut(_vectors(chunks)), cut(_vectors(queries))
    index = ivf.IvfIndex.create(vectors, path or scratch(spark, "ivf"), k=k)
    best = cut(ivf.search(index, asked, vectors, k, again))
    short = asked.join(best.filter(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if short.isEmpty():
        return best
    exact = _best_rows(short, vectors, k, _dims(vectors), linked=False).select("query_id", F.col("row_id").alias("chunk_id"), "score", "rank")
    return best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)


def text_search(queries: DataFrame, texts: DataFrame, k: int = 10, dims: int = 256) -> DataFrame:
    """Top k texts per query text by the dot product of hashed embeddings; texts that share no bucket are none."""

    def of(df: DataFrame) -> DataFrame:
        v = cut(df.select("id", hashed_vector("text", dims).alias("v"))).filter(F.size("v") > 0).dropDuplicates(["id"])  # cut first: a filter would move below the vector and make it twice
        return v.select("id", F.col("v.bucket").cast("array<int>").alias("b"), F.col("v.weight").alias("w"))

    return _best_rows(of(queries), of(texts), k, dims, linked=True).select("query_id", F.col("row_id").alias("file_id"), "score", "rank")


def search_enrich(hits: DataFrame, chunks: DataFrame, ent: DataFrame) -> DataFrame:
    """Hits with their level, entity and the module it is in; ``chunks`` (chunk_id, level, entity_id) have no entity where they are modules, which are their own place."""
    named = hits.join(chunks.select("chunk_id", "level", "entity_id"), "chunk_id", "left")
    found = named.join(ent.select("entity_id", "name", "module"), "entity_id", "left")
    return found.select("query_id", "chunk_id", "level", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("module", F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"))).alias("path"), "score", "rank")
