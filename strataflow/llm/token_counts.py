"""Token counts through a digest cache.

The cache is a table of (tokenizer version, text digest) -> count. Texts are joined to it by digest; only
distinct misses are encoded, once each, and appended. Jobs that append the same miss at the same time leave
several rows of it, which are read as one. A tokenizer's version is the SHA-256 of its file,
and the normalisation is one that leaves counts alone: null becomes empty.

Counts are those of the ``tokenizers`` library. Texts whose characters all lie in the ASCII and Latin
ranges of ``PLAIN`` may be encoded by ``tiktoken`` with the same merges where the vocabulary has such a
file (several times faster, same pieces: the split pattern of the two libraries can only differ on
characters outside these ranges); all other texts go through ``tokenizers`` itself.

Defined cases: null and empty texts have 0 tokens; repeated texts are encoded once and counted for every
row; repeated rows are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches, scratch_path, stage, text_of

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: Characters encoded by one call of the library, so that a batch of long texts stays small.
BATCH_CHARS = 1 << 20


@lru_cache(maxsize=4)
def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def json_counter(path: str, ranks_path: str | None = None, pattern: str = "", special: tuple[str, ...] = ()) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, for a ``tokenizers`` file.

    With ``ranks_path`` (the same merges as ranks) plain texts without special strings take the faster way.
    """

    def count(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        slow: list[int] = []
        fast = _ranks(ranks_path, pattern) if ranks_path else None
        for i, text in enumerate(texts):
            if not text:
                continue
            if fast and PLAIN.fullmatch(text) and not any(s in text for s in special):
                out[i] = len(fast.encode_ordinary(text))
            else:
                slow.append(i)
        start = 0
        while start < len(slow):
            end, chars = start, 0
            while end < len(slow) and (end == start or chars < BATCH_CHARS):
                chars += len(texts[slow[end]])
                end += 1
            encoded = _library(path).encode_batch_fast([texts[i] for i in slow[start:end]], add_special_tokens=False)
            for i, e in zip(slow[start:end], encoded, strict=True):
                out[i] = len(e)
            start = end
        return out

    return count


class TokenCache:
    """The stored counts: Parquet files below ``path``; parts are only ever added."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "token-cache")

    def rows(self, version: str) -> DataFrame:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).filter(F.col("version") == version)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def token_counts(docs: DataFrame, version: str, count: Callable[[list[str]], list[int]], cache: TokenCache | None = None, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    bound_batches(docs.sparkSession)
    cache = cache or TokenCache(docs.sparkSession)
    text = text_of()
    digested = stage(docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes")), "text-digests")
    known = cache.rows(version).select("digest")
    # min() names one row per distinct text; null ids come last, so such a text keeps a way to its rows
    misses = digested.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    wanted = misses.select(F.xxhash64("doc_id").alias("key"), F.col("digest").alias("miss"))
    texts = (docs.select(F.xxhash64("doc_id").alias("key"), text.alias("text"))
             .join(wanted, "key").filter(F.unhex(F.sha2("text", 256)) == F.col("miss")).select("miss", "text"))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"version": version, "digest": part["miss"], "n_tokens": count(part["text"].tolist())})

    cache.append(texts.mapInPandas(encode, CACHE_SCHEMA).dropDuplicates(["digest"]))
    # writers that missed the same text at the same time leave a row each, with the same count; staged, so that a hot text's rows can still be split
    counts = stage(cache.rows(version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return digested.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.json")
    count = json_counter(path, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ("<|endoftext|>",))
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_version(path), count)
