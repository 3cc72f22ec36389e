"""Slots for functions that users bring: they run on Arrow batches inside tasks.

Models fail now and then: a call is tried again after a growing pause, and what still fails becomes a row with its error instead
of ending the job. With a log, results are appended to a table by content, so that a later run, or one whose driver was lost,
calls only for what has no result yet; rows that failed are tried again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import extract
from strataflow.operators.store import cut


def attempted(call: Callable[[], list], size: int, tries: int, pause: float) -> tuple[list, str | None, int]:
    """Results of a call for ``size`` rows, or Nones with the last error; and how often it was tried."""
    error = None
    for n in range(1, tries + 1):
        try:
            found = list(call())
            if len(found) != size:
                raise ValueError(f"{len(found)} results for {size} rows")
            return found, None, n
        except Exception as problem:  # a model may raise anything
            error = f"{type(problem).__name__}: {problem}"[:500]
            if n < tries:
                time.sleep(pause * 2 ** (n - 1))
    return [None] * size, error, tries


def _called(rows: DataFrame, inputs: list[str], run: Callable[..., list], result: str, kind: str, batch: int, tries: int, pause: float, log: str | None) -> DataFrame:
    """``rows`` with ``result``, ``error`` and ``tries``; equal inputs are called for once."""
    key = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumn("_call", key)
    asked = keyed.select("_call", *inputs).dropDuplicates(["_call"])
    schema = f"_call string, {result} {kind}, error string, tries int"
    spark = rows.sparkSession

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                piece = part.iloc[i : i + batch]
                found, error, n = attempted(lambda: run(*(piece[c].tolist() for c in inputs)), len(piece), tries, pause)  # noqa: B023
                yield pd.DataFrame({"_call": piece["_call"], result: pd.Series(found, index=piece.index, dtype="object"), "error": error, "tries": n})

    if log is None:
        done = cut(asked.mapInPandas(work, schema))  # stored, so that no later reading calls again
    else:
        spark.createDataFrame([], schema).write.mode("append").parquet(log)
        known = spark.read.schema(schema).parquet(log)
        asked.join(known.filter("error IS NULL").select("_call").distinct(), "_call", "left_anti").mapInPandas(work, schema).write.mode("append").parquet(log)
        logged = spark.read.schema(schema).parquet(log)
        done = logged.groupBy("_call").agg(F.min_by(F.struct(result, "error", "tries"), F.col("error").isNotNull().cast("int")).alias("r")).select("_call", "r.*")
    return keyed.join(done, "_call", "left").drop("_call")


def embed_with(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64, tries: int = 3, pause: float = 0.5, log: str | None = None) -> DataFrame:
    """(id, embedding, error, tries) of texts (id, text) by a model that takes up to ``batch`` texts a call; null texts count as empty."""
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return _called(rows, ["text"], model, "embedding", "array<double>", batch, tries, pause, log).select("id", "embedding", "error", "tries")


def respond_with(prompts: DataFrame, responder: Callable[[str, str], str], tries: int = 3, pause: float = 0.5, log: str | None = None) -> DataFrame:
    """Prompts (conv_id, turn, system, prompt) with response, error and tries; equal prompts are asked once."""
    rows = prompts.select("conv_id", "turn", "system", "prompt")
    return _called(rows, ["system", "prompt"], lambda systems, texts: [responder(s, p) for s, p in zip(systems, texts, strict=True)], "response", "string", 1, tries, pause, log)


def extract_with(code: DataFrame, extractors: dict[str, Callable[[str], list[str]]] | None = None) -> DataFrame:
    """(repository_id, path, language, fact): by the extractor of each file's language; files of other languages give their qualified names."""
    key = ("repository_id", "path", "language")
    own = extractors or {}
    found = extract.definitions(code.filter(~F.col("language").isin(*own)) if own else code).select(*key, F.col("qualified_name").alias("fact"))
    if not own:
        return found

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r, p, lang, fact) for r, p, lang, text in zip(part["repository_id"], part["path"], part["language"], part["text"], strict=True) for fact in own[lang](text or "")]
            yield pd.DataFrame(rows, columns=[*key, "fact"], dtype="object")

    return code.filter(F.col("language").isin(*own)).select(*key, "text").mapInPandas(run, "repository_id string, path string, language string, fact string").unionByName(found)
