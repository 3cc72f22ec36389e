"""The pipeline's stages against plain versions, each over what its predecessor kept."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from strataflow.llm.toxicity import toxicity
from test_near_dup import brute, plain_set

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = rows_of(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    items = [plain_set(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.score for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}

    def clean(rows):
        return {i for i in rows if scores[i] < 0.5}

    def exact(rows):
        best = {}
        for i, r in rows.items():
            key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
            best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), i))
        return {i for _, i in best.values()}

    def near(rows):
        return {i for i, (_, least) in brute([(i, r.text) for i, r in rows.items()], 5, 80).items() if i == least}

    def apart(rows):
        return {i for i, r in rows.items() if not any(g and 100 * len(g & plain_set(r.text, 5)) >= 80 * len(g) for g in items)}

    for (name, stage), plain in zip(corpus_pipeline.STAGES, (clean, exact, near, apart), strict=False):
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = rows_of(out)
        assert set(got) == plain(at), name
        assert all(got[i] == at[i] for i in got)
        docs, at = spark.createDataFrame(list(got.values()), out.schema), got
    mixed = rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert set(mixed) == set(at) and all(r.size == len((at[i].text or "").split()) for i, r in mixed.items())
    assert {(i, r.taken) for i, r in rows_of(corpus_pipeline.run(spark, SF)).items()} == {(i, r.taken) for i, r in mixed.items()}
