"""Input that once ended a job or was lost at large sizes."""

from __future__ import annotations

import json
import random

from strataflow.llm.pii import free_spans, sample_limit
from strataflow.llm.tool_calls import link_calls

TOOLS = {"t": {"properties": {"a": "string", "n": "number"}, "required": []}}


def test_one_bad_call_spoils_no_other(spark):
    deep = '{"a":' + "[" * 100_000 + "]" * 100_000 + "}"
    raw = ['{"a": "\\ud83d"}', deep, '{"n": NaN}', '{"n": 1e999}', '{"n": -Infinity}', '{"\\ud800": 1}', '{"a": "fine"}']
    messages = [(1, i, "assistant", json.dumps({"tool_calls": [{"id": str(i), "name": "t", "arguments": r}]})) for i, r in enumerate(raw)]
    got = {r.turn: r for r in link_calls(spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string"), TOOLS).collect()}
    assert len(got) == len(raw) and got[6].status == "pending" and json.loads(got[6].line)["call"]["arguments"] == {"a": "fine"}
    assert json.loads(got[0].line)["call"]["arguments"] == {"a": "\ud83d"} and got[0].status == "pending"
    assert "no JSON" in got[2].errors and "no JSON" in got[3].errors and "no JSON" in got[4].errors and "nested" in got[1].errors
    assert got[5].errors == "unexpected \\ud800" and all(json.loads(r.line) for r in got.values())


def test_a_sample_of_a_huge_table_is_not_empty():
    assert sample_limit(10, 20_000) == 1 << 62 and 0 < sample_limit(10**12, 20_000) < 1 << 40
    assert abs(sample_limit(10**12, 20_000) / 2**62 * 10**12 - 20_000) < 1


def test_spans_by_search_are_those_by_comparison():
    rng = random.Random(5)
    for _ in range(200):
        base = sorted((a, a + rng.randrange(1, 6), "email") for a in rng.sample(range(60), rng.randrange(8)))
        more = [{"p": rng.random(), "s": a, "e": a + rng.randrange(1, 6), "kind": "phone"} for a in rng.choices(range(60), k=15)]
        kept = list(base)
        for x in sorted(more, key=lambda x: (-x["p"], x["s"], x["e"], x["kind"])):
            if all(x["e"] <= a or x["s"] >= b for a, b, _ in kept):
                kept.append((x["s"], x["e"], x["kind"]))
        assert free_spans(base, more) == kept


def test_records_are_read_by_their_length(spark, tmp_path):
    import gzip

    from strataflow.llm.warc import read_responses

    def record(kind: str, url: str, block: bytes, length: int | None = None) -> bytes:
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:{url}>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    bodies = [b"one\r\n\r\nWARC/1.0 two\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nthree", "caf\xe9".encode("latin-1"), b"", "漢".encode()]
    data = record("warcinfo", "w", b"software: x") + b"".join(record("response", f"u{i}", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b) for i, b in enumerate(bodies)) + record("request", "q", b"GET /")
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(data[i : i + 300]) for i in range(0, len(data), 300)))
    for name in ("a.warc", "b.warc.gz"):
        got = {r.url: (r.payload, r.http_headers, r.record_id) for r in read_responses(spark, f"file://{tmp_path}/{name}").collect()}
        assert got == {f"u{i}": (b.decode("utf-8", "replace"), "HTTP/1.1 200 OK\r\nA: b", f"urn:u{i}") for i, b in enumerate(bodies)}


def test_each_row_is_judged_by_its_own_text(spark):
    from strataflow.llm.toxicity import drop_toxic

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").select("text").orderBy("text").limit(40)
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").select("text").orderBy("text").limit(40)
    more = toxic.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "'no id' AS source").unionByName(toxic.selectExpr("900001L AS doc_id", "text", "'shared' AS source")).unionByName(clean.selectExpr("900001L AS doc_id", "text", "'clean' AS source"))
    kept = drop_toxic(docs.select("doc_id", "text", "source").unionByName(more), labels)
    left: dict[str, set] = {}
    for r in kept.collect():
        left.setdefault(r.source if r.source in ("no id", "shared", "clean") else "given", set()).add(r.text)
    # one text has one score: what goes of the given rows goes of the added ones, and nothing else does
    asked, good = {r.text for r in toxic.collect()}, {r.text for r in clean.collect()}
    assert kept.columns == ["doc_id", "text", "source"] and left["no id"] == left["shared"] == left["given"] & asked and left["clean"] == left["given"] & good
    assert len(left["no id"]) < len(asked) / 2 and len(left["clean"]) > 0.9 * len(good)
