"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that refer to it by its identifier: ``metadata`` (warc-fields: title,
outlinks, the source's status line, every header line of it as ``source-header`` and its payload digest) and
``conversion`` (the visible text as text/plain). Identifiers are urn:uuid values made from the response's identifier, so reruns agree.
Digests are SHA-256 of the block in lowercase hex. ``read_responses`` takes responses from WARC files; ``response_records``
makes them of a table of pages, which has neither headers nor dates, so both are the same for all pages there.

Defined cases: a null payload counts as empty, a null URL leaves its headers out; control signs and spaces in a URL
are percent-encoded and those in header values are spaces, so that no field can forge another; continued header
lines are joined; null headers give no header fields, a null date is the Unix epoch, a null digest is made from the
payload and a null identifier from URL and digest; repeated responses give repeated records; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches
from strataflow.llm.html_text import TAG, lines_of

CRLF, EPOCH = "\r\n", "1970-01-01T00:00:00Z"
_TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
_HREF = re.compile(r"\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def uuid_of(text: Column) -> Column:
    """A urn:uuid (version 3 layout) from the MD5 of a text."""
    h = F.md5(text)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Responses of a table of raw pages: page_id, record_id, url, date, http_headers, payload, payload_digest."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), uuid_of(F.concat_ws("|", F.col("page_id").cast("string"), "url")).alias("record_id"), F.col("url"),
        F.lit(date).alias("date"), F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8").alias("http_headers"),
        payload.alias("payload"), F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"))


#: What separates records for Spark's text reader: it ends in the middle of the next version line.
SEPARATOR = f"{CRLF}{CRLF}WARC/1."


def parse_record(raw: bytes) -> dict | None:
    """The fields of one response record (without its version line); None if it is of another type or broken. What is no UTF-8 is replaced."""
    head, found, block = raw.partition(b"\r\n\r\n")
    fields = header_of(head)
    if not found or fields.get("warc-type", "").lower() != "response":
        return None
    if fields.get("content-length", "").isdigit():
        block = block[: int(fields["content-length"])]
    headers, _, body = block.partition(b"\r\n\r\n")
    text = lambda part: part.decode("utf-8", "replace")
    return {"record_id": fields.get("warc-record-id", "").strip("<>"), "url": fields.get("warc-target-uri", "").strip("<>") or None, "date": fields.get("warc-date"),
            "http_headers": text(headers), "payload": text(body), "payload_digest": fields.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()}


def header_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in unfolded(head.decode("utf-8", "replace")))}


def whole_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records (without version line) of the pieces between separators; a separator inside a block, by its Content-Length, is put back."""
    held: bytes | None = None
    missing = 0
    for piece in pieces:
        if held is not None and missing > 0:
            held += SEPARATOR.encode() + piece
            missing -= len(SEPARATOR) + len(piece)
            continue
        if held is not None:
            yield held
        held = piece.partition(CRLF.encode())[2]
        head, found, block = held.partition(b"\r\n\r\n")
        size = header_of(head).get("content-length", "") if found else ""
        missing = int(size) - len(block) if size.isdigit() else 0
    if held is not None:
        yield held


def unfolded(head: str) -> list[str]:
    """Header lines, each with its continuation lines."""
    return re.sub(r"\r?\n[ \t]+", " ", head).strip("\r\n").replace("\r\n", "\n").split("\n")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC/1.0 or 1.1 files, gzipped or not, as ``response_records`` gives them; page_id is null.

    Records are bytes: a block is as long as its Content-Length says, whatever it holds, and bytes that are no UTF-8 are replaced. Gzipped files
    are a task each; Spark splits plain ones between records, and there only a block that holds a separator right where Spark splits is cut.
    """
    schema = "page_id bigint, record_id string, url string, date string, http_headers string, payload string, payload_digest string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for record in whole_records(piece.as_py() for part in parts for piece in part.column(0)):
            if r := parse_record(record):
                held.append({"page_id": None} | r)
            if len(held) == 100:
                yield pa.RecordBatch.from_pylist(held, SCHEMA)
                held = []
        yield pa.RecordBatch.from_pylist(held, SCHEMA)

    SCHEMA = pa.schema([(c, pa.int64() if c == "page_id" else pa.string()) for c in columns])
    bound_batches(spark)
    return spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary")).mapInArrow(run, schema)


def page_title(page: str) -> str:
    m = _TITLE.search(page)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def outlinks(page: str) -> list[str]:
    out = []
    for m in TAG.finditer(page):
        if (m["name"] or m["name2"] or "").lower() == "a" and (h := _HREF.search(m["attrs"] or m["attrs2"] or "")):
            out.append("".join(html.unescape(h[1].strip("\"'")).split()))
    return out


def clean_url(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def clean_value(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def header_fields(http_headers: str | None) -> str:
    """Status line and headers of a response as warc-fields."""
    lines = unfolded(http_headers or "")
    status, headers = (lines[0], lines[1:]) if lines[0].upper().startswith("HTTP/") else ("", lines)
    out = [f"source-status: {clean_value(status)}"] if status else []
    out += [f"source-header: {clean_value(line)}" for line in headers if line.strip()]
    return "".join(f"{line}{CRLF}" for line in out)


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        part["url"] = [clean_url(u) for u in part["url"]]
        part["http_headers"] = [header_fields(h) for h in part["http_headers"]]
        part["title"] = [page_title(p) for p in part["payload"]]
        part["links"] = ["".join(f"outlink: {clean_url(u)}{CRLF}" for u in outlinks(p)) for p in part["payload"]]
        part["plain"] = ["\n".join(x.text for x in lines_of(p)) for p in part["payload"]]
        part["page_id"] = pd.array(part["page_id"], dtype="Int64")
        yield part.drop(columns="payload")


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: page_id, record_type, record_id, refers_to, url, content_type, content_length, block_digest, source_digest, record."""
    schema = "page_id bigint, record_id string, url string, date string, http_headers string, payload_digest string, title string, links string, plain string"
    bound_batches(responses.sparkSession)
    payload = F.coalesce("payload", F.lit(""))
    digest = F.coalesce("payload_digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256)))
    rows = responses.select("page_id", F.coalesce("record_id", uuid_of(F.concat_ws("|", "url", digest))).alias("record_id"), "url", F.coalesce("date", F.lit(EPOCH)).alias("date"),
                            "http_headers", digest.alias("payload_digest"), payload.alias("payload")).mapInPandas(_blocks, schema)
    fields = F.concat(F.lit("title: "), F.col("title"), F.lit(CRLF), F.col("http_headers"),
                      F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF), F.col("links"))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
                    F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), F.col("plain").alias("block")))
    flat = rows.select("page_id", F.col("record_id").alias("refers_to"), "url", "date", F.col("payload_digest").alias("source_digest"), F.explode(kinds).alias("k")).select("*", "k.*")
    ready = (flat.withColumn("record_id", uuid_of(F.concat_ws("|", "refers_to", "record_type"))).withColumn("content_length", F.octet_length("block").cast("bigint"))
             .withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))))
    target = lambda name: F.when(F.col("url").isNotNull(), F.concat(F.lit(f"{name}: "), F.col("url"), F.lit(CRLF))).otherwise("")
    header = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: <"), F.col("record_id"),
                      F.lit(f">{CRLF}WARC-Refers-To: <"), F.col("refers_to"), F.lit(f">{CRLF}"), target("WARC-Target-URI"), target("WARC-Refers-To-Target-URI"),
                      F.lit("WARC-Refers-To-Date: "), F.col("date"), F.lit(f"{CRLF}WARC-Date: "), F.col("date"), F.lit(f"{CRLF}WARC-Block-Digest: "), F.col("block_digest"),
                      F.lit(f"{CRLF}Content-Type: "), F.col("content_type"), F.lit(f"{CRLF}Content-Length: "), F.col("content_length").cast("string"), F.lit(CRLF + CRLF))
    return ready.select("page_id", "record_type", "record_id", "refers_to", "url", "content_type", "content_length", "block_digest", "source_digest", F.concat(header, F.col("block")).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one per partition: Spark's text writer ends each record with the two line ends that the format asks for."""
    records.select("record").write.option("lineSep", CRLF + CRLF).text(path)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(response_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.withColumn("record_sha256", F.sha2("record", 256)).drop("record")
