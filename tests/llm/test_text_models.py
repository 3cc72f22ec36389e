"""Toxicity, HTML text, WARC derivatives and tool calls."""

from __future__ import annotations

import hashlib
import html
import json
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from strataflow.llm.html_text import extract_text, lines_of, main_text, weights_of
from strataflow.llm.tool_calls import as_tool_messages, link_calls
from strataflow.llm.toxicity import drop_toxic, fold, toxicity
from strataflow.llm.warc import CRLF, derive, read_responses, response_records, write_warc

SF = "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    """A third of the toxic labels of this table are noise, which bounds what any model can find."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity(docs, labels).filter("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    ranks = rows.score.rank()
    auc = (ranks[rows.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc > 0.9 and bad.predicted.mean() > 0.6 and good.predicted.mean() < 0.02 and rows.score.between(0, 1).all()


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "1 2 3", 3), (3, "1 2 3", 3), (None, "word", 4), (4, "word " * 20_000, 5)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity(docs, none).collect()
    assert len(rows) == 6 and all(r.score < 0.02 and r.predicted == 0 for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id} == {r.doc_id: r.h for r in docs.filter("doc_id IS NOT NULL").select("doc_id", (fold() % 5 == 0).alias("h")).collect()}
    assert toxicity(docs.limit(0), none).count() == 0
    assert drop_toxic(docs, none).columns == docs.columns and drop_toxic(docs, none).count() == 6


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(fold() % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {(r.doc_id, round(r.score, 9)) for r in toxicity(docs, x).collect()}
    assert score(labels) == score(turned)


PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><article><h1>Head &amp; more</h1><p>One\n two<br>three</p><p>A</p><p><b>Open<p>Next &lt;b&gt; &#233;&nbsp;x</p></article><footer>&copy; F</footer>":
        "Head & more\nOne two three\nA\nOpen\nNext <b> é x",
    "<article><p>First</p><div class='ad'>Buy</div><p>Second</p><aside>Side</aside><section id=comments><p>I say</p></section><form><p>Mail</p></form></article><p>Out</p>": "First\nSecond",
    "<body><div id='menu'><p>Home</p></div><div class='content'><p>A long text of the page itself.</p><p>It goes on here.</p></div><div class='sidebar'>x</div><div class=\"cookie-notice\">We use cookies</div></body>": "A long text of the page itself.\nIt goes on here.",
    "<p>a<script>if (1 < 2) document.write('<p>no</p>')</script>b</p>": "a\nb",
    "<!-- <p>no</p> --><p title=\"a > b\">yes": "yes",
    "<body class='has-sidebar menu'><div class='wrap with-sidebar'><p>Text</p></div><div role=navigation><p>Go</p></div></body>": "Text",
    "": "", "no markup at  all": "no markup at all", "<p>  </p>": "", "<": "<", "a < b": "a < b",
}


def test_main_text_of_built_pages():
    for page, text in PAGES.items():
        assert main_text(page) == text, page
    assert main_text(None) == "" and main_text("<div>" * 20_000 + "x") == "x" and main_text("<a " * 50_000) == ""


def plain_article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_the_windows_find_the_article_without_marks():
    """Given pages without article, nav, footer and class names; where the advert is longer than half the text, nothing tells them apart."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).column(0).to_pylist()
    unmarked = found = told = 0
    for page in pages:
        want = plain_article(page)
        bare = re.sub(r"</?article>", "", page)
        unmarked += main_text(bare) == want
        bare = re.sub(r"<(/?)(?:nav|footer|article)>", r"<\1div>", page).replace(' class="ad"', "")
        found += main_text(bare) == want
        lines = lines_of(page)
        told += "\n".join(x.text for x, w in zip(lines, weights_of(lines), strict=True) if w > 0) == want
    # weights alone, without surge and dive points, give no page
    assert unmarked == len(pages) and found > 0.98 * len(pages) and told == 0


def test_names_cut_blocks_only_where_they_say_noise():
    page = "<article><p>Body</p><div class='search-result'>A result.</div><p class='banner-year notice'>A year.</p><p class=ad>Buy</p><div class='ad-box'>Buy</div><ul class='share links'><li>Share</li></ul><p>End</p></article>"
    assert main_text(page) == "Body\nA result.\nA year.\nEnd"
    page = "<div class=wrap><div class=text><p>" + "A long paragraph of the page. " * 8 + "</p></div><div class=text><p>Short closing paragraph.</p></div></div><div>© 2024 Site of pages and of more pages</div>"
    assert main_text(page).endswith("\nShort closing paragraph.")


def test_given_pages_keep_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain_article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_extract_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, None, 1), (2, "u", "<p>x</p>", 2), (2, "u", "<p>x</p>", 2)], "page_id bigint, url string, html string, text int")
    assert sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in extract_text(rows).collect()) == [(1, "", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)]
    assert extract_text(rows.limit(0)).count() == 0


def test_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; t</title><nav><a href='/x'>X</a></nav><p>Über</p>"), (2, None, None)], "page_id bigint, url string, html string")
    responses = response_records(pages)
    ids = {r.page_id: (r.record_id, r.payload_digest) for r in responses.collect()}
    rows = {(r.page_id, r.record_type): r for r in derive(responses).collect()}
    assert len(rows) == 4 and len({r.record_id for r in rows.values()}) == 4
    for (page, kind), r in rows.items():
        head, block = r.record.split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert (r.refers_to, r.source_digest) == ids[page] and fields["WARC-Refers-To"] == f"<{r.refers_to}>" and fields["WARC-Type"] == kind
        assert int(fields["Content-Length"]) == len(block.encode()) == r.content_length
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest() == r.block_digest
        assert ("WARC-Target-URI" in fields) == (page == 1)
    assert rows[1, "conversion"].record.endswith("\r\n\r\nX\nÜber") and "title: T & t\r\n" in rows[1, "metadata"].record and "outlink: /x\r\n" in rows[1, "metadata"].record
    assert ids[1][1] in rows[1, "metadata"].record
    write_warc(derive(responses), f"file://{tmp_path}/warc")
    text = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*")).decode()
    assert text.count("WARC/1.1\r\n") == 4 and text.count("\r\n\r\nWARC/1.1") + 1 <= 4 and derive(responses.limit(0)).count() == 0


def test_tool_calls_are_linked_ordered_and_checked(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    result = lambda i, text: json.dumps({"tool_call_id": i, "content": text})
    rows = [(1, 1, "assistant", call(("b", "add", '{"x": "$result:a", "y": 1}'), ("a", "get", '{"key": "ü"}'))), (1, 2, "tool", result("a", "7")), (1, 3, "tool", result("a", "8")), (1, 4, "tool", result("b", "9")),
            (2, 1, "assistant", call(("p", "get", '{"key": "$result:q"}'), ("q", "get", '{"key": "$result:p"}'), ("r", "get", '{"key": "$result:zz"}'))), (2, 2, "assistant", call(("s", "get", '{"kee": 1}'), ("t", "no", "{"), ("u", "get", None))),
            (None, 1, "assistant", call(("a", "get", '{"key": "k"}'))), (3, 1, "assistant", "not json"), (3, 2, "tool", result("a", "orphan")), (3, 3, "user", None), (1, 2, "tool", result("a", "7"))]
    schemas = {"get": {"properties": {"key": "string"}, "required": ["key"]}, "add": {"properties": {"x": "string", "y": "integer"}, "required": ["x", "y"]}}
    got = {(r.conv_id, r.call_id): r for r in link_calls(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), schemas).collect()}
    assert {k: (r.level, r.status) for k, r in got.items()} == {(1, "a"): (0, "linked"), (1, "b"): (1, "linked"), (2, "p"): (None, "cyclic"), (2, "q"): (None, "cyclic"), (2, "r"): (0, "unresolved"),
                                                               (2, "s"): (0, "invalid"), (2, "t"): (0, "invalid"), (2, "u"): (0, "invalid"), (None, "a"): (0, "pending")}
    assert got[1, "a"].line == '{"call":{"arguments":{"key":"ü"},"id":"a","name":"get"},"result":"7"}' and got[1, "a"].result_turn == 2
    assert got[2, "s"].errors == "missing key; unexpected kee" and got[2, "t"].errors == "arguments are no JSON"


def test_every_user_turn_of_the_conversations_is_a_call(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    from strataflow.llm.tool_calls import TOOLS

    rows = {(r.conv_id, r.turn): r for r in link_calls(as_tool_messages(table), TOOLS).collect()}
    turns = {(r.conv_id, r.turn): r for r in table.collect()}
    users = {k: r for k, r in turns.items() if r.role == "user"}
    assert set(rows) == set(users)
    for (conv, turn), r in rows.items():
        line, answer = json.loads(r.line), turns.get((conv, turn + 1))
        assert line["call"]["arguments"]["query"] == users[conv, turn].text and r.line == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert line["result"] == (answer.text if answer and answer.role == "assistant" else None)
    assert link_calls(as_tool_messages(table.limit(0)), TOOLS).count() == 0


def test_models_of_any_size_give_the_same_scores(spark, monkeypatch):
    from strataflow.llm import toxicity as module

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "1 2"), (None, "word"), (-5, None)], "doc_id bigint, text string"))
    score = lambda: sorted((r.doc_id or 0, round(r.score, 9)) for r in toxicity(docs, labels).collect())
    held = score()
    monkeypatch.setattr(module, "MAX_KEYS", 1000)
    assert score() == held and len(held) == docs.count()


def test_calls_with_shared_or_no_identifier_stay(spark):
    from strataflow.llm.tool_calls import TOOLS

    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 0, "user", "c"), (None, 1, "assistant", "x"), (1, None, "user", "d"), (1, 0, "user", "e"), (1, 1, "assistant", "y"),
            (2, 0, "user", "f"), (2, 0, "user", "f"), (2, 2, "user", "g"), (2, 2, "user", "h")]
    got = link_calls(as_tool_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")), TOOLS).collect()
    said = sorted((r.conv_id or 0, json.loads(r.line)["call"]["arguments"]["query"], r.call_id, r.level, r.status) for r in got)
    assert said == [(0, "a", "0", 0, "ambiguous"), (0, "b", "0", 0, "ambiguous"), (0, "c", "0", 0, "ambiguous"), (1, "d", None, 0, "no id"), (1, "e", "0", 0, "linked"),
                    (2, "f", "0", 0, "pending"), (2, "g", "2", 1, "ambiguous"), (2, "h", "2", 1, "ambiguous")]


def test_unmarked_article_that_a_link_list_divides():
    links = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(4))
    prose, end = "Prose of the page. " * 100, "The closing paragraph. " * 13
    page = f"<body><div><a href=x>Home</a></div><div class=text><p>{prose}</p><ul>{links}</ul><p>{end}</p></div><div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a href=3>Three</a></div><div><p>Small print</p></div></body>"
    assert main_text(page) == "\n".join([prose.strip(), *(f"Link number {i}" for i in range(4)), end.strip()])


def plain_evidence(texts, word, order, discount=0.75):
    """The word's log-likelihood under the toxic model less that under the ordinary one, by the formulas of interpolated Kneser-Ney."""
    import math

    from strataflow.llm.toxicity import words_of

    counts = {0: {}, 1: {}}
    for text, y in texts:
        for w in words_of(text):
            signs = f"^{w}$"
            for i in range(1, len(signs)):
                g = signs[max(0, i + 1 - order) : i + 1]
                counts[y][g] = counts[y].get(g, 0) + 1
    every = set(counts[0]) | set(counts[1])
    # continuation counts: different signs before a shorter n-gram; those that begin a word have been seen as such
    kinds, levels = {g for g in every if len(g) == order}, {}
    for m in range(order - 1, 0, -1):
        levels[m] = {}
        for g in kinds:
            levels[m][g[1:]] = levels[m].get(g[1:], 0) + 1
        kinds = set(levels[m]) | {g for g in every if len(g) == m}

    def low(g):
        if len(g) == 1:
            return levels[1][g] / sum(levels[1].values())
        same = {k: c for k, c in levels[len(g)].items() if k[:-1] == g[:-1]}
        return (max(same[g] - discount, 0) + discount * len(same) * low(g[1:])) / sum(same.values())

    def both(g):
        same = {k for k in every if k[:-1] == g[:-1]}
        total = sum(counts[y].get(k, 0) for y in (0, 1) for k in same)
        return (max(sum(counts[y].get(g, 0) for y in (0, 1)) - discount, 0) + discount * len(same) * low(g[1:])) / total

    def log_p(y, g):
        same = {k: c for k, c in counts[y].items() if k[:-1] == g[:-1]}
        s = sum(same.values())
        if g not in every:  # the shared estimate is the same in both classes; its weight is not
            return math.log(discount * len(same) / s) if s else 0.0
        return math.log((max(counts[y].get(g, 0) - discount, 0) + discount * len(same) * both(g)) / s if s else both(g))

    signs = f"^{word}$"
    grams = [signs[max(0, i + 1 - order) : i + 1] for i in range(1, len(signs))]
    return sum(log_p(1, g) - log_p(0, g) for g in grams)


def test_word_evidence_against_the_formulas(spark):
    from strataflow.llm import toxicity as module

    texts = [("bad badly sad", 1), ("sad sandy band bad", 0), ("vile vile bad", 1), ("fine ände ok a", 0), ("", 1), ("ok", 0)]
    train = spark.createDataFrame(texts, "text string, toxic int")
    for order in (3, 4):
        model = module.keyed_model(module.evidence_rows(module.count_grams(train, order), order), order)
        words = ["bad", "badly", "vile", "ände", "xyz", "band", "a", "sadness"]
        got = module.word_evidence(words, *model, order)
        want = [plain_evidence(texts, w, order) for w in words]
        assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-5, (got, want)


def test_labels_that_differ_count_as_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")).filter("doc_id % 3 = 0"))
    worst = labels.withColumn("toxic", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col("toxic")))
    score = lambda x: {(r.doc_id, round(r.score, 9)) for r in toxicity(docs, x).collect()}
    assert score(both.repartition(5)) == score(both.repartition(1)) == score(worst)


class Links(HTMLParser):
    """Title and link targets by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.inside = "", [], False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title"
        self.links += [dict(attrs)["href"]] if tag == "a" and "href" in dict(attrs) else []

    def handle_data(self, data):
        self.title += data if self.inside else ""

    def handle_endtag(self, tag):
        self.inside = False


def test_derivatives_of_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {(r.page_id, r.record_type): r for r in derive(response_records(pages)).collect()}
    rows = pages.collect()
    assert len(got) == 2 * len(rows)
    for r in rows:
        parser = Links()
        parser.feed(r.html)
        digest = "sha256:" + hashlib.sha256(r.html.encode()).hexdigest()
        block = f"title: {' '.join(parser.title.split())}{CRLF}source-status: HTTP/1.1 200 OK{CRLF}source-header: Content-Type: text/html; charset=utf-8{CRLF}source-payload-digest: {digest}{CRLF}"
        block += "".join(f"outlink: {link}{CRLF}" for link in parser.links)
        meta, plain = got[r.page_id, "metadata"], got[r.page_id, "conversion"]
        assert meta.record.partition(CRLF * 2)[2] == block and meta.refers_to == plain.refers_to and meta.block_digest == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        text = plain.record.partition(CRLF * 2)[2]
        assert plain_article(r.html) in text and "<" not in text and plain.content_length == len(text.encode()) and f"WARC-Target-URI: {r.url}{CRLF}" in plain.record


def test_headers_are_kept_and_nothing_forges_a_field(spark, tmp_path):
    headers = CRLF.join(["HTTP/1.1 404 Not Found", "Content-Type: text/html", "ETag: \"x\"", "X-Long: a", "  b", "Server: s"])
    rows = [(1, "urn:uuid:1", f"http://a/{CRLF}WARC-Type: response{CRLF}{CRLF}x y", "2024-05-06T07:08:09Z", headers, "<p>\u00dc " + "long " * 100_000 + "</p>", None, "extra"), (1, "urn:uuid:1", None, None, None, None, None, None), (1, None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id bigint, record_id string, url string, date string, http_headers string, payload string, payload_digest string, record string")
    got = derive(frame).collect()
    assert len(got) == 6 and all(r.record and r.refers_to for r in got)
    for r in got:
        assert r.record.partition(CRLF * 2)[0].count("WARC-Type: ") == 1
    meta = next(r for r in got if r.record_type == "metadata" and r.url)
    assert "WARC-Target-URI: http://a/%0D%0AWARC-Type:%20response%0D%0A%0D%0Ax%20y" in meta.record and "WARC-Date: 2024-05-06T07:08:09Z" in meta.record
    for line in ("source-status: HTTP/1.1 404 Not Found", "source-header: Content-Type: text/html", 'source-header: ETag: "x"', "source-header: X-Long: a b", "source-header: Server: s"):
        assert f"{line}{CRLF}" in meta.record
    assert derive(frame.limit(0)).count() == 0


def test_responses_are_read_from_warc_files(spark, tmp_path):
    payloads = ["<title>A</title>\u00fc\r\n\r\nmore <a href=x>x</a>", "", "see\r\nWARC/1.0 is a format"]
    out = b""
    for i, payload in enumerate(payloads):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-N: {i}\r\n\r\n{payload}".encode()
        out += f"WARC/1.{i % 2}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Date: 2024-01-0{i + 1}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        out += b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:r>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n"
    (tmp_path / "in.warc").write_bytes(out)
    responses = read_responses(spark, str(tmp_path / "in.warc"))
    got = {r.record_id: r for r in responses.collect()}
    assert {k: (r.url, r.payload, r.date[:10], r.http_headers.split("\r\n")[-1]) for k, r in got.items()} == {f"urn:uuid:{i}": (f"http://h/{i}", p, f"2024-01-0{i + 1}", f"X-N: {i}") for i, p in enumerate(payloads)}
    write_warc(derive(responses), str(tmp_path / "out"))
    assert {r.refers_to for r in derive(responses).collect()} == set(got) and "source-header: X-N: 2" in "".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("part-*"))


def test_long_chains_and_orders(spark, tmp_path):
    from strataflow.llm.tool_calls import format_chats

    call = lambda i, needs: json.dumps({"tool_calls": [{"id": str(i), "name": "get", "arguments": json.dumps({"key": f"$result:{needs}" if needs is not None else "k"})}]})
    rows = [(7, 100 - i, "assistant", call(i, i - 1 if i else None), 0) for i in range(25)] + [(7, 200, "tool", json.dumps({"tool_call_id": "3", "content": "x " * 200_000}), 0)]
    rows += [(8, 1, "assistant", call("a", None), 0), (8, 1, "assistant", call("a", "b"), 0), (8, None, "assistant", call("b", None), 0)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, level int")
    schemas = {"get": {"properties": {"key": "string"}, "required": ["key"]}}
    found = link_calls(frame, schemas)
    got = sorted((r.conv_id, int(r.call_id, 36), r.level, r.status) for r in found.collect())
    assert got == sorted([(7, int(str(i), 36), i, "linked" if i == 3 else "pending") for i in range(25)] + [(8, 10, 1, "ambiguous")] * 2 + [(8, 11, 0, "pending")])
    for n in (1, 3, 7):
        assert sorted(map(str, link_calls(frame.repartition(n), schemas).collect())) == sorted(map(str, found.collect()))
    format_chats(found, str(tmp_path / "chats"))
    lines = [json.loads(x) for p in sorted((tmp_path / "chats").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["level"] for x in lines if x["conv_id"] == 7] == list(range(25)) and len(lines) == 28
