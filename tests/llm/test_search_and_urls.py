"""URL rules, ranked lexical search and hard negatives against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np

from strataflow.llm import lexical_search
from strataflow.llm.hard_negatives import Bucket, exact, hard_negatives
from strataflow.llm.lexical_search import Best, search, terms_of, tile_scores
from strataflow.llm.url_rules import rule_table, url_verdicts


def judged(url, rules, default="allow"):
    """Host, path, rule and verdict by trying every rule."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_rules_against_trying_all(spark):
    rng = random.Random(11)
    label = lambda: rng.choice(["a", "b", "a-b", "ä", "c"])
    host = lambda n: ".".join(label() for _ in range(rng.randrange(1, n)))
    path = lambda n: "/" + "/".join(rng.choice("xyz") for _ in range(rng.randrange(n)))
    rules = sorted({(host(4), path(4)) for _ in range(120)} | {("a", ""), ("b.a", "/"), ("c", "/x"), ("c", "/x/"), ("c", "/x/y")})
    rules = [(*r, rng.choice(["allow", "block"])) for r in rules]
    urls = [f"https://{host(6)}{path(7)}{rng.choice(['', '?q=/x', '#/y', '/é'])}" for _ in range(3000)] + ["http://A.B.C", "http://c/x", "HTTP://C.b.A:80/x", "x.a/y", "", "a://", "://c/x/y://z", "http://.a/", "http://a./x"]
    table = spark.createDataFrame([(i, u, "p", "v") for i, u in enumerate(urls)] + [(None, None, "p", "v"), (None, urls[0], "p", "v"), (1, urls[1], "p", "v")], "page_id bigint, url string, path string, rule string")
    got = url_verdicts(table, spark.createDataFrame(rules + [("q", None, "block"), rules[0]], "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(urls) + 3
    for r in rows:
        if r.page_id is not None:
            assert tuple(r)[1:] == judged(urls[r.page_id], rules), urls[r.page_id]
    assert sorted(r.host for r in rows if r.page_id is None) == sorted(["", judged(urls[0], rules)[0]])


def test_rules_with_a_hot_host_and_edges(spark):
    rules = (("net", "/", "block"), ("hot.net", "/en/", "allow"), ("hot.net", "/en/", "block"), ("net", "/en/longer/", "allow"))
    urls = [f"http://hot.net/en/{i % 50}" for i in range(2000)] + ["http://hot.net/en/longer/1", "http://www.hot.net/en/longer/", "http://hot.net"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rows = {r.page_id: (r.rule, r.verdict) for r in url_verdicts(table, rule_table(spark, rules)).collect()}
    assert len(rows) == len(urls) and rows[5] == ("hot.net/en/", "block") and rows[2000] == ("net/en/longer/", "allow") and rows[2002] == (None, "allow")
    assert url_verdicts(table.limit(0), rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in url_verdicts(table, rule_table(spark, rules).limit(0), default="block").collect()} == {"block"}


def ranked(docs, items, k):
    """The ranking by its definition, in Python's integers."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, split(t)) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df: dict[str, int] = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in wanted.items():
        scores = []
        for doc, bag in bags:
            if bag:
                m = 10 + (90 * len(bag) * n_docs) // n_words
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag.count(t)) // (1000 * bag.count(t) + 8 * m)) for t in terms if t in df and t in bag)
                if score > 0:
                    scores.append((-score, doc is None, doc or 0))
        out += [(i, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_against_its_definition(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "ÜNÏ", "X", "x", "漢", "7"]
    docs = [(i, " ,.\n"[rng.randrange(4)].join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [(200 + i, "w1 w2 w3") for i in range(40)] + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (None, None), (500, ""), (501, "?!"), (502, "w5 " * 3000 + "w6" + " other" * 3000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for i in range(20)] + [(100, "w1"), (100, "w2 W3"), (None, "w4"), (101, None), (102, "nowhere"), (103, "w1-w2/w3")]
    table = spark.createDataFrame([(*d, "n") for d in docs], "doc_id bigint, text string, score string").repartition(5)
    wanted = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    for more in ({}, {"block_items": 4, "block_terms": 40}):
        got = search(table, wanted, **more)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 10)
    assert search(table.limit(0), wanted).count() == 0 and search(table, wanted.limit(0)).count() == 0


def test_terms_are_cut_only_at_blanks(monkeypatch):
    text = ("Aä1 b--C\x00d 漢字É " * 50).encode()
    whole = [t for piece in terms_of(text) for t in piece]
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    assert [t for piece in terms_of(text) for t in piece] == whole and whole[:5] == ["aä1".encode(), b"b", b"c", b"d", "漢字É".encode()]


def test_tiles_add_up_and_ties_go_by_id():
    rng = np.random.default_rng(3)
    terms, tfs = np.arange(40, dtype=np.int32) % 20, rng.integers(1, 9, 40)
    items = lambda w: [(np.zeros(min(w, 20 - lo), int), np.arange(min(w, 20 - lo)), np.full(min(w, 20 - lo), 26_000.0)) for lo in range(0, 20, w)]
    args = (np.array([50, 60]), np.array([0, 20, 40]), terms, tfs, (2, 110))
    assert (tile_scores(*args, items(20), 1, 20) == tile_scores(*args, items(3), 1, 3)).all()
    best = Best(1, 3)
    for lo in (90, 60, 30, 0):
        best.add(np.full((1, 30), 5), np.arange(lo, lo + 30), np.zeros(30, bool))
    assert best.id.tolist() == [0, 1, 2] and best.least[0] == 5


def mined(rows, every=50, flip=7):
    """The results by all pairs."""
    good = []
    for r, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((r, i, (label + 1) % 10 if i is not None and i % flip == 0 else label, [math.floor(256 * x) for x in v]))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for r, i, label, v in good:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for q, j, other, w in good if q != r]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fits = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, j, n + 1, other, p, s) for n, (s, other, _) in enumerate(fits)]
    return sorted(out, key=str)


def test_negatives_against_all_pairs(spark):
    rng = random.Random(13)
    centre = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    near = lambda c, s: [x + rng.gauss(0, s) for x in c]
    rows = [(i, [x * rng.choice([0.2, 1, 1, 3]) for x in near(rng.choice(centre), rng.choice([0.05, 0.3, 1.0]))], rng.randrange(4)) for i in range(900)]
    rows += [(1000 + i, [0.5] * 12, i % 3) for i in range(300)]  # one vector many times
    rows += [(50, rows[50][1], rows[50][2]), (100, rows[3][1], 1), (None, rows[7][1], 2), (None, [0.5] * 12, 0), (1400, None, 1), (1401, [None, 1.0], 1), (1402, [float("nan")] * 12, 1),
             (1450, [1.0, 2.0], 1), (1500, [1.0, 2.0] + [0.0] * 10, 1), (1550, [], 2), (1600, [0.0], 2), (1650, [1.0] * 12, None), (1700, [float("inf")] + [1.0] * 11, 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, score string").repartition(6)
    got = hard_negatives(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)
    assert hard_negatives(table.limit(0)).count() == 0


def test_sorted_lists_lose_no_candidate():
    rng = np.random.default_rng(14)
    m = (rng.normal(size=(500, 8)) * 100).astype(np.int32)
    size = np.sqrt((m.astype(float) ** 2).sum(axis=1))
    lists = np.argsort(m / size[:, None], axis=0, kind="stable").T.astype(np.uint16)
    row = type("Row", (), {"ids": np.arange(500).tobytes(), "noid": np.zeros(500, bool).tobytes(), "labels": np.zeros(500, np.int64).tobytes(), "dim": 8, "top": float(size.max()), "vectors": m.tobytes(), "lists": lists.tobytes()})
    bucket, pruned = Bucket(row), 0
    for q in m[:100].astype(np.int64):
        scores = exact(bucket.m, q)
        assert (scores == m.astype(np.int64) @ q).all()
        length = math.sqrt(float(q @ q))
        for share in (0.3, 0.8, 0.95):
            found = bucket.candidates(q, length, share * length * size.max())
            if found is not None:
                assert set(np.nonzero(scores >= share * length * size.max())[0]) <= set(found)
                pruned += len(found) < 100
    assert pruned > 50


def test_long_vectors_are_multiplied_as_integers():
    m = np.full((2, 3), 1 << 26, np.int64)
    assert exact(m, m[0]).tolist() == [3 << 52, 3 << 52]
