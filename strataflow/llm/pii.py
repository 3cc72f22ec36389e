"""Personal data by candidate gradient boosting.

1. Base: four strict patterns (email, ip, card, phone) with their checks; what they find always counts.
2. Generators of high recall propose overlapping candidates: spelled-out emails, dotted numbers, digit
   groups of any separators, phone shapes without a plus, IBAN and identity-number shapes, and long tokens that
   may be keys or passwords.
3. Boosted trees score each candidate from its format (length, kinds of signs and their changes, groups,
   separators) and its context (neighbouring signs, trigger words before it). What labels a candidate is hidden
   from them: no checksum, range or digit-count check is a feature, nor is the keyword or prefix that names
   a secret. Format is read from the normal form, which hides how the strict patterns spell: no plus or 00
   before phones, ``@`` and ``.`` for their names in brackets, spaces for dots in cards.
4. Labels: what a base check accepts, IBANs whose checksum is right, and tokens that a keyword assigns
   (``password=``) or whose prefix a vendor gives to keys are positive; what fails the check of
   its kind or stands among numbers (versions, ISBNs, dates, columns of figures; a bare ``@`` between spaces), tokens
   called a digest and long words without digits are negative. Other candidates have no label: that only a generator
   finds them says nothing against them.
5. Documents are halved by hash: the trees are fitted on a sample of one half's labelled candidates that is bounded by
   ``sample`` (taken by hash); one threshold per kind comes from the scores of all labelled candidates of the other half
   that pass their check: the least score from which on ``precision`` of them are positive; kinds without labels use
   the greatest of the base kinds. Candidates of any document that reach it and pass their check are
   added where they overlap nothing stronger; a label counts in fitting and calibration only and vetoes nothing.

Defined cases: null text counts as empty; documents without spans have zeros and the digest of the empty
string; matches that fail their check are dropped and not tried again from a later start; repeated rows are
kept; without candidates of both labels nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches, stage

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds that only the trees can add, after the base kinds in the order of ties.
MORE = ("iban", "national_id", "secret")
GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,5}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){3}(?![0-9.])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}|(?<=[=:\"'])[A-Za-z0-9_+/-]{8,}={0,2}")),
)
KEYWORD = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\s*[=:]\s*[\"']?$")
VENDOR = re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}")
DIGEST = re.compile(r"(?i)(?:sha-?[0-9]*|md5|commit|digest|hash|uuid|revision)\W*$|[/.@]$")
#: Where the generators of numbers look: digits with single signs between, nine or more signs (an IBAN may start before).
NUMERIC = re.compile(r"[+(]?[0-9](?:[ .()+-]{0,2}[0-9]){6,}|[A-Z]{2}[0-9]{2}[ 0-9A-Z]{8}")
TRIGGERS = (re.compile(r"(?i)e-?mail|correo|courriel|contact|write|kontakt"), re.compile(r"(?i)\bip\b|server|host|adress"), re.compile(r"(?i)card|karte|carte|tarjeta|visa|credit"),
            re.compile(r"(?i)phone|tel|call|mobil|fax|anruf"), re.compile(r"(?i)iban|bank|konto|account|ssn|social"), re.compile(r"(?i)version|release|isbn|license|§"))
NUMBERS = TRIGGERS[5]
DATE = re.compile(r"(?:19|20)[0-9]{2}[-. ][0-1]?[0-9][-. ][0-3]?[0-9](?![0-9])|[0-3]?[0-9][-. ][0-1]?[0-9][-. ](?:19|20)[0-9]{2}(?![0-9])")
AT, DOT, PREFIX = re.compile(r" ?(?:@|\(at\)|\[at\]) ?"), re.compile(r" ?(?:\.|\(dot\)|\[dot\]) ?"), re.compile(r"^(?:\+|00)?")
VOWELS = frozenset("aeiouAEIOU")
FEATURES = ("length", "digits", "letters", "groups", "longest_group", "dots", "spaces", "dashes", "parens", "turns", "distinct", "vowels", "before_letter", "after_letter", "near_number", "upper",
            *(f"trigger{i}" for i in range(len(TRIGGERS))), *(f"is_{k}" for k, _ in GENERATORS))
CANDIDATE = "struct<kind:string, s:int, e:int, accepted:boolean, passed:boolean, label:double, features:array<float>>"
ROW = f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<struct<s:int, e:int, kind:string>>, candidates array<{CANDIDATE}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """The check of a base kind on a match of its pattern."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))
    if kind == "card":
        d = digits_of(text)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(digits_of(text)) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, found from each @ so that long words cost no retries."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = max(at + 1, end)


def dotted_quads(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the ip pattern: four full parts in a row of a run of digits and dots."""
    for run in DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        starts = []
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        i = 0
        while i + 3 < len(parts):
            if all(parts[i : i + 4]):
                yield starts[i], starts[i + 3] + len(parts[i + 3])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strict patterns, by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    found += [(a, b, "ip") for a, b in dotted_quads(text) if valid("ip", text[a:b])]
    found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if m.end() - m.start() >= 14 and valid("card", m[0])]
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if valid("phone", m[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def normal(kind: str, m: str) -> str:
    """A candidate without what only tells the spelling of the strict pattern from others."""
    if kind == "email":
        return DOT.sub(".", AT.sub("@", m))
    if kind == "card":
        return m.replace(".", " ")
    return PREFIX.sub("", m) if kind == "phone" else m


def passes(kind: str, form: str) -> bool:
    """The check of any kind on a candidate's normal form."""
    if kind == "email":
        last = form.rpartition(".")[2]
        return len(last) > 1 and last.isalpha()
    if kind == "iban":
        m = form.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1
    if kind == "secret":
        return any(c.isdigit() for c in form) and any(c.isalpha() for c in form)
    if kind == "national_id":
        return form[:3] not in ("000", "666") and form[0] != "9" and form[4:6] != "00" and form[7:] != "0000"
    return valid(kind, form)


def near_number(text: str, a: int, b: int) -> bool:
    """Whether a figure stands next to the span on its line, as in columns of numbers."""
    return any(c.isdigit() for c in (*text[max(0, a - 2) : a].rpartition("\n")[2], *text[b : b + 2].partition("\n")[0]))


def label(text: str, kind: str, a: int, b: int, check: bool) -> float | None:
    """What is known of a candidate that no strict pattern accepts: 0 if it is none, 1 if its checksum tells, else nothing."""
    m, before = text[a:b], text[max(0, a - 30) : a]
    if kind == "secret":
        return 0.0 if not check or DIGEST.search(before) else 1.0 if KEYWORD.search(before) or VENDOR.fullmatch(m) else None
    if not check or NUMBERS.search(before) or kind == "email" and " @" in m and "@ " in m and not TRIGGERS[0].search(before):
        return 0.0
    if kind == "iban":
        return 1.0
    return 0.0 if kind != "email" and (near_number(text, a, b) or DATE.match(m)) else None


def sign(c: str) -> int:
    """The kind of a sign: digit, lower case, upper case or other."""
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    m = normal(kind, text[a:b])
    d, groups = digits_of(m), re.findall(r"[0-9]+", m)
    before = text[max(0, a - 30) : a]
    turns = sum(x != y for x, y in pairwise(map(sign, m)))
    out = [len(m), len(d), sum(c.isalpha() for c in m), len(groups), max(map(len, groups), default=0), m.count("."), m.count(" "), m.count("-"), m.count("("),
           turns, len(set(m)), sum(c in VOWELS for c in m), text[a - 1 : a].isalpha(), text[b : b + 1].isalpha(), near_number(text, a, b), sum(c.isupper() for c in m)]
    return [*map(float, out), *(float(bool(t.search(before))) for t in TRIGGERS), *(float(kind == k) for k, _ in GENERATORS)]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Base spans (accepted, label 1) and the generated spans that overlap none of them, once each."""
    strict, ends = set(base), [0]
    for _, e, _ in base:
        ends.append(max(ends[-1], e))
    starts = [a for a, _, _ in base]
    spans = set()
    if "@" in text or "at)" in text or "at]" in text:
        spans.update((m.start(), m.end(), "email") for m in GENERATORS[0][1].finditer(text))
    # a token of letters alone is a candidate only if it is long; nearly all are plain words
    spans.update((m.start(), m.end(), "secret") for m in GENERATORS[-1][1].finditer(text) if len(m[0]) >= 20 or passes("secret", m[0]))
    for run in NUMERIC.finditer(text):
        for kind, pattern in GENERATORS[1:-1]:
            start, end = (max(0, run.start() - 4), run.end() + 40) if kind == "iban" else (max(0, run.start() - 2), run.end() + 1)
            # an optional separator before the first group is none of the number
            spans.update((m.end() - len(m[0].lstrip(" .-")), m.end(), kind) for m in pattern.finditer(text, start, end))
    out = []
    for a, b, k in sorted(strict | {(a, b, k) for a, b, k in spans if ends[bisect_left(starts, b)] <= a}):
        known = (a, b, k) in strict
        passed = known or passes(k, normal(k, text[a:b]))
        out.append({"kind": k, "s": a, "e": b, "accepted": known, "passed": passed, "label": 1.0 if known else label(text, k, a, b, passed), "features": features(text, k, a, b)})
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of its base spans, the spans and all candidates."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                base = base_spans(text)
                said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                n = [sum(x[2] == k for x in base) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(said.encode()).hexdigest(), [{"s": a, "e": b, "kind": k} for a, b, k in base], candidates(text, base)))
            out = pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "candidates"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, ROW)


def thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """Per kind the least score (in steps of 1/200) from which on the share of positive labels is ``precision``, or half-way to the next labelled one (0.5 at most if there is none); 2 if none."""
    bins = scored.filter("label IS NOT NULL").groupBy("kind", F.floor(F.col("p") * 200).alias("bin")).agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for kind in (*KINDS, *MORE):
        yes = n = 0
        best, below = 2.0, None
        for r in sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin):
            yes, n = yes + r.yes, n + r.n
            if yes >= precision * n and yes:
                best, below = r.bin / 200, None
            elif below is None:
                below = r.bin / 200
        # between the last score that is sure enough and the first that is not lies no label: half of that belongs to each
        out[kind] = best if best > 1 else min(best, 0.5) if below is None else (best + below) / 2
    checked = [out[k] for k in KINDS if out[k] < 2]
    labelled = {r.kind for r in bins if r.yes}
    return out | {k: max(checked, default=2.0) for k in MORE if k not in labelled}


def sample_limit(n: int, sample: int) -> int:
    """The hashes (of 62 bits) below which about ``sample`` of ``n`` rows lie: all of them for small tables, never none."""
    return 1 << 62 if n <= sample else (sample << 62) // n


def free_spans(base: list[tuple[int, int, str]], more: list[dict]) -> list[tuple[int, int, str]]:
    """``base`` and those of ``more``, likeliest first, that touch nothing taken before; by search in sorted starts."""
    kept = list(base)
    starts, ends = [], []
    for a, b, _ in sorted(base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for x in sorted(more, key=lambda x: (-x["p"], x["s"], x["e"], x["kind"])):
        i = bisect.bisect_right(starts, x["s"])
        if (i == 0 or ends[i - 1] <= x["s"]) and (i == len(starts) or starts[i] >= x["e"]):
            starts.insert(i, x["s"])
            ends.insert(i, x["e"])
            kept.append((x["s"], x["e"], x["kind"]))
    return kept


def find_pii(docs: DataFrame, sample: int = 20_000, precision: float = 0.99, trees: int = 12, depth: int = 4) -> DataFrame:
    """For every row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    bound_batches(docs.sparkSession)
    scanned = stage(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    each = scanned.select("row", F.pmod(F.xxhash64("doc_id", "base_sha256"), F.lit(2)).alias("half"), "doc_id", F.explode("candidates").alias("c")).select("row", "half", "doc_id", "c.*")
    # 62 bits of hash: the share of a sample is never rounded to nothing
    at = F.xxhash64("doc_id", "s", "e", "kind")
    each = each.withColumn("h", F.pmod(at, F.lit(1 << 20)) * F.lit(1 << 42) + F.pmod(F.shiftrightunsigned(at, 20), F.lit(1 << 42)))
    to_fit = each.filter("label IS NOT NULL AND half = 0")
    n = to_fit.count()
    fit_on = stage(to_fit.filter(F.col("h") < sample_limit(n, sample)).select("label", array_to_vector("features").alias("vector")), "pii-fit")
    columns = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    if fit_on.select("label").distinct().count() < 2:
        ready = scanned.select("row", *columns, "base", F.array().cast("array<struct<p:double, s:int, e:int, kind:string>>").alias("added"))
    else:
        model = GBTClassifier(labelCol="label", featuresCol="vector", maxIter=trees, maxDepth=depth, maxBins=32, seed=7).fit(fit_on)
        scored = model.transform(each.withColumn("vector", array_to_vector("features"))).select("row", "half", "s", "e", "kind", "accepted", "passed", "label", vector_to_array("probability")[1].alias("p"))
        scored = stage(scored, "pii-scored")
        limit = thresholds(scored.filter("half = 1 AND passed"), precision)
        table = F.create_map(*(x for k, v in limit.items() for x in (F.lit(k), F.lit(float(v)))))
        taken = scored.filter("NOT accepted AND passed").filter(F.col("p") >= table[F.col("kind")]).groupBy("row").agg(F.collect_list(F.struct("p", "s", "e", "kind")).alias("added"))
        ready = scanned.select("row", *columns, "base").join(taken, "row", "left")

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            spans, added = [], []
            for base, more in zip(part["base"], part["added"], strict=True):
                kept = free_spans([(x["s"], x["e"], x["kind"]) for x in base], more if more is not None else [])
                order = (*KINDS, *MORE)
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(kept, key=lambda x: (x[0], order.index(x[2]), x[1]))))
                added.append(len(kept) - len(base))
            out = part[columns].copy()
            yield out.assign(doc_id=pd.array(out["doc_id"], dtype="Int64"), spans=spans, n_added=added)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return ready.drop("row").mapInPandas(merge, schema)


def redact(text: str, spans: str) -> str:
    """The text with each span of ``spans`` replaced by its kind in brackets."""
    out, at = [], 0
    for part in filter(None, spans.split(",")):
        kind, a, b = part.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind}]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
