"""Text columns: identifier tokens, normalisation, token estimates, budgets, responses and evidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight and signs of empty explanations.
STOPWORDS = ("a", "an", "the", "after", "before", "for", "to", "of", "on", "with", "and", "or", "at", "by", "from", "in", "when", "then", "as", "is",
             "are", "be", "this", "that", "per", "value", "model")
PLACEHOLDERS = ("none detected", "standard control flow", "see evidence", "per source lines", "low risk", "propagates exceptions to the caller", "relies on callee error semantics")
TRUNCATED = "\n... [truncated due to token budget]"


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def words(text: str | Column) -> Column:
    """Identifiers of a text, lower-cased, repeats kept."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit(r"[a-zA-Z0-9_]+"), 0), lambda w: F.lower(w))


def identifier_tokens(text: str | Column) -> Column:
    """Identifiers lower-cased, each followed by its parts, which underscores, digits and capitals divide."""
    whole = F.regexp_extract_all(_col(text), F.lit(r"[a-zA-Z0-9_]+"), 0)
    part = F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
    return F.flatten(F.transform(whole, lambda w: F.concat(F.array(F.lower(w)), F.transform(F.regexp_extract_all(w, part, 0), lambda p: F.lower(p)))))


def token_set(text: str | Column) -> Column:
    """The different tokens of ``identifier_tokens``, in no order; two passes over the whole text, which is faster than one per identifier."""
    whole = F.regexp_extract_all(_col(text), F.lit(r"[a-zA-Z0-9_]+"), 0)
    parts = F.regexp_extract_all(_col(text), F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), 0)
    return F.array_distinct(F.transform(F.concat(whole, parts), lambda w: F.lower(w)))


def hashed_vector(text: str | Column, dims: int) -> Column:
    """Sparse unit vector [(bucket, weight)] of the tokens of a text, in order of buckets; made within the row, so no token is shuffled.

    Each different token adds a signed one to its bucket: the first four bytes of its MD5 name the bucket, an odd fifth byte adds, an even one takes away.
    """
    head = F.transform(token_set(text), lambda t: F.conv(F.substring(F.md5(t), 1, 10), 16, 10).cast("bigint"))  # five bytes as one number
    found = F.sort_array(F.transform(head, lambda h: F.shiftright(h, 8) % dims * 2 + h % 2))
    bucket = lambda x: F.shiftright(x, 1)

    def sums(p: Column) -> Column:
        """Sums of the runs of ``v`` that begin at ``at``."""
        v, at = p["v"], p["at"]
        total = lambda i, end: F.aggregate(F.slice(v, i + 1, end - i), F.lit(0).cast("bigint"), lambda s, x: s + x % 2 * 2 - 1)
        runs = F.transform(at, lambda i, n: F.struct(bucket(F.get(v, i)).alias("bucket"), total(i, F.coalesce(F.get(at, n + 1), F.size(v))).alias("s")))
        return F.filter(runs, lambda r: r["s"] != 0)

    def starts(p: Column) -> Column:
        v = p["v"]
        first = F.transform(v, lambda x, i: F.when((i == 0) | (bucket(F.get(v, F.greatest(i - 1, F.lit(0)))) != bucket(x)), i))
        return F.array_compact(first)

    runs = _bound(lambda p: _bound(sums, v=p["v"], at=starts(p)), v=found)
    norm = lambda p: F.sqrt(F.aggregate(p["runs"], F.lit(0).cast("bigint"), lambda n, r: n + r["s"] * r["s"]))
    unit = lambda p: F.transform(p["runs"], lambda r: F.struct(r["bucket"].alias("bucket"), (r["s"] / p["norm"]).alias("weight")))
    return _bound(lambda p: _bound(unit, runs=p["runs"], norm=norm(p)), runs=runs)


def normalize(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9<=._]+", " "))


def normal_words(text: str | Column) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda w: w != ""))


def _bound(use: Callable[[Column], Column], **parts: Column) -> Column:
    """``use`` of a struct of ``parts``, which are computed once a row, however often they occur and though they occur in lambdas."""
    return F.get(F.transform(F.array(F.struct(*(c.alias(name) for name, c in parts.items()))), use), F.lit(0))


def cover_ratio(expected: Column, found: Column) -> Column:
    """Share of expected words that are found; longer than four letters, a common start of four letters is enough."""
    keys = lambda ws: F.array_distinct(F.transform(ws, lambda w: F.substring(w, 1, 4)))

    def share(words: Column) -> Column:
        expected, found = words["expected"], words["found"]
        hit = lambda t: F.size(F.filter(t["expected"], lambda w: F.array_contains(t["exact"], w) | (F.length(w) > 4) & F.array_contains(t["starts"], F.substring(w, 1, 4))))
        exact, starts = F.array_intersect(expected, found), F.array_intersect(keys(expected), keys(F.filter(found, lambda w: F.length(w) >= 4)))
        return F.when(F.size(expected) == 0, 1.0).otherwise(_bound(hit, expected=expected, exact=exact, starts=starts) / F.size(expected))

    return _bound(share, expected=expected, found=found)


def has_any(text: Column, anchors: tuple[str, ...]) -> Column:
    return F.greatest(*(text.contains(a) for a in anchors)) if len(anchors) > 1 else text.contains(anchors[0])


def estimate_tokens(text: str | Column) -> Column:
    """A quarter of each word, number or sign, rounded up; white space is free, a text that is not empty counts one at least."""
    text = _col(text)
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+|[^\p{L}\p{N}]"), 0)
    weight = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda n, t: n + F.when(t.rlike(r"^\s$"), 0).otherwise(F.ceil(F.length(t) / 4)))
    return (F.when(F.length(text) == 0, 0).when(F.size(tokens) == 0, F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).otherwise(F.greatest(F.lit(1), weight))).cast("bigint")


def fit_to_budget(prompt: Column, prompt_tokens: Column, system_tokens: Column, budget: int, reserve: int) -> Column:
    """(text, status): the prompt as it is, cut to the budget, or null where the budget is too small."""
    left = F.lit(budget - reserve) - system_tokens
    chars = left * 4 - 50
    status = F.when(left <= 0, "no budget").when(prompt_tokens <= left, "whole").when(chars <= 0, "no budget").otherwise("truncated")
    text = F.when(status == "whole", prompt).when(status == "truncated", F.concat(F.substring(prompt, F.lit(1), chars.cast("int")), F.lit(TRUNCATED)))
    return F.struct(text.alias("text"), status.alias("status"))


def response_json(text: str | Column) -> Column:
    """The first of: the text itself, its fenced block, its first ``{...}``, that is a JSON object; else null."""
    text = _col(text)
    tries = (F.trim(text), F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    valid = [F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t) for t in tries]
    return F.coalesce(*valid)


def checked_json(text: str | Column, required: dict[str, str]) -> Column:
    """(json, reason): the response's JSON object, if it has all required keys with values of their types (string, number, boolean, array, object); else null and why."""
    json = response_json(text)
    of = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

    def wrong(key: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))
        fits = reduce(lambda a, b: a | b, (found.startswith(word) for word in of[kind]))
        return F.when(found.isNull() | (found == "VOID"), f"missing {key}").when(~fits, f"{key} is no {kind}")

    reason = F.when(json.isNull(), "no JSON object").otherwise(F.coalesce(*(wrong(k, t) for k, t in required.items())))
    return F.struct(F.when(reason.isNull(), json).alias("json"), reason.alias("reason"))


def strip_fences(text: str | Column) -> Column:
    """The inside of the first fenced block, or the trimmed text."""
    text = _col(text)
    return F.when(text.rlike(r"(?s)```.*?```"), F.btrim(F.regexp_extract(text, r"(?is)```(?:python|java)?\s*(.*?)\s*```", 1), F.lit(" \n\t\r"))).otherwise(F.btrim(text, F.lit(" \n\t\r")))


def first_filled(json: Column, keys: tuple[str, ...], otherwise: Column) -> Column:
    """The first of the JSON object's fields that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(json, f"$.{k}")), F.lit("")) for k in keys), otherwise)


def brace_balance(text: str | Column) -> Column:
    """Whether a text is not blank and has as many closing as opening braces."""
    text = _col(text)
    n = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    return (F.trim(text) != "") & (n("{") == n("}"))


# Ordered rules from words in a parameter to a literal.
ARGUMENT_RULES = (
    ("1.0", ("float", "amount", "rate", "price", "ratio", "pct", "percentage")),
    ("1", ("int", "count", "n", "limit", "index", "size", "year", "age")),
    ("True", ("bool", "enabled", "active", "flag", "valid")),
    ("[]", ("list", "sequence", "items", "expenses", "rows", "values")),
    ("{}", ("dict", "mapping", "config", "expense", "payload", "data", "options", "record")),
    ('"test"', ("str", "string", "name", "key", "category", "label", "text", "path", "message", "region", "uri", "username", "password", "query", "token", "s")),
)


def placeholder_argument(param: str | Column) -> Column:
    """A literal for a parameter (``name``, ``name: type``, ``name=default``) by the first rule whose word it contains."""
    token = F.lower(F.trim(_col(param)))
    name = F.trim(F.split(F.split(token, ":")[0], "=")[0])
    kind = F.when(token.contains(":"), F.trim(F.split(F.regexp_extract(token, r"^[^:]*:(.*)$", 1), "=")[0])).otherwise("")
    source = F.concat_ws(" ", name, kind)
    out = None
    for literal, found in ARGUMENT_RULES:
        out = F.when(has_any(source, found), literal) if out is None else out.when(has_any(source, found), literal)
    return out.when(name.rlike("^[a-z]$"), "1.0").otherwise("None")


def claim(line: Column, number: Column, target: Column) -> Column:
    """What a source line is evidence of."""
    at = F.concat(F.lit(" at line "), number.cast("string"), F.lit("."))
    return (F.when(line.startswith("if ") | line.startswith("elif "), F.concat(F.lit("Conditional control flow"), at))
            .when(line.startswith("def ") | line.startswith("class ") | line.startswith("async def "), F.concat(F.lit("Declares "), target, at))
            .when(line.contains("return "), F.concat(F.lit("Returns a value"), at)).when(line.contains("raise "), F.concat(F.lit("Raises an exception"), at))
            .otherwise(F.concat(F.lit("Code"), at)))
