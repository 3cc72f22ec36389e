"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts each get an n-gram model over the letters of their words (``^`` and ``$`` mark
word ends; the context of a letter is its word so far, at most ``order - 1`` signs). Both classes
interpolate with one shared model, made from the counts of all labelled texts at the same context and from
continuation counts below it, so a rare expression that a class hardly showed falls back on the same
estimate in both. A word's evidence is its log-likelihood under the toxic model minus that under the
ordinary one; a document's are the means of these differences over the words of the whole text and of its
most telling runs of words. A logistic regression over
them, fitted on labelled rows that the models have not seen, calibrates the score.

Counts cover every labelled training row and come from Spark aggregations, and no n-gram is pruned. A model
of up to ``MAX_KEYS`` 64-bit keys (48 MB) is broadcast as a sorted table; a larger one stays a distributed
table: the distinct words' n-grams are joined with it, and the words' evidence with each text's word
positions. Both ways give the same evidence.

Defined cases: null, empty and wordless texts have no evidence (all features 0) and get the score that
calibration gives to that; repeated rows are scored each; labels of a doc_id that occurs several times
count for each row; a doc_id with labels that differ is toxic; without labelled rows of both classes in the calibration part every score is the
logistic of the best word's evidence less ``PRIOR``, so that texts without evidence pass; empty tables give
empty results; extra columns are ignored or kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches, fresh_name, lean, stage, text_of
from strataflow.llm.shingles import mix64

ORDER, DISCOUNT = 6, 0.75
MAX_KEYS = 4_000_000  # of a model that is broadcast; a larger one is joined
PRIOR = 4.0  # log-odds against toxicity where nothing calibrates
RUNS = (1, 3, 8)  # lengths, in words, of the runs whose best one is a feature
FEATURES = ("whole", *(f"best{n}" for n in RUNS), "second", "third")
#: Labels up to this number are broadcast to the texts (9 bytes each); more are shuffled.
BROADCAST_LABELS = 2_000_000
#: Words are looked up for groups of texts of this many characters, and remembered up to this many bytes (a word beside its letters takes WORD_BYTES).
GROUP_CHARS, HELD_BYTES, WORD_BYTES = 1 << 18, 12 << 20, 190
WORDS = re.compile(r"[^\W\d_]+")
_A, _N = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _signs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` of all words in a row, and each sign's place in its word."""
    signs = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return signs, np.arange(len(signs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _gram_hashes(signs: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """At each sign, the hash of the longest n-gram that ends there within its word, and its length."""
    n = np.minimum(place + 1, order)
    out, power = np.zeros(len(signs), np.uint64), np.ones(1, np.uint64)
    for j in range(order):
        back = np.concatenate((np.zeros(min(j, len(signs)), np.uint32), signs[: max(len(signs) - j, 0)])).astype(np.uint64)
        out = out + np.where(n > j, back * power, np.uint64(0))
        power = np.multiply(power, _A, dtype=np.uint64)
    return mix64(out + n.astype(np.uint64) * _N), n


def _context_hashes(signs: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """At each sign but the first of a word, the hash of its context (at most order - 1 signs), told apart from n-grams."""
    h, _ = _gram_hashes(signs, place, order - 1)
    return mix64(np.concatenate((h[:1], h[:-1])) ^ _A)


def count_grams(train: DataFrame, order: int) -> DataFrame:
    """(g, c1, c0): longest n-grams with their counts in toxic and ordinary texts; train has text and toxic."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {0: Counter(), 1: Counter()}

        def flush(y: int) -> pd.DataFrame:
            words, times = list(held[y]), np.fromiter(held[y].values(), np.int64, len(held[y]))
            held[y].clear()
            signs, place = _signs(words)
            hashes, n = _gram_hashes(signs, place, order)
            weight = np.repeat(times, [len(w) + 2 for w in words])
            at = np.nonzero(place > 0)[0]
            _, first, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
            text = "".join(f"^{w}$" for w in words)
            ends = at[first]
            grams = [text[e + 1 - m : e + 1] for e, m in zip(ends.tolist(), n[ends].tolist(), strict=True)]
            return pd.DataFrame({"g": grams, "toxic": y, "c": np.bincount(inverse, weight[at]).astype(np.int64)})

        for part in parts:
            for text, y in zip(part["text"], part["toxic"], strict=True):
                held[y].update(words_of(text))
                if len(held[y]) > 50_000:
                    yield flush(y)
        for y in held:
            if held[y]:
                yield flush(y)

    rows = train.mapInPandas(lean(run), "g string, toxic int, c bigint")
    return rows.groupBy("g").agg(F.sum(F.col("c") * F.col("toxic")).alias("c1"), F.sum(F.col("c") * (1 - F.col("toxic"))).alias("c0"))


def _context(g: str = "g"):
    return F.expr(f"substring({g}, 1, length({g}) - 1)")


def shared_model(grams: DataFrame, order: int) -> DataFrame:
    """(g, p): the lower-order Kneser-Ney estimate for n-grams of 1 to order - 1 signs, from continuation counts."""
    longest = grams.select("g", F.length("g").alias("n"))
    kinds = longest.filter(F.col("n") == order).select("g")
    levels = {}
    for m in range(order - 1, 0, -1):
        levels[m] = stage(kinds.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count(F.lit(1)).alias("cont")), "kinds")
        kinds = levels[m].select("g").unionByName(longest.filter(F.col("n") == m).select("g"))
    total = levels[1].agg(F.sum("cont").alias("total"))
    model = levels[1].crossJoin(F.broadcast(total)).select("g", (F.col("cont") / F.col("total")).alias("p"))  # total is one row
    every = model
    for m in range(2, order):
        context = levels[m].groupBy(_context().alias("context")).agg(F.sum("cont").alias("s"), F.count(F.lit(1)).alias("kinds"))
        lower = model.select(F.col("g").alias("suffix"), F.col("p").alias("p_low"))
        model = (levels[m].withColumn("context", _context()).withColumn("suffix", F.expr("substring(g, 2)"))
                 .join(context, "context").join(lower, "suffix")
                 .select("g", ((F.greatest(F.col("cont") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p_low")) / F.col("s")).alias("p")))
        model = stage(model, "shared")
        every = every.unionByName(model)
    return every


def evidence_rows(grams: DataFrame, order: int) -> DataFrame:
    """(key, is_context, v): log-likelihood differences of known n-grams, and of known contexts with an unknown sign."""
    grams = stage(grams, "grams")
    shared = shared_model(grams, order).select(F.col("g").alias("suffix"), F.col("p"))
    kinds = lambda c: F.sum((F.col(c) > 0).cast("bigint"))
    context = stage(grams.groupBy(_context().alias("context")).agg(F.sum("c1").alias("s1"), F.sum("c0").alias("s0"), kinds("c1").alias("k1"), kinds("c0").alias("k0"), F.count(F.lit(1)).alias("kinds")), "contexts")

    def p(y: int):
        c, s, k = F.col(f"c{y}"), F.col(f"s{y}"), F.col(f"k{y}")
        return F.when(s > 0, (F.greatest(c - DISCOUNT, F.lit(0.0)) + DISCOUNT * k * F.col("both")) / s).otherwise(F.col("both"))

    both = (F.greatest(F.col("c0") + F.col("c1") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("p")) / (F.col("s0") + F.col("s1"))

    def rest(y: int):
        return F.when(F.col(f"s{y}") > 0, DISCOUNT * F.col(f"k{y}") / F.col(f"s{y}")).otherwise(F.lit(1.0))

    known = (grams.withColumn("context", _context()).withColumn("suffix", F.expr("substring(g, 2)"))
             .join(context, "context").join(shared, "suffix").withColumn("both", both)
             .select(F.col("g").alias("key"), F.lit(False).alias("is_context"), F.log(p(1) / p(0)).alias("v")))
    unknown = context.select(F.col("context").alias("key"), F.lit(True), F.log(rest(1) / rest(0)).alias("v"))
    return stage(known.union(unknown), "evidence")


def hashed(evidence: DataFrame, order: int, packed: bool = False) -> DataFrame:
    """(k, v): the evidence by 64-bit key; ``packed`` gives a batch as one row of two arrays' bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            signs = np.frombuffer("".join(part["key"]).encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = part["key"].str.len().to_numpy()
            ends = np.cumsum(lengths) - 1
            place = np.arange(len(signs)) - np.repeat(ends + 1 - lengths, lengths)
            h = _gram_hashes(signs, place, order)[0][ends]
            h = np.where(part["is_context"].to_numpy(), mix64(h ^ _A), h)
            k, v = h.view(np.int64), part["v"].to_numpy(np.float32)
            yield pd.DataFrame({"k": [k.tobytes()], "v": [v.tobytes()]} if packed else {"k": k, "v": v})

    return evidence.mapInPandas(run, "k binary, v binary" if packed else "k bigint, v float")


def keyed_model(evidence: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values), sorted by key; for evidence of at most ``MAX_KEYS`` rows."""
    # a batch comes as one row of two packed arrays: 12 bytes a key on the driver. Packed by the worker that hashes: a second
    # one per task would live on beside it, in all later stages
    packed = hashed(evidence, order, packed=True).collect()
    keys, values = np.frombuffer(b"".join(r.k for r in packed), np.uint64), np.frombuffer(b"".join(r.v for r in packed), np.float32)
    order_ = np.argsort(keys)
    return keys[order_], values[order_]


def word_evidence(words: list[str], keys: np.ndarray, values: np.ndarray, order: int) -> np.ndarray:
    """The log-likelihood difference of each word."""
    signs, place = _signs(words)
    if not len(signs):
        return np.zeros(0)

    def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
        return hit, np.where(hit, values[at], 0).astype(np.float64) if len(keys) else np.zeros(len(h))

    hit, v = look(_gram_hashes(signs, place, order)[0])
    _, back = look(_context_hashes(signs, place, order))
    v = np.where(hit, v, back)
    v[place == 0] = 0
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return np.add.reduceat(v, np.cumsum(lengths) - lengths)


def doc_features(x: np.ndarray) -> list[float]:
    """Mean evidence of a text's words: of all, of the best run of each length, of the second and third best word."""
    if not len(x):
        return [0.0] * len(FEATURES)
    cx = np.concatenate(([0.0], np.cumsum(x)))
    out = [float(cx[-1] / len(x))]
    for n in RUNS:
        n = min(n, len(x))
        out.append(float((cx[n:] - cx[:-n]).max() / n))
    top = np.sort(np.partition(x, max(len(x) - 3, 0))[-3:])[::-1]
    return [*out, float(top[min(1, len(top) - 1)]), float(top[min(2, len(top) - 1)])]


def groups(texts: pd.Series, chars: int) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``chars`` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], order: int) -> DataFrame:
    """doc_id and the features of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = shared.value
        known: dict[str, float] = {}
        size = 0
        for part in parts:
            rows = []
            for texts in groups(part["text"], GROUP_CHARS):
                split = [words_of(text) for text in texts]
                new = list(set(chain.from_iterable(split)).difference(known))
                size += sum(map(len, new)) + WORD_BYTES * len(new)
                if size > HELD_BYTES:
                    known.clear()
                    new = list(set(chain.from_iterable(split)))
                    size = sum(map(len, new)) + WORD_BYTES * len(new)
                known.update(zip(new, word_evidence(new, keys, values, order).tolist(), strict=True))
                rows += [doc_features(np.fromiter(map(known.__getitem__, words), np.float64, len(words))) for words in split]
            out = pd.DataFrame(rows, columns=list(FEATURES), dtype="float64")
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy() if part["doc_id"].notna().all() else pd.array(part["doc_id"], dtype="Int64"))
            yield out

    return docs.mapInPandas(lean(run), "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def evidence_by_join(docs: DataFrame, rows: DataFrame, order: int) -> DataFrame:
    """What ``evidence`` gives, for a model of any size: ``rows`` are joined with the n-grams of the distinct words."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row", "doc_id", "word", "at"]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"row": "int64", "doc_id": "Int64"})
        for part in parts:
            out = []
            ids = [None if pd.isna(x) else int(x) for x in part["doc_id"]]
            for row, doc_id, text in zip(part["row"], ids, part["text"], strict=True):
                at: dict[str | None, list[int]] = {}
                for i, word in enumerate(words_of(text)):
                    at.setdefault(word, []).append(i)
                out += [(row, doc_id, word, places) for word, places in (at or {None: []}).items()]
                if len(out) > 50_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    def letters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            signs, place = _signs(list(part["word"]))
            g, c = _gram_hashes(signs, place, order)[0], _context_hashes(signs, place, order)
            words = np.repeat(part["word"].to_numpy(object), part["word"].str.len() + 2)
            yield pd.DataFrame({"word": words[place > 0], "g": g[place > 0].view(np.int64), "c": c[place > 0].view(np.int64)})

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for xs, sizes, at in zip(part["xs"], part["sizes"], part["at"], strict=True):
                x = np.zeros(len(at))
                x[np.asarray(at, np.int64)] = np.repeat(np.asarray(xs, np.float64), np.asarray(sizes, np.int64))
                rows.append(doc_features(x))
            out = pd.DataFrame(rows, columns=list(FEATURES), dtype="float64")
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy() if part["doc_id"].notna().all() else pd.array(part["doc_id"], dtype="Int64"))
            yield out

    places = stage(docs.withColumn("row", F.monotonically_increasing_id()).mapInPandas(spread, "row bigint, doc_id bigint, word string, at array<int>"), "places")
    model = stage(hashed(rows, order).groupBy("k").agg(F.min("v").alias("v")), "keys")
    of_words = places.filter("word IS NOT NULL").select("word").distinct().mapInPandas(letters, "word string, g bigint, c bigint")
    known, back = model.select(F.col("k").alias("g"), F.col("v").alias("known")), model.select(F.col("k").alias("c"), F.col("v").alias("back"))
    signs = of_words.join(known.hint("merge"), "g", "left").join(back.hint("merge"), "c", "left")
    words = stage(signs.groupBy("word").agg(F.sum(F.coalesce("known", "back", F.lit(0.0)).cast("double")).alias("x")), "words")
    texts = (places.join(words.hint("merge"), "word", "left").groupBy("row")
             .agg(F.max("doc_id").alias("doc_id"), F.collect_list(F.coalesce("x", F.lit(0.0))).alias("xs"), F.collect_list(F.size("at")).alias("sizes"), F.flatten(F.collect_list("at")).alias("at")))
    return texts.drop("row").mapInPandas(features, "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER, for_calibration: int = 4, row: str | None = None) -> DataFrame:
    """For every row: doc_id, held_out, score, predicted.

    Labels are read only where crc32(doc_id) % 5 is not 0; of these rows one in ``for_calibration`` fits
    the logistic regression and the others the models. ``row`` names a bigint column that tells rows apart; the result then has it too.
    """
    bound_batches(docs.sparkSession)
    also = [] if row is None else [row]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), *also)
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1) & (fold() % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = stage(known.withColumn("part", F.floor(fold() / 5) % for_calibration), "labels")
    for_counts = known.filter("part <> 0").select("doc_id", "toxic")
    few = for_counts.count() <= BROADCAST_LABELS
    train = texts.join(F.broadcast(for_counts) if few else for_counts.hint("merge"), "doc_id").select("text", "toxic")
    rows = evidence_rows(count_grams(train, order), order)
    asked = texts if row is None else texts.select(F.col(row).alias("doc_id"), "text")
    scored = evidence(asked, keyed_model(rows, order), order) if rows.count() <= MAX_KEYS else evidence_by_join(asked, rows, order)
    found = stage(scored, "evidence")
    if row is not None:
        found = stage(found.withColumnRenamed("doc_id", row).join(texts.select(row, "doc_id").hint("merge"), row), "evidence-rows", done=(found,))
    fit_on = found.join(known.filter("part = 0").select("doc_id", "toxic").hint("merge"), "doc_id")
    found = found.withColumn("held_out", F.coalesce(fold() % 5 == 0, F.lit(False)))
    vector, score = "features_vector", F.col("score")
    if fit_on.select("toxic").distinct().count() == 2:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol=vector)
        fitted = LogisticRegression(featuresCol=vector, labelCol="toxic", maxIter=50, regParam=1e-3).fit(assemble.transform(fit_on))
        found = fitted.transform(assemble.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        found = found.withColumn("score", 1 / (1 + F.exp(PRIOR - F.col("best1"))))
    return found.select("doc_id", "held_out", "score", (score >= 0.5).cast("int").alias("predicted"), *also)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with all columns of ``docs``; each row is judged by its own text, whatever its doc_id."""
    key = fresh_name(docs, "toxic_row")
    numbered = stage(docs.withColumn(key, F.monotonically_increasing_id()), "toxic-rows")
    bad = stage(toxicity(numbered, labels, row=key).filter(F.col("score") >= threshold).select(key), "toxic")
    return numbered.join(bad, key, "left_anti").select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return toxicity(read("documents"), read("labels"))
