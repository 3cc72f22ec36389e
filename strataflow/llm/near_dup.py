"""Near-duplicate groups by a Chosen Path set similarity join.

1. Each text becomes its set of k-word shingles (64-bit fingerprints), a digest of that set and a MinHash
   of ``COORDS`` coordinates (one permutation, empty bins filled from others). Texts with equal sets form a
   class; only one document of a class goes on.
2. Every tree sends a document down from its root: at a node, one or two coordinates are chosen by the
   node's hash (1/threshold on average), and each chosen coordinate's value leads to a child. Two texts of
   similarity s stay together in a child with probability s, so similar ones share a path and others part.
   Nodes of one document are dropped, small ones are leaves, large ones branch again.
3. Leaves are compared exhaustively on sizes and MinHash estimates. First the estimate's spanning forest of
   each leaf of a few trees is verified on the full sets and contracted into components; then all candidate
   pairs of all leaves that still lie in different components are held against samples of their sets (the
   whole sets up to ``SAMPLE`` shingles) inside the leaf, and what passes is verified. Pairs inside a component
   can add nothing, and pairs that only resemble each other end inside their leaf, so groups of near copies
   send on as much as their size, not its square.
4. A node that stays large at the last level (thousands of near copies) is split: into blocks for the
   forest, and then into pairs of (block, block of the members outside its largest component).

No pair is capped or sampled. By the branching model, with the noise of its MinHash, a lone pair at the
threshold is missed by all 12 trees with a chance of 4.1e-06, 4.4e-04, 3.5e-03 at 0.85 and
2.1e-05, 1.4e-03, 8.9e-03 at 0.80, where its nodes descend 3, 6 and 9 levels.

Classes have numbers of their own, so one doc_id may carry several texts: its classes count as linked.

Defined cases: null or wordless text has an empty set and is linked with nothing; fewer than k words give
one shingle, the whole sequence; equal sets are always linked; repeated rows with one doc_id are one
document, with different texts too; rows without doc_id are linked like others, each for itself, and take the least
doc_id of their component, null if it has none (such rows all count as kept); an empty table gives an empty result; extra columns are
ignored by ``near_groups`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bound_batches, fresh_name, lean, stage, text_of
from strataflow.llm.components import components
from strataflow.llm.shingles import WordHashes, mix64, shingle_set, similar

COORD_BITS = 7
COORDS = 1 << COORD_BITS
LEVELS = 3  # levels that one round descends
ROUNDS = 3  # rounds at most: nodes that are large after them are split
LEAF = 64
SAMPLE = 256  # fingerprints at most in a set's sample
FIRST_TREES = 4  # trees whose leaves give the first forest
#: Stands for a missing doc_id.
LAST_ID = 2**63 - 1
FEATURES = "doc_id bigint, text_hash bigint, n_shingles bigint, set_digest binary, minhash binary"
_EDGES = (np.arange(COORDS, dtype=np.uint64) << np.uint64(64 - COORD_BITS)).astype(np.uint64)
_PROBE = (mix64(np.arange(COORDS * 96, dtype=np.uint64)) % np.uint64(COORDS)).astype(np.int64).reshape(COORDS, 96)
_K, _S1, _S2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0x1B873593A2F4C6D1), np.uint64(0x2545F4914F6CDD1D)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of an ascending array: the least value of each bin, 16 bits of it."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.append(at[1:], len(shingles)) > at
    values = (shingles[np.minimum(at, len(shingles) - 1)] >> np.uint64(64 - COORD_BITS - 16)).astype(np.uint16)
    if not full.all():
        empty = np.nonzero(~full)[0]
        found = full[_PROBE[empty]]
        values[empty] = values[_PROBE[empty, found.argmax(1)]]
        lost = empty[~found.any(1)]
        if len(lost):
            values[lost] = values[np.nonzero(full)[0][0]]
    return values


def _features(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            n, digests, minima = [], [], []
            for text in part["text"]:
                s = shingle_set(text, k, hashes)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                minima.append(minhash(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "n_shingles": n, "set_digest": digests, "minhash": minima})

    return run


def branch(nodes: np.ndarray, rows: np.ndarray, minima: np.ndarray, levels: int, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Children ``levels`` below ``nodes`` of the documents ``rows``: the choice of coordinates is the node's alone."""
    for _ in range(levels):
        h = mix64(nodes ^ _S1)
        c1 = (h % np.uint64(COORDS)).astype(np.int64)
        c2 = (c1 + 1 + ((h >> np.uint64(32)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
        two = (mix64(nodes ^ _S2) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < extra
        down = lambda n, c, r: mix64(n * _K + ((c.astype(np.uint64) << np.uint64(16)) | minima[r, c]))
        nodes, rows = (np.concatenate((down(nodes, c1, rows), down(nodes[two], c2[two], rows[two]))), np.concatenate((rows, rows[two])))
    return nodes, rows


def _minima(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), COORDS)


def _from_roots(trees: int, extra: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            minima, ids = _minima(part["minhash"]), part["rep"].to_numpy()
            for tree in range(trees):
                root = mix64(np.full(len(ids), tree + 1, np.uint64))
                nodes, rows = branch(root, np.arange(len(ids)), minima, LEVELS, extra)
                yield pd.DataFrame({"tree": np.full(len(rows), tree, np.int16), "node": nodes.view(np.int64), "rep": ids[rows]})

    return run


def _deeper(extra: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            nodes, rows = branch(part["node"].to_numpy().view(np.uint64), np.arange(len(part)), _minima(part["minhash"]), LEVELS, extra)
            yield pd.DataFrame({"tree": part["tree"].to_numpy()[rows], "node": nodes.view(np.int64), "rep": part["rep"].to_numpy()[rows]})

    return run


def candidate_pairs(reps: np.ndarray, sizes: np.ndarray, minima: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, agreement) of a leaf that sizes and MinHash do not rule out (five standard errors of slack)."""
    i, j = np.triu_indices(len(reps), 1)
    low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    ok = (100 * low >= percent * high) & (reps[i] != reps[j])
    i, j, low = i[ok], j[ok], low[ok]
    agree = (minima[i] == minima[j]).mean(1)
    t = percent / 100
    ok = agree >= t - 5 * np.sqrt(t * (1 - t) / np.minimum(low, COORDS)) - 1e-9
    return i[ok], j[ok], agree[ok]


def _forest(percent: int):
    """The spanning forest of greatest agreement among a leaf's candidates."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for reps, sizes, minima in zip(part["reps"], part["sizes"], part["minima"], strict=True):
                reps = np.asarray(reps)
                i, j, agree = candidate_pairs(reps, np.asarray(sizes), _minima(minima), percent)
                a, b = np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j])
                parent: dict[int, int] = {}
                for at in np.lexsort((b, a, -agree)).tolist():
                    x, y = int(a[at]), int(b[at])
                    while parent.get(x, x) != x:
                        x = parent[x]
                    while parent.get(y, y) != y:
                        y = parent[y]
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((int(a[at]), int(b[at])))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def sample_level(n: np.ndarray) -> np.ndarray:
    """The power of two by which a set of n shingles is thinned so that at most about ``SAMPLE`` are left."""
    return np.ceil(np.log2(np.maximum(n, SAMPLE) / SAMPLE)).astype(np.int64)


def thinned(shingles: np.ndarray) -> np.ndarray:
    """The fingerprints below 2**(64 - level), without their last 8 bits."""
    level = int(sample_level(np.array([len(shingles)]))[0])
    return (shingles[: np.searchsorted(shingles, np.uint64(1) << np.uint64(64 - level))] if level else shingles) >> np.uint64(8)


def _thin(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            yield pd.DataFrame({"rep": part["rep"], "sample": [thinned(shingle_set(t, k, hashes)).tobytes() for t in part["text"]]})

    return run


def sample_survivors(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, samples: list[bytes], percent: int) -> np.ndarray:
    """Which pairs the samples do not rule out: exact where both are whole sets, else with five standard errors of slack."""
    keep, t = np.zeros(len(i), bool), percent / 100
    sets, level = [np.frombuffer(b, np.uint64) for b in samples], sample_level(sizes)
    pair_level = np.maximum(level[i], level[j])
    for at in np.unique(pair_level):
        now = np.nonzero(pair_level == at)[0]
        members = np.unique(np.concatenate((i[now], j[now])))
        top = np.uint64(1) << np.uint64(56 - int(at))
        parts = [sets[m][: np.searchsorted(sets[m], top)] for m in members]
        n = np.array([len(x) for x in parts])
        _, column = np.unique(np.concatenate(parts), return_inverse=True)
        table = np.zeros((len(members), int(column.max(initial=-1)) + 1), np.float32)
        table[np.repeat(np.arange(len(members)), n), column] = 1
        x, y = np.searchsorted(members, i[now]), np.searchsorted(members, j[now])
        common = (table @ table.T)[x, y]
        union = np.maximum(n[x] + n[y] - common, 1)
        slack = 5 * np.sqrt(t * (1 - t) / union) if at else 0.0
        keep[now] = common / union >= t - slack - 1e-6
    return keep


def _across(percent: int):
    """Candidates of a leaf (or of two blocks) that lie in different components and pass on the samples."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for reps, sizes, minima, labels, sides, samples in zip(part["reps"], part["sizes"], part["minima"], part["labels"], part["sides"], part["samples"], strict=True):
                reps, sizes, labels, sides = np.asarray(reps), np.asarray(sizes), np.asarray(labels), np.asarray(sides)
                i, j, _ = candidate_pairs(reps, sizes, _minima(minima), percent)
                ok = (labels[i] != labels[j]) & ((sides[i] == 0) | (sides[i] != sides[j]))
                i, j = i[ok], j[ok]
                if len(i):
                    ok = sample_survivors(i, j, sizes, list(samples), percent)
                    out.append(np.stack((np.minimum(reps[i], reps[j])[ok], np.maximum(reps[i], reps[j])[ok]), 1))
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _verified(k: int, percent: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, left = WordHashes(), None, np.empty(0, np.uint64)
        for part in parts:
            keep = []
            for a, text_a, text_b in zip(part["a"], part["text_a"], part["text_b"], strict=True):
                if a != last:
                    last, left = a, shingle_set(text_a, k, hashes)
                keep.append(similar(left, shingle_set(text_b, k, hashes), percent))
            yield part.loc[keep, ["a", "b"]]

    return run


def leaves(reps: DataFrame, percent: int, trees: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(tree, node, rep) of leaves, (tree, node, rep, members) of nodes that stay large, and the staged frames behind both."""
    extra = 100 / percent - 1
    paths = reps.select("rep", "minhash").mapInPandas(_from_roots(trees, extra), "tree smallint, node bigint, rep bigint")
    small, held = None, []
    for turn in range(ROUNDS):
        if turn:
            with_minima = large.join(reps.select("rep", "minhash").hint("merge"), "rep")
            paths = with_minima.mapInPandas(_deeper(extra), "tree smallint, node bigint, rep bigint")
            paths = stage(paths, "paths")
            held.append(paths)
        counts = paths.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        counts = stage(counts, "members")  # an aggregate in the join itself would keep adaptive execution from splitting hot nodes
        held.append(counts)
        found = stage(paths.join(counts.hint("merge"), "node"), "nodes")
        held.append(found)
        now = found.filter(F.col("members") <= LEAF).select("tree", "node", "rep")
        small = now if small is None else small.unionByName(now)
        large = found.filter(F.col("members") > LEAF)
        if large.isEmpty():
            break
    return small, large, held


def _gather(rows: DataFrame, keys: list[str], reps: DataFrame, more: list[str]) -> DataFrame:
    lists = [F.collect_list(c).alias(n) for c, n in (("rep", "reps"), ("n_shingles", "sizes"), ("minhash", "minima"), *((m, f"{m}s") for m in more))]
    return rows.join(reps.hint("merge"), "rep").groupBy(*keys).agg(*lists)


def link_classes(reps: DataFrame, texts_of: DataFrame, known: DataFrame, k: int, percent: int, trees: int = 12) -> DataFrame:
    """(id, component) of the classes that are linked with another one; ``known`` holds links (a, b) besides."""
    small, large, held = leaves(reps, percent, trees)
    pairs_type, n_blocks = "a bigint, b bigint", F.ceil(F.col("members") / LEAF)
    first = small.select("tree", "node", F.lit(0).alias("block"), "rep").unionByName(
        large.select("tree", "node", F.pmod(F.xxhash64("rep", "tree"), n_blocks).cast("int").alias("block"), "rep")).filter(F.col("tree") < FIRST_TREES)
    tried = stage(_gather(first, ["node", "block"], reps, []).mapInPandas(lean(_forest(percent)), pairs_type).distinct(), "tried")
    # any further candidate may join two of these or others, so texts are kept for all that share a node
    shared = small.select("rep").union(large.select("rep")).distinct()
    texts = stage(texts_of.join(shared.hint("merge"), "rep", "left_semi").dropDuplicates(["rep"]), "texts")  # repeated rows are alike

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInPandas(lean(_verified(k, percent)), pairs_type)

    links = stage(verify(tried).unionByName(known), "links")
    labels = components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("id").alias("rep"), F.col("component")).hint("merge"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")

    open_leaves = labelled(small).withColumn("side", F.lit(0))
    mixed = open_leaves.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("node")
    rows = open_leaves.join(mixed.hint("merge"), "node", "left_semi").select("node", F.lit(0).alias("block"), F.lit(0).alias("other"), "rep", "label", "side")
    if not large.isEmpty():
        split = stage(labelled(large), "split")
        held.append(split)
        shares = split.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        main = shares.groupBy("node").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select("node", F.col("top.label").alias("main"), (F.col("all") - F.col("top.n")).alias("outside")).filter("outside > 0")
        main = stage(main, "main")
        held.append(main)
        parts = split.join(main.hint("merge"), "node").withColumn("others", F.ceil(F.col("outside") / LEAF)).withColumn("blocks", n_blocks)
        block, other = F.pmod(F.xxhash64("rep"), "blocks").cast("int"), F.pmod(F.xxhash64("rep"), "others").cast("int")
        ones = parts.select("node", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("others").cast("int") - 1)).alias("other"), "rep", "label", F.lit(1).alias("side"))
        twos = parts.filter("label <> main").select("node", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), other.alias("other"), "rep", "label", F.lit(2).alias("side"))
        rows = rows.unionByName(ones).unionByName(twos)
    rows = stage(rows, "mixed", done=(*held, labels))
    samples = texts.join(rows.select("rep").distinct().hint("merge"), "rep", "left_semi").mapInPandas(lean(_thin(k)), "rep bigint, sample binary")
    members = stage(reps.join(samples.hint("merge"), "rep"), "members")
    more = _gather(rows, ["node", "block", "other"], members, ["label", "side", "sample"]).mapInPandas(lean(_across(percent)), pairs_type).distinct()
    more = stage(more.join(tried.hint("merge"), ["a", "b"], "left_anti"), "more", done=(tried, rows, members))
    added = stage(verify(more), "links", done=(more, texts))
    return components(links.unionByName(added))


def _grouped(docs: DataFrame, k: int, percent: int, trees: int) -> DataFrame:
    """For every row: doc_id (``LAST_ID`` where it has none), text_hash, n_shingles, component (the like)."""
    bound_batches(docs.sparkSession)
    text = text_of()
    # rows without doc_id sort last, so a class has the least doc_id of its rows if there is any
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    features = stage(rows.mapInPandas(lean(_features(k)), FEATURES), "features")
    full = features.filter("n_shingles > 0")
    classes = full.groupBy("set_digest").agg(F.min("doc_id").alias("least"))
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    mine = full.join(classes.hint("merge"), "set_digest").filter("doc_id = least")
    reps = stage(mine.select("rep", "doc_id", "text_hash", "n_shingles", "minhash").dropDuplicates(["rep"]), "reps")  # rows of a class have one set
    h = F.xxhash64("set_digest")
    several = stage(full.filter(F.col("doc_id") < LAST_ID).groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo < hi").select("doc_id"), "several-texts")
    same_id = full.sparkSession.createDataFrame([], "a bigint, b bigint")
    if not several.isEmpty():
        theirs = stage(full.join(several.hint("merge"), "doc_id").select("doc_id", "set_digest").join(classes.hint("merge"), "set_digest").select("doc_id", "rep"), "several-texts")
        same_id = theirs.groupBy("doc_id").agg(F.min("rep").alias("a")).join(theirs.hint("merge"), "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
    texts_of = rows.join(reps.select("doc_id", "text_hash", "rep").hint("merge"), ["doc_id", "text_hash"]).select("rep", "text")
    found = link_classes(reps.select("rep", "n_shingles", "minhash"), texts_of, same_id, k, percent, trees)
    named = classes.join(found.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").select("set_digest", "least", F.coalesce("component", "rep").alias("label"))
    named = stage(named, "named", done=(reps,))
    best = named.groupBy("label").agg(F.min("least").alias("component"))
    named = stage(named.join(best.hint("merge"), "label").select("set_digest", "component"), "named", done=(named,))
    out = features.select("doc_id", "text_hash", "n_shingles", "set_digest").join(named.hint("merge"), "set_digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 12) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id (least doc_id that links reach), kept."""
    real = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return _grouped(docs, k, percent, trees).select(real("doc_id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 12) -> DataFrame:
    """The rows of one document of each group (the least doc_id), with all columns of ``docs``."""
    key, text_key = fresh_name(docs, "near_key"), fresh_name(docs, "near_text")
    dropped = _grouped(docs, k, percent, trees).filter("doc_id <> component").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key))
    gone = stage(dropped.distinct(), "dropped")
    same = (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST_ID)) == gone[key]) & (F.xxhash64(text_of(docs["text"])) == gone[text_key])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
