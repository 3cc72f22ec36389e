"""Node and edge tables, module graph, cycles, components and filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.metrics import edges
from strataflow.operators.store import cut


def graph_nodes(ent: DataFrame) -> DataFrame:
    modules = ent.select(F.concat_ws("/", "repository_id", "module").alias("id"), F.col("module").alias("label"), F.lit("module").alias("type")).distinct()
    entities = ent.select(F.col("entity_id").alias("id"), F.col("name").alias("label"), "type", "complexity")
    return modules.unionByName(entities, allowMissingColumns=True)


def graph_edges(ent: DataFrame, calls: DataFrame, module_edges: DataFrame, inheritance: DataFrame | None = None) -> DataFrame:
    """contains, call, imports, inherits and implements edges as a bag; imports of a module by itself are dropped.

    ``module_edges`` (src, dst) has the ids that modules have in ``graph_nodes``; ``inheritance`` (entity_id, parent_id, kind) has the parents that are known, by id or by a name that is unique.
    """
    contains = ent.select(F.concat_ws("/", "repository_id", "module").alias("source"), F.col("entity_id").alias("target"), F.lit("contains").alias("kind"))
    call = edges(calls).select("source", "target", F.lit("call").alias("kind"))
    imports = module_edges.filter("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("imports").alias("kind"))
    found = contains.unionByName(call).unionByName(imports)
    if inheritance is None:
        return found
    kind = F.when(F.col("kind") == "extends", "inherits").otherwise("implements")
    return found.unionByName(inheritance.filter("entity_id IS NOT NULL AND parent_id IS NOT NULL").select(F.col("entity_id").alias("source"), F.col("parent_id").alias("target"), kind.alias("kind")))


def module_dependency_graph(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Distinct pairs of different modules with a call edge between them."""
    at = lambda end, out: ent.select(F.col("entity_id").alias(end), F.col("module").alias(out))
    pairs = edges(calls).join(at("source", "src"), "source").join(at("target", "dst"), "target")
    return pairs.filter("src <> dst").select("src", "dst").distinct()


def module_cycles(edge: DataFrame, max_length: int | None = None) -> DataFrame:
    """Simple cycles of modules, one per set of members: (length, members); of any length unless ``max_length`` is given.

    Only edges inside a strong component can lie on a cycle. Paths start at their least node and grow by an equi-join,
    so a cycle is found once per direction. A dense graph has exponentially many cycles, as many as this returns.
    """
    parts = cyclic_components(edge)
    at = lambda end, out: parts.select(F.col("node").alias(end), F.col("component").alias(out))
    step = cut(edge.filter("src <> dst").select("src", "dst").distinct().join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a = b").select("src", "dst"))
    paths = step.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("tip"), F.array("src", "dst").alias("path"))
    onward = step.select(F.col("src").alias("tip"), F.col("dst").alias("next"))
    found = [edge.limit(0).select(F.lit(0).alias("length"), F.lit("").alias("members"))]
    length = 2
    while max_length is None or length <= max_length:
        grown = cut(paths.join(onward, "tip"))
        if grown.isEmpty():
            break
        found.append(grown.filter("next = start").select(F.size("path").alias("length"), F.array_join(F.sort_array("path"), ",").alias("members")))
        paths = grown.filter(F.expr("next > start AND NOT array_contains(path, next)")).select("start", F.col("next").alias("tip"), F.concat("path", F.array("next")).alias("path"))
        length += 1
    return reduce(DataFrame.unionByName, found).distinct()


#: Edges that one task may search on its own (some tens of MB).
EDGES_A_TASK = 100_000


def _strong(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of the nodes on cycles of a small graph, by two depth-first passes without recursion."""
    onward: dict = {}
    back: dict = {}
    for part in parts:
        for a, b in zip(part["src"].tolist(), part["dst"].tolist(), strict=True):
            onward.setdefault(a, []).append(b)
            onward.setdefault(b, [])
            back.setdefault(b, []).append(a)
    left, seen = [], set()
    for root in onward:
        if root in seen:
            continue
        seen.add(root)
        path = [(root, iter(onward[root]))]
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    path.append((other, iter(onward[other])))
                    break
            else:
                left.append(node)
                path.pop()
    out, seen = [], set()
    for root in reversed(left):
        members, waiting = [], [root] if root not in seen else []
        seen.add(root)
        while waiting:
            node = waiting.pop()
            members.append(node)
            for other in back.get(node, ()):
                if other not in seen:
                    seen.add(other)
                    waiting.append(other)
        if len(members) > 1:
            out += [(node, min(members)) for node in members]
    yield pd.DataFrame(out, columns=["node", "component"])


def _trimmed(left: DataFrame) -> DataFrame:
    """Edges whose source is entered and whose target is left: the others lie on no cycle."""
    return cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def _doubled(links: DataFrame, rounds: int) -> DataFrame:
    """(node, ptr, lo) of chains: ``links`` (node, next) followed to the first node that is in no link, by doubling; lo is the least node on the way.

    ``rounds`` doublings cover 2^rounds nodes. A row whose ``ptr`` is still in a link lies on a ring, and its lo is the ring's least node.
    """
    rows = cut(links.select("node", F.col("next").alias("ptr"), F.col("node").alias("lo")))
    for _ in range(rounds):
        ahead = rows.select(F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("lo").alias("far_lo"))
        rows = cut(rows.join(ahead, "ptr", "left").select("node", F.coalesce("far", "ptr").alias("ptr"), F.least("lo", F.coalesce("far_lo", "lo")).alias("lo"), F.col("far").isNotNull().alias("moved")), done=(rows,))
        if rows.filter("moved").isEmpty():
            break
    return rows.select("node", "ptr", "lo")


def contracted(left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chains, rings) of a graph without loops, with chains contracted by pointer doubling.

    A node with one way in and one way out is on a cycle exactly if the edge that its whole chain makes from the node before it to the node after
    it lies in one strong component. ``edges`` has those edges instead of the chains (an edge to itself where a chain leaves and enters one node);
    ``chains`` (node, a, b) has the ends of the chain around each such node, ``rings`` (node, component) the nodes of cycles without any other node.
    """
    into, out = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("prev")), left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("next"))
    inside = cut(into.join(out, "node").filter("n_in = 1 AND n_out = 1").select("node", "prev", "next"))
    rounds = max(1, inside.count()).bit_length() + 1
    links = lambda way: inside.select("node", F.col(way).alias("next"))
    after, before = _doubled(links("next"), rounds), _doubled(links("prev"), rounds)
    ends = after.select("node", F.col("ptr").alias("b"), "lo").join(before.select("node", F.col("ptr").alias("a")), "node")
    on_ring = ends.join(inside.select(F.col("node").alias("b"), F.lit(True).alias("ring")), "b", "left")
    rows = cut(on_ring.select("node", "a", "b", "lo", F.coalesce("ring", F.lit(False)).alias("ring")))
    known = inside.select("node")
    kept = left.join(known.withColumnRenamed("node", "src"), "src", "left_anti").join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    chains = rows.filter("NOT ring").select("node", "a", "b")
    edges_ = cut(kept.unionByName(chains.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct())
    return edges_, chains, rows.filter("ring").select("node", F.col("lo").alias("component"))


def cyclic_components(edge: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(node, component) of every node on a cycle of any length; component is the least node of its strong component.

    A graph of at most ``edges_a_task`` edges is searched in one task. Of a larger one, chains are contracted to single edges first, so that its
    rounds do not grow with their length; the rest is searched by ``_rounds``, and a chain whose edge lies in a component joins it.
    """
    left = cut(edge.filter("src <> dst").select("src", "dst").distinct())
    if left.count() <= edges_a_task:
        return _rounds(left, edges_a_task)
    edges_, chains, rings = contracted(left)
    found = cut(_rounds(cut(edges_.filter("src <> dst")), edges_a_task))
    # A node with a chain back to itself is a component even if it is in no other.
    loops = edges_.filter("src = dst").select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti").withColumn("component", F.col("node"))
    core = cut(found.unionByName(loops))
    at = lambda end: core.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    joined = chains.join(at("a"), "a").join(at("b"), "b").filter("a_part = b_part").select("node", F.col("a_part").alias("component"))
    both = core.unionByName(joined)
    least = both.groupBy("component").agg(F.min("node").alias("least"))
    return both.join(least, "component").select("node", F.col("least").alias("component")).unionByName(rings)


def _rounds(left: DataFrame, edges_a_task: int) -> DataFrame:
    """``cyclic_components`` of distinct edges without loops.

    A graph of more than ``edges_a_task`` edges loses, round by round, the edges that are entered or left by nothing, and is coloured: the
    least node that reaches each node spreads forward, then what reaches its colour's root backwards inside the colour is that root's
    strong component and leaves the graph.
    """
    kind = left.schema["src"].dataType.simpleString()
    out = []
    while left.count() > edges_a_task:
        before = left.count()
        left = _trimmed(left)
        if left.count() < before:
            continue
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            seen = left.join(colour, left.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("via"))
            after = cut(colour.join(seen, "node", "left").select("node", F.least("colour", F.coalesce("via", "colour")).alias("colour"), (F.col("via") < F.col("colour")).alias("moved")))
            colour = after.select("node", "colour")
            if after.filter("moved").isEmpty():
                break
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inner = cut(ends.filter("a = b").select("src", "dst", "a"))
        back = [colour.filter("node = colour")]
        newest, known = back[0], back[0].select("node")
        while not newest.isEmpty():
            newest = cut(inner.join(newest.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct().join(known, "node", "left_anti"))
            back.append(newest)
            known = cut(known.unionByName(newest.select("node")))
        part = cut(reduce(DataFrame.unionByName, back))
        sizes = part.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour")
        out.append(part.join(sizes, "colour", "left_semi").select("node", F.col("colour").alias("component")))
        left = cut(left.join(known.withColumnRenamed("node", "src"), "src", "left_anti").join(known.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    out.append(left.coalesce(1).mapInPandas(_strong, f"node {kind}, component {kind}"))
    return reduce(DataFrame.unionByName, out)


def graph_filter(nodes: DataFrame, edge: DataFrame, kind: str | None = None, text: str = "", high_risk: DataFrame | None = None, circular: DataFrame | None = None) -> DataFrame:
    """The induced subgraph as edges, by semi-joins: of one kind, between nodes whose label or id contains a text.

    ``high_risk`` (id) keeps edges between risky nodes, ``circular`` (id) those between nodes on a cycle.
    """
    wanted = nodes.filter(F.lower("label").contains(text.lower()) | F.lower("id").contains(text.lower())).select("id")
    for more in (high_risk, circular):
        wanted = wanted if more is None else wanted.join(more.select("id"), "id", "left_semi")
    rows = edge if kind is None else edge.filter(F.col("kind") == kind)
    return (rows.join(wanted.withColumnRenamed("id", "source"), "source", "left_semi")
            .join(wanted.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind"))
