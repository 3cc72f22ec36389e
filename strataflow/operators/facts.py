"""All facts of a file as one tree, assembled bottom-up, and its JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import extract as X
from strataflow.operators.store import cut, sorted_join
from strataflow.operators.tokens import KEY


def file_facts(code: DataFrame) -> DataFrame:
    """(repository_id, path, language, entities, imports, module_calls) of files; entities with their own calls, arguments, globals and parents.

    Every list is grouped at its own level and sorted, so two analyses of one file give one tree; a text that several files hold has one tree. All facts of
    entities are grouped once, so they meet in one shuffle.
    """
    files, code = X.distinct_texts(code)
    done = X.analyse(code, "parameters", "signatures", "strings", "calls", "inheritance", "names", "points", "imports")
    names = X.NAME
    listed = lambda df, by, fields, out: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    found = X.definitions(code, done)
    local = found.select(*KEY, F.col("name").alias("tail")).distinct().withColumn("resolved", F.lit(True))
    calls = X.extract_calls(code, done).withColumn("tail", F.substring_index("callee_name", ".", -1)).join(sorted_join(local), [*KEY, "tail"], "left")
    calls = calls.select(*KEY, F.col("caller").alias("qualified_name"), "line", F.col("callee_name").alias("name"), (F.coalesce("resolved", F.lit(False)) & ~F.col("dynamic")).alias("resolved"), "dynamic")
    call = ("line", "name", "resolved", "dynamic")
    parameters = cut(X.parameters(code, done))
    one = lambda df, c, value: df.select(*names, value.alias(c))
    parts = (
        one(calls.filter("qualified_name <> ''"), "calls", F.struct(*call)),
        one(X.extract_inheritance(code, done).select(*KEY, F.col("entity").alias("qualified_name"), "line", F.col("parent_name").alias("name"), "kind"), "inheritances", F.struct("line", "name", "kind")),
        one(X.arguments(parameters), "arguments", F.struct("pos", "argument")),
        one(X.globals_used(code, done), "globals_used", F.col("global_name")),
        one(X.docstrings(code, done), "docstring", F.col("doc")),
        one(X.cyclomatic_complexity(code, done).unionByName(X.class_complexity(code, done)), "complexity", F.col("complexity")),
        one(X.signatures(code, done, parameters), "signature", F.col("signature")),
    )
    several = lambda c: F.array_sort(F.collect_list(c)).alias(c)
    about = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy(*names).agg(
        several("calls"), several("inheritances"), F.transform(F.array_sort(F.collect_list("arguments")), lambda a: a["argument"]).alias("arguments"), F.array_sort(F.collect_set("globals_used")).alias("globals_used"),
        F.min("docstring").alias("docstring"), F.max("complexity").alias("complexity"), F.min("signature").alias("signature"))
    rows = found.select(*names, "line_start", "line_end", "name", "kind", "parent", "is_public").join(sorted_join(about), names, "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    entity = ["line_start", "line_end", "name", "kind", "parent", "qualified_name", "signature", "is_public", "docstring", "complexity", *map(none, ("arguments", "globals_used", "calls", "inheritances"))]
    entities = listed(rows, KEY, entity, "entities")
    imports = listed(X.extract_imports(code, done), KEY, ("line", "module", "local_name", "kind"), "imports")
    outside = listed(calls.filter("qualified_name = ''"), KEY, call, "module_calls")
    trees = code.select(*KEY)
    for part in (entities, imports, outside):
        trees = trees.join(sorted_join(part), KEY, "left")
    out = X.in_files(files, trees, "left")
    return out.select(*KEY, "language", *(F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("entities", "imports", "module_calls")))


def to_json(facts: DataFrame) -> DataFrame:
    """(repository_id, path, json): a file's tree as text; nulls are kept."""
    return facts.select(*KEY, F.to_json(F.struct(*facts.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame, schema) -> DataFrame:
    """The trees of JSON texts (json) by the schema of ``file_facts``; a text that is no object, lacks a part or has another type there goes to ``reason``."""
    tree = F.try_parse_json("json")
    kinds = {"entities": "ARRAY", "imports": "ARRAY", "module_calls": "ARRAY", "path": "STRING"}
    wrong = [F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(tree, f"$.{c}", "variant")).startswith(kind), F.lit(False)), F.lit(f"{c} is no {kind.lower()}")) for c, kind in kinds.items()]
    reason = F.when(tree.isNull(), "no JSON").otherwise(F.coalesce(*wrong))
    return texts.withColumn("reason", reason).withColumn("facts", F.when(F.col("reason").isNull(), F.from_json("json", schema)))
