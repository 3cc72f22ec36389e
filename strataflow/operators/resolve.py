"""Name resolution and lookups as keyed joins; every lookup side is reduced to one row per key first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions.paths import stem
from strataflow.operators.store import sorted_join

KEY = ["repository_id", "path"]
PARTS_OF_NAME = 4  # calls of one name and module that are counted apart
last = lambda name: F.substring_index(name, ".", -1)


def first_entity_by_name(ent: DataFrame) -> DataFrame:
    """Per module, the first entity (by id) of each simple name."""
    w = W.partitionBy("repository_id", "module", "name").orderBy("entity_id")
    return ent.withColumn("n", F.row_number().over(w)).filter("n = 1").select("repository_id", "module", "name", "entity_id")


def unique_name_match(ent: DataFrame) -> DataFrame:
    """Names that exactly one entity of the repository has."""
    return ent.groupBy("repository_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1").drop("n")


def with_caller(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Calls with the caller's module; calls whose caller is unknown go."""
    return calls.join(ent.select(F.col("entity_id").alias("caller_id"), F.col("module").alias("caller_module")), "caller_id")


def resolve_calls_local(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Callees in the caller's own module: by the full name, then by its last segment."""
    local, rows = first_entity_by_name(ent), with_caller(calls, ent).select("repository_id", "caller_id", "caller_module", "callee_name", "call_line")
    by = lambda names, key, out: names.select("repository_id", F.col("module").alias("caller_module"), F.col("name").alias(key), F.col("entity_id").alias(out))
    short = by(local.filter(~F.col("name").contains(".")), "tail", "short")
    here = [rows[c] == short[c] for c in ("repository_id", "caller_module")]
    found = rows.join(short, [*here, last(rows["callee_name"]) == short["tail"]], "left").select(*(rows[c] for c in rows.columns), "short")
    if ent.filter(F.col("name").contains(".")).isEmpty():  # then a full name that is found is its own last segment
        target = F.col("short")
    else:
        found = found.join(by(local.filter(F.col("name").contains(".")), "callee_name", "full"), ["repository_id", "caller_module", "callee_name"], "left")
        target = F.coalesce("full", "short")
    return found.select("repository_id", "caller_id", "callee_name", "call_line", target.alias("resolved_id"), target.isNull().alias("external"))


def resolve_calls_repo(calls: DataFrame, ent: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Callees by four tiers: own module, module named before the dot, import alias, name unique in the repository.

    ``aliases`` (repository_id, module, alias, target_module) are a module's import aliases. Dynamic calls
    stay unresolved.
    """
    local, unique = first_entity_by_name(ent), unique_name_match(ent)
    rows = with_caller(calls, ent).withColumn("tail", last("callee_name")).withColumn("head", F.when(F.col("callee_name").contains("."), F.regexp_extract("callee_name", r"^(.*)\.[^.]*$", 1)))
    named = lambda module, out: local.select("repository_id", F.col("module").alias(module), F.col("name").alias("tail"), F.col("entity_id").alias(out))
    rows = (rows.join(named("caller_module", "t1"), ["repository_id", "caller_module", "tail"], "left")
            .join(named("head", "t2"), ["repository_id", "head", "tail"], "left"))
    if aliases is None:
        rows = rows.withColumn("t3", F.lit(None).cast("string"))
    else:
        via = aliases.select("repository_id", F.col("module").alias("caller_module"), F.col("alias").alias("head"), "target_module").dropDuplicates(["repository_id", "caller_module", "head"])
        rows = rows.join(via, ["repository_id", "caller_module", "head"], "left").join(named("target_module", "t3"), ["repository_id", "target_module", "tail"], "left")
    rows = rows.join(unique.select("repository_id", F.col("name").alias("tail"), F.col("entity_id").alias("t4")), ["repository_id", "tail"], "left")
    tier = F.coalesce(*(F.when(F.col(f"t{i}").isNotNull() & ~F.col("dynamic"), F.lit(i)) for i in range(1, 5)))
    target = F.when(~F.col("dynamic"), F.coalesce("t1", "t2", "t3", "t4"))
    return rows.select("repository_id", "caller_id", "callee_name", "call_line", "dynamic", target.alias("resolved_id"), tier.alias("tier"))


def callers_of(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Callers of every entity: calls that carry its id, its name, or a dotted name that ends in it.

    The disjunction is a union of two equi-joins; a caller counts once per (name, module, line).
    """
    who = calls.join(ent.select(F.col("entity_id").alias("caller_id"), F.col("name").alias("caller"), F.col("module").alias("caller_module")), "caller_id")
    by_id = who.filter("callee_id IS NOT NULL").select("repository_id", F.col("callee_id").alias("entity_id"), "caller", "caller_module", "call_line")
    targets = ent.select("repository_id", F.col("name").alias("tail"), "entity_id")
    by_name = (who.withColumn("tail", last("callee_name")).join(targets, ["repository_id", "tail"])
               .select("repository_id", "entity_id", "caller", "caller_module", "call_line"))
    return by_id.unionByName(by_name).distinct()


def caller_totals(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """(repository_id, entity_id, callers, modules): sizes of what ``callers_of`` lists, for entities with callers.

    Calls by name are counted once per (repository, name) and by id once per entity, less those that the entity's name has already; a name of many calls
    and many entities thus costs the sum of both, not the product.
    """
    at = ["caller", "caller_module", "call_line"]
    who = calls.join(ent.select(F.col("entity_id").alias("caller_id"), F.col("name").alias("caller"), F.col("module").alias("caller_module")), "caller_id")
    # Dealt by a part of what is counted, so that distinct rows and their sums per name and module need no further shuffle of calls.
    part = F.pmod(F.xxhash64("caller", "call_line"), F.lit(PARTS_OF_NAME)).alias("part")
    named = who.select("repository_id", last("callee_name").alias("name"), *at, part).repartition("repository_id", "name", "caller_module", "part").distinct()
    per_module = named.groupBy("repository_id", "name", "caller_module", "part").agg(F.count(F.lit(1)).alias("n"))
    by_name = per_module.groupBy("repository_id", "name").agg(F.sum("n").alias("n"), F.count_distinct("caller_module").alias("m"))
    target = ent.select("repository_id", "entity_id", "name").distinct()
    # A call by id whose name is the entity's is counted by name already; only the others are compared with the calls by name.
    by_id = (who.filter("callee_id IS NOT NULL").select("repository_id", F.col("callee_id").alias("entity_id"), last("callee_name").alias("tail"), *at)
             .join(target, ["repository_id", "entity_id"], "left").filter(~F.col("tail").eqNullSafe(F.col("name")) | F.col("name").isNull()).drop("tail").distinct())
    null_safe = lambda left, right, keys: [left[k].eqNullSafe(right[k]) for k in keys]
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = target.join(by_name, ["repository_id", "name"], "left")
    if by_id.isEmpty():
        return all_.select("repository_id", "entity_id", zero("n").alias("callers"), zero("m").alias("modules")).filter("callers > 0")
    more = by_id.join(named, null_safe(by_id, named, ["repository_id", "name", *at]), "left_anti").groupBy("repository_id", "entity_id").agg(F.count(F.lit(1)).alias("more_n"))
    at_module, in_module = by_id.select("repository_id", "entity_id", "name", "caller_module").distinct(), per_module.select("repository_id", "name", "caller_module").distinct()
    more_modules = at_module.join(in_module, null_safe(at_module, in_module, ["repository_id", "name", "caller_module"]), "left_anti").groupBy("repository_id", "entity_id").agg(F.count("caller_module").alias("more_m"))
    all_ = all_.join(more, ["repository_id", "entity_id"], "full").join(more_modules, ["repository_id", "entity_id"], "left")
    rows = all_.select("repository_id", "entity_id", (zero("n") + zero("more_n")).alias("callers"), (zero("m") + zero("more_m")).alias("modules"))
    return rows.filter("callers > 0")


def callees_of(calls: DataFrame, ent: DataFrame) -> DataFrame:
    """Callees of every caller with their module where the id is known; once per (name, module)."""
    target = ent.select(F.col("entity_id").alias("callee_id"), F.col("name").alias("target"), "module")
    rows = calls.join(target, "callee_id", "left").select("repository_id", F.col("caller_id").alias("entity_id"), F.coalesce("target", "callee_name").alias("callee"), F.coalesce("module", F.lit("")).alias("module"))
    return rows.distinct()


def containment(nodes: DataFrame) -> DataFrame:
    """(parent, child, depth) of repository -> module -> entity."""
    top = nodes.select(F.lit("root").alias("parent"), F.col("repository_id").alias("child"), F.lit(1).alias("depth"))
    mid = nodes.select(F.col("repository_id").alias("parent"), F.concat_ws("/", "repository_id", "module").alias("child"), F.lit(2).alias("depth"))
    low = nodes.select(F.concat_ws("/", "repository_id", "module").alias("parent"), F.col("entity_id").alias("child"), F.lit(3).alias("depth"))
    return top.distinct().unionByName(mid.distinct()).unionByName(low)


def file_node() -> F.Column:
    return F.concat_ws("/", "repository_id", "path")


def entity_id(name: str = "qualified_name") -> F.Column:
    """The id of a definition: repository, path and qualified name."""
    return F.concat_ws("::", file_node(), name)


def containment_of_code(found: DataFrame) -> DataFrame:
    """(parent, child, depth) of repository -> file -> definition -> definitions in it, as deep as they go."""
    top = found.select(F.lit("root").alias("parent"), F.col("repository_id").alias("child"), F.lit(1).alias("depth")).distinct()
    mid = found.select(F.col("repository_id").alias("parent"), file_node().alias("child"), F.lit(2).alias("depth")).distinct()
    depth = F.when(F.col("parent") == "", 3).otherwise(F.size(F.split("parent", r"\.")) + 3)
    low = found.select(F.when(F.col("parent") == "", file_node()).otherwise(entity_id("parent")).alias("parent"), entity_id().alias("child"), depth.alias("depth"))
    return top.unionByName(mid).unionByName(low)


def parent_link(found: DataFrame) -> DataFrame:
    """Each definition with the one that holds it: the definition of that qualified name in the same file, the last one before it."""
    inner = found.select("repository_id", "path", "qualified_name", "parent", "line_start")
    outer = found.select(F.col("repository_id").alias("r"), F.col("path").alias("p"), F.col("qualified_name").alias("q"), F.col("line_start").alias("at"), F.col("line_end").alias("to"))
    around = (F.col("r") == F.col("repository_id")) & (F.col("p") == F.col("path")) & (F.col("q") == F.col("parent")) & (F.col("at") < F.col("line_start")) & (F.col("line_start") <= F.col("to"))
    held = inner.join(sorted_join(outer), around, "left")
    return held.select(entity_id().alias("child"), F.when(F.col("at").isNotNull(), entity_id("parent")).alias("parent"), F.col("at").alias("parent_line"))


def source_slice(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines line_start..line_end (from 1, clamped) of each range's file; empty where nothing is left."""
    lines = F.split("text", "\n")
    start = F.greatest(F.col("line_start"), F.lit(1))
    n = F.least(F.col("line_end"), F.size(lines)) - start + 1
    code = F.when(n > 0, F.array_join(F.slice(lines, start.cast("int"), F.greatest(n, F.lit(0)).cast("int")), "\n")).otherwise("")
    return ranges.join(files.select("file_id", "text"), "file_id").select("file_id", "line_start", "line_end", code.alias("code"))


def evidence_validate(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Citations with a verdict: ok, no file, or bad range; valid ones carry the true slice."""
    lines = F.split("text", "\n")
    ok = (F.col("line_start") > 0) & (F.col("line_start") <= F.col("line_end"))
    n = F.least(F.col("line_end"), F.size(lines)) - F.col("line_start") + 1
    found = claims.join(files.select("file_id", "text"), "file_id", "left")
    verdict = F.when(F.col("text").isNull(), "no file").when(~ok, "bad range").otherwise("ok")
    code = F.when((verdict == "ok") & (n > 0), F.array_join(F.slice(lines, F.greatest(F.col("line_start"), F.lit(1)).cast("int"), F.greatest(n, F.lit(0)).cast("int")), "\n")).otherwise("")
    return found.select("file_id", "item_id", verdict.alias("verdict"), F.sha2(code, 256).alias("code_sha256"))


def grounding_in_bounds(claims: DataFrame, ranges: DataFrame) -> DataFrame:
    """Whether a citation lies in a range of its file (file_id, lo, hi): equi-join with a residual."""
    hit = claims.join(ranges, "file_id", "left").withColumn("inside", F.coalesce((F.col("line_start") >= F.col("lo")) & (F.col("line_end") <= F.col("hi")) & (F.col("line_start") <= F.col("line_end")), F.lit(False)))
    return hit.groupBy("file_id", "item_id").agg(F.bool_or("inside").alias("grounded"))


def case_to_entity(cases: DataFrame, ent: DataFrame) -> DataFrame:
    """Entity of the repository under test by the case's name without ``test_`` and its known endings; the first by id."""
    target = F.regexp_replace(F.regexp_replace("name", r"^test_", ""), r"_(main_branch|exception_path)$", "")
    first = ent.groupBy("repository_id", F.col("name").alias("target")).agg(F.min("entity_id").alias("entity_id"))
    return cases.select("repository_id", "name").distinct().withColumn("target", target).join(sorted_join(first), ["repository_id", "target"], "left").select("repository_id", "name", "target", "entity_id")


def import_externality(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Whether an import's module (Java: its last segment) is no file of its repository in the same language; relative imports are local."""
    stems = files.select("repository_id", "language", stem().alias("key")).distinct().withColumn("local", F.lit(True))
    rows = imports.join(sorted_join(files.select(*KEY, "language").distinct()), KEY)
    key = F.when(F.col("language") == "java", last("module")).otherwise(F.col("module"))
    found = rows.withColumn("key", key).join(sorted_join(stems), ["repository_id", "language", "key"], "left")
    return found.select(*KEY, "module", "local_name", (F.col("local").isNull() & ~F.col("module").startswith(".")).alias("is_external"))


def import_target(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The first file (by path) of the repository whose stem is the last segment of an import's module."""
    first = files.groupBy("repository_id", stem().alias("tail")).agg(F.min("path").alias("target_path"))
    return imports.withColumn("tail", last("module")).join(sorted_join(first), ["repository_id", "tail"], "left").select(*KEY, "module", "local_name", "target_path")


def resolve_inheritance(inheritance: DataFrame, found: DataFrame) -> DataFrame:
    """Parents by name in the file, else by a name that one type of the repository has alone; type arguments do not count."""
    types = found.filter(F.col("kind").isin("class", "interface", "enum", "record", "annotation")).select(*KEY, "name", entity_id().alias("id"))
    bare = last(F.regexp_replace("parent_name", r"[<\[].*$", ""))
    here = types.groupBy(*KEY, F.col("name").alias("bare")).agg(F.min("id").alias("in_file"))
    unique = types.groupBy("repository_id", F.col("name").alias("bare")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("in_repo")).filter("n = 1").drop("n")
    rows = inheritance.withColumn("bare", bare).join(sorted_join(here), [*KEY, "bare"], "left").join(sorted_join(unique), ["repository_id", "bare"], "left")
    return rows.select(*KEY, "entity", "parent_name", "kind", F.coalesce("in_file", "in_repo").alias("parent_id"))
