"""Source facts: definitions, names, complexity, calls, imports, inheritance, used globals, documentation.

Every fact is a projection of the token rows of ``tokens``, which quote the source where a fact does. Those rows that stand for a fact are its
marks; all marks meet the definitions that own them in one pass. ``facts=`` takes a stored analysis, which several facts can share. All facts are keyed by
repository and path.
"""

from __future__ import annotations

import builtins
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.operators import tokens as T
from strataflow.operators.store import cut, sorted_join
from strataflow.operators.tokens import KEY

FUNCTIONS = ("function", "method")
NAME = [*KEY, "qualified_name"]


class Analysis(NamedTuple):
    """Stored token rows of files, the definitions that own them, comments, and the marks of facts with their ``owner``."""

    tokens: DataFrame
    found: DataFrame
    comments: DataFrame
    marks: DataFrame | None


def analyse(code: DataFrame, *parts: str) -> Analysis:
    """Lex the files once and store what all facts are read from; with ``parts`` (of ``tokens.PARTS``) only what those need beside definitions."""
    rows = cut(T.analysed(code, ("outline", *parts) if parts else None))
    tokens = rows.filter("what <> 'comment'")
    found = cut(T.definitions(tokens))
    marks = [mark(tokens).withColumn("mark", F.lit(part)) for part, mark in MARKS.items() if not parts or part in parts]
    if marks:
        marks = T.owned(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marks), found).filter("owner IS NULL OR owner.counts")
    return Analysis(tokens, found, rows.filter("what = 'comment'"), cut(marks) if marks else None)


def _all(code: DataFrame, facts: Analysis | None, *parts: str) -> Analysis:
    return analyse(code, *parts) if facts is None else facts


def _marks(facts: Analysis, part: str) -> DataFrame:
    """The marks of ``part`` with the definition that owns them; those of definitions that are not reported are gone."""
    return facts.marks.filter(F.col("mark") == part)


def distinct_texts(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, texts): each text once and shaped as ``code``, and the files it stands in; texts are keyed by digest and language in place of repository and path (in this order, in which sorts tell them apart by the first bytes).

    Facts depend on nothing else, so forks, copies and vendored files are analysed once; ``in_files`` gives each file its own rows again.
    """
    said = code.select(*KEY, "language", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    # Not grouped in the order of KEY: the lexer's own shuffle would be left out, and adaptive execution would judge the width by texts.
    texts = said.filter(F.col("language").isin(*T.LEXERS)).groupBy("language", "digest").agg(F.min("text").alias("text"))
    return said.drop("text"), texts.select(F.col("digest").alias("repository_id"), F.col("language").alias("path"), F.lit(0).cast("bigint").alias("file_id"), "language", "text")


def in_files(files: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` of ``distinct_texts`` for each of the ``files`` that hold the text (with ``left`` files without rows, too), with the file's language."""
    columns = [c for c in rows.columns if c not in (*KEY, "language")]
    rows = rows.select(F.col("repository_id").alias("digest"), F.col("path").alias("language"), *columns)
    return files.join(sorted_join(rows), ["digest", "language"], how).select(*KEY, "language", *columns)


def definitions(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """Definitions with parent and dotted qualified name; a function right under a class is a method."""
    return _all(code, facts, "outline").found.filter("counts").drop("counts")


def extract_definitions(code: DataFrame) -> DataFrame:
    return definitions(code).select(*KEY, "kind", "name", "line_start", "line_end")


def qualified_names(code: DataFrame) -> DataFrame:
    return definitions(code).select(*KEY, "kind", "qualified_name", "parent", "line_start")


def visibility_flag(code: DataFrame) -> DataFrame:
    """Python: names without a leading underscore. Java: members with ``public`` or without any modifier or annotation."""
    return definitions(code).select(*NAME, "is_public")


def _items(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (direct tokens of a list, with ``language``) numbered by the commas before them outside of type arguments."""
    order = W.partitionBy(*KEY, *by).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    angle = F.sum(F.when((F.col("language") == "java") & (F.col("tok") == "<"), 1).when((F.col("language") == "java") & (F.col("tok") == ">"), -1).otherwise(0)).over(order)
    comma = (F.col("tok") == ",") & (F.col("angle") == 0)
    rows = rows.withColumn("angle", angle).withColumn("comma", comma)
    return rows.withColumn("item", F.sum(F.col("comma").cast("int")).over(order)).filter("NOT comma")


def _parameter_marks(tokens: DataFrame) -> DataFrame:
    return tokens.filter("listed = 'parameters'").select(*KEY, "i", "language", "tok", "what", "box", F.col("gap").alias("text"))


def _list_text() -> F.Column:
    """The source of an item's tokens (i, tok, text before it), from the first to the last."""
    said = F.array_sort(F.collect_list(F.struct("i", "tok", F.coalesce("text", F.lit("")).alias("gap"))))
    whole = F.array_join(F.transform(said, lambda x, k: F.when(k == 0, x["tok"]).otherwise(F.concat(x["gap"], x["tok"]))), "")
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


def parameters(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """Parameters of functions: (lo of the definition, its qualified name, item, name, stars, text)."""
    rows = _marks(_all(code, facts, "parameters"), "parameters").filter(F.col("owner.kind").isin(*FUNCTIONS)).filter("box = owner.name_i + 1 AND (owner.body IS NULL OR box <> owner.body)")
    rows = _items(rows.select(*KEY, "i", "language", "tok", "what", "text", F.col("owner.lo").alias("lo"), F.col("owner.qualified_name").alias("qualified_name")), ["lo"])
    each = rows.groupBy(*KEY, "language", "lo", "qualified_name", "item").agg(
        F.min(F.struct("i", "tok")).alias("a"), F.min(F.when(F.col("what") == "word", F.struct("i", "tok"))).alias("first_word"), F.max(F.when(F.col("what") == "word", F.struct("i", "tok"))).alias("last_word"),
        F.bool_or(F.col("tok") == "...").alias("spread"), _list_text().alias("span"))
    py = F.col("language") == "python"
    name = F.when(py, F.col("first_word.tok")).otherwise(F.col("last_word.tok"))
    stars = F.when(py & (F.col("a.tok") == "*"), 1).when(py & (F.col("a.tok") == "**"), 2).otherwise(0)
    each = each.withColumns({"name": name, "stars": stars}).filter(F.col("name").isNotNull() | py).filter(~(~py & F.coalesce("spread", F.lit(False))))
    tidy = F.regexp_replace(F.regexp_replace("span", r" ?= ?", "="), r" ?: ?", ": ")
    return each.select(*KEY, "language", "lo", "qualified_name", "item", "name", "stars", F.when(py, tidy).otherwise(F.col("span")).alias("text"))


def _signature_marks(tokens: DataFrame) -> DataFrame:
    """Bases at the bracket of a class of Python; results, at the arrow with the colon after it, or at the stop of a Java method's head with the place of its name."""
    py, head = F.col("language") == "python", F.col("head.kind").isin("method", "compact")
    base = py & (F.col("tok") == "(") & (F.col("p2") == "class")
    rows = tokens.filter(F.coalesce(base, F.lit(False)) | py & (F.col("tok") == "->") & (F.col("depth") == 0) | F.coalesce(head, F.lit(False))).filter("said IS NOT NULL")
    return rows.select(*KEY, "i", "language", "tok", F.col("said").alias("text"), F.coalesce("head.i", "colon").alias("at"))


def signatures(code: DataFrame, facts: Analysis | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(repository_id, path, lo, qualified_name, signature): name, parameters and result of functions; name and bases of classes; the qualified name of Java types."""
    facts = _all(code, facts, "parameters", "signatures")
    found = facts.found.filter("counts")
    inside = (parameters(code, facts) if listed is None else listed).groupBy(*KEY, "lo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]), ", ").alias("inside"))
    py, kind = F.col("language") == "python", F.col("owner.kind")
    base = py & (F.col("tok") == "(") & (kind == "class") & (F.col("i") == F.col("owner.name_i") + 1)
    # The result: after the arrow up to the colon that opens the body, or before the name of a method.
    result = py & (F.col("tok") == "->") & kind.isin(*FUNCTIONS) & (F.col("i") > F.col("owner.name_i")) & (F.col("at") <= F.col("owner.hi")) | ~py & (kind == "method") & (F.col("at") == F.col("owner.name_i"))
    texts = _marks(facts, "signatures").filter("owner IS NOT NULL").select(*KEY, F.col("owner.lo").alias("lo"), "language", F.col("text").alias("span"), F.when(base, "base").when(result, "result").alias("part")).filter("part IS NOT NULL")
    words = "|".join(m for m in ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default"))
    bare = F.regexp_replace(F.regexp_replace("span", rf"^(?:(?:@[\w.]+(?:\s*\([^()]*\))?|{words})(?:\s+|$))*", ""), r"^<(?:[^<>]|<[^<>]*>)*>\s*", "")
    texts = texts.groupBy(*KEY, "lo").agg(
        F.max(F.when(F.col("part") == "base", F.col("span"))).alias("bases"), F.max(F.when(F.col("part") == "result", F.when(F.col("language") == "java", bare).otherwise(F.col("span")))).alias("result"))
    rows = found.join(sorted_join(inside), [*KEY, "lo"], "left").join(sorted_join(texts), [*KEY, "lo"], "left")
    result = F.when(F.coalesce("result", F.lit("")) != "", F.concat(F.lit(" -> "), "result")).otherwise("")
    signature = (F.when(F.col("kind").isin(*FUNCTIONS), F.concat("name", F.lit("("), F.coalesce("inside", F.lit("")), F.lit(")"), result))
                 .when(F.col("language") == "java", F.col("qualified_name")).when(F.coalesce("bases", F.lit("")) != "", F.concat("name", F.lit("("), "bases", F.lit(")"))).otherwise(F.col("name")))
    return rows.select(*KEY, "lo", "qualified_name", "kind", signature.alias("signature"))


def signature_arguments(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, qualified_name, signature, pos, argument) of functions; starred parameters of Python come last, spread ones of Java are none."""
    facts = _all(code, facts, "parameters", "signatures")
    listed = cut(parameters(code, facts))
    return arguments(listed).join(sorted_join(signatures(code, facts, listed)), [*KEY, "lo", "qualified_name"]).select(*NAME, "signature", "pos", "argument")


def arguments(listed: DataFrame) -> DataFrame:
    """(repository_id, path, lo, qualified_name, pos, argument) of ``parameters`` with a name."""
    named = listed.filter("name IS NOT NULL").withColumn("pos", F.row_number().over(W.partitionBy(*KEY, "lo").orderBy("stars", "item")) - 1)
    return named.select(*KEY, "lo", "qualified_name", "pos", F.col("name").alias("argument"))


def _point_marks(tokens: DataFrame) -> DataFrame:
    """Tokens that add to complexity, each by one.

    Python: branches, loops and their ``else``, handlers, assertions, cases but the open one, logical and conditional operators.
    Java: branches, loops, handlers, switches and their labels, conditional and logical operators; question marks of type arguments are none.
    """
    py = F.col("language") == "python"
    word = py & F.col("tok").isin("if", "elif", "for", "while", "except", "and", "or", "assert") & (F.col("what") == "word")
    case = py & (F.col("tok") == "case") & (F.col("seg.i") == F.col("i")) & F.coalesce(~F.col("n1").isin("=", ".", ":", ",", ")"), F.lit(False)) & ~((F.col("n1") == "_") & (F.col("n2") == ":"))
    ends_do = (F.col("tok") == "while") & (F.col("p1") == "}") & (F.col("opened.p1") == "do")
    label = (F.col("tok") == "default") & F.col("n1").isin(":", "->")
    wild = (F.col("tok") == "?") & F.coalesce(F.col("p1").isin("<", ","), F.lit(True))
    java = ~py & (F.col("tok").isin("if", "for", "while", "do", "catch", "case", "switch", "&&", "||", "?") | F.coalesce(label, F.lit(False))) & ~F.coalesce(ends_do, F.lit(False)) & ~F.coalesce(wild, F.lit(False))
    # An ``else`` adds where it ends a loop or a try.
    ends = py & F.col("new_line") & (F.col("depth") == 0) & (F.col("tok") == "else") & F.col("same").isin("for", "while", "except", "async", "try")
    return tokens.filter(F.coalesce(word, F.lit(False)) | F.coalesce(case, F.lit(False)) | java | F.coalesce(ends, F.lit(False))).select(*KEY, "i", "language")


def cyclomatic_complexity(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """1 + decisions of a function; those of a function defined in it are its own."""
    facts = _all(code, facts, "points")
    functions = facts.found.filter(F.col("counts") & F.col("kind").isin(*FUNCTIONS)).select(*KEY, "lo", "qualified_name")
    points = _marks(facts, "points").filter("owner IS NOT NULL AND i > owner.name_i").groupBy(*KEY, F.col("owner.lo").alias("lo")).agg(F.count(F.lit(1)).alias("points"))
    return functions.join(sorted_join(points), [*KEY, "lo"], "left").select(*NAME, (F.coalesce("points", F.lit(0)) + 1).alias("complexity"), "lo").drop("lo")


def class_complexity(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """The greatest complexity of a class's methods, 1 if it has none."""
    facts = _all(code, facts, "points")
    found = definitions(code, facts)
    most = cyclomatic_complexity(code, facts).join(sorted_join(found.filter("kind = 'method'").select(*NAME, "parent").distinct()), NAME).groupBy(*KEY, F.col("parent").alias("qualified_name")).agg(F.max("complexity").alias("m"))
    return found.filter(F.col("kind").isin(*T.TYPES)).select(*NAME).join(sorted_join(most), NAME, "left").select(*NAME, F.coalesce("m", F.lit(1)).alias("complexity"))


def _call_marks(tokens: DataFrame) -> DataFrame:
    """Calls by their bracket: what is called, the line it begins in, and whether no name resolves it."""
    py = F.col("language") == "python"
    before = F.col("pw") == "word"
    reserved = F.when(py, F.col("p1").isin(*T.PY_WORDS)).otherwise(F.col("p1").isin(*T.JAVA_WORDS))
    python = py & (F.col("valued") | before & ~reserved) & ~F.coalesce(F.col("p2").isin("def", "class"), F.lit(False))
    built = (F.col("start.tok") == "new") & (F.coalesce("opened.i", F.lit(0)) < F.col("start.i"))
    declared = F.coalesce(F.col("n2").isin("{", "throws"), F.lit(False))
    java = ~py & before & ~reserved & ~built & ~declared & ~F.coalesce(F.col("p2") == "@", F.lit(False))
    rows = tokens.filter("tok = '(' AND p1 IS NOT NULL AND start IS NOT NULL").filter(F.coalesce(F.when(py, python).otherwise(java), F.lit(False)))
    # Calls that no name resolves: of getattr, of its result, or of a subscript.
    getattr_ = py & (F.col("p1") == "getattr") & F.coalesce(F.col("p2") != ".", F.lit(True))
    dynamic = py & (getattr_ | (F.col("p1") == "]") | F.col("said").rlike(r"^getattr\s*\((?s:.*)\)$"))
    return rows.select(*KEY, "i", "language", F.regexp_replace("said", r" ?\. ?", ".").alias("text"), F.col("start.line").alias("line"), dynamic.alias("a"))


def extract_calls(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """Calls as written (the text before their brackets) with the line they begin in and their innermost owner.

    Python: all calls, those outside of definitions with an empty caller; calls of ``getattr``, of its result and of subscripts are ``dynamic``.
    Java: method calls in bodies of methods and constructors; ``new``, ``this(...)`` and ``super(...)`` are none.
    """
    rows = _marks(_all(code, facts, "calls"), "calls").filter((F.col("language") == "python") | (F.col("owner.kind") == "method") & (F.col("i") > F.col("owner.body")))
    return rows.select(*KEY, F.coalesce("owner.qualified_name", F.lit("")).alias("caller"), F.col("text").alias("callee_name"), "line", F.col("a").alias("dynamic"))


def dynamic_call_flag(code: DataFrame) -> DataFrame:
    """Calls that no name resolves, by caller and line."""
    return extract_calls(code).filter("dynamic").select(*KEY, "caller", "line")


def extract_imports(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, module, local_name, kind, line) of ``import``, ``from .. import`` and Java imports, over as many lines as they take."""
    tokens = cut(T.analysed(code, ("imports",))) if facts is None else facts.tokens
    span = tokens.filter("depth = 0 AND seg.i = i AND tok IN ('import', 'from')").select(*KEY, "language", "line", F.col("said").alias("span"))
    # Comments and the signs of continued lines go; what is left is one line.
    span = span.withColumn("span", F.trim(F.regexp_replace("span", r"[()\;]", " ")))
    py, java = span.filter("language = 'python'"), span.filter("language = 'java'")
    local = lambda p: F.when(p.rlike(r"\sas\s"), F.regexp_extract(p, r"\sas\s+(\w+)", 1))
    part = F.trim("p")
    plain = py.filter(F.col("span").startswith("import")).select(*KEY, "line", F.explode(F.split(F.regexp_replace("span", r"^import\s+", ""), ",")).alias("p")).select(
        *KEY, F.regexp_extract(part, r"^([\w.]+)", 1).alias("module"), F.coalesce(local(part), F.regexp_extract(part, r"^(\w+)", 1)).alias("local_name"), F.lit("normal").alias("kind"), "line")
    rest = F.regexp_extract("span", r"^from\s*[.\s]*[\w.]*\s*import\s+(.*)$", 1)
    named = py.filter(F.col("span").startswith("from")).select(*KEY, "line", F.regexp_replace(F.regexp_extract("span", r"^from\s*([.\s]*[\w.]*?)\s*\bimport\b", 1), r"\s", "").alias("module"), F.explode(F.split(rest, ",")).alias("p")).filter(F.trim("p") != "").select(
        *KEY, "module", F.coalesce(local(part), F.regexp_extract(part, r"^(\w+|\*)", 1)).alias("local_name"), F.lit("normal").alias("kind"), "line")
    name = F.regexp_replace(F.regexp_extract("span", r"^import\s+(?:static\s+)?([\w.*\s]+)", 1), r"\s", "")
    java = java.select(*KEY, name.alias("module"), F.substring_index(name, ".", -1).alias("local_name"), F.when(F.col("span").rlike(r"^import\s+static\s"), "static").otherwise("normal").alias("kind"), "line").filter("module <> ''")
    return plain.filter("module <> ''").unionByName(named).unionByName(java)


def extract_inheritance(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, entity, parent_name, kind, line) of base classes, ``extends`` and ``implements``; type arguments stay with their name. ``entity`` is the qualified name."""
    rows = _marks(_all(code, facts, "inheritance"), "inheritance").filter(F.col("owner.kind").isin(*T.TYPES)).withColumn("lo", F.col("owner.lo")).withColumn("group", F.lit(0).cast("bigint"))
    rows = rows.select(*KEY, "i", "language", "tok", "box", "depth", "text", "owner", "lo", "group")
    py = _items(rows.filter("language = 'python' AND box = owner.name_i + 1"), ["lo"]).withColumn("relation", F.lit("extends"))
    java = rows.filter("language = 'java' AND i > owner.name_i AND i < owner.body AND depth = owner.depth")
    order = W.partitionBy(*KEY, "lo").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    java = java.withColumn("angle", F.sum(F.when(F.col("tok") == "<", 1).when(F.col("tok") == ">", -1).otherwise(0)).over(order))
    clause = (F.col("angle") == 0) & F.col("tok").isin("extends", "implements", "permits")
    java = java.withColumn("clause", F.last(F.when(clause, F.struct("i", "tok")), True).over(order)).filter(~clause & F.col("clause").isNotNull() & (F.col("clause.tok") != "permits"))
    java = _items(java.withColumn("group", F.col("clause.i").cast("bigint")).withColumn("relation", F.col("clause.tok")).drop("clause", "angle"), ["lo", "group"])
    each = py.select(*java.columns).unionByName(java).groupBy(*KEY, "language", "lo", "group", "item", "relation").agg(
        F.first("owner").alias("owner"), _list_text().alias("span"), F.bool_or(F.col("tok").isin("=", "**", "*")).alias("keyword"))
    text = each.filter("NOT (keyword AND language = 'python')").filter("span <> ''")
    return text.select(*KEY, F.col("owner.qualified_name").alias("entity"), F.col("span").alias("parent_name"), F.col("relation").alias("kind"), F.col("owner.line_start").alias("line"))


def _base_marks(tokens: DataFrame) -> DataFrame:
    return tokens.filter("listed = 'bases'").select(*KEY, "i", "language", "tok", "box", "depth", F.col("gap").alias("text"))


def _python_names(tokens: DataFrame) -> DataFrame:
    """Words of Python that may name something: no attributes, names of definitions, imports or handlers; ``keyword`` where a keyword of a call looks the same."""
    rows = tokens.filter("language = 'python' AND what = 'word'").filter(~F.col("tok").isin(*T.PY_WORDS) & F.coalesce(F.col("p1") != ".", F.lit(True)))
    keyword_ = (F.col("box") > 0) & (F.col("n1") == "=") & F.coalesce(F.col("p1").isin("(", ","), F.col("p1").isNull())
    imported = F.coalesce(F.col("seg.tok").isin("import", "from", "global", "nonlocal"), F.lit(False))
    handled = (F.col("p1") == "as") & (F.col("seg.tok") == "except")
    no_name = F.coalesce(F.col("p1").isin("def", "class"), F.lit(False)) | F.coalesce(handled, F.lit(False)) | imported
    return rows.filter(~no_name).withColumn("keyword", F.coalesce(keyword_, F.lit(False)))


def _name_marks(tokens: DataFrame) -> DataFrame:
    """Words that may name something. Python: stored (a), looking like a keyword of a call (b), standing where a parameter's name stands (c). Java: declared where fields are (a)."""
    words = _python_names(tokens).filter(~F.col("tok").isin(*dir(builtins)))
    # A '=' later in a statement tells targets from values; the last 'for' without its 'in' tells loop targets, brackets right inside of which hold targets too.
    op = F.col("n1").rlike(r"^(?:[+\-*/%&|^@]|//|\*\*)=$")
    assigned = (F.col("depth") == 0) & F.col("later_eq") & ((F.col("i") == F.col("seg.i")) | F.col("p1").isin(",", "*", "=")) & F.col("n1").isin("=", ",")
    typed = (F.col("i") == F.col("seg.i")) & ((F.col("n1") == ":") & (F.col("depth") == 0) | op)
    held = (F.col("p1") == "as") & F.col("seg.tok").isin("with", "async")
    loop = ((F.col("loop") == "for") | F.col("in_loop")) & F.coalesce(F.col("p1").isin("for", ",", "*"), F.when(F.col("in_loop"), True)) & F.coalesce(~F.col("n1").isin(".", "[", "("), F.lit(True))
    store = F.coalesce(assigned, F.lit(False)) | F.coalesce(typed, F.lit(False)) | F.coalesce(held, F.lit(False)) | F.coalesce(loop, F.lit(False)) | F.coalesce(F.col("n1") == ":=", F.lit(False))
    python = words.select(*KEY, "i", "language", "tok", "box", store.alias("a"), F.col("keyword").alias("b"), F.coalesce(F.col("p1").isin(",", "*", "**"), F.lit(True)).alias("c"))
    jv = tokens.filter("language = 'java' AND what = 'word'").filter(~F.col("tok").isin(*T.JAVA_WORDS))
    declares = F.col("n1").isin("=", ";", ",", "[") & (F.coalesce(F.col("eq"), F.lit(0)) < F.col("seg.i")) & (F.col("i") > F.col("seg.i")) & ~F.col("p1").isin(".", "<", "@")
    several = (F.col("p1") == ",") & F.col("n1").isin("=", ";", ",") & (F.col("i") > F.col("seg.i"))
    java = jv.select(*KEY, "i", "language", "tok", "box", F.coalesce(declares | several, F.lit(False)).alias("a"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("boolean").alias("c"))
    return python.unionByName(java)


def globals_used(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, qualified_name, global_name).

    Python: names that a definition loads, less those it stores or has as parameters, less built-in ones; definitions in it have their own.
    Java: fields of the class around a method, or of types in it, whose name occurs in the method's body.
    """
    facts = _all(code, facts, "names")
    names = _marks(facts, "names").filter("owner IS NOT NULL")
    # The names of parameters are stores; what stands in their annotations and defaults is loaded.
    parameter = F.col("owner.kind").isin(*FUNCTIONS) & (F.col("box") == F.col("owner.name_i") + 1) & F.col("c")
    seen = names.filter("language = 'python'").withColumn("parameter", F.coalesce(parameter, F.lit(False))).filter("parameter OR NOT b")
    python = seen.groupBy(*KEY, F.col("owner.lo").alias("lo"), F.col("owner.qualified_name").alias("qualified_name"), F.col("tok").alias("global_name")).agg(F.bool_or(F.col("a") | F.col("parameter")).alias("store")).filter("NOT store").select(*NAME, "global_name")

    jv = names.filter("language = 'java'")
    fields = F.col("owner.kind").isin(*T.TYPES) & (F.col("box") == F.col("owner.body")) & F.col("a")
    holders = F.concat(F.col("owner.outer"), F.array(F.col("owner.qualified_name")))
    fields = jv.filter(fields).select(*KEY, F.explode(holders).alias("holder"), F.col("tok").alias("global_name")).distinct()
    used = jv.filter("owner.kind = 'method' AND i > owner.body").select(*KEY, F.col("owner.qualified_name").alias("qualified_name"), F.try_element_at("owner.outer", F.lit(-1)).alias("holder"), F.col("tok").alias("global_name")).distinct()
    java = used.join(sorted_join(fields), [*KEY, "holder", "global_name"]).select(*NAME, "global_name").distinct()
    return python.unionByName(java)


def _line_marks(tokens: DataFrame) -> DataFrame:
    """Facts of lines at their first token; a pattern is tried where a line has one of the words it needs."""
    fact = lambda name, words, pattern: F.struct(F.lit(name).alias("fact"), F.when(reduce(lambda a, b: a | b, (F.contains(F.col("raw"), F.lit(w)) for w in words)), F.regexp_extract("raw", pattern, 1)).alias("text"))
    facts = F.array(
        fact("raise", ("raise", "throw"), r"\b(?:raise|throw)\s+(?:new\s+)?([\w.]+)"),
        fact("return", ("return",), r"^\s*return\s+(.*?);?\s*$"),
        fact("assign", ("=",), r"^\s*((?:int |double |String )?[A-Za-z_][\w.\[\]]*\s*=(?!=).*?);?\s*$"),
        fact("branch", ("if", "while"), r"^\s*(?:if|elif|while)\s*\(?(.*?)(?::\s*$|\)\s*\{)"))
    each = tokens.filter("new_line").select(*KEY, "i", "language", "line", F.explode(facts).alias("f"))
    return each.select(*KEY, "i", "language", "line", F.col("f.fact").alias("tok"), F.col("f.text").alias("text")).filter("text <> '' AND length(text) <= 200")


def semantic_facts(code: DataFrame, k: int = 10, facts: Analysis | None = None) -> DataFrame:
    """First k raises, assignments, branch conditions and returns of each function, in order; texts over 200 signs are none.

    A fact is found in the line it begins with; the line's first token tells whose it is, so lines inside texts have none.
    """
    rows = _marks(_all(code, facts, "lines"), "lines").filter(F.col("owner.kind").isin(*FUNCTIONS))
    each = rows.select(*KEY, F.col("owner.qualified_name").alias("qualified_name"), F.col("line").alias("n"), F.col("tok").alias("fact"), "text")
    w = W.partitionBy(*NAME, "fact").orderBy("n")
    return each.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select(*NAME, "fact", "pos", "text")


def _string_marks(tokens: DataFrame) -> DataFrame:
    return tokens.filter("what = 'string' AND colon IS NOT NULL").select(*KEY, "i", "language", "tok", F.col("colon").alias("at"))


def docstrings(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, qualified_name, doc, language): the string that begins a Python body, cleaned of its indent, or the comments right before a Java member as they stand."""
    facts = _all(code, facts, "strings")
    found, comments = facts.found.filter("counts"), facts.comments
    # A string right after the colon that opens the body: no other colon stands between that and the name.
    said = _marks(facts, "strings").filter("at < owner.name_i AND owner.name_i < i - 1").filter(~F.lower("tok").rlike(r"^[a-z]*[fb][a-z]*[\"']"))
    text = F.regexp_replace("tok", r"""^[A-Za-z]*(?:\"{3}|'{3}|"|')|(?:\"{3}|'{3}|"|')$""", "")
    lines = F.split(text, "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    margin = F.array_min(F.transform(F.filter(rest, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x))))
    clean = F.array_join(F.concat(F.array(F.ltrim(F.get(lines, F.lit(0)))), F.transform(rest, lambda x: F.rtrim(F.substring(x, F.coalesce(margin, F.lit(0)) + 1, F.length(x))))), "\n")
    py = said.select(*KEY, F.col("owner.qualified_name").alias("qualified_name"), F.regexp_replace(clean, r"^\s+|\s+$", "").alias("doc"), "language")
    comments = comments.filter("language = 'java'").select(*KEY, F.col("i").alias("lo"), F.col("pos").alias("at"), "tok")
    java = comments.join(sorted_join(found.filter("language = 'java'").select(*KEY, "lo", "qualified_name", "language")), [*KEY, "lo"]).groupBy(*KEY, "lo", "qualified_name", "language").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "tok"))), lambda x: x["tok"]), "\n").alias("doc"))
    return py.unionByName(java.select(*py.columns)).filter("doc <> ''")


def doc_comments(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, qualified_name, description, tag, tag_text) of docstrings and of comments before Java members; lines after a tag continue its text."""
    docs = docstrings(code, facts)
    py = docs.filter("language = 'python'").select(*NAME, F.col("doc").alias("description"), F.lit("").alias("tag"), F.lit("").alias("tag_text"))
    parts = _doc_parts(docs)
    tags = parts.filter("part > 0").select(*NAME, "tag", F.trim(F.regexp_replace("text", r"^@\S+\s*", "")).alias("tag_text"))
    java = _described(parts).join(sorted_join(tags), NAME, "left").select(*NAME, *(F.coalesce(c, F.lit("")).alias(c) for c in ("description", "tag", "tag_text")))
    return py.unionByName(java)


def descriptions(code: DataFrame, facts: Analysis | None = None) -> DataFrame:
    """(repository_id, path, qualified_name, description) of ``doc_comments``, without the tags."""
    docs = docstrings(code, facts)
    py = docs.filter("language = 'python'").select(*NAME, F.col("doc").alias("description"))
    return py.unionByName(_described(_doc_parts(docs)).select(*NAME, F.coalesce("description", F.lit("")).alias("description")))


def _described(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*NAME).agg(F.max(F.when(F.col("part") == 0, F.col("text"))).alias("description"))


def _doc_parts(docs: DataFrame) -> DataFrame:
    """Comments of Java, cleaned of their signs, in parts: the description (0), then each tag with the lines that continue it."""
    line = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim("raw"), r"^(?:/\*\*?|//)", "")), r"\*/$", "")), r"^\*+", ""))
    rows = docs.filter("language = 'java'").select(*NAME, F.posexplode(F.split("doc", "\n")).alias("n", "raw")).withColumn("text", line).filter("text <> ''").withColumn("tag", F.regexp_extract("text", r"^@(\S+)", 1))
    rows = rows.withColumn("part", F.sum((F.col("tag") != "").cast("int")).over(W.partitionBy(*NAME).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(*NAME, "part").agg(F.max("tag").alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))


def quarantine_unparseable(code: DataFrame) -> DataFrame:
    """Files per repository, and how many have brackets that close in order; brackets in texts and comments are none."""
    rows = T.analysed(code, ("brackets",)).filter("what <> 'comment'")
    pair = F.when(F.col("tok") == "(", ")").when(F.col("tok") == "[", "]").when(F.col("tok") == "{", "}")
    closing = (F.col("what") == "sign") & F.col("tok").isin(")", "]", "}")
    bad = (F.col("what") == "sign") & pair.isNotNull() & ~F.col("other.tok").eqNullSafe(pair) | closing & (F.col("depth") < 0)
    broken = rows.groupBy(*KEY).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("broken"))
    files = code.select(*KEY).distinct().join(sorted_join(broken), KEY, "left")
    return files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("files_total"), F.count_if(~F.coalesce("broken", F.lit(False))).alias("files_parsed"))


#: What stands for the facts of each of ``tokens.PARTS``: number of the token, language, and columns of its own.
MARKS = {"points": _point_marks, "parameters": _parameter_marks, "signatures": _signature_marks, "calls": _call_marks, "inheritance": _base_marks, "names": _name_marks, "strings": _string_marks, "lines": _line_marks}
