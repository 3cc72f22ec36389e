"""URL filtering by host and path rules: a sort-merge range join swept with a stack of nested rules.

A host is keyed by its labels in reverse, each closed by a point (``www.example.net`` is ``net.example.www.``), so
that a rule host and all its subdomains are one interval of keys: those with the rule's key as prefix. Paths below one
rule host are keyed by that host and the path, so that a rule is an interval again. Intervals of prefixes are nested or
apart. ``active_rules`` range-sorts interval starts, points and interval ends into cells; a running sum of starts less
ends is the height of the stack, and the rule in slot d of the stack at a point is the last one opened at height d. What
is open where a cell begins (height, rule per slot) is carried into it from the cells before.

Two sweeps: distinct hosts over rule hosts give each host the rule hosts above it (the whole stack), and distinct
(rule host, path) pairs over the rules give each pair its longest rule (the top). The longest of these wins.

Defined cases: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with only A-Z lower-cased,
the path what follows up to ``?``, ``#`` or the end; a null url and one without ``://`` have both empty. User names and ports
belong to the host. A url with an empty path fits only rules with an empty path. The longest rule is the one with the most
code points of host and path together, then of the host. Of rules with one host and path the greatest verdict in code
point order stands (``block`` over ``allow``); rules with a null in any column are left out. Rows that repeat, rows with a
null page_id and an empty table give their rows each; extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataflow.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"://([^/?#]*)([^?#]*)"
START, POINT, END = 0, 1, 2

#: Production rules: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: str | Column = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def host_key(host: str | Column) -> Column:
    """The labels in reverse, each closed by a point, as bytes: subdomains have it as prefix, and nothing else has."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary")


def path_key(host: str | Column, path: str | Column) -> Column:
    """Host key and path as bytes; the byte between them is in no UTF-8 text."""
    return F.concat(host_key(host), F.unhex(F.lit("FE")), F.col(path) if isinstance(path, str) else path)


def _events(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Starts, points and ends with their step; an interval ends after all keys that begin with its own."""
    no_point, no_rule = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((points, "point"), (intervals, "rule")))
    opened = intervals.select("key", F.lit(START).alias("kind"), F.lit(1).alias("step"), no_point.alias("point"), "rule")
    closed = intervals.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(END).alias("kind"), F.lit(-1).alias("step"), no_point.alias("point"), no_rule.alias("rule"))
    return opened.unionByName(closed).unionByName(points.select("key", F.lit(POINT).alias("kind"), F.lit(0).alias("step"), "point", no_rule.alias("rule")))


def active_rules(points: DataFrame, intervals: DataFrame, whole: bool) -> DataFrame:
    """(point, rule) for the rules open at each point: all of the stack if ``whole``, else only its top.

    ``points`` has (key, point), ``intervals`` has (key, rule) with distinct keys; a rule is open at a key that begins with its own.
    """
    # The sort: cells are ranges of keys. They are written, so that every reader sees the same cells.
    events = stage(_events(points, intervals).repartitionByRange("key", "kind").withColumn("cell", F.spark_partition_id()), "url-events")
    swept = W.partitionBy("cell").orderBy("key", "kind")
    # Heights where cells begin: one row per cell, as many as there are shuffle partitions.
    net = events.groupBy("cell").agg(F.sum("step").alias("net"))
    begins = net.select("cell", F.coalesce(F.sum("net").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("height"))
    level = (F.col("height") + F.sum("step").over(swept.rowsBetween(W.unboundedPreceding, W.currentRow))).cast("int")
    levels = stage(events.repartitionByRange("cell").join(F.broadcast(begins), "cell").withColumn("level", level).filter(f"kind = {START} OR (kind = {POINT} AND level > 0)")
                   .select("cell", "level", "key", "kind", "point", "rule"), "url-levels")
    # Slots that are filled where a cell begins: the last rule opened at that height in the cells before.
    last = levels.filter(f"kind = {START}").groupBy("cell", "level").agg(F.max_by("rule", "key").alias("rule"))
    asked = begins.filter("height > 0").select("cell", F.explode(F.sequence(F.lit(1), F.col("height").cast("int"))).alias("level"))
    slots = last.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    earlier = W.partitionBy("level").orderBy("cell", F.desc("asks")).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = slots.withColumn("rule", F.last("rule", ignorenulls=True).over(earlier)).filter("asks").select("cell", "level", F.lit(b"").alias("key"), F.lit(START).alias("kind"), "rule")
    asks = levels.withColumn("level", F.explode(F.sequence(F.lit(1), "level"))) if whole else levels
    rows = levels.filter(f"kind = {START}").unionByName(asks.filter(f"kind = {POINT}")).unionByName(carried, allowMissingColumns=True)
    slot = W.partitionBy("cell", "level").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("rule", F.last("rule", ignorenulls=True).over(slot)).filter(f"kind = {POINT}").select("point", "rule")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null) and verdict of every row.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains if the url's path starts with the rule's.
    """
    parsed = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    known = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", F.col("verdict").cast("string").alias("verdict")).dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    rule_hosts = known.select("host").distinct()
    hosts = parsed.select("host").distinct()
    above = active_rules(hosts.select(host_key("host").alias("key"), F.col("host").alias("point")), rule_hosts.select(host_key("host").alias("key"), F.col("host").alias("rule")), whole=True)
    # A hot host has one row in ``above``; its urls are the side that adaptive execution splits.
    urls = parsed.select("host", "path").distinct()
    asked = stage(urls.join(above.select(F.col("point").alias("host"), F.col("rule").alias("rule_host")), "host"), "url-asks")
    points = asked.select("rule_host", "path").distinct()
    tops = active_rules(points.select(path_key("rule_host", "path").alias("key"), F.struct("rule_host", "path").alias("point")),
                        known.select(path_key("host", "path").alias("key"), F.struct("host", "path", "verdict").alias("rule")), whole=False)
    fits = tops.select("point.rule_host", "point.path", F.struct(
        (F.length("rule.host") + F.length("rule.path")).alias("n"), F.length("rule.host").alias("n_host"), F.concat("rule.host", "rule.path").alias("rule"), F.col("rule.verdict").alias("verdict")).alias("fit"))
    best = asked.join(fits, ["rule_host", "path"]).groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """A short list of rules as a table."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), rule))) for rule in rules))))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


OP11_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT page_id, row_number() OVER () AS n, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages)
SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path,
       arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule,
       coalesce(arg_max(r.verdict, length(r.host) + length(r.path)), 'allow') AS verdict
FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.n, p.page_id
"""
