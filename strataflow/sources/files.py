"""Scans of file tables: languages, counts, warnings, archives and URLs, for all repositories in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions import paths as P
from strataflow.sources.versions import VersionedTable


def read_tree(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """A directory tree as a files table: path below ``root``, content and text; the listing is Spark's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = files.select(F.regexp_replace("path", r"^file:/+", "/").alias("full"), "content")
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    return base.select(F.lit(repository_id).alias("repository_id"), F.substring("full", len(prefix) + 1, 1 << 20).alias("path"), "content", F.decode("content", "UTF-8").alias("text"))


def kept(files: DataFrame) -> DataFrame:
    """Files outside ignored directories."""
    return files.filter(~P.is_ignored())


def ignored_path_filter(files: DataFrame) -> DataFrame:
    return kept(files).select("repository_id", "path")


def detect_language(files: DataFrame) -> DataFrame:
    return files.select("repository_id", "path", P.language().alias("language")).filter("language IS NOT NULL")


def scan_files(files: DataFrame) -> DataFrame:
    """Supported files outside ignored directories: language, loc and content digest."""
    return (kept(files).withColumn("language", P.language()).filter("language IS NOT NULL")
            .select("repository_id", "path", "language", P.line_count().alias("loc"), F.sha2("text", 256).alias("sha256")))


def unsupported_breakdown(files: DataFrame) -> DataFrame:
    rest = kept(files).filter(P.language().isNull())
    return rest.groupBy("repository_id", P.other_language().alias("name")).agg(F.count(F.lit(1)).alias("n_files"))


def count_loc(files: DataFrame) -> DataFrame:
    return files.select("repository_id", "path", P.line_count().alias("loc"))


def content_hash(files: DataFrame) -> DataFrame:
    """Groups of files with equal content."""
    return files.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_file_id"))


def language_counts(files: DataFrame, as_map: bool = False) -> DataFrame:
    counts = kept(files).groupBy("repository_id", F.coalesce(P.language(), P.other_language()).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))
    if not as_map:
        return counts
    entries = F.sort_array(F.collect_list(F.struct("language", "n_files")))
    return counts.groupBy("repository_id").agg(F.map_from_entries(entries).alias("language_counts"))


def language_flags(files: DataFrame) -> DataFrame:
    lang = P.language()
    return kept(files).groupBy("repository_id").agg(
        F.bool_or(F.coalesce(lang == "python", F.lit(False))).alias("python"), F.bool_or(F.coalesce(lang == "java", F.lit(False))).alias("java"), F.bool_or(lang.isNull()).alias("other"))


def _totals(files: DataFrame) -> DataFrame:
    """Per repository (also those whose files are all ignored): supported, named unsupported and unknown files."""
    seen = files.withColumn("ok", ~P.is_ignored()).withColumn("language", P.language()).withColumn("name", P.other_language())
    good, bad = F.col("ok") & F.col("language").isNotNull(), F.col("ok") & F.col("language").isNull()
    return seen.groupBy("repository_id").agg(
        F.count_if(good).alias("n_good"), F.count_if(bad & (F.col("name") != "other")).alias("n_named"), F.count_if(bad & (F.col("name") == "other")).alias("n_unknown"),
        F.sum(F.when(good, P.line_count())).alias("loc"), F.array_join(F.sort_array(F.collect_set(F.when(bad & (F.col("name") != "other"), F.col("name")))), ", ").alias("names"))


def scan_warnings(files: DataFrame) -> DataFrame:
    n = _totals(files)
    found = F.filter(F.array(
        F.when((F.col("n_good") == 0) & (F.col("n_named") + F.col("n_unknown") == 0), F.lit("repository contains no files to analyze")),
        F.when(F.col("n_named") > 0, F.concat(F.col("n_named").cast("string"), F.lit(" unsupported file(s) across "), "names")),
        F.when(F.col("n_unknown") > 0, F.concat(F.col("n_unknown").cast("string"), F.lit(" file(s) with unrecognized extensions"))),
        F.when(F.col("n_good") == 0, F.lit("no supported languages detected (python/java required)"))), lambda x: x.isNotNull())
    return n.select("repository_id", F.posexplode(found).alias("pos", "warning"))


def repository_rollup(files: DataFrame) -> DataFrame:
    return _totals(files).select("repository_id", F.coalesce("loc", F.lit(0)).alias("loc"), F.col("n_good").alias("file_count"), (F.col("n_named") + F.col("n_unknown")).alias("unsupported_count"))


def archive_admission(manifest: DataFrame, max_bytes: int = 200 * 1024 * 1024, max_files: int = 20_000) -> DataFrame:
    """Verdict per archive (repository_id, pos, path, size): the first member that breaks a rule decides."""
    upto = W.partitionBy("repository_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    depth = F.aggregate(F.split("path", "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct(
        (a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low")))
    checked = (manifest.withColumn("upto", F.sum("size").over(upto)).withColumn("escapes", F.col("path").startswith("/") | (depth["low"] < 0))
               .withColumn("why", F.when(F.col("upto") > max_bytes, "archive too large").when(F.col("escapes"), "path escapes")))
    bad = F.min(F.when(F.col("why").isNotNull(), F.struct("pos", "why", "path")))
    per = checked.groupBy("repository_id").agg(F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("members"), bad.alias("bad"))
    return per.select("repository_id", "total_bytes", "members",
                      F.coalesce("bad.why", F.when(F.col("members") > max_files, "too many files"), F.lit("ok")).alias("verdict"), F.col("bad.path").alias("first_bad_path"))


def collapse_top_dir(files: DataFrame) -> DataFrame:
    top = F.when(F.col("path").contains("/"), F.split("path", "/")[0])
    per = files.groupBy("repository_id").agg(F.min(top).alias("lo"), F.max(top).alias("hi"), F.count_if(top.isNull()).alias("flat"))
    single = per.filter("flat = 0 AND lo = hi").select("repository_id", F.col("lo").alias("top"))
    return files.join(single, "repository_id", "left").select("repository_id", "path", F.expr("CASE WHEN top IS NULL THEN path ELSE substring(path, length(top) + 2) END").alias("collapsed_path"))


# Hosts that are never admitted.
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "local", "internal")


# IPv4 networks for private, local, reserved, documentation and group use, as (address, bits).
CLOSED_IPV4 = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3))


def closed_address(host: str) -> F.Column:
    """Whether a host is a literal address outside of public use; null for names.

    IPv4: ``CLOSED_IPV4``. IPv6 is public in 2000::/3 only, without 2001::/23, 2001:db8::/32, 2002::/16 and 3fff::/20; what is no address but has a colon is closed too.
    """
    part = lambda i: F.regexp_extract(host, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("bigint")
    v4 = part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)
    number = lambda net: reduce(lambda a, b: a * 256 + int(b), net.split("."), 0)
    closed = reduce(lambda a, b: a | b, (F.shiftright(v4, 32 - bits) == number(net) >> (32 - bits) for net, bits in CLOSED_IPV4))
    group = lambda i: F.conv(F.regexp_extract(host, r"^([0-9a-f]{1,4}):(?:([0-9a-f]{1,4}))?", i), 16, 10).try_cast("bigint")
    first, second = F.coalesce(group(1), F.lit(0)), F.coalesce(group(2), F.lit(0))
    public = first.between(0x2000, 0x3FFF) & ~((first == 0x2001) & ((second < 0x200) | (second == 0xDB8))) & (first != 0x2002) & ~((first == 0x3FFF) & (second < 0x1000)) & ~F.col(host).rlike(r"[^0-9a-f:.]")
    return F.when(F.contains(F.col(host), F.lit(":")), ~public).otherwise(closed | (F.greatest(*(part(i) for i in range(1, 5))) > 255))


def url_admission(links: DataFrame) -> DataFrame:
    """Verdict of a clone URL: scheme, host names and literal addresses outside of public use."""
    url = F.trim(F.coalesce("url", F.lit("")))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"^\[|\]$", ""))
    parsed = links.select("page_id", url.alias("url"), scheme.alias("scheme"), host.alias("host"))
    reason = (F.when(F.col("url") == "", "empty").when(~F.col("scheme").isin("http", "https"), "scheme")
              .when((F.col("host") == "") | F.col("host").isin(*BLOCKED_HOSTS) | F.col("host").endswith(".local") | F.col("host").endswith(".internal"), "host")
              .when(F.coalesce(closed_address("host"), F.lit(False)), "address").otherwise("ok"))
    return parsed.select("page_id", F.when(reason == "ok", "accept").otherwise("reject").alias("verdict"), reason.alias("reason"))


def repository_name(links: DataFrame) -> DataFrame:
    """The last part of the URL's path without ``.git``; ``repository`` if there is none."""
    last = F.regexp_extract(F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", ""), r"([^/]*)$", 1)
    name = F.regexp_replace(last, r"\.git$", "")
    return links.select("page_id", F.when(name == "", "repository").otherwise(name).alias("name"))


def ordered_listing(files: DataFrame) -> DataFrame:
    """Supported files by language (in the supported order), then path; pos is the place in the repository."""
    lang = kept(files).withColumn("language", P.language()).filter("language IS NOT NULL")
    order = W.partitionBy("repository_id").orderBy(F.array_position(F.array(*map(F.lit, P.SUPPORTED)), F.col("language")), "path")
    return lang.select("repository_id", F.row_number().over(order).alias("pos"), "language", "path")


def test_file_filter(files: DataFrame) -> DataFrame:
    return files.filter(~P.is_test_file()).select("repository_id", "path")


def architecture_layers(files: DataFrame) -> DataFrame:
    named = files.withColumn("layer", P.layer()).filter("layer IS NOT NULL")
    return named.groupBy("repository_id", "layer").agg(F.count(F.lit(1)).alias("n_modules"), F.array_join(F.sort_array(F.collect_list("path")), ",").alias("modules"))


def analysis_stats(files: DataFrame) -> DataFrame:
    """Files per repository and supported language, zeros included."""
    good = kept(files).withColumn("language", P.language())
    per = good.groupBy("repository_id").agg(*(F.count_if(F.col("language") == x).alias(x) for x in P.SUPPORTED))
    return per.select("repository_id", F.explode(F.array(*(F.struct(F.lit(x).alias("language"), F.col(x).alias("n_files")) for x in P.SUPPORTED))).alias("s")).select("repository_id", "s.*")


def majority_language(files: DataFrame) -> DataFrame:
    """The most frequent language of files that are no tests (of all, where only tests exist); python wins ties."""
    lang = files.withColumn("language", P.language()).filter("language IS NOT NULL").withColumn("is_test", P.is_test_file())
    counts = lang.groupBy("repository_id", "language").agg(F.count_if(~F.col("is_test")).alias("n_main"), F.count(F.lit(1)).alias("n_all"))
    best = counts.groupBy("repository_id").agg(F.max(F.struct("n_main", F.when(F.col("n_main") > 0, 0).otherwise(F.col("n_all")).alias("n_rest"), (F.col("language") == "python").alias("python"), "language")).alias("b"))
    return best.select("repository_id", F.col("b.language").alias("language"), F.when(F.col("b.n_main") > 0, F.col("b.n_main")).otherwise(F.col("b.n_rest")).alias("n"))


def facts_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows of each table, with repeats, that the other lacks; zeros for equal tables."""
    columns = [F.col(f"`{c}`") for c in a.columns]
    more = a.withColumn("__more", F.lit(1)).union(b.withColumn("__more", F.lit(-1))).groupBy(*columns).agg(F.sum("__more").alias("__more"))
    n = lambda sign: F.coalesce(F.sum(F.greatest(sign * F.col("__more"), F.lit(0))), F.lit(0))
    sides = F.array(*(F.struct(F.lit(side).alias("side"), n(sign).alias("n")) for side, sign in (("left", 1), ("right", -1))))
    return more.agg(sides.alias("sides")).select(F.inline("sides"))


def replace_facts(facts: DataFrame, path: str) -> DataFrame:
    """Facts of whole repositories as one commit to the versioned table at ``path``: those of repositories that occur replace the older ones; the live rows."""
    table = VersionedTable(facts.sparkSession, path, facts.schema, "repository_id")
    batch = 1 + max((b for c in table.manifest() for b in c["batches"]), default=-1)
    table.stage(batch, facts)
    table.commit([batch], replace=True)
    return table.read()


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> DataFrame:
    """(table, remaining): rows left per table after removing those whose key is in ``gone`` (column key)."""
    out = None
    for name, (df, key) in tables.items():
        left = df.join(gone.withColumnRenamed("key", key), key, "left_anti").agg(F.count(F.lit(1)).alias("remaining")).select(F.lit(name).alias("table"), "remaining")
        out = left if out is None else out.unionByName(left)
    return out
