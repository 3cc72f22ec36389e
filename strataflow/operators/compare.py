"""Comparison of text versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def line_diff(versions: DataFrame) -> DataFrame:
    """(id, change, line_no, line_sha256) of an ordered walk over both texts.

    Lines that only one text has are removed (old numbers) or added (new numbers). The others are paired in order: equal ones are
    common (old numbers), and of others the old one is removed and the new one added, so a moved line is both. Common and added lines
    in the order of the new text are the new text.
    """
    side = lambda c, new: versions.select("id", F.lit(new).alias("new"), F.posexplode(F.split(c, "\n")).alias("i", "line")).select("id", "new", (F.col("i") + 1).alias("line_no"), F.unhex(F.sha2("line", 256)).alias("line"))
    # Lines as digests, dealt once by id: all windows below find their rows together.
    lines = side("old_text", False).unionByName(side("new_text", True)).repartition("id")
    same_line, in_order = W.partitionBy("id", "line"), W.partitionBy("id", "new").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    shared = lines.withColumn("shared", F.min("new").over(same_line) != F.max("new").over(same_line))
    placed = shared.withColumn("place", F.when(F.col("shared"), F.count_if("shared").over(in_order)))
    pairs = W.partitionBy("id").orderBy("place", "new")
    beside = lambda f: (f("place").over(pairs) == F.col("place")) & (f("line").over(pairs) == F.col("line"))  # noqa: E731  a place has an old line, a new one, or both
    change = F.when(F.col("new"), F.when(F.coalesce(beside(F.lag), F.lit(False)), None).otherwise("added")).otherwise(F.when(F.coalesce(beside(F.lead), F.lit(False)), "common").otherwise("removed"))
    return placed.withColumn("change", change).filter("change IS NOT NULL").select("id", "change", "line_no", F.lower(F.hex("line")).alias("line_sha256"))
