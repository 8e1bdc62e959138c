"""Configuration lists: keywords, labelled values, topics.

These files are configuration.  ``keyword_lists`` brings them to the driver
behind a size check because they become part of the query itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsetrail import vocab
from pulsetrail.functions.text import strip

MAX_KEYWORDS = 50_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of non-blank trimmed lines, file order kept."""
    files = spark.read.text(path, wholetext=True)
    return (files.select(F.col("_metadata.file_path").alias("file"),
                         F.posexplode(F.split("value", "\r?\n")).alias("pos", "_l"))
            .select("file", "pos", strip(F.col("_l")).alias("line")).filter(F.col("line") != ""))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(kind keep|drop, keyword) lower-cased; comments are skipped and a comment
    holding the marker starts the DROP part of its file."""
    files = spark.read.text(path, wholetext=True)
    marked = files.select(F.split("value", "\r?\n").alias("_all"))
    at = F.coalesce(F.array_min(F.filter(
        F.transform("_all", lambda s, i: F.when(strip(s).startswith("#") & s.contains(vocab.DROP_MARKER), i)),
        lambda x: x.isNotNull())), F.size("_all"))
    return (marked.withColumn("_at", at).select("_at", F.posexplode("_all").alias("pos", "_l"))
            .select(F.when(F.col("pos") > F.col("_at"), "drop").otherwise("keep").alias("kind"),
                    F.lower(strip(F.col("_l"))).alias("keyword"))
            .filter((F.col("keyword") != "") & ~F.col("keyword").startswith("#")))


def keyword_lists(keywords: DataFrame, default_keep=(), default_drop=()) -> tuple[list[str], list[str]]:
    """KEEP and DROP lists; if either is empty both fall back to the defaults."""
    rows = keywords.select("kind", "keyword").distinct().limit(MAX_KEYWORDS + 1).collect()
    if len(rows) > MAX_KEYWORDS:
        raise ValueError("keyword list is too large to be a configuration list")
    keep = sorted(r["keyword"] for r in rows if r["kind"] == "keep")
    drop = sorted(r["keyword"] for r in rows if r["kind"] == "drop")
    return (keep, drop) if keep and drop else (list(default_keep), list(default_drop))


def known_label(label: Column, known) -> Column:
    """The label if it is one of the known categories, else 'other'."""
    return F.when(label.isin(*known), label).otherwise("other")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label, value) of ``label | value`` lines; no bar means 'other'."""
    rows = _lines(spark, path).filter(~F.col("line").startswith("#"))
    bar = F.instr("line", "|")
    return (rows.select("file", "pos",
                        F.when(bar > 0, strip(F.substring_index("line", "|", 1))).otherwise("other").alias("label"),
                        strip(F.expr("substring(line, instr(line, '|') + 1)")).alias("value"))
            .filter(F.col("value") != ""))


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, value) of feeds: lines without a bar are skipped and the last
    line of a label wins."""
    rows = read_queries(spark, path)
    raw = _lines(spark, path).filter(F.col("line").contains("|")).select("file", "pos")
    return (rows.join(raw, ["file", "pos"], "left_semi").filter(F.col("label") != "")
            .groupBy("label").agg(F.max_by("value", F.struct("file", "pos")).alias("value")))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic) of plain lists; comments and blanks skipped."""
    return _lines(spark, path).filter(~F.col("line").startswith("#")).select(F.col("line").alias("topic"))
