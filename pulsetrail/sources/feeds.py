"""RSS and Atom files already fetched to storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsetrail.functions.dates import feed_stamp
from pulsetrail.functions.text import strip

# all-text schemas: inference would read a title such as ``T1`` as a time
_RSS = "title string, link string, description string, pubDate string, `dc:date` string"
_ATOM = ("title string, link array<struct<_href string>>, summary string, content string, "
         "published string, updated string")
SUMMARY_CHARS = 600


def _summary(c: Column) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")), 1, SUMMARY_CHARS)


def _filled(*cs: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def _read(spark, path, row_tag, schema):
    return (spark.read.format("xml").schema(schema).option("rowTag", row_tag)
            .option("mode", "DROPMALFORMED").option("ignoreSurroundingSpaces", True).load(path))


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, link, summary, published) of all RSS items and Atom entries.

    A feed file is one document and read by one task; many files spread over
    the cluster.
    """
    file = F.col("_metadata.file_path").alias("file")
    rss = _read(spark, path, "item", _RSS).select(
        file, strip(F.col("title")).alias("title"), strip(F.col("link")).alias("link"),
        _summary(F.col("description")).alias("summary"),
        feed_stamp(_filled(F.col("pubDate"), F.col("dc:date"))).alias("published"))
    atom = _read(spark, path, "entry", _ATOM).select(
        file, strip(F.col("title")).alias("title"),
        F.coalesce(F.get(F.col("link"), F.lit(0))["_href"], F.lit("")).alias("link"),
        _summary(_filled(F.col("summary"), F.col("content"))).alias("summary"),
        feed_stamp(_filled(F.col("published"), F.col("updated"))).alias("published"))
    return rss.unionByName(atom)


def feed_health(sources: DataFrame, fetched: DataFrame, items: DataFrame) -> DataFrame:
    """Status per source label: error (nothing landed), empty, or ok with count.

    ``fetched`` has one row per landed label, ``items`` one per parsed item.
    """
    n = items.groupBy("label").agg(F.count("*").alias("items"))
    landed = fetched.select("label").distinct().withColumn("_landed", F.lit(True))
    return (sources.select("label").distinct().join(landed, "label", "left").join(n, "label", "left")
            .select("label", F.when(F.col("_landed").isNull(), "error")
                    .when(F.coalesce("items", F.lit(0)) == 0, "empty").otherwise("ok").alias("status"),
                    F.coalesce("items", F.lit(0)).alias("items")))
