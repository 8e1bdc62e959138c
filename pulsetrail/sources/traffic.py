"""Measured-traffic CSV files (country, date, traffic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsetrail import vocab
from pulsetrail.functions.text import one_of, strip


def country_code(c: Column) -> Column:
    """Upper-case code with the known aliases resolved."""
    u = F.upper(strip(c))
    return F.coalesce(one_of(u, vocab.TRAFFIC_COUNTRY_ALIASES), u)


def parse_traffic_lines(lines: DataFrame, first_line: Column) -> DataFrame:
    """(country, day, traffic) from raw text lines; unreadable rows drop out.

    ``first_line`` marks lines that may be a header, which they are when they
    name a column.
    """
    text = F.regexp_replace("value", "^﻿", "")
    header = first_line & F.lower(text).rlike("|".join(vocab.TRAFFIC_HEADER_WORDS))
    cells = F.transform(F.split(text, ","), strip)
    number = F.regexp_extract(F.regexp_replace(F.get("_c", F.lit(2)), r"[^0-9.\-]", ""),
                              r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    day = F.replace(F.get("_c", F.lit(1)), F.lit("/"), F.lit("-"))
    pattern = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    padded = F.when(day.rlike(pattern), F.concat_ws(
        "-", F.regexp_extract(day, pattern, 1), F.lpad(F.regexp_extract(day, pattern, 2), 2, "0"),
        F.lpad(F.regexp_extract(day, pattern, 3), 2, "0"))).otherwise(day)
    return (lines.filter((strip(text) != "") & ~header).withColumn("_c", cells)
            .filter(F.size("_c") >= 3)
            .select(country_code(F.get("_c", F.lit(0))).alias("country"), padded.alias("day"),
                    F.nullif(number, F.lit("")).try_cast("double").alias("traffic"))
            .filter((F.col("country") != "") & (F.col("day") != "") & F.col("traffic").isNotNull()))


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """Read traffic CSV files with the splittable line reader.

    A header is told by its words: a line that names a column and whose third
    cell holds no digit, wherever in its file it stands.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    return parse_traffic_lines(lines, ~F.col("value").rlike(",.*,.*[0-9]"))
