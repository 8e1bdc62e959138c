"""Readers for daily series and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsetrail.functions.dates import parse_strict

SERIES_SCHEMA = T.StructType([
    T.StructField("updated", T.StringType()),
    T.StructField("series", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()), T.StructField("views", T.DoubleType())])))),
    T.StructField("divisions", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def read_series_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Points of nested series files: (series_id, date, views, pos)."""
    docs = spark.read.schema(SERIES_SCHEMA).option("multiLine", multi_line).json(path)
    return (docs.select(F.explode("series").alias("series_id", "points"))
            .select("series_id", F.posexplode("points").alias("pos", "p"))
            .select("series_id", "p.date", "p.views", "pos"))


def read_divisions(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(SERIES_SCHEMA).option("multiLine", True).json(path)
    return (docs.select(F.explode("divisions").alias("series_id", "d"))
            .select("series_id", F.explode("d").alias("division")))


def points_to_series(points: DataFrame) -> DataFrame:
    """Valid days only; a null value is 0; the last position wins per day."""
    return (points.withColumn("day", parse_strict(F.col("date"))).filter(F.col("day").isNotNull())
            .groupBy("series_id", "day")
            .agg(F.max_by(F.coalesce("views", F.lit(0.0)), "pos").alias("value")))
