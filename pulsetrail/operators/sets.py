"""Set operations over item channels and curated collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_channels(**channels: DataFrame) -> DataFrame:
    """Items of all channels in one shape, tagged by ``channel``."""
    tagged = [df.withColumn("channel", F.lit(name)) for name, df in channels.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_curated(*collections: DataFrame) -> DataFrame:
    """Curated collections one after the other, duplicates included."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), collections)


def covers_all(codes: str, required) -> "F.Column":
    """True when the array column holds every required code."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.col(codes))) == 0
