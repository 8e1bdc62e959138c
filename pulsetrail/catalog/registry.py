"""Registry of named queries with their optional SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from pulsetrail.catalog.bindings import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Engine-neutral output types: text dates and lists, BIGINT, DOUBLE."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ";")
        elif isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def as_callables() -> dict:
    def bind(fn):
        return lambda spark, sf_dir: present(fn(Views(spark, sf_dir)))
    return {name: bind(fn) for name, fn in QUERIES.items()}
