"""Vitals (parallel arrays) and indicator CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsetrail.functions.text import strip

_DATE = "STRUCT<year: INT, month: INT, day: INT>"
_SCHEMA = (f"record STRUCT<collectionPeriods: ARRAY<STRUCT<lastDate: {_DATE}>>, "
           "metrics: MAP<STRING, STRUCT<percentilesTimeseries: STRUCT<p75s: ARRAY<STRING>>>>>")


def read_vitals(spark: SparkSession, path: str, metrics: dict[str, tuple[str, float]],
                multi_line: bool = True) -> DataFrame:
    """(metric, period_end, p75) from one dates array and an array per metric.

    ``metrics`` maps a source name to (metric, scale).  Null, unreadable and
    overhanging values are skipped.
    """
    docs = spark.read.schema(_SCHEMA).option("multiLine", multi_line).json(path)
    ends = F.transform("record.collectionPeriods", lambda p: F.concat_ws(
        "-", F.lpad(F.coalesce(p["lastDate"]["year"], F.lit(0)).cast("string"), 4, "0"),
        F.lpad(F.coalesce(p["lastDate"]["month"], F.lit(0)).cast("string"), 2, "0"),
        F.lpad(F.coalesce(p["lastDate"]["day"], F.lit(0)).cast("string"), 2, "0")))
    flat = (docs.select(ends.alias("_ends"), F.explode("record.metrics").alias("_m", "_ts"))
            .select("_ends", "_m", F.posexplode("_ts.percentilesTimeseries.p75s").alias("_i", "_v"))
            .filter(F.col("_i") < F.size("_ends")))
    name, scale = None, None
    for source, (metric, factor) in metrics.items():
        test = F.col("_m") == source
        name = F.when(test, metric) if name is None else name.when(test, metric)
        scale = F.when(test, float(factor)) if scale is None else scale.when(test, float(factor))
    return (flat.select(name.alias("metric"),
                        F.try_to_date(F.get("_ends", F.col("_i")), "yyyy-MM-dd").alias("period_end"),
                        (F.col("_v").try_cast("double") * scale).alias("p75"))
            .filter(F.col("metric").isNotNull() & F.col("p75").isNotNull()))


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """(period, value, file) from CSV files whose column names vary.

    Blank, ``NaN`` and unreadable values are dropped; ``2024-M01`` becomes
    ``2024-01``.
    """
    rows = spark.read.option("header", True).csv(path)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns],
                                     F.lit(None).cast("string"))
    period, value = pick("TIME_PERIOD", "TIME", "time_period"), pick("OBS_VALUE", "value", "OBS")
    text = strip(value)
    keep = [c for c in rows.columns if c in ("country", "indicator")]
    return (rows.select(*keep, F.replace(period, F.lit("-M"), F.lit("-")).alias("period"),
                        F.when(text != "NaN", text.try_cast("double")).alias("value"))
            .filter(F.col("period").isNotNull() & F.col("value").isNotNull()))
