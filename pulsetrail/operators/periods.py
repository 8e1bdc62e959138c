"""Period algebra and period-over-period verdicts.

A *periods* frame holds one row per comparison to evaluate:
``series_id, cur_start, cur_end, cmp_start, cmp_end`` plus any labels.  Many
comparisons over many series are answered by one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail import vocab
from pulsetrail.functions.dates import shift_months
from pulsetrail.functions.measures import direction_of, ratio

PERIOD_COLUMNS = ("cur_start", "cur_end", "cmp_start", "cmp_end")


def current_period(kind: Column, today: Column) -> Column:
    """STRUCT(start, end) of the period of ``kind`` that ``today`` falls in."""
    month, quarter, year = (F.trunc(today, p) for p in ("MM", "QUARTER", "YEAR"))
    start = (F.when(kind == "day", today)
             .when(kind == "week", F.date_sub(today, 6))
             .when(kind.isin("month", "mtd"), month)
             .when(kind.isin("quarter", "qtd"), quarter).otherwise(year))
    end = (F.when(kind == "month", F.last_day(today))
           .when(kind == "quarter", F.date_sub(F.add_months(quarter, 3), 1))
           .when(kind == "year", F.date_sub(F.add_months(year, 12), 1))
           .otherwise(today))
    return F.struct(start.alias("start"), end.alias("end"))


def shift_day(day: Column, basis: Column) -> Column:
    """One comparison step back; month steps overflow like calendar fields."""
    return (F.when(basis == "DoD", F.date_sub(day, 1))
            .when(basis == "WoW", F.date_sub(day, 7))
            .when(basis == "MoM", shift_months(day, -1))
            .when(basis == "QoQ", shift_months(day, -3))
            .when(basis == "YoY", shift_months(day, -12)))


def default_period(today: Column) -> Column:
    """Year to date against the same stretch a year ago (29 Feb becomes 28)."""
    start = F.trunc(today, "YEAR")
    return F.struct(start.alias("cur_start"), today.alias("cur_end"),
                    F.add_months(start, -12).alias("cmp_start"),
                    F.add_months(today, -12).alias("cmp_end"))


def period_grid(todays: DataFrame) -> DataFrame:
    """Every period kind with every comparison basis allowed for it."""
    bases = F.map_from_arrays(
        F.array(*[F.lit(k) for k in vocab.PERIOD_BASES]),
        F.array(*[F.array(*map(F.lit, b)) for b in vocab.PERIOD_BASES.values()]))
    grid = (todays.select("*", F.explode(bases).alias("kind", "bases"))
            .select("*", F.explode("bases").alias("basis"),
                    (F.element_at("bases", -1)).alias("default_basis"))
            .withColumn("cur", current_period(F.col("kind"), F.col("today"))))
    return grid.select(
        "series_id", "kind", "basis",
        (F.col("basis") == F.col("default_basis")).alias("is_default"),
        F.col("cur.start").alias("cur_start"), F.col("cur.end").alias("cur_end"),
        shift_day(F.col("cur.start"), F.col("basis")).alias("cmp_start"),
        shift_day(F.col("cur.end"), F.col("basis")).alias("cmp_end"))


def fixed_periods(ids: DataFrame, cur, cmp) -> DataFrame:
    """The same two literal periods for every ``series_id`` of ``ids``."""
    day = lambda v: F.lit(v).cast("date")
    return ids.select("series_id", day(cur[0]).alias("cur_start"), day(cur[1]).alias("cur_end"),
                      day(cmp[0]).alias("cmp_start"), day(cmp[1]).alias("cmp_end"))


def period_means(series: DataFrame, periods: DataFrame) -> DataFrame:
    """``cur_avg`` and ``cmp_avg`` over the observed days, one row per comparison.

    Equality join on the series, then one conditional aggregate; a comparison
    whose series has no rows keeps null averages.
    """
    labels = periods.columns
    day = F.col("day")
    cur = day.between(F.col("cur_start"), F.col("cur_end"))
    cmp = day.between(F.col("cmp_start"), F.col("cmp_end"))
    points = series.select("series_id", "day", "value")
    return (periods.join(points, "series_id", "left")
            .groupBy(*labels)
            .agg(F.avg(F.when(cur, F.col("value"))).alias("cur_avg"),
                 F.avg(F.when(cmp, F.col("value"))).alias("cmp_avg")))


def change_pct(cur: Column, base: Column) -> Column:
    return ratio(cur - base, base) * 100


def period_verdict(series: DataFrame, periods: DataFrame) -> DataFrame:
    """Move of the mean level; comparisons without a usable base are dropped."""
    return (period_means(series, periods)
            .withColumn("pct", change_pct(F.col("cur_avg"), F.col("cmp_avg")))
            .filter(F.col("pct").isNotNull())
            .withColumn("direction", direction_of(F.col("pct"))))


def competitor_verdict(series: DataFrame, rivals: DataFrame, periods: DataFrame) -> DataFrame:
    """Verdict over the sum of per-rival means; an absent rival adds nothing.

    ``rivals`` is (subject_id, series_id); ``periods.series_id`` names subjects.
    """
    labels = [c for c in periods.columns if c != "series_id"]
    per_rival = period_means(
        series, periods.withColumnRenamed("series_id", "subject_id")
        .join(rivals, "subject_id"))
    return (per_rival.groupBy("subject_id", *labels)
            .agg(F.sum("cur_avg").alias("cur_avg"), F.sum("cmp_avg").alias("cmp_avg"))
            .withColumn("pct", change_pct(F.col("cur_avg"), F.col("cmp_avg")))
            .filter(F.col("pct").isNotNull())
            .withColumn("direction", direction_of(F.col("pct")))
            .withColumnRenamed("subject_id", "series_id"))


def market_vs_own(own: DataFrame, market: DataFrame) -> DataFrame:
    """Read a subject's move against its competitors' move."""
    labels = ["series_id", *[c for c in own.columns if c in PERIOD_COLUMNS or c in ("kind", "basis")]]
    m = market.select(*labels, F.col("direction").alias("market_direction"))
    return (own.filter(F.col("direction") != "neutral").join(m, labels, "left")
            .withColumn("reading",
                        F.when(F.col("market_direction").isNull(), "no_market_data")
                        .when(F.col("market_direction") == "neutral", "own_move")
                        .when(F.col("market_direction") == F.col("direction"), "market_wide")
                        .otherwise("own_move")))


def period_overlay(series: DataFrame, rivals: DataFrame, periods: DataFrame,
                   measured: DataFrame | None = None) -> DataFrame:
    """Both periods aligned by the ordinal of their observed days.

    ``market`` is the rivals' zero-filled total on the current day.  With
    ``measured`` (series_id, day, value) its values ride along.
    """
    from pyspark.sql import Window
    # a day may lie in both periods (adjacent windows can overlap)
    tagged = (series.join(periods, "series_id")
              .withColumn("part", F.explode(F.filter(F.array(
                  F.when(F.col("day").between(F.col("cur_start"), F.col("cur_end")), "cur"),
                  F.when(F.col("day").between(F.col("cmp_start"), F.col("cmp_end")), "cmp")),
                  lambda p: p.isNotNull()))))
    w = Window.partitionBy("series_id", "part").orderBy("day")
    tagged = tagged.withColumn("ordinal", F.row_number().over(w))
    market = (series.join(rivals, "series_id").groupBy("subject_id", "day")
              .agg(F.sum("value").alias("market")))
    tagged = tagged.join(market.withColumnRenamed("subject_id", "series_id"),
                         ["series_id", "day"], "left")
    cur, cmp = F.col("part") == "cur", F.col("part") == "cmp"
    aggs = [F.max(F.when(cur, F.col("value"))).alias("cur_value"),
            F.max(F.when(cmp, F.col("value"))).alias("cmp_value"),
            F.max(F.when(cur, F.coalesce("market", F.lit(0.0)))).alias("market")]
    if measured is not None:
        tagged = tagged.join(measured.select("series_id", "day",
                                             F.col("value").alias("measured")),
                             ["series_id", "day"], "left")
        aggs += [F.max(F.when(cur, F.col("measured"))).alias("cur_measured"),
                 F.max(F.when(cmp, F.col("measured"))).alias("cmp_measured")]
    return (tagged.groupBy("series_id", "ordinal").agg(*aggs)
            .withColumn("market", F.coalesce("market", F.lit(0.0))))
