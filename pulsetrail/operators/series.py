"""Daily-series operators: combination, windows, change points, prefix sums.

A series frame is long: ``series_id, day DATE, value DOUBLE``, one row per
(series, day).  A window over one series is bounded by its calendar length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsetrail import vocab
from pulsetrail.functions.measures import ratio
from pulsetrail.session import shared_dir


def _by_day(*keys):
    return Window.partitionBy(*(keys or ("series_id",))).orderBy("day")


def latest_point(points: DataFrame, keys=("series_id", "day"), order="arrival") -> DataFrame:
    """One row per key: the last arrival wins."""
    value = [c for c in points.columns if c not in keys]
    return (points.groupBy(*keys).agg(F.max_by(F.struct(*value), order).alias("_v"))
            .select(*keys, "_v.*"))


def series_upsert(existing: DataFrame, fresh: DataFrame, as_of: Column,
                  retention_days: int = 730) -> DataFrame:
    """Fresh points override stored ones by day; older than retention is cut."""
    keys = ["series_id", "day"]
    cutoff = F.date_sub(as_of, retention_days)
    new = fresh.filter(F.col("day") >= cutoff).select(*keys, F.col("value").alias("_new"))
    return (existing.filter(F.col("day") >= cutoff).join(new, keys, "full")
            .select(*keys, F.coalesce("_new", "value").alias("value")))


def market_strict(series: DataFrame, rivals: DataFrame) -> DataFrame:
    """(subject_id, day, value): rivals' total on days where all of them report.

    A rival with no points at all does not count; only subject days are kept.
    """
    of_rivals = rivals.join(series, "series_id")
    needed = (rivals.join(series.select("series_id").distinct(), "series_id", "left_semi")
              .groupBy("subject_id").agg(F.countDistinct("series_id").alias("_needed")))
    daily = of_rivals.groupBy("subject_id", "day").agg(
        F.sum("value").alias("value"), F.count("value").alias("_have"))
    subject = series.select(F.col("series_id").alias("subject_id"), "day")
    return (daily.join(needed, "subject_id").filter(F.col("_have") == F.col("_needed"))
            .join(subject, ["subject_id", "day"], "left_semi")
            .select("subject_id", "day", "value"))


def market_zero_fill(series: DataFrame, rivals: DataFrame) -> DataFrame:
    """(subject_id, day, own, value): subject plus rivals on the subject's days."""
    own = series.select(F.col("series_id").alias("subject_id"), "day",
                        F.col("value").alias("own"), F.col("value"))
    other = (rivals.join(series, "series_id")
             .select("subject_id", "day", F.lit(None).cast("double").alias("own"), "value"))
    subjects = rivals.select("subject_id").distinct()
    return (own.join(subjects, "subject_id", "left_semi").unionByName(other)
            .groupBy("subject_id", "day")
            .agg(F.max("own").alias("own"), F.sum("value").alias("value"))
            .filter(F.col("own").isNotNull()))


def share_zero_fill(series: DataFrame, rivals: DataFrame) -> DataFrame:
    """Subject's percentage of the zero-filled total."""
    return (market_zero_fill(series, rivals)
            .select("subject_id", "day", (ratio(F.col("own"), F.col("value")) * 100).alias("value"))
            .filter(F.col("value").isNotNull()))


def share_strict(series: DataFrame, rivals: DataFrame) -> DataFrame:
    """Subject over subject plus market, on days where all rivals report."""
    own = series.select(F.col("series_id").alias("subject_id"), "day",
                        F.col("value").alias("own"))
    return (market_strict(series, rivals).join(own, ["subject_id", "day"])
            .select("subject_id", "day",
                    ratio(F.col("own"), F.col("own") + F.col("value")).alias("value"))
            .filter(F.col("value").isNotNull()))


def capture_series(basis: DataFrame, market: DataFrame) -> DataFrame:
    """Basis per unit of market on shared days where the market is not 0."""
    m = market.select("subject_id", "day", F.col("value").alias("_m"))
    return (basis.withColumnRenamed("series_id", "subject_id")
            .join(m, ["subject_id", "day"]).filter(F.col("_m") != 0)
            .select("subject_id", "day", (F.col("value") / F.col("_m")).alias("value")))


def calendar(spans: DataFrame, start="start", end="end") -> DataFrame:
    """One row per day of each span row."""
    return (spans.filter(F.col(end) >= F.col(start))
            .withColumn("day", F.explode(F.sequence(F.col(start), F.col(end))))
            .drop(start, end))


def span_of(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.min("day").alias("start"),
                                           F.max("day").alias("end"))


def densify(series: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Every calendar day of each series' span; missing values are null."""
    days = calendar(span_of(series) if spans is None else spans)
    return days.join(series, ["series_id", "day"], "left")


def prefix_sums(series: DataFrame) -> DataFrame:
    """(series_id, day, psum, pcount) on the dense calendar of each series.

    A mean over any day range is then two equality lookups instead of a range
    join, so cost does not depend on the width of the range.
    """
    spans = span_of(series).withColumn("start", F.date_sub("start", 1))
    w = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    return densify(series, spans).select(
        "series_id", "day", F.coalesce(F.sum("value").over(w), F.lit(0.0)).alias("psum"),
        F.count("value").over(w).alias("pcount"))


def range_stats(requests: DataFrame, prefix: DataFrame, start: str, end: str,
                name: str) -> DataFrame:
    """Add ``<name>_mean`` and ``<name>_n`` over [start, end] of the series.

    ``requests`` carries ``series_id, first_day, last_day`` (see
    ``with_span``).  Days outside the span hold no observations.
    """
    lo = F.greatest(F.date_sub(start, 1), F.date_sub("first_day", 1))
    hi = F.least(F.col(end), F.col("last_day"))
    a = prefix.select("series_id", F.col("day").alias("_lo"), F.col("psum").alias("_ps0"),
                      F.col("pcount").alias("_pc0"))
    b = prefix.select("series_id", F.col("day").alias("_hi"), F.col("psum").alias("_ps1"),
                      F.col("pcount").alias("_pc1"))
    n = F.when(F.col("_hi") > F.col("_lo"),
               F.coalesce(F.col("_pc1") - F.col("_pc0"), F.lit(0))).otherwise(0)
    return (requests.withColumn("_lo", lo).withColumn("_hi", hi)
            .join(a, ["series_id", "_lo"], "left").join(b, ["series_id", "_hi"], "left")
            .withColumn(f"{name}_n", n)
            .withColumn(f"{name}_mean", F.when(F.col(f"{name}_n") > 0,
                        (F.col("_ps1") - F.col("_ps0")) / F.col(f"{name}_n")))
            .drop("_lo", "_hi", "_ps0", "_ps1", "_pc0", "_pc1"))


def with_span(requests: DataFrame, series: DataFrame) -> DataFrame:
    """Attach each series' first and last observed day."""
    return requests.join(span_of(series).withColumnsRenamed(
        {"start": "first_day", "end": "last_day"}), "series_id")


def forward_change(series: DataFrame, spans: DataFrame | None = None,
                   days: int = vocab.FORWARD_DAYS) -> DataFrame:
    """(series_id, day, change): next ``days`` mean against the trailing one.

    Evaluated on every calendar day, with or without an observation; ``spans``
    (series_id, start, end) limits the days reported, not the values used.
    """
    dense = densify(series).withColumn("_n", F.datediff("day", F.lit("1970-01-01")))
    if spans is not None:
        wide = spans.select("series_id", F.col("start").alias("s0"), F.col("end").alias("e0"))
        both = (span_of(series).join(wide, "series_id")
                .select("series_id", F.least("start", "s0").alias("start"),
                        F.greatest("end", "e0").alias("end")))
        dense = densify(series, both).withColumn("_n", F.datediff("day", F.lit("1970-01-01")))
    w = Window.partitionBy("series_id").orderBy("_n")
    prev = F.avg("value").over(w.rangeBetween(-(days - 1), 0))
    nxt = F.avg("value").over(w.rangeBetween(1, days))
    out = dense.select("series_id", "day", ratio(nxt - prev, prev).alias("change"))
    out = out.filter(F.col("change").isNotNull())
    if spans is not None:
        out = (out.join(spans, "series_id")
               .filter(F.col("day").between(F.col("start"), F.col("end")))
               .select("series_id", "day", "change"))
    return out


def centered_ma(series: DataFrame, half: int = 2) -> DataFrame:
    """Centred mean by observation order, shrinking at the edges."""
    return series.withColumn("smooth", F.avg("value").over(_by_day().rowsBetween(-half, half)))


def change_points(series: DataFrame, threshold: float = vocab.CHANGE_THRESHOLD_PCT) -> DataFrame:
    """(series_id, day, before, after, pct, direction) of sharp level moves.

    Positions are observations, not calendar days; series under 11 points have
    none.
    """
    from pulsetrail.functions.measures import direction_of
    w = _by_day()
    s = (centered_ma(series)
         .withColumn("_i", F.row_number().over(w))
         .withColumn("_n", F.count("value").over(Window.partitionBy("series_id")))
         .withColumn("before", F.avg("smooth").over(w.rowsBetween(-5, -3)))
         .withColumn("after", F.avg("smooth").over(w.rowsBetween(2, 4)))
         .filter((F.col("_n") >= 11) & F.col("_i").between(6, F.col("_n") - 4)))
    s = s.withColumn("pct", ratio(F.col("after") - F.col("before"), F.col("before")) * 100)
    return (s.filter(F.abs("pct") >= threshold)
            .select("series_id", "day", "before", "after", "pct",
                    F.when(F.col("pct") < 0, "-").otherwise("+").alias("direction")))


def change_point_merge(points: DataFrame, days: int = vocab.CHANGE_MERGE_DAYS) -> DataFrame:
    """Left to right: closer than ``days`` to the last kept, the larger stays.

    A gap of ``days`` or more to the previous point always starts afresh, so
    the fold runs over such chains rather than over whole series.
    """
    w = _by_day()
    gap = F.datediff("day", F.lag("day").over(w))
    chained = points.withColumn("_chain", F.sum(
        F.when(gap < days, 0).otherwise(1)).over(w))
    item = F.struct("day", "pct", "direction")

    def step(acc, x):
        last = F.element_at(acc, -1)
        near = F.datediff(x["day"], last["day"]) < days
        return (F.when(~near, F.concat(acc, F.array(x)))
                .when(F.abs(x["pct"]) > F.abs(last["pct"]),
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x)))
                .otherwise(acc))

    folded = (chained.groupBy("series_id", "_chain")
              .agg(F.array_sort(F.collect_list(item)).alias("_pts"))
              .withColumn("_kept", F.aggregate(
                  F.slice(F.col("_pts"), F.lit(2), F.size("_pts")),
                  F.slice(F.col("_pts"), 1, 1), step)))
    return folded.select("series_id", F.inline("_kept"))


def calendar_gaps(series: DataFrame, as_of: Column, retention_days: int = 730,
                  lag_days: int = 2, max_ranges: int = 2) -> DataFrame:
    """Newest missing day ranges of each series, at most ``max_ranges``.

    A gap lies between two present days that don't follow one another; the day
    before the first and the day after the last expected one stand in for
    present days.  No calendar is laid out.
    """
    cutoff, newest = F.date_sub(as_of, retention_days), F.date_sub(as_of, lag_days)
    spans = (series.groupBy("series_id").agg(F.min("day").alias("_first"))
             .select("series_id", F.greatest(F.col("_first"), cutoff).alias("start")).filter(F.col("start") <= newest))
    ends = spans.select("series_id", F.explode(F.array(F.date_sub("start", 1), F.date_add(newest, 1))).alias("day"))
    present = series.filter(F.col("day").between(cutoff, newest)).select("series_id", "day").unionByName(ends)
    ranges = (present.withColumn("_prev", F.lag("day").over(_by_day())).filter(F.datediff("day", "_prev") > 1)
              .select("series_id", F.date_add("_prev", 1).alias("gap_start"), F.date_sub("day", 1).alias("gap_end")))
    r = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("gap_start")))
    return (ranges.withColumn("rank", r).filter(F.col("rank") <= max_ranges)
            .select("series_id", "rank", "gap_start", "gap_end"))


def series_coverage(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Observed over expected days; ``windows`` is (series_id, start, end)."""
    expected = F.datediff("end", "start") + 1
    inside = F.col("day").between(F.col("start"), F.col("end"))
    return (windows.join(series.select("series_id", "day"), "series_id", "left")
            .groupBy("series_id", "start", "end")
            .agg(F.count(F.when(inside, 1)).alias("present"))
            .withColumn("expected", F.greatest(expected, F.lit(0)))
            .withColumn("coverage", F.coalesce(ratio(F.col("present"), F.col("expected")),
                                               F.lit(0.0))))


def asof_point(probes: DataFrame, series: DataFrame, start, end) -> DataFrame:
    """Last in-period observation on or before each probe's day, up to the series' last one.

    ``probes`` has (series_id, day) and columns of its own.  Probes and
    observations are range-partitioned together by series and day and stored
    (an action), so one series may span many tasks.  Inside a partition the
    last observation is carried along; what a partition takes over at its
    border comes from one row per partition and series.
    """
    shared_dir(series.sparkSession)
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    mine = [c for c in probes.columns if c not in ("series_id", "day")]
    points = series.filter(F.col("day").between(s, e)).select(
        "series_id", "day", F.struct(F.col("day").alias("obs_day"), F.col("value").alias("obs_value")).alias("obs"))
    asked = probes.filter(F.col("day").between(s, e)).select("series_id", "day", F.struct(*mine).alias("probe"))
    order = ["series_id", "day", "_asked", "_tie"]
    rows = points.unionByName(asked, allowMissingColumns=True)
    rows = rows.withColumn("_asked", F.col("probe").isNotNull()).withColumn("_tie", F.xxhash64("probe"))
    rows = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint())
    held = rows.filter(~F.col("_asked"))
    sides = (rows.select("_part", "series_id").distinct()
             .join(held.groupBy("_part", "series_id").agg(F.max_by("obs", "_at").alias("_last"), F.min("day").alias("_first")), ["_part", "series_id"], "left"))
    by_part = Window.partitionBy("series_id").orderBy("_part")      # a row a partition
    sides = sides.select(
        "_part", "series_id", F.last("_last", True).over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(by_part.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    here = Window.partitionBy("_part", "series_id").orderBy("_at")
    filled = (rows.withColumn("_obs", F.last("obs", True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_next", F.first(F.when(~F.col("_asked"), F.col("day")), True).over(here.rowsBetween(0, Window.unboundedFollowing)))
              .filter("_asked").join(sides, ["_part", "series_id"]))
    found = F.coalesce("_obs", "_before")
    later = F.coalesce("_next", "_after").isNotNull()
    return (filled.withColumn("_found", found).filter(F.col("_found").isNotNull() & (later | (F.col("_found.obs_day") == F.col("day"))))
            .select("series_id", "day", *[F.col(f"probe.{c}").alias(c) for c in mine], "_found.obs_day", "_found.obs_value"))


def last_n_points(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` points of each series."""
    w = Window.partitionBy("series_id").orderBy(F.desc("day"))
    return (series.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r"))


def first_nonempty(points: DataFrame, keys, candidate="candidate_no") -> DataFrame:
    """Points of the first candidate that has any, per key."""
    best = points.groupBy(*keys).agg(F.min(candidate).alias(candidate))
    return points.join(best, [*keys, candidate], "left_semi")


def indicator_last_change(series: DataFrame, keys, period="period", n: int = 6) -> DataFrame:
    """Last ``n`` points with the latest change against the point before it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(period))
    prev = F.lead("value").over(w)
    pct = F.when(prev.isNotNull(), F.coalesce(ratio(F.col("value") - prev, prev) * 100, F.lit(0.0)))
    return (series.withColumn("recency", F.row_number().over(w)).withColumn("_pct", pct)
            .filter(F.col("recency") <= n)
            .withColumn("change_pct", F.when(F.col("recency") == 1, F.col("_pct"))).drop("_pct"))


def vitals_regression(vitals: DataFrame, good: float = 2500, poor: float = 4000,
                      worse_pct: float = 10) -> DataFrame:
    """Latest weekly value against the upper median of the eight before it."""
    w = Window.partitionBy("metric").orderBy(F.desc("period_end"))
    recent = (vitals.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 9)
              .groupBy("metric")
              .agg(F.max(F.when(F.col("_r") == 1, F.col("p75"))).alias("latest"),
                   F.sort_array(F.collect_list(F.when(F.col("_r") > 1, F.col("p75")))).alias("_p"),
                   F.count("p75").alias("_n")))
    median = F.try_element_at("_p", (F.floor(F.size("_p") / 2) + 1).cast("int"))
    pct = ratio(F.col("latest") - F.col("median"), F.col("median")) * 100
    return (recent.filter(F.col("_n") >= 3).withColumn("median", median)
            .withColumn("delta_pct", pct)
            .select("metric", "latest", "median", "delta_pct",
                    F.coalesce(F.col("delta_pct") > worse_pct, F.lit(False)).alias("regression"),
                    F.when(F.col("latest") <= good, "good").when(F.col("latest") > poor, "poor")
                    .otherwise("needs_improvement").alias("band")))


def measured_rollup(measured: DataFrame) -> DataFrame:
    """Measured traffic per (country, day), and per day over all countries (``is_total``)."""
    sums = measured.filter(F.col("day").isNotNull()).rollup("day", "country").agg(
        F.sum("traffic").alias("traffic"), F.grouping_id().alias("_g"))
    return sums.filter(F.col("_g") < 2).select("day", "country", (F.col("_g") == 1).alias("is_total"), "traffic")


def measured_summary(measured: DataFrame) -> DataFrame:
    """How much was measured: distinct days, their span, and countries."""
    return measured.agg(F.countDistinct("day").alias("days"), F.min("day").alias("first_day"),
                        F.max("day").alias("last_day"), F.countDistinct("country").alias("countries"))


def prefer_measured(measured: DataFrame, proxy: DataFrame) -> DataFrame:
    """Per series the measured points when there are any, else the proxy's."""
    have = measured.select("series_id").distinct()
    return (measured.withColumn("basis", F.lit("measured"))
            .unionByName(proxy.join(have, "series_id", "left_anti")
                         .withColumn("basis", F.lit("proxy"))))
