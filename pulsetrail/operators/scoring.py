"""Were past predictions right?  Pressure, hit scores, correlation, null test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsetrail import vocab
from pulsetrail.functions import measures as M
from pulsetrail.functions.text import one_of
from pulsetrail.operators.series import (calendar, forward_change, market_strict,
                                         prefix_sums, range_stats, share_strict, span_of,
                                         with_span)

AXES_ALL = (*vocab.AXES, "all")
_PRIME = 2147483647


def overlap_span(ledger: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, start, end): where the ledger and each series overlap."""
    ev = ledger.filter(F.col("date").isNotNull()).groupBy("series_id").agg(
        F.min("date").alias("_e0"), F.max("date").alias("_e1"))
    return (span_of(series).join(ev, "series_id")
            .select("series_id", F.greatest("start", "_e0").alias("start"),
                    F.least("end", "_e1").alias("end"))
            .filter(F.col("end") > F.col("start")))


def impulses(ledger: DataFrame) -> DataFrame:
    """Signed weight per (series, axis, horizon, day); 'all' holds every event.

    This is the only pass over the ledger and it folds map-side, so what is
    shuffled is bounded by days x axes x horizons per series.
    """
    w = M.event_weight(F.col("impact_strength"), F.col("confidence"), F.col("impact_direction"))
    ax = M.clean_axis(F.col("axis"))
    axes = F.when(ax == "", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), ax))
    return (ledger.filter(F.col("date").isNotNull())
            .select("series_id", F.col("date").alias("day"),
                    M.horizon(F.col("impact_horizon")).alias("horizon"),
                    w.alias("w"), F.explode(axes).alias("axis"))
            .filter(F.col("w") != 0)
            .groupBy("series_id", "axis", "horizon", "day").agg(F.sum("w").alias("w")))


def decay(points: DataFrame) -> DataFrame:
    """Spread impulses over the following days: w * 0.5 ** (age / half-life)."""
    half = one_of(F.col("horizon"), vocab.HALF_LIFE_DAYS)
    return (points.withColumn("_hl", half)
            .withColumn("_age", F.explode(F.sequence(F.lit(0), F.col("_hl") * vocab.DECAY_HALF_LIVES)))
            .withColumn("day", F.date_add("day", F.col("_age")))
            .withColumn("p", F.col("w") * F.pow(F.lit(0.5), F.col("_age") / F.col("_hl"))))


def pressure_index(ledger: DataFrame, spans: DataFrame) -> DataFrame:
    """(series_id, axis, day, p) for every axis and day of each span."""
    grid = calendar(spans).withColumn("axis", F.explode(F.array(*map(F.lit, AXES_ALL))))
    spread = (decay(impulses(ledger)).groupBy("series_id", "axis", "day")
              .agg(F.sum("p").alias("p")))
    return (grid.join(spread, ["series_id", "axis", "day"], "left")
            .select("series_id", "axis", "day", F.coalesce("p", F.lit(0.0)).alias("p")))


def dense_window(ledger: DataFrame, spans: DataFrame,
                 minimum: int = vocab.MONTH_MINIMUM) -> DataFrame:
    """(series_id, dense_start, end): the populated stretch up to the end.

    ``dense_start`` is null when even the last month is below ``minimum``.
    """
    month = F.trunc("date", "MM")
    per = ledger.groupBy("series_id", month.alias("month")).agg(F.count("*").alias("n"))
    months = spans.select("series_id", "start", "end", F.explode(F.sequence(
        F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("interval 1 month"))).alias("month"))
    counted = months.join(per, ["series_id", "month"], "left")
    thin = F.max(F.when(F.coalesce("n", F.lit(0)) < minimum, F.col("month")))
    return (counted.groupBy("series_id", "start", "end")
            .agg(thin.alias("_thin"), F.max("month").alias("_last"))
            .select("series_id",
                    F.when(F.col("_thin").isNull(), F.col("start"))
                    .when(F.col("_thin") < F.col("_last"), F.add_months("_thin", 1))
                    .alias("dense_start"), "end"))


def event_windows(ledger: DataFrame, series: DataFrame,
                  baseline_days: int = vocab.BASELINE_DAYS) -> DataFrame:
    """Mean level before each event and over its horizon window after it.

    The answer depends only on (series, date, window), so it is worked out once
    per such combination, a number bounded by the calendar, and joined to the
    events a single time.
    """
    keys = ["series_id", "date", "window_days"]
    events = (ledger.filter(F.col("date").isNotNull())
              .withColumn("window_days", one_of(M.horizon(F.col("impact_horizon")), vocab.WINDOW_DAYS)))
    prefix = prefix_sums(series)
    asked = (with_span(events.select(*keys).distinct(), series)
             .withColumn("_b0", F.date_sub("date", baseline_days))
             .withColumn("_b1", F.date_sub("date", 1))
             .withColumn("_a0", F.date_add("date", 1))
             .withColumn("_a1", F.date_add("date", F.col("window_days"))))
    both = range_stats(asked, prefix, "_b0", "_b1", "before")
    both = range_stats(both, prefix, "_a0", "_a1", "after")
    return events.join(both.select(*keys, "before_mean", "before_n", "after_mean", "after_n"), keys)


def hit_scores(ledger: DataFrame, series: DataFrame,
               min_coverage: float = vocab.MIN_COVERAGE) -> DataFrame:
    """Every event with its outcome: scored, skipped or unfinished."""
    sign = M.direction_sign(F.col("impact_direction"))
    dated = event_windows(ledger, series)
    status = (F.when(sign.isNull(), "skipped")
              .when(F.col("after_n") / F.col("window_days") < min_coverage, "unfinished")
              .when(F.coalesce(F.col("before_mean"), F.lit(0.0)) == 0, "skipped")
              .otherwise("scored"))
    move = M.ratio(F.col("after_mean") - F.col("before_mean"), F.col("before_mean"))
    out = dated.withColumn("status", status).withColumn("_move", F.when(F.col("status") == "scored", move))
    return (out.withColumn("actual_pct", M.half_up(F.col("_move") * 100, 2))
            .withColumn("hit", (F.col("_move") > 0) == (sign > 0)).drop("_move"))


def hit_summary(scores: DataFrame) -> DataFrame:
    """Hit rate and mean move of each series overall, by provenance and by axis, each also by
    strength and by confidence: one grouping-sets aggregate.
    """
    src = F.coalesce("date_source", F.lit("seed"))
    flat = (scores.filter(F.col("status") == "scored")
            .select("series_id", F.lit("all").alias("every"),
                    F.when(src.isin("url", "llm", "seed"), "foreknown")
                    .when(src == "capture", "retrospective").alias("provenance"),
                    F.nullif(M.clean_axis(F.col("axis")), F.lit("")).alias("axis"),
                    M.strength(F.col("impact_strength")).alias("strength"),
                    F.lower(F.coalesce("confidence", F.lit("low"))).alias("confidence"),
                    F.col("hit").cast("int").alias("hit"), F.round(F.abs("actual_pct") * 100).cast("long").alias("move"))
            .withColumn("block", F.explode(F.array(F.col("every"), F.col("provenance"), F.col("axis"))))
            .filter(F.col("block").isNotNull()))
    grouped = flat.groupingSets(
        [["series_id", "block"], ["series_id", "block", "strength"], ["series_id", "block", "confidence"]],
        "series_id", "block", "strength", "confidence").agg(
            F.count("*").alias("n"), F.avg("hit").alias("_h"),
            F.sum("move").alias("_s"), F.count("move").alias("_k"))
    # moves are whole hundredths: their mean is rounded on integers, so a tie goes up in whatever order they were added
    mean = F.when(F.col("_k") > 0, F.expr("(2 * _s + _k) div (2 * _k)") / 100.0)
    return grouped.select("series_id", "block", F.coalesce(F.col("strength").cast("string"), F.lit("")).alias("strength"),
                          F.coalesce("confidence", F.lit("")).alias("confidence"), "n",
                          M.half_up(F.col("_h"), 3).alias("hit_rate"),
                          mean.alias("mean_abs_move_pct"))


def axis_targets(series: DataFrame, rivals: DataFrame, spans: DataFrame) -> DataFrame:
    """(series_id, axis, day, change): the series each axis should anticipate."""
    def tagged(values, *axes):
        fwd = forward_change(values, spans)
        return fwd.withColumn("axis", F.explode(F.array(*map(F.lit, axes))))
    rename = {"subject_id": "series_id"}
    own = series.join(spans.select("series_id"), "series_id", "left_semi")
    return (tagged(own, "all", "supply")
            .unionByName(tagged(market_strict(series, rivals).withColumnsRenamed(rename), "demand"))
            .unionByName(tagged(share_strict(series, rivals).withColumnsRenamed(rename), "share")))


def pressure_correlation(pressure: DataFrame, targets: DataFrame, dense: DataFrame) -> DataFrame:
    """Pearson r of pressure and forward change over the full and dense spans.

    Without a dense stretch the full span stands in for it.
    """
    joined = (targets.join(pressure, ["series_id", "axis", "day"])
              .join(dense, "series_id")
              .withColumn("_in", F.col("dense_start").isNull() | (F.col("day") >= F.col("dense_start")))
              .withColumn("stretch", F.explode(F.when(
                  F.col("_in"), F.array(F.lit("full"), F.lit("dense")))
                  .otherwise(F.array(F.lit("full"))))))
    return joined.groupBy("series_id", "stretch", "axis").agg(
        M.pearson("p", "change").alias("r"), F.count("change").alias("n"))


def permutation_coefficients(n: int, seed: int) -> DataFrame:
    """(perm, c0..c3): coefficients of one random cubic per permutation.

    Cubics over a prime field give 4-wise independent draws, so the null keeps
    the mean, variance and kurtosis of independent redraws while every draw
    stays a few integer operations inside the JVM.
    """
    from pyspark.sql import SparkSession
    perms = SparkSession.getActiveSession().range(n).select(F.col("id").alias("perm"))
    x = (F.col("perm") * 104729 + F.lit(seed)) % _PRIME
    for j in range(4):
        x = (x * 48271 + F.lit(7919 * (j + 1))) % _PRIME
        perms = perms.withColumn(f"c{j}", x)
    return perms


def draw_index(key: Column, n_days: Column) -> Column:
    """Position of an event's redrawn day for the permutation on the row."""
    k = key % _PRIME
    v = F.col("c3")
    for c in ("c2", "c1", "c0"):
        v = (v * k + F.col(c)) % _PRIME
    return (v % n_days).cast("int")


def _class_null(sized: DataFrame, in_dense: DataFrame, permutations: int, seed: int, block: int = 50) -> DataFrame:
    """(series_id, axis, perm, null_r): redraws by class of events, in numpy.

    Events of one class (series, axis, horizon, weight) are exchangeable, so their redrawn days are
    multinomial counts; decay is a convolution over the calendar.  Work depends on classes x days x
    permutations, not on events.  A row holds a series' classes and targets, both bounded by the
    vocabulary and the calendar, and ``block`` permutations; its generator is seeded by series and
    block, so a repeated task draws the same.
    """
    import zlib

    import numpy as np
    import pandas as pd

    half, schema = dict(vocab.HALF_LIFE_DAYS), "series_id string, axis string, perm long, null_r double"

    def decayed(x, horizon):
        age = np.arange(half[horizon] * vocab.DECAY_HALF_LIVES + 1)
        n = x.shape[1] + len(age) - 1
        kernel = np.fft.rfft(0.5 ** (age / half[horizon]), n)
        return np.fft.irfft(np.fft.rfft(x, n) * kernel, n)[:, :x.shape[1]]

    def draw(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                perms = np.arange(r.block * block, min((r.block + 1) * block, permutations))
                rng = np.random.default_rng([seed, zlib.crc32(str(r.series_id).encode()), int(r.block)])
                even, moved = np.full(r.n_days, 1.0 / r.n_days), {}
                for c in sorted(r.classes, key=lambda c: (c["ax"], c["horizon"], c["w"])):
                    got = rng.multinomial(c["events"], even, size=len(perms)) * c["w"]
                    key = (c["ax"], c["horizon"])
                    moved[key] = moved[key] + got if key in moved else got
                pressure = {a: np.zeros((len(perms), r.n_days)) for a in AXES_ALL}
                for (ax, horizon), x in moved.items():
                    p = decayed(x, horizon)
                    pressure["all"] += p
                    if ax:
                        pressure[ax] += p
                goal = pd.DataFrame(list(map(dict, r.goal)))
                for axis, g in goal.groupby("axis"):
                    p, change = pressure[axis][:, g["at"].to_numpy()], g["change"].to_numpy()
                    p, change = p - p.mean(axis=1, keepdims=True), change - change.mean()
                    spread = np.sqrt((p * p).sum(axis=1) * (change @ change))
                    ok = (spread > 0) & (len(change) >= 3)
                    yield pd.DataFrame({"series_id": r.series_id, "axis": axis, "perm": perms[ok], "null_r": (p @ change)[ok] / spread[ok]})

    classes = (sized.groupBy("series_id", "ax", "horizon", "w", "n_days").agg(F.count("*").alias("events"))
               .groupBy("series_id", "n_days").agg(F.collect_list(F.struct("ax", "horizon", "w", "events")).alias("classes")))
    goals = (in_dense.filter(F.col("change").isNotNull()).groupBy("series_id")
             .agg(F.collect_list(F.struct("axis", "at", "change")).alias("goal")))
    blocks = F.sequence(F.lit(0), F.lit((permutations - 1) // block))
    rows = classes.join(goals, "series_id").withColumn("block", F.explode(blocks))
    # few bytes, much work: a task for every few blocks
    return rows.repartition(64, "series_id", "block").mapInPandas(draw, schema)


def _perm_range(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def permutation_test(ledger: DataFrame, dense: DataFrame, targets: DataFrame,
                     observed: DataFrame, permutations: int = 1000,
                     seed: int = 20260810, key: str = "arrival", draw_by: str = "class") -> DataFrame:
    """Could a ledger with random dates explain the series just as well?

    Each permutation redraws every event's day uniformly over the dense
    stretch; all axes share the draw.  ``dense`` is (series_id, dense_start,
    end), ``observed`` (series_id, axis, r).

    ``draw_by='class'`` draws day counts per class of events, so the ledger is
    read once whatever the number of permutations.  ``draw_by='event'`` draws
    each event's day from its unique integer ``key`` in Spark expressions: the
    same distribution, for ledgers of few events.
    """
    w = M.event_weight(F.col("impact_strength"), F.col("confidence"), F.col("impact_direction"))
    slim = (ledger.select("series_id", F.col(key).alias("k"), w.alias("w"),
                          M.horizon(F.col("impact_horizon")).alias("horizon"),
                          M.clean_axis(F.col("axis")).alias("ax"))
            .filter(F.col("w") != 0))
    usable = dense.filter(F.datediff("end", "dense_start") >= 9)
    sized = slim.join(usable.select("series_id", (F.datediff("end", "dense_start") + 1).alias("n_days")), "series_id")
    in_dense = (targets.join(usable, "series_id")
                .filter(F.col("day").between(F.col("dense_start"), F.col("end")))
                .select("series_id", "axis", "day", "change", F.datediff("day", "dense_start").alias("at")))
    if draw_by == "event":
        coef = permutation_coefficients(permutations, seed)
        drawn = (sized.withColumn("perm", F.explode(_perm_range(permutations)))
                 .join(F.broadcast(coef), "perm")       # ``permutations`` rows, a parameter
                 .groupBy("series_id", "perm", "ax", "horizon", draw_index(F.col("k"), F.col("n_days")).alias("at"))
                 .agg(F.sum("w").alias("w")))
        axes = F.when(F.col("ax") == "", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("ax")))
        placed = (drawn.join(usable, "series_id").withColumn("axis", F.explode(axes))
                  .withColumn("day", F.date_add("dense_start", F.col("at"))))
        spread = (decay(placed).filter(F.col("day") <= F.col("end"))
                  .groupBy("series_id", "perm", "axis", "day").agg(F.sum("p").alias("p")))
        null_r = (in_dense.withColumn("perm", F.explode(_perm_range(permutations)))
                  .join(spread, ["series_id", "perm", "axis", "day"], "left")
                  .withColumn("p", F.coalesce("p", F.lit(0.0)))
                  .groupBy("series_id", "axis", "perm").agg(M.pearson("p", "change").alias("null_r"))
                  .filter(F.col("null_r").isNotNull()))
    else:
        null_r = _class_null(sized, in_dense, permutations, seed)
    obs = observed.filter(F.col("r").isNotNull()).select("series_id", "axis", F.col("r").alias("observed_r"))
    one_test = Window.partitionBy("series_id", "axis")      # ``permutations`` rows each
    return (null_r.join(obs, ["series_id", "axis"])
            .withColumn("_rank", F.row_number().over(one_test.orderBy(F.abs("null_r"))))
            .withColumn("_n", F.count("*").over(one_test))
            .groupBy("series_id", "axis", "observed_r")
            .agg(F.count("*").alias("permutations"),
                 F.avg((F.abs("null_r") >= F.abs("observed_r")).cast("int")).alias("p_value"),
                 F.max(F.when(F.col("_rank") == F.floor(F.col("_n") * 0.95) + 1, F.abs("null_r")))
                 .alias("null_p95_abs_r"))
            .withColumn("significant", F.col("p_value") < 0.05))
