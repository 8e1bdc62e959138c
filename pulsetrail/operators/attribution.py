"""What moved a series between two periods, and which events explain it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsetrail import vocab
from pulsetrail.functions import measures as M
from pulsetrail.functions.text import one_of
from pulsetrail.operators.periods import PERIOD_COLUMNS, period_means
from pulsetrail.operators.series import (market_zero_fill, prefix_sums, range_stats, with_span)
from pulsetrail.session import shared_dir

_LABELS = ["series_id", *PERIOD_COLUMNS]


def seasonal_baseline(series: DataFrame, periods: DataFrame, max_back: int = 10) -> DataFrame:
    """Replay each comparison at its own lag back through history.

    Returns the median log ratio, a robust sigma (null when 0) and the number
    of replays; comparisons with fewer than three replays are absent.
    """
    lag, length = F.datediff("cur_start", "cmp_start"), F.datediff("cur_end", "cur_start")
    replays = (with_span(periods.filter((lag > 0) & (length >= 0)), series)
               .withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max_back))))
               .withColumn("_cf", F.date_sub("cur_start", lag * F.col("_k")))
               .withColumn("_ct", F.date_add("_cf", length))
               .withColumn("_pf", F.date_sub("_cf", lag))
               .withColumn("_pt", F.date_add("_pf", length))
               .filter(F.col("_pf") >= F.col("first_day")))
    prefix = prefix_sums(series)
    replays = range_stats(range_stats(replays, prefix, "_cf", "_ct", "a"), prefix, "_pf", "_pt", "b")
    logs = (replays.filter((F.col("a_mean") != 0) & (F.col("b_mean") != 0))
            .withColumn("_g", F.ln(F.col("a_mean") / F.col("b_mean"))))
    # at most ``max_back`` ratios per comparison
    got = (logs.groupBy(*_LABELS).agg(F.median("_g").alias("expected_log"),
                                      F.collect_list("_g").alias("_all"),
                                      F.count("*").alias("replays"))
           .filter(F.col("replays") >= 3))
    dev = F.array_sort(F.transform("_all", lambda g: F.abs(g - F.col("expected_log"))))
    mid = F.floor(F.col("replays") / 2).cast("int")
    mad = (F.when(F.col("replays") % 2 == 1, F.element_at("_dev", mid + 1))
           .otherwise((F.element_at("_dev", F.greatest(mid, F.lit(1))) + F.element_at("_dev", mid + 1)) / 2))
    return (got.withColumn("_dev", dev)
            .select(*_LABELS, "expected_log", F.nullif(mad * 1.4826, F.lit(0.0)).alias("sigma"),
                    "replays"))


def _vitals_means(vitals: DataFrame, periods: DataFrame) -> DataFrame:
    """Mean vitals of both periods of each comparison (``v1``, ``v0``).

    Vitals belong to the site, so they are found by day, not by series.
    """
    day = lambda part: lambda d: F.struct(F.lit(part).alias("part"), d.alias("day"))
    days = periods.select(*_LABELS, F.inline(F.concat(
        F.transform(F.sequence("cur_start", "cur_end"), day("cur")),
        F.transform(F.sequence("cmp_start", "cmp_end"), day("cmp")))))
    points = vitals.select(F.col("period_end").alias("day"), "p75")
    return days.join(points, "day").groupBy(*_LABELS).agg(
        F.avg(F.when(F.col("part") == "cur", F.col("p75"))).alias("v1"),
        F.avg(F.when(F.col("part") == "cmp", F.col("p75"))).alias("v0"))


def log_attribution(basis: DataFrame, series: DataFrame, rivals: DataFrame, periods: DataFrame,
                    vitals: DataFrame | None = None) -> DataFrame:
    """Demand, share and supply parts of each comparison's log move.

    ``basis`` is what is being explained (measured or proxy), ``series`` and
    ``rivals`` give market attention.  Share is the residual, so the parts add
    up to the total exactly; only axes pushing the total's way get a share of
    the allocation.  One row per (comparison, axis).
    """
    total = period_means(basis, periods).withColumnsRenamed({"cur_avg": "t1", "cmp_avg": "t0"})
    market = period_means(market_zero_fill(series, rivals)
                          .select(F.col("subject_id").alias("series_id"), "day", "value"), periods)
    market = market.select(*_LABELS, F.col("cur_avg").alias("d1"), F.col("cmp_avg").alias("d0"))
    moved = total.join(market, _LABELS)
    if vitals is not None:
        moved = moved.join(_vitals_means(vitals, periods), _LABELS, "left")
    else:
        moved = moved.withColumn("v1", F.lit(None).cast("double")).withColumn("v0", F.lit(None).cast("double"))
    usable = ((F.col("t0") != 0) & (F.col("d0") != 0) & F.col("t1").isNotNull()
              & F.col("d1").isNotNull())
    g = (moved.filter(usable)
         .withColumn("g_total", F.ln(F.col("t1") / F.col("t0")))
         .withColumn("g_demand", F.ln(F.col("d1") / F.col("d0")))
         .filter(F.abs("g_total") > 1e-6)
         .withColumn("_rest", F.col("g_total") - F.col("g_demand"))
         .withColumn("vitals_pct", M.ratio(F.col("v1") - F.col("v0"), F.col("v0")) * 100))
    slow = (F.col("vitals_pct") > 10) & (F.col("g_total") < 0) & (F.col("_rest") < 0)
    part = F.when(slow, F.least(F.lit(0.25), (F.col("vitals_pct") - 10) / 100)).otherwise(0.0)
    g = (g.withColumn("_supply", F.col("_rest") * part)
         .withColumn("_share", F.col("_rest") - F.col("_supply")))
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("g"))
                     for a, c in (("demand", "g_demand"), ("share", "_share"), ("supply", "_supply"))])
    drove = lambda x: F.when(F.col("g_total") < 0, x < -1e-9).otherwise(x > 1e-9)
    causes = F.aggregate("_axes", F.lit(0.0),
                         lambda acc, x: acc + F.when(drove(x["g"]), F.abs(x["g"])).otherwise(0.0))
    out = (g.withColumn("_axes", axes).withColumn("_sum", causes)
           .select(*_LABELS, "g_total", "vitals_pct", "_sum", F.inline("_axes")))
    return out.select(
        *_LABELS, "axis", "g_total", "g",
        F.when(drove(F.col("g")), F.abs("g") / F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum")))
        .otherwise(0.0).alias("allocation"),
        (F.exp("g") - 1).alias("effect"),
        ((F.exp("g_total") - 1) * 100).alias("total_pct"), "vitals_pct")


def seasonal_residual(moves: DataFrame, baseline: DataFrame) -> DataFrame:
    """Expected and unexplained parts of each move, with its z-score."""
    z = M.ratio(F.col("g_total") - F.col("expected_log"), F.col("sigma"))
    return (moves.select(*_LABELS, "g_total").distinct().join(baseline, _LABELS)
            .withColumn("expected_pct", (F.exp("expected_log") - 1) * 100)
            .withColumn("residual_pct", (F.exp(F.col("g_total") - F.col("expected_log")) - 1) * 100)
            .withColumn("z", z)
            .withColumn("unusual", F.abs("z") >= 2))


def basis_gap(basis: DataFrame, periods: DataFrame) -> DataFrame:
    """Comparisons a measured basis cannot answer: a period has no level."""
    return (period_means(basis, periods)
            .withColumn("gap", F.col("cur_avg").isNull()
                        | (F.coalesce("cmp_avg", F.lit(0.0)) == 0)))


#: verdicts that are sent to every task at most, and the parts that a series is dealt into beyond that
BROADCAST, PARTS = 100_000, 32


def with_move(ledger: DataFrame, verdicts: DataFrame, bound: int = BROADCAST, parts: int = PARTS) -> DataFrame:
    """Attach each series' periods and move direction to its events.

    ``verdicts`` holds one comparison per series; without a verdict the
    direction stays null.  Verdicts are stored and counted (an action): up to
    ``bound`` of them go to the events, so the ledger isn't shuffled; beyond
    that each series is joined in ``parts``, however many events it holds.
    """
    shared_dir(ledger.sparkSession)
    known = verdicts.select("series_id", *PERIOD_COLUMNS, F.col("direction").alias("move"), "pct").checkpoint()
    if known.count() <= bound:
        return ledger.join(F.broadcast(known), "series_id")
    known = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = ledger.withColumn("_part", F.pmod(F.xxhash64("event_id", "date"), F.lit(parts)).cast("int"))
    return dealt.join(known, ["series_id", "_part"]).drop("_part")


def direction_match(moved: DataFrame) -> DataFrame:
    """In-period events; ``explains`` marks those pushing the move's way.

    With no move everything explains.
    """
    inside = F.col("date").between(F.col("cur_start"), F.col("cur_end"))
    return moved.filter(inside).withColumn(
        "explains", F.col("move").isNull() | F.col("impact_direction").eqNullSafe(F.col("move")))


def category_attribution(moved: DataFrame) -> DataFrame:
    """Share of the move per category group, by summed event weight."""
    w = (M.strength(F.col("impact_strength"))
         * one_of(F.col("confidence"), vocab.CONFIDENCE_WEIGHT, 0.5))
    group = one_of(F.col("category"), vocab.CATEGORY_GROUPS, vocab.OTHER_GROUP)
    groups = (direction_match(moved.filter(F.col("move").isin("+", "-"))).filter("explains")
              .groupBy("series_id", "pct", group.alias("category_group"))
              .agg(F.sum(w).alias("weight"), F.count("*").alias("events")))
    # a handful of groups per series after the aggregate
    total = F.sum("weight").over(Window.partitionBy("series_id"))
    return (groups.withColumn("share", M.ratio(F.col("weight"), total))
            .select("series_id", "category_group", "events", "weight", "share",
                    (F.col("share") * F.abs("pct")).alias("points")))


def carry_base_factors(moved: DataFrame) -> DataFrame:
    """Events outside the current period that still bear on the comparison.

    carry: between the periods, lasting months, pushing the move's way.
    base: inside the comparison period, pushing the other way.
    """
    keys = ("event_id", "date", "title")
    d = F.col("date")
    other = F.when(F.col("move") == "-", "+").otherwise("-")
    kind = (F.when((d > F.col("cmp_end")) & (d < F.col("cur_start"))
                   & (F.col("impact_horizon") == "months")
                   & (F.col("impact_direction") == F.col("move")), "carry")
            .when(d.between(F.col("cmp_start"), F.col("cmp_end"))
                  & (F.col("impact_direction") == other), "base"))
    return (moved.filter(F.col("move").isin("+", "-") & (F.col("cmp_end") < F.col("cur_start")))
            .withColumn("kind", kind).filter(F.col("kind").isNotNull())
            .dropDuplicates(["series_id", *keys]))


def axis_event_lists(moved: DataFrame, allocations: DataFrame, axis: str = "axis_used",
                     gap_at: float = 0.02) -> DataFrame:
    """Per axis: explaining events, the rest, and a flag where the numbers
    give the axis weight but no event explains it."""
    counts = (direction_match(moved).groupBy("series_id", axis)
              .agg(F.count_if("explains").alias("events"),
                   F.count_if(~F.col("explains")).alias("excluded")))
    every = allocations.select("series_id", F.col("axis").alias(axis), "allocation")
    return (every.join(counts, ["series_id", axis], "full")
            .withColumn("events", F.coalesce("events", F.lit(0)))
            .withColumn("excluded", F.coalesce("excluded", F.lit(0)))
            .withColumn("gap", (F.col("events") == 0)
                        & (F.coalesce("allocation", F.lit(0.0)) >= gap_at)))


def event_changepoint_link(ledger: DataFrame, points: DataFrame,
                           days: int = vocab.LINK_DAYS) -> DataFrame:
    """Nearest change point 0..``days`` after each event, same direction.

    A change point is spread over the ``days`` + 1 days it can answer for and
    the nearest is kept per day and direction; events then find theirs by an
    equality join.
    """
    reach = (points.select("series_id", F.col("direction").alias("impact_direction"),
                           F.col("day").alias("change_day"), F.col("pct").alias("change_pct"),
                           F.explode(F.sequence(F.lit(0), F.lit(days))).alias("gap_days"))
             .withColumn("date", F.date_sub("change_day", F.col("gap_days")))
             .groupBy("series_id", "impact_direction", "date")
             .agg(F.min_by(F.struct("change_day", "change_pct", "gap_days"), "gap_days").alias("_n"))
             .select("series_id", "impact_direction", "date", "_n.*"))
    return ledger.join(reach, ["series_id", "impact_direction", "date"])
