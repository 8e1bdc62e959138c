"""Ranking, top-k, retention and small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsetrail import vocab
from pulsetrail.functions import measures as M
from pulsetrail.functions.text import one_of
from pulsetrail.session import shared_dir


def rivals_of_divisions(membership: DataFrame, wanted: DataFrame) -> DataFrame:
    """(subject_id, series_id): distinct competitors in the divisions of each subject; ``wanted`` is (subject_id, division)."""
    return (wanted.join(membership, "division").filter(F.col("series_id") != F.col("subject_id"))
            .select("subject_id", "series_id").distinct())


#: offsets that are sent to every task at most; more are joined by partition and group
BROADCAST = 100_000


def rank_keys(move: Column) -> list[Column]:
    """Ordering of events for a move ('+', '-', 'neutral' or null = none)."""
    d = F.col("impact_direction")
    matched = (F.when(d == move, 0).when(d == "neutral", 2).otherwise(1))
    directional = F.coalesce(move.isin("+", "-"), F.lit(False))
    return [F.when(directional, matched).otherwise(0),
            F.when(move.isNotNull(), -one_of(F.col("confidence"), vocab.RANK_WEIGHT, 0)).otherwise(0),
            F.when(move.isNotNull() & (d == "neutral"), 1).otherwise(0),
            -F.datediff("date", F.lit("1970-01-01"))]


def global_rank_by_range(df: DataFrame, columns: list[str], tie: str = "arrival",
                         name: str = "rank", per: tuple[str, ...] = ()) -> DataFrame:
    """Row number over the whole frame, or within each ``per``, for keys of any cardinality.

    Rows are range-partitioned and sorted, and that arrangement is stored by a
    checkpoint (an action), so that the position inside a partition and the
    partition offsets are read from the same rows even when an executor is
    lost.  ``tie`` is unique, so equal keys, and a group that holds most rows,
    spread over partitions.  Offsets are counts per partition and group, summed
    within the group: a row a partition, and one more a group.
    """
    shared_dir(df.sparkSession)
    order = [*per, *columns, tie]
    stored = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(per)]
    sizes = stored.groupBy(part.alias("_p"), *groups).agg(F.count("*").alias("_n"), F.min(inside).alias("_from"))
    whole = Window.partitionBy(*[f"_g{i}" for i in range(len(per))]) if per else Window
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").checkpoint()
    same = part == F.col("_p")
    for i, c in enumerate(per):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST else offsets
    return (stored.join(offsets, same).withColumn(name, F.col("_off") + inside - F.col("_from") + 1)
            .drop("_p", "_off", "_from", "_at", *[f"_g{i}" for i in range(len(per))]))


def rank_events(moved: DataFrame) -> DataFrame:
    """Events with their display rank within their series, for the move on the row."""
    keys = rank_keys(F.col("move"))
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = moved.withColumns(dict(zip(names, keys)))
    return global_rank_by_range(keyed, names, per=("series_id",)).drop(*names)


def topk_events(moved: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` events of each series by display order; Spark keeps k rows a series and task."""
    w = Window.partitionBy("series_id").orderBy(*rank_keys(F.col("move")), "arrival")
    return moved.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def first_rank_by_date(ranked: DataFrame) -> DataFrame:
    """Rank of the first listed event of each series and date."""
    return ranked.groupBy("series_id", "date").agg(F.min("rank").alias("first_rank"))


def topk_per_axis(events: DataFrame, axis: str, k: int = 3, tie: str = "arrival") -> DataFrame:
    """Top ``k`` per series and axis by strength x confidence rank, and how many remain.

    The row_number filter is applied before the shuffle as a group limit, so
    an axis holding most rows sends k rows per task.
    """
    w = (M.strength(F.col("impact_strength"))
         * one_of(F.col("confidence"), vocab.RANK_WEIGHT, 1))
    order = Window.partitionBy("series_id", axis).orderBy(F.desc("weight"), tie)
    scored = events.withColumn("weight", w)
    top = (scored.withColumn("axis_rank", F.row_number().over(order))
           .filter(F.col("axis_rank") <= k))
    totals = events.groupBy("series_id", axis).agg(F.count("*").alias("_n"))
    return (top.join(totals, ["series_id", axis])
            .withColumn("remaining", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n"))


def recent_titles(ledger: DataFrame, n: int = 25) -> DataFrame:
    """Titles of the last ``n`` rows of each origin in ledger order.

    Company events without a source are passed over; the raw title wins over
    the judged one and rows without any are left out after the cut.
    """
    order = Window.partitionBy("origin").orderBy(F.desc("date"), F.desc("arrival"))
    eligible = ledger.filter((F.col("category") != "company") | (F.coalesce("source", F.lit("")) != ""))
    return (eligible.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
            .withColumn("shown", F.coalesce(F.nullif("raw_title", F.lit("")), "title"))
            .filter(F.coalesce("shown", F.lit("")) != "").drop("_r"))


def recent_raw_items(ledger: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows that have a raw title."""
    return (ledger.filter(F.coalesce("raw_title", F.lit("")) != "")
            .orderBy(F.desc("date"), F.desc("arrival")).limit(n))


def keep_last_records(records: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the latest ``n`` records; ``key`` orders and names a record."""
    latest = records.select(key).distinct().orderBy(F.desc(key)).limit(n)
    return records.join(F.broadcast(latest), key, "left_semi")   # n keys


keep_last_dates = keep_last_records


def items_per_source_cap(items: DataFrame, label: str = "label", order: str = "arrival",
                         n: int = 10) -> DataFrame:
    """The first ``n`` items of every source (this report's own definition)."""
    w = Window.partitionBy(label).orderBy(order)
    return items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def dashboard_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"),
                      F.count_if(F.col("impact_direction") == "-").alias("negatives"))
