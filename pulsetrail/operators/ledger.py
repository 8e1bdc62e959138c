"""Ledger hygiene: filters, record conformance, event building, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsetrail import vocab
from pulsetrail.functions import dates as D, measures as M, text as X
from pulsetrail.operators.ranking import global_rank_by_range
from pulsetrail.operators.scope import Places, normalise_scope, normalise_tokens


def keyword_gate(text: Column, keep, drop) -> Column:
    """No DROP substring and at least one KEEP substring, case-insensitive."""
    t = F.lower(text)
    lower = lambda ws: [w.lower() for w in ws]
    return ~X.contains_any(t, lower(drop)) & X.contains_any(t, lower(keep))


def fold_keywords(keep, topics) -> list[str]:
    """KEEP list with the interest topics added once each, lower-cased."""
    out = list(keep)
    for t in topics:
        if t.lower() not in out:
            out.append(t.lower())
    return out


def origin(event_id: Column) -> Column:
    """Where a row came from, by its id prefix."""
    return (F.when(event_id.startswith("E"), "seed").when(event_id.startswith("A"), "news")
            .when(event_id.startswith("FP"), "feed"))


def division_filter(ledger: DataFrame, division: str | None) -> DataFrame:
    return ledger if division in (None, "ALL") else ledger.filter(
        F.array_contains("divisions", division))


def period_filter(ledger: DataFrame, start=None, end=None) -> DataFrame:
    """Closed date interval; a missing bound is open."""
    if start is not None:
        ledger = ledger.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        ledger = ledger.filter(F.col("date") <= F.lit(end).cast("date"))
    return ledger


def untranslated_report(rows: DataFrame, text: str = "description", raw: str = "raw_desc",
                        by: str | None = None) -> DataFrame:
    """Rows without Hangul, rows equal to their raw text, and the share."""
    foreign, same = ~X.has_hangul(F.col(text)), (F.coalesce(text, F.lit("")) == F.col(raw)) & (F.col(raw) != "")
    out = rows.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("rows"), F.count_if(foreign).alias("untranslated"),
        F.count_if(same).alias("unchanged"))
    return out.withColumn("untranslated_pct",
                          M.half_up(M.ratio(F.col("untranslated"), F.col("rows")) * 100, 2))


def date_repair(ledger: DataFrame) -> DataFrame:
    """Each row with its repaired date, provenance and outcome."""
    collected = F.substring("event_id", 1, 1).isin("A", "F")
    day, captured, url_day = F.col("date"), F.col("captured_date"), F.col("_url_day")
    # separate steps, so that each parsed value is computed once per row
    rows = (ledger.withColumn("_url_day", D.from_url(F.col("raw_url")))
            .withColumn("_raw_day", D.parse_strict(F.col("raw_date")))
            .withColumn("outcome", D.repair_outcome(day, captured, url_day, collected)))
    done = F.col("outcome")
    return (rows.withColumn("new_date", F.when(done == "from_url", url_day)
                            .when(done == "from_capture", captured).otherwise(day))
            .withColumn("new_source", F.when(done == "from_url", "url")
                        .when(done == "from_capture", "capture")
                        .when(F.col("date_source").isNull() & (done != "seed_skipped"),
                              D.infer_source(day, F.col("_raw_day"), captured, url_day))
                        .otherwise(F.col("date_source")))
            .drop("_url_day", "_raw_day"))


def first_per_key(rows: DataFrame, keys, order: str = "arrival") -> DataFrame:
    """First row of every key by ``order``.

    The ``row_number = 1`` filter is applied per task before the shuffle, so
    one key holding most rows costs one row per task.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def dedup_date_title(rows: DataFrame, title_chars: int | None = None) -> DataFrame:
    """First row per (date, title); optionally only the title's head counts."""
    title = F.col("title") if title_chars is None else F.substring("title", 1, title_chars)
    return first_per_key(rows, ["date", F.coalesce(title, F.lit(""))])


def number_curated(rows: DataFrame, first: int = 101) -> DataFrame:
    """Ids ``E101``... in (date, title) order over the whole frame.

    Runs an action (see ``global_rank_by_range``).
    """
    ranked = global_rank_by_range(rows, ["date", "title"])
    return (ranked.withColumn("event_id", F.concat(F.lit("E"), (F.col("rank") + (first - 1)).cast("string")))
            .drop("rank"))


def _choice(c: Column, allowed, default: str) -> Column:
    t = X.strip(F.coalesce(c, F.lit(default)))
    return F.when(t.isin(*allowed), t).otherwise(default)


def _choices(c: Column, allowed) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), X.strip)
    return F.array_distinct(F.filter(parts, lambda p: p.isin(*allowed)))


def conform_records(rows: DataFrame, places: Places) -> DataFrame:
    """Curated text records to the ledger's vocabulary.

    Expects text columns; rows with a malformed date or no title are dropped.
    The date test is the pattern only, so the date stays text.
    """
    date, title = X.strip(F.col("date")), X.strip(F.col("title"))
    cat = X.strip(F.coalesce("category", F.lit("economy")))
    cat = F.coalesce(X.one_of(cat, vocab.CATEGORY_FIXES), cat)
    kpi = _choices(F.col("kpi"), vocab.KPIS)
    n = F.coalesce(X.strip(F.col("impact_strength").cast("string")).try_cast("int"), F.lit(2))
    text = lambda c: X.strip(F.col(c))
    return (rows.filter(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & (title != ""))
            .select("arrival", date.alias("date"),
                    F.coalesce(F.nullif(X.strip(F.coalesce("captured_date", date)), F.lit("")), date)
                    .alias("captured_date"),
                    normalise_scope(F.col("scope"), places).alias("scope"),
                    _choices(F.col("divisions"), vocab.DIVISIONS).alias("divisions"),
                    F.when(F.size(kpi) > 0, kpi).otherwise(F.array(F.lit("Traffic"))).alias("kpi"),
                    F.when(cat.isin(*vocab.CATEGORIES), cat).otherwise("economy").alias("category"),
                    title.alias("title"), text("description").alias("description"),
                    _choice(F.col("impact_direction"), vocab.DIRECTIONS, "unknown").alias("impact_direction"),
                    _choice(F.col("impact_horizon"), vocab.HORIZONS, "weeks").alias("impact_horizon"),
                    _choice(F.col("confidence"), vocab.CONFIDENCES, "low").alias("confidence"),
                    _choice(F.col("metric"), vocab.METRICS, "traffic").alias("metric"),
                    text("source").alias("source"), text("impact").alias("impact"),
                    F.greatest(F.lit(1), F.least(F.lit(5), n)).alias("impact_strength"),
                    M.clean_axis(F.col("axis")).alias("axis")))


def event_key(prefix: str, *parts: Column) -> Column:
    """Prefix and the first eight hex digits of the md5 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat(*[
        F.coalesce(p, F.lit("")) for p in parts])), 1, 8))


def news_event_id(title: Column, date_text: Column) -> Column:
    return event_key("A", title, date_text)


def feed_event_id(label: Column, title: Column) -> Column:
    return event_key("FP", label, title)


def build_events(items: DataFrame, channel: str, today: Column, places: Places) -> DataFrame:
    """Judged items to ledger rows with the channel's defaults.

    ``items`` has ``title, desc, url, published, label`` and a struct column
    ``verdict`` (title, impact, description, date, scope ARRAY, divisions
    ARRAY, kpi ARRAY, category, impact_direction, impact_horizon,
    impact_strength, confidence, metric, axis) plus ``llm``.
    """
    news = channel == "news"
    v = lambda f: F.col(f"verdict.{f}")
    when = D.validate(v("date"), F.col("published"), today)
    empty = F.array().cast("array<string>")
    judged = F.when(F.coalesce(v("title"), F.lit("")) != "", v("title")).otherwise(F.col("title"))
    title = (F.substring(judged, 1, 140) if news else
             F.concat(F.lit("["), F.col("label"), F.lit("] "), F.substring(judged, 1, 60)))
    kpi = F.coalesce(v("kpi"), empty)
    event_id = (news_event_id(F.col("title"), D.iso(F.col("_when.date"))) if news
                else feed_event_id(F.col("label"), F.col("title")))
    text = lambda c: F.coalesce(c, F.lit(""))
    source = (F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("url")) if news else F.col("label"))
    return items.withColumn("_when", when).select(
        "arrival", event_id.alias("event_id"), F.col("_when.date").alias("date"),
        F.col("_when.date_source").alias("date_source"), today.alias("captured_date"),
        normalise_tokens(F.coalesce(v("scope"), empty), places).alias("scope"),
        F.coalesce(v("divisions"), empty).alias("divisions"),
        (kpi if news else F.when(F.size(kpi) > 0, kpi).otherwise(F.array(F.lit("Traffic")))).alias("kpi"),
        F.coalesce(v("category"), F.lit("economy" if news else "platform")).alias("category"),
        title.alias("title"), text(v("impact")).alias("impact"),
        text(v("description")).alias("description"),
        F.coalesce(v("impact_direction"), F.lit("unknown")).alias("impact_direction"),
        F.coalesce(v("impact_horizon"), F.lit("weeks")).alias("impact_horizon"),
        F.coalesce(v("impact_strength"), F.lit(2)).alias("impact_strength"),
        F.coalesce(v("confidence"), F.lit("low" if news else "med")).alias("confidence"),
        F.coalesce(v("metric"), F.lit("traffic")).alias("metric"),
        M.clean_axis(v("axis")).alias("axis"), "llm", source.alias("source"),
        F.col("title").alias("raw_title"), text(F.col("desc")).alias("raw_desc"),
        text(F.col("url")).alias("raw_url"), text(F.col("published")).alias("raw_date"))


def accept_verdict(relevant: Column, *required_texts: Column) -> Column:
    """'missing', 'irrelevant', 'rejected' or 'accepted'.

    A relevant verdict whose non-empty text fields lack Hangul is rejected so
    that the next judge is asked.
    """
    foreign = F.lit(False)
    for c in required_texts:
        foreign = foreign | ((F.coalesce(c, F.lit("")) != "") & ~X.has_hangul(c))
    return (F.when(relevant.isNull(), "missing").when(~relevant, "irrelevant")
            .when(foreign, "rejected").otherwise("accepted"))


def split_facts(rows: DataFrame, site_pattern: str, text: str = "description",
                raw: str | None = "raw_description") -> DataFrame:
    """Facts and inference of each description; the original is kept."""
    source = F.coalesce(F.nullif(raw, F.lit("")), text) if raw else F.col(text)
    s = rows.withColumn("_s", X.sentences(source)).withColumn(
        "_k", X.fact_count(F.col("_s"), site_pattern))
    join = lambda a: F.array_join(a, " ")
    out = (s.withColumn("facts", F.when(F.col("_k") > 0, join(F.slice("_s", F.lit(1), F.col("_k")))).otherwise(""))
           .withColumn("inference", join(F.slice(F.col("_s"), F.col("_k") + 1, F.size("_s")))))
    changed = (F.col("inference") != "") & (F.col("facts") != F.coalesce(text, F.lit("")))
    return out.withColumn("changed", changed).drop("_s", "_k")


def split_report(split: DataFrame) -> DataFrame:
    """Changed and unchanged rows; shortest and upper-median fact length.

    The median comes from a count per distinct length, so it is exact and its
    input is bounded by the number of different lengths.
    """
    length = F.when(F.col("changed"), F.length("facts"))
    lengths = split.groupBy(length.alias("len")).agg(F.count("*").alias("n"))
    changed = F.when(F.col("len").isNotNull(), F.col("n")).otherwise(0)
    # distinct lengths are few; a running count over them locates the middle
    every = Window.orderBy(F.asc_nulls_first("len"))
    upto = F.sum(changed).over(every.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(changed).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (lengths.withColumn("_upto", upto).withColumn("_total", total)
            .agg(F.sum(changed).alias("changed"), (F.sum("n") - F.sum(changed)).alias("unchanged"),
                 F.min("len").alias("min_len"),
                 F.min(F.when(F.col("_upto") > F.floor(F.col("_total") / 2), F.col("len"))).alias("median_len")))
