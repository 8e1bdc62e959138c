"""Invariants over the given tables, at the smallest scale."""

import pytest
from pyspark.sql import Window, functions as F

from pulsetrail.catalog.bindings import CMP, CUR, SUBJECT, Views
from pulsetrail.catalog.series import periods
from pulsetrail.operators import attribution as A, periods as P, ranking as K, scoring as S, series as O

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def test_attribution_adds_up(v):
    rows = A.log_attribution(v.series(), v.series(), v.rivals(), periods(v), v.vitals()).groupBy(
        "series_id", "g_total").agg(F.sum("g").alias("g"), F.sum("allocation").alias("a")).collect()
    assert rows
    for r in rows:
        assert r["g"] == pytest.approx(r["g_total"]) and r["a"] == pytest.approx(1.0)


def test_upsert_is_idempotent(v):
    s = v.series()
    day = F.lit("2001-03-15").cast("date")
    fresh = s.filter(F.col("day") >= "2000-12-01").withColumn("value", F.col("value") * 2)
    once = O.series_upsert(s, fresh, day)
    twice = O.series_upsert(once, fresh, day)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.agg(F.min(F.datediff(day, "day"))).first()[0] is not None


def test_rank_is_a_row_number_of_its_series(v):
    led = v.scored_ledger().withColumn("move", F.when(F.col("series_id") < "H", "-").when(F.col("series_id") < "M", "+"))
    want = led.withColumn("want", F.row_number().over(
        Window.partitionBy("series_id").orderBy(*K.rank_keys(F.col("move")), "arrival"))).select("arrival", "want")
    got = K.rank_events(led)
    assert got.join(want, "arrival").filter("rank <> want").count() == 0
    assert got.count() == led.count()


def test_range_means_match_plain_averages(v):
    s = v.series().filter(F.col("series_id") == SUBJECT)
    ev = v.scored_ledger().filter(F.col("series_id") == SUBJECT)
    got = S.event_windows(ev, s).select("event_id", "before_mean", "before_n", "after_mean", "after_n")
    brute = (ev.withColumn("win", F.when(F.col("impact_horizon") == "immediate", 7)
                           .when(F.col("impact_horizon") == "weeks", 28).otherwise(90))
             .join(s.select("day", "value"), (F.col("day") >= F.date_sub("date", 14)) & (F.col("day") <= F.date_add("date", F.col("win"))), "left")
             .groupBy("event_id").agg(
                 F.avg(F.when(F.col("day") < F.col("date"), F.col("value"))).alias("b"),
                 F.avg(F.when(F.col("day") > F.col("date"), F.col("value"))).alias("a")))
    bad = got.join(brute, "event_id").filter(
        (F.abs(F.coalesce("before_mean", F.lit(-1.0)) - F.coalesce("b", F.lit(-1.0))) > 1e-3)
        | (F.abs(F.coalesce("after_mean", F.lit(-1.0)) - F.coalesce("a", F.lit(-1.0))) > 1e-3))
    assert got.count() == ev.count() and bad.count() == 0


def test_draws_are_spread_and_shared_by_axes(spark):
    n = 40
    coef = S.permutation_coefficients(50, 1)
    draws = (spark.range(2000).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(49)).cast("array<bigint>")))
             .join(coef, "perm").select("perm", S.draw_index(F.col("id"), F.lit(n)).alias("i")))
    per = draws.groupBy("i").count().collect()
    assert len(per) == n and all(abs(r["count"] - 2500) < 300 for r in per)
    spread = draws.groupBy("perm").agg(F.var_pop("i").alias("v")).agg(F.min("v"), F.max("v")).first()
    assert 90 < spread[0] and spread[1] < 180


def test_null_without_timing_is_not_significant(v):
    led = v.scored_ledger()
    own = v.series().filter(F.col("series_id") == SUBJECT)
    spans = S.overlap_span(led, own)
    dense = spans.select("series_id", F.lit("2001-03-01").cast("date").alias("dense_start"), "end")
    targets = S.axis_targets(v.series(), v.rivals(SUBJECT), spans)
    obs = S.pressure_correlation(S.pressure_index(led, spans), targets, dense).filter("stretch = 'dense'")
    out = S.permutation_test(led, dense, targets, obs, 40, draw_by="event").collect()
    assert {r["axis"] for r in out} <= {"all", "demand", "share", "supply"} and out
    assert all(r["permutations"] == 40 and 0 <= r["p_value"] <= 1 for r in out)


def test_movement_report_covers_the_move(v):
    from pulsetrail.plans.reports import movement_explained
    own = v.series().filter(F.col("series_id") == SUBJECT)
    p = P.fixed_periods(v.series_ids().filter(F.col("series_id") == SUBJECT), CUR, CMP)
    rows = movement_explained(v.ledger().withColumn("series_id", F.lit(SUBJECT)), own, p).collect()
    assert sum(r["points"] for r in rows) == pytest.approx(abs(rows[0]["pct"]))


def test_class_draws_agree_with_event_draws(v):
    led = v.scored_ledger()
    own = v.series().filter(F.col("series_id") == SUBJECT)
    spans = S.overlap_span(led, own)
    dense = spans.select("series_id", F.lit("2001-03-01").cast("date").alias("dense_start"), "end")
    targets = S.axis_targets(v.series(), v.rivals(SUBJECT), spans).filter("axis in ('all', 'supply')")
    obs = S.pressure_correlation(S.pressure_index(led, spans), targets, dense).filter("stretch = 'dense'")
    by = {m: {r["axis"]: r for r in S.permutation_test(led, dense, targets, obs, 150, draw_by=m).collect()}
          for m in ("event", "class")}
    assert set(by["event"]) == set(by["class"]) != set()
    for axis, r in by["event"].items():
        assert abs(r["p_value"] - by["class"][axis]["p_value"]) < 0.2
        assert abs(r["null_p95_abs_r"] - by["class"][axis]["null_p95_abs_r"]) < 0.15


def test_rank_by_range_is_a_row_number(v):
    led = v.ledger().select("arrival", "date", "title")
    got = K.global_rank_by_range(led, ["date", "title"])
    want = led.select("arrival", F.row_number().over(Window.orderBy("date", "title", "arrival")).alias("want"))
    assert got.join(want, "arrival").filter("rank <> want").count() == 0 and got.count() == led.count()


def test_period_prunes_month_folders(spark, v):
    from pulsetrail.session import fresh_path
    from pulsetrail.sources.ledger import read_ledger_table
    from pulsetrail.sources.sinks import write_ledger
    path = fresh_path(spark, "ledger")
    write_ledger(v.ledger(), path)
    df = read_ledger_table(spark, path, *CUR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(date" in plan
    assert df.count() == v.ledger().filter(F.col("date").between(*CUR)).count()


def test_first_row_per_key_is_cut_before_the_shuffle(v):
    from pulsetrail.operators.ledger import first_per_key
    plan = first_per_key(v.ledger(), ["category"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
