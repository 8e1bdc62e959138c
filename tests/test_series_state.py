"""As-of points, gaps, ranks within groups and partial ledger writes against plain versions."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pulsetrail.operators import attribution as A, ranking as K, series as O
from pulsetrail.session import fresh_path
from pulsetrail.sources import sinks

START = date(2024, 1, 1)


def points(seed=1, series=6, days=120):
    rng = random.Random(seed)
    rows = [("hot", START + timedelta(days=k), float(k)) for k in range(0, days, 2)]
    return rows + [(f"s{i}", START + timedelta(days=k), float(rng.randint(0, 9))) for i in range(series) for k in range(days) if rng.random() < 0.1]


def test_asof_equals_a_plain_search(spark):
    rng, rows = random.Random(3), points()
    probes = [(k, rng.choice(["hot", "hot", "s0", "s1", "s2", "none"]), START + timedelta(days=rng.randint(-5, 130))) for k in range(500)]
    first, last = START + timedelta(days=10), START + timedelta(days=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # the hot series spans tasks
    try:
        got = O.asof_point(spark.createDataFrame(probes, "k int, series_id string, day date"), spark.createDataFrame(rows, "series_id string, day date, value double"),
                           str(first), str(last)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, s, day in probes:
        inside = sorted((d, v) for x, d, v in rows if x == s and first <= d <= last)
        before = [p for p in inside if p[0] <= day]
        if before and day <= inside[-1][0]:
            want[k] = before[-1]
    assert {r["k"]: (r["obs_day"], r["obs_value"]) for r in got} == want and len(want) > 100


def test_gaps_equal_a_plain_walk(spark):
    rows = points(5) + [("late", START + timedelta(days=400), 1.0), ("old", START - timedelta(days=900), 1.0)]
    as_of = START + timedelta(days=130)
    got = {(r["series_id"], r["rank"]): (r["gap_start"], r["gap_end"]) for r in
           O.calendar_gaps(spark.createDataFrame(rows, "series_id string, day date, value double"), F.lit(as_of), retention_days=110).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        present = {d for x, d, _ in rows if x == s}
        day, end, gaps = max(min(present), as_of - timedelta(days=110)), as_of - timedelta(days=2), []
        while day <= end:
            if day not in present:
                if gaps and gaps[-1][1] == day - timedelta(days=1):
                    gaps[-1][1] = day
                else:
                    gaps.append([day, day])
            day += timedelta(days=1)
        want |= {(s, k): tuple(g) for k, g in enumerate(gaps[:-3:-1], 1)}
    assert got == want


def test_ranks_within_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randint(0, 5), k) for k in range(2000)]
    got = K.global_rank_by_range(spark.createDataFrame(rows, "g string, x int, arrival long"), ["x"], per=("g",)).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for rank, (x, k) in enumerate(sorted((x, k) for y, x, k in rows if y == g), 1):
            want[k] = (g, x, rank)
    assert {r["arrival"]: (r["g"], r["x"], r["rank"]) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("bound", [100, 1])
def test_verdicts_meet_their_events_either_way(spark, bound):
    day = lambda k: START + timedelta(days=k)
    verdicts = spark.createDataFrame([("a", day(1), day(2), day(3), day(4), "+", 1.0), ("b", day(1), day(2), day(3), day(4), None, 2.0)],
                                     "series_id string, cur_start date, cur_end date, cmp_start date, cmp_end date, direction string, pct double")
    events = spark.createDataFrame([(f"e{k}", "abc"[k % 3], day(k)) for k in range(90)], "event_id string, series_id string, date date")
    from pulsetrail.operators.periods import PERIOD_COLUMNS
    for c in set(PERIOD_COLUMNS) - set(verdicts.columns):
        verdicts = verdicts.withColumn(c, F.lit(None).cast("string"))
    got = A.with_move(events, verdicts, bound=bound).collect()
    assert sorted(r["event_id"] for r in got) == sorted(f"e{k}" for k in range(90) if k % 3 < 2)
    assert all(r["pct"] == (1.0 if r["series_id"] == "a" else 2.0) for r in got)


def test_only_touched_months_are_rewritten(spark):
    rows = [(k, f"A{k}", START + timedelta(days=k)) for k in range(120)]
    schema, path = "arrival long, event_id string, date date", fresh_path(spark, "months")
    sinks.write_ledger(spark.createDataFrame(rows, schema), path)
    files = lambda: {m: sorted(os.listdir(f"{path}/{m}")) for m in os.listdir(path) if m.startswith("month=")}
    before = files()
    new = [(3, "A3b", START + timedelta(days=40)), (500, "A500", START + timedelta(days=41))]     # moves from January to February
    for _ in range(2):
        sinks.update_ledger(spark.createDataFrame(new, schema), path)
        after = files()
        assert after["month=2024-03"] == before["month=2024-03"] and after["month=2024-04"] == before["month=2024-04"]
        assert after["month=2024-01"] != before["month=2024-01"] and after["month=2024-02"] != before["month=2024-02"]
        got = {tuple(r) for r in spark.read.parquet(path).select("arrival", "event_id", "date").collect()}
        assert got == {r for r in rows if r[0] != 3} | set(new)
