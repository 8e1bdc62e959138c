"""Single rules on literal rows; expected values worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pulsetrail.functions import dates as D, measures as M, text as X
from pulsetrail.operators import ledger as L, raters as R, scope as SC, series as O, scoring as S
from pulsetrail.operators.periods import default_period, shift_day

d = lambda s: F.lit(s).cast("date")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("value, published, today, want", [
    ("2024-05-00", "2026-08-05", "2026-08-06", (date(2026, 8, 5), "url")),
    ("2024-08-22", None, "2026-08-04", (date(2026, 8, 4), "capture")),
    ("2026-08-09", "2026-08-05", "2026-08-10", (date(2026, 8, 5), "url")),
    ("2026-08-05", "2026-08-05", "2026-08-10", (date(2026, 8, 5), "llm")),
    ("2026-8-1", "2026-08-05", "2026-08-10", (date(2026, 8, 1), "llm")),
])
def test_date_validate(spark, value, published, today, want):
    r = one(spark, D.validate(F.lit(value), F.lit(published).cast("string"), d(today)).alias("w"))
    assert tuple(r["w"]) == want


def test_date_provenance_differs_from_validation(spark):
    r = one(spark, D.infer_source(d("2026-08-05"), d("2026-08-05"), d("2026-08-07"), d(None)).alias("s"))
    assert r["s"] == "url"


@pytest.mark.parametrize("url, want", [
    ("https://a.com/2026/08/01/x", date(2026, 8, 1)),
    ("https://a.com/x-20260801.html", date(2026, 8, 1)),
    ("https://a.com/2026/13/x", None),
    ("https://a.com/2026/8/x", date(2026, 8, 1)),
    ("https://a.com/2026/13/40/x-20260802-1", date(2026, 8, 2)),
    ("https://a.com/1999/08/01/x", None),
])
def test_date_from_url(spark, url, want):
    assert one(spark, D.from_url(F.lit(url)).alias("x"))["x"] == want


@pytest.mark.parametrize("raw, want", [
    ("Tue, 05 Aug 2026 09:12:00 GMT", "2026-08-05"), ("2026-08-05T09:12:00Z", "2026-08-05"),
    ("5 August 2026", "2026-08-05"), ("Tue, 05 Xyz 2026", ""), ("", ""), (None, ""),
])
def test_feed_stamp(spark, raw, want):
    assert one(spark, D.feed_stamp(F.lit(raw).cast("string")).alias("x"))["x"] == want


def test_text_rules(spark):
    r = one(spark, X.normalise_url(F.lit("HTTPS://www.A.com/x/?utm=1#t")).alias("u"),
            X.title_grams(X.normalise_title(F.lit("[Src] Abc def"))).alias("g"),
            X.title_grams(X.normalise_title(F.lit("[Src] Abcd efgh"))).alias("g8"),
            L.keyword_gate(F.lit("shadow"), ["ad"], ["zzz"]).alias("sub"),
            L.keyword_gate(F.lit("shadow ban"), ["ad"], ["ban"]).alias("both"),
            X.url_host(F.lit("https://www.Site.example/x")).alias("host"),
            X.url_host(F.lit("not a url")).alias("raw"))
    assert r["u"] == "a.com/x" and r["g"] is None and r["sub"] and not r["both"]
    assert sorted(r["g8"]) == ["abc", "bcd", "cde", "def", "efg", "fgh"]
    assert r["host"] == "site.example" and r["raw"] == "not a url"


def test_substring_pattern_is_literal(spark):
    words = ["a.b", "a+b", "robots.txt", "rob", "가격 인하", "x|y", "[z]"]
    texts = ["axb", "a.b", "a+b", "robbery", "robots_txt", "가격 인하!", "x|y", "z", "[z]", "xy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"] for r in df.filter(X.contains_any(F.col("t"), words)).collect()}
    assert got == {t for t in texts if any(w in t for w in words)}


PLACES = SC.Places(countries=(("미국", "US", "USA"), ("독일", "DE")), regions={"유럽": ("독일",)},
                   region_aliases={"EU": "유럽"}, all_words=("WW",))


@pytest.mark.parametrize("raw, want", [
    ("US;EU;??", ["미국", "유럽"]), ("US;WW", ["전체"]), ("??", ["전체"]), ("", ["전체"]),
    (' "de." ;[us]', ["미국", "독일"]), ("EU;de;DE", ["독일", "유럽"]),
])
def test_scope_normalise(spark, raw, want):
    assert one(spark, SC.normalise_scope(F.lit(raw), PLACES).alias("s"))["s"] == want


def test_scope_filter_reaches_regions(spark):
    df = spark.createDataFrame([(1, ["전체"]), (2, ["유럽"]), (3, ["미국"]), (4, ["독일"])], "id int, scope array<string>")
    assert {r["id"] for r in SC.scope_filter(df, PLACES, ["독일"]).collect()} == {1, 2, 4}


def test_event_weight(spark):
    r = one(spark, M.event_weight(F.lit(None), F.lit(None).cast("string"), F.lit("+")).alias("a"),
            M.event_weight(F.lit(9), F.lit("high"), F.lit("-")).alias("b"),
            M.event_weight(F.lit("x"), F.lit("MED"), F.lit("neutral")).alias("c"))
    assert r["a"] == pytest.approx(0.66) and r["b"] == -5 and r["c"] == 0


@pytest.mark.parametrize("text, facts, inference", [
    ("One. Two.", "One.", "Two."), ("Only one.", "Only one.", ""),
    ("A. B. site c. site d.", "A. B.", "site c. site d."), ("A. B. C.", "A. B.", "C."),
    ("site a. site b. site c.", "site a.", "site b. site c."), ("", "", ""),
])
def test_fact_split(spark, text, facts, inference):
    df = spark.createDataFrame([(text,)], "description string")
    r = L.split_facts(df, "site", raw=None).first()
    assert (r["facts"], r["inference"]) == (facts, inference)


def test_verdict_align(spark):
    rows = [("a", 1, "2"), ("a", 2, "1"), ("a", 3, "3"), ("b", 1, "1"), ("b", 2, "1"), ("b", 3, "3"),
            ("c", 1, "x"), ("d", 1, "1"), ("d", 2, "2")]
    out = R.align_batches(spark.createDataFrame(rows, "batch_id string, pos int, echoed string"))
    got = {(r["batch_id"], r["pos"]): (r["seat"], r["verified"], r["reordered"]) for r in out.collect()}
    assert got[("a", 1)] == (2, True, True) and got[("a", 3)] == (3, True, True)
    assert got[("b", 2)] == (2, False, False) and got[("c", 1)] == (1, False, False)
    assert got[("d", 2)] == (2, True, False)


@pytest.mark.parametrize("day, basis, want", [
    ("2026-03-31", "MoM", "2026-03-03"), ("2024-02-29", "YoY", "2023-03-01"),
    ("2026-05-31", "QoQ", "2026-03-03"), ("2026-01-01", "DoD", "2025-12-31")])
def test_period_shift_overflows(spark, day, basis, want):
    assert str(one(spark, shift_day(d(day), F.lit(basis)).alias("x"))["x"]) == want


def test_default_period_clamps(spark):
    r = one(spark, default_period(d("2024-02-29")).alias("p"))["p"]
    assert str(r["cmp_end"]) == "2023-02-28" and str(r["cmp_start"]) == "2023-01-01"


def test_change_point_merge(spark):
    rows = [("s", date(2026, 1, 1), 9.0, "+"), ("s", date(2026, 1, 8), -12.0, "-"),
            ("s", date(2026, 1, 16), 10.0, "+"), ("s", date(2026, 1, 30), 8.0, "+")]
    df = spark.createDataFrame(rows, "series_id string, day date, pct double, direction string")
    got = [(r["day"].day, r["pct"]) for r in O.change_point_merge(df).orderBy("day").collect()]
    assert got == [(8, -12.0), (30, 8.0)]


def test_calendar_gaps(spark):
    rows = [("s", date(2026, 1, i), 1.0) for i in (1, 2, 5, 6, 9)]
    df = spark.createDataFrame(rows, "series_id string, day date, value double")
    got = [(r["gap_start"].day, r["gap_end"].day) for r in
           O.calendar_gaps(df, d("2026-01-12")).orderBy("rank").collect()]
    assert got == [(10, 10), (7, 8)]


def test_pearson_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(M.pearson("x", "y").alias("r")).first()["r"] is None
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert two.agg(M.pearson("x", "y").alias("r")).first()["r"] is None


def test_hit_on_exactly_no_change(spark):
    from datetime import timedelta
    d0 = date(2026, 1, 20)
    pts = [("s", d0 + timedelta(days=i), 5.0) for i in range(-14, 8)]
    series = spark.createDataFrame(pts, "series_id string, day date, value double")
    ev = [("s", k, d0, dr, "immediate") for k, dr in (("m", "-"), ("p", "+"), ("n", "neutral"))] + \
        [("s", "late", d0 + timedelta(days=3), "+", "immediate"), ("s", "out", d0 - timedelta(days=300), "+", "immediate")]
    events = spark.createDataFrame(ev, "series_id string, event_id string, date date, impact_direction string, impact_horizon string")
    got = {r["event_id"]: (r["status"], r["hit"]) for r in S.hit_scores(events, series).collect()}
    assert got["m"] == ("scored", True) and got["p"] == ("scored", False)
    assert got["n"] == ("skipped", None) and got["late"][0] == "unfinished" and got["out"][0] == "unfinished"


def test_accept_verdict(spark):
    r = one(spark, L.accept_verdict(F.lit(None).cast("boolean"), F.lit("x")).alias("a"),
            L.accept_verdict(F.lit(True), F.lit("제목"), F.lit("english")).alias("b"),
            L.accept_verdict(F.lit(True), F.lit("제목"), F.lit("")).alias("c"),
            L.accept_verdict(F.lit(False), F.lit("english")).alias("e"))
    assert (r["a"], r["b"], r["c"], r["e"]) == ("missing", "rejected", "accepted", "irrelevant")
