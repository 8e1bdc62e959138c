"""Readers on small literal files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsetrail.operators import funnel as U
from pulsetrail.sources import arrays, feeds, ledger as SL, lists, series as SS, traffic, verdicts, vitals


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text, encoding="utf-8")
        return str(p)
    return write


def test_missing_ledger_is_empty(spark, tmp_path):
    assert SL.read_ledger(spark, str(tmp_path / "none.json")).count() == 0


def test_ledger_array_file(spark, put):
    path = put("l.json", json.dumps([{"event_id": "A1", "date": "2026-08-01", "scope": "미국;유럽", "impact_strength": 3},
                                     {"event_id": "A2", "date": "2024-05-00"}], ensure_ascii=False))
    rows = {r["event_id"]: r for r in SL.read_ledger(spark, path, multi_line=True).collect()}
    assert rows["A1"]["scope"] == ["미국", "유럽"] and rows["A1"]["impact_strength"] == 3
    assert rows["A2"]["date"] is None and rows["A2"]["scope"] == []


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", ["40b", "128m"])
def test_array_elements_over_many_tasks(spark, tmp_path, indent, split):
    """Braces, quotes and backslashes in texts, nested values, one long element; a broken tail loses only itself."""
    rows = [{"event_id": f"A{i}", "title": t, "more": {"x": [{}, {"y": "}{"}]}}
            for i, t in enumerate(["}{", 'a "quoted" {', "back\\", "\\\"}", "", "[,]", "é🙂}" * 60, "line\nline", "end"] * 3)]
    text = json.dumps(rows, ensure_ascii=False, indent=indent)
    (tmp_path / "whole.json").write_text(text, encoding="utf-8")
    (tmp_path / "cut.json").write_text(text[:text.rindex('"title"') + 3], encoding="utf-8")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = arrays.array_elements(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["element"], r["value"]))
        ledger = SL.read_ledger(spark, str(tmp_path), multi_line=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [json.loads(t) for _, t in sorted(got["whole.json"])] == rows
    assert [json.loads(t) for _, t in sorted(got["cut.json"])[:-1]] == rows[:-1] and set(got) == {"whole.json", "cut.json"}
    assert sorted(r["event_id"] for r in ledger) == sorted([r["event_id"] for r in rows] + [r["event_id"] for r in rows[:-1]])


def test_traffic_csv(spark, put):
    path = put("t.csv", "﻿Country,Date,Traffic\nuk, 2026/8/1 ,\"x\nUSA,2026-8-2,1.5k\n\nMX,2026-08-03, 1200 visits\nKR,2026-08-04\nDE,,5\n")
    got = {(r["country"], r["day"], r["traffic"]) for r in traffic.read_traffic(spark, path).collect()}
    assert got == {("US", "2026-08-02", 1.5), ("MX_C", "2026-08-03", 1200.0)}


def test_traffic_without_header(spark, put):
    path = put("t.csv", "DE,2026-08-01,7\nFR,2026-08-01,8")
    assert traffic.read_traffic(spark, path).count() == 2


def test_keywords(spark, put):
    path = put("k.txt", "# keep\nGalaxy\n\n phone \n# ---DROP---\nGossip\n# note\n")
    keep, drop = lists.keyword_lists(lists.read_keywords(spark, path))
    assert (keep, drop) == (["galaxy", "phone"], ["gossip"])
    half = put("h.txt", "only keep\n")
    assert lists.keyword_lists(lists.read_keywords(spark, half), ["a"], ["b"]) == (["a"], ["b"])


def test_labelled_lists(spark, put):
    path = put("q.txt", "# c\nnews | one two\nplain\n| x\nnews | three | four\n")
    got = sorted((r["label"], r["value"]) for r in lists.read_queries(spark, path).collect())
    assert got == [("", "x"), ("news", "one two"), ("news", "three | four"), ("other", "plain")]
    assert [(r["label"], r["value"]) for r in lists.read_feed_list(spark, path).collect()] == [("news", "three | four")]


def test_fragments_of_arrays_are_not_dealt_by_split(spark, put, tmp_path):
    """Only elements at the borders of splits are shuffled: no sum runs over the fragments of a split."""
    put("a.json", json.dumps([{"event_id": "A}"}] * 9))
    df = arrays.array_elements(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and not re.search(r"Window .*\[file#\d+, block#", plan)
    assert sorted(r["element"] for r in df.collect()) == list(range(9))


@pytest.mark.parametrize("split", ["3b", "128m"])
def test_arrays_of_random_texts(spark, tmp_path, split):
    rnd, want = random.Random(11), {}
    text = lambda: "".join(rnd.choice('{}"\\,[]a\u00e9 \n') for _ in range(rnd.randrange(9)))
    for i in range(8):
        rows = [{text() + str(k): rnd.choice([text(), {"x": text(), "y": [{}, text()]}, [], 5]) for k in range(rnd.randrange(3))} for _ in range(rnd.randrange(6))]
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, ensure_ascii=False, indent=rnd.choice([None, 1])), encoding="utf-8")
        want |= {(f"{i}.json", k): r for k, r in enumerate(rows)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = arrays.array_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r["file"].rsplit("/", 1)[1], r["element"]): json.loads(r["value"]) for r in rows}
    assert len(rows) == len(got) and got == want


def test_feeds(spark, put, tmp_path):
    put("a.xml", "<rss><channel><item><title>T1</title><link> http://a/1 </link><description>x &lt;b&gt;y&lt;/b&gt;</description>"
                 "<pubDate>Tue, 5 Aug 2026 09:12:00 GMT</pubDate></item><item><title>No date</title></item></channel></rss>")
    put("b.xml", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://b/2"/>'
                 "<content>body</content><updated>2026-08-06T01:00:00Z</updated></entry></feed>")
    put("c.xml", "not xml at all")
    rows = {r["title"]: r for r in feeds.read_feed_items(spark, str(tmp_path)).collect()}
    assert set(rows) == {"T1", "No date", "E"}
    assert rows["T1"]["link"] == "http://a/1" and rows["T1"]["published"] == "2026-08-05"
    assert rows["T1"]["summary"].split() == ["x", "y"] and rows["No date"]["published"] == ""
    assert (rows["E"]["link"], rows["E"]["summary"], rows["E"]["published"]) == ("http://b/2", "body", "2026-08-06")


def test_series_points(spark, put):
    path = put("s.json", json.dumps({"series": {"a": [{"date": "2026-08-01", "views": 1}, {"date": "2026-8-1", "views": None},
                                                      {"date": "bad", "views": 9}]}, "divisions": {"a": ["MX", "DA"]}}))
    rows = SS.points_to_series(SS.read_series_files(spark, path)).collect()
    assert [(str(r["day"]), r["value"]) for r in rows] == [("2026-08-01", 0.0)]
    assert SS.read_divisions(spark, path).count() == 2


def test_vitals_skip_what_cannot_be_read(spark, put):
    doc = {"record": {"collectionPeriods": [{"lastDate": {"year": 2026, "month": 8, "day": d}} for d in (1, 8, 15)],
                      "metrics": {"lcp": {"percentilesTimeseries": {"p75s": [2400, None, "2.5", 9]}},
                                  "other": {"percentilesTimeseries": {"p75s": [1]}}}}}
    got = vitals.read_vitals(spark, put("v.json", json.dumps(doc)), {"lcp": ("lcp_ms", 2)}).collect()
    assert sorted((str(r["period_end"]), r["p75"]) for r in got) == [("2026-08-01", 4800.0), ("2026-08-15", 5.0)]


def test_verdict_batches(spark):
    item = '{"i": 1, "relevant": true}'
    rows = [("a", f"```json\n[{item}]\n```"), ("b", '{"items": [' + item + "]}"), ("c", f"[{item},{item}]"), ("d", "sorry"),
            ("e", '{"x": [' + item + '], "y": [' + item + "]}"), ("f", '{"x": "text", "y": [' + item + "]}")]
    df = spark.createDataFrame([(b, "p", 1, t) for b, t in rows], "batch_id string, provider string, expected int, payload string")
    assert sorted(r["batch_id"] for r in verdicts.parse_verdict_batches(df).collect()) == ["a", "b", "f"]


def test_provider_log_and_funnel_log(spark, put):
    p = put("u.json", json.dumps([{"date": "2026-08-01", "at": "x", "stage": "s", "providers": {"g": {"attempt": 3, "ok": 2}}}]))
    assert {(r["counter"], r["n"]) for r in SL.read_provider_log(spark, p).collect()} == {("attempt", 3), ("ok", 2)}
    f = put("f.json", json.dumps([{"date": "2026-08-01", "per_query": {"q": {"raw": 4, "kept": 1}}}]))
    r = U.rolling_rates(SL.read_funnel_log(spark, f, multi_line=True)).first()
    assert (r["raw"], r["dup"], r["pass_rate"], r["keep_rate"]) == (4, 0, 0.25, 0.0)


def test_pool_defaults(spark, put):
    p = put("p.json", json.dumps([{"title": "t", "url": "u", "date": "20260801"}]))
    r = SL.read_pool(spark, p).first()
    assert (r["source"], r["query"], r["desc"]) == ("pool", "", "")
