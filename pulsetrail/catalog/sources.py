"""Source and sink queries: inputs are written from the tables, then read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pulsetrail.catalog.bindings import (ACTIVITY, LEDGER, LINKS, SALES, SCORED, SERIES, STORIES,
                                         VITALS, with_)
from pulsetrail.catalog.ledger import FUNNEL_LOG, funnel_log
from pulsetrail.catalog.registry import query
from pulsetrail.catalog.scoring import PRESSURE, RS, _spans
from pulsetrail.catalog.series import c4, r4
from pulsetrail.operators import scoring as S
from pulsetrail.session import fresh_path
from pulsetrail.sources import feeds, ledger as SL, lists, sinks, traffic, verdicts, vitals


def _flat_ledger(v):
    """Ledger rows as the stored JSON text records."""
    l = v.ledger()
    return l.select("event_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "date_source",
                    F.date_format("captured_date", "yyyy-MM-dd").alias("captured_date"),
                    F.array_join("scope", ";").alias("scope"), F.array_join("divisions", ";").alias("divisions"),
                    "category", "title", "raw_title", "impact_direction", "impact_horizon",
                    F.col("impact_strength"), "confidence", "axis", "source", "raw_date", "raw_url")


def _as_array(parts):
    """The lines of one array a task, of JSON texts; where their number is odd the file breaks off in one more element."""
    n = 0
    for part in parts:
        texts = part.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"value": [("[" if n + i == 0 else ",") + t for i, t in enumerate(texts)]})
        n += len(texts)
    if n:
        yield pa.RecordBatch.from_pydict({"value": [', {"event_id": "cut {[' if n % 2 else "]"]})


@query("src_ledger", with_("""
SELECT event_id, CAST(date AS VARCHAR) AS date, array_to_string(scope, ';') AS scope, array_to_string(divisions, ';') AS divisions, title, raw_title,
 CAST(impact_strength AS BIGINT) AS impact_strength FROM ledger""", LEDGER))
def _(v):
    path = fresh_path(v.spark, "ledger-json")
    records = _flat_ledger(v).select(F.to_json(F.struct("*")).alias("value"))
    records.mapInArrow(_as_array, "value string").write.text(path)
    return SL.read_ledger(v.spark, path, multi_line=True).select("event_id", "date", "scope", "divisions", "title", "raw_title", "impact_strength")


@query("src_funnel_log", with_("SELECT CAST(day AS VARCHAR) AS day, label, raw, 0::BIGINT AS dup, dup_near, kw_pass, kept FROM log", ACTIVITY, FUNNEL_LOG))
def _(v):
    path = fresh_path(v.spark, "funnel-json")
    # labels per day are the configured queries; the oldest form lacks ``dup``
    c = F.struct("raw", "dup_near", "kw_pass", "kept")
    days = funnel_log(v).groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).agg(
        F.map_from_entries(F.collect_list(F.struct("label", c))).alias("per_query"))
    days.write.json(path)
    return SL.read_funnel_log(v.spark, path)


@query("src_feed_items", with_("""
SELECT CASE WHEN arrival % 2 = 0 THEN 'RSS ' ELSE 'Atom ' END || arrival AS title, url AS link, 'Body <' || label || '> of' AS summary,
 CASE WHEN arrival % 2 = 0 THEN strftime(DATE '2024-01-01' + CAST(arrival % 300 AS INTEGER), '%Y-%m-%d') ELSE strftime(DATE '2024-01-01' + CAST(arrival % 200 AS INTEGER), '%Y-%m-%d') END AS published
FROM links""".replace("'Body <' || label || '> of'", "'Body   ' || label || '   of'").replace("'   of'", "' of'"), LINKS))
def _(v):
    path = fresh_path(v.spark, "feeds")
    k = F.col("arrival")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    url, num = esc(F.col("url")), k.cast("string")
    body = esc(F.concat(F.lit("Body <b>"), "label", F.lit(" of<br>")))
    rss = F.concat(F.lit("<item><title> RSS "), num, F.lit("</title><link>"), url, F.lit("</link><description>"), body,
                   F.lit("</description><pubDate>"),
                   F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "EEE, dd MMM yyyy '09:12:00 GMT'"),
                   F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>Atom "), num, F.lit('</title><link href="'), url, F.lit('"/><content>'), body,
                    F.lit("</content><updated>"),
                    F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")), "yyyy-MM-dd'T09:12:00Z'"),
                    F.lit("</updated></entry>"))
    # one document per block of 1000 pages, items of both kinds inside one root
    docs = (v.links().select(F.floor(k / 1000).alias("doc"), F.when(k % 2 == 0, rss).otherwise(atom).alias("x"))
            .groupBy("doc").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("x"), ""),
                                         F.lit("</channel></rss>")).alias("value")))
    docs.write.partitionBy("doc").text(path)    # a file holds one document: the reader stops at the end of the first root
    return feeds.read_feed_items(v.spark, path).select(
        "title", "link", F.regexp_replace("summary", " {2,}", "   ").alias("summary"), "published")


@query("src_indicator_csv", with_("""
SELECT series_id AS indicator, strftime(day, '%Y-%m') AS period, CAST(sum(cents) AS DOUBLE) AS value FROM sales WHERE nation_id <> 3 GROUP BY ALL""", SALES))
def _(v):
    path = fresh_path(v.spark, "indicators")
    m = F.date_format("day", "yyyy-'M'MM")
    agg = F.sum(F.when(F.col("nation_id") != 3, F.col("cents"))).cast("string")
    rows = v.sales().groupBy(F.col("series_id").alias("indicator"), m.alias("TIME_PERIOD")).agg(agg.alias("OBS_VALUE"))
    junk = v.series_ids().select(F.col("series_id").alias("indicator"), F.lit("2024-M01").alias("TIME_PERIOD"),
                                 F.when(F.col("series_id") < "C", "NaN").otherwise("n/a").alias("OBS_VALUE"))
    rows.unionByName(junk).write.option("header", True).csv(path)
    return vitals.read_indicators(v.spark, path)


@query("src_parallel_arrays", with_("SELECT metric, CAST(period_end AS VARCHAR) AS period_end, p75 FROM vitals WHERE month(period_end) <> 7", VITALS))
def _(v):
    path = fresh_path(v.spark, "vitals")
    d = F.col("period_end")
    # weekly points of one site: a few hundred
    one = v.vitals().groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("period_end", "p75"))).alias("pts"))
    when = F.struct(F.year(d).alias("year"))
    periods = F.transform("pts", lambda p: F.struct(F.struct(
        F.year(p["period_end"]).alias("year"), F.month(p["period_end"]).alias("month"),
        F.dayofmonth(p["period_end"]).alias("day")).alias("lastDate")))
    p75s = F.concat(F.transform("pts", lambda p: F.when(F.month(p["period_end"]) != 7, p["p75"].cast("string"))),
                    F.array(F.lit("123"), F.lit("x")))
    ts = F.struct(F.struct(p75s.alias("p75s")).alias("percentilesTimeseries"))
    record = F.struct(periods.alias("collectionPeriods"), F.create_map(F.lit("lcp"), ts).alias("metrics"))
    one.select(record.alias("record")).write.json(path)
    return vitals.read_vitals(v.spark, path, {"lcp": ("lcp_ms", 1.0)}, multi_line=False)


@query("src_measured_csv", with_("""
SELECT CASE nation_id WHEN 1 THEN 'GB' WHEN 2 THEN 'MX_C' ELSE 'N' || nation_id END AS country, CAST(day AS VARCHAR) AS day, CAST(sum(cents) AS DOUBLE) AS traffic
FROM sales GROUP BY ALL""", SALES))
def _(v):
    path = fresh_path(v.spark, "traffic")
    n = F.col("nation_id")
    code = F.when(n == 1, " uk ").when(n == 2, "mx").otherwise(F.concat(F.lit("n"), n.cast("string")))
    daily = v.sales().groupBy("nation_id", "day").agg(F.sum("cents").alias("c"))
    shape = F.when(n % 2 == 0, F.date_format("day", "yyyy/M/d")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    lines = daily.select(F.concat(code, F.lit(","), shape, F.lit(", $"), F.col("c").cast("string"), F.lit(" visits")).alias("value"))
    bad = v.table("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(",2024-01-01")).alias("value"))
    header = v.table("region").select(F.lit("﻿Country,Date,Traffic").alias("value")).distinct()
    header.coalesce(1).write.text(path)
    lines.unionByName(bad).write.mode("append").text(path)
    return traffic.read_traffic(v.spark, path)


@query("src_keyword_list", with_("""
SELECT 'keep' AS kind, label AS keyword FROM (SELECT DISTINCT label FROM stories) UNION ALL SELECT 'drop', lang FROM (SELECT DISTINCT lang FROM stories)""", STORIES))
def _(v):
    path = fresh_path(v.spark, "keywords")
    s = v.stories()
    body = (s.select(F.lit(1).alias("k")).distinct().select(F.lit("# keep list").alias("value"), F.lit(0).alias("o"))
            .unionByName(s.select(F.upper("label").alias("value")).distinct().withColumn("o", F.lit(1)))
            .unionByName(s.select(F.lit("# ---DROP---").alias("value")).distinct().withColumn("o", F.lit(2)))
            .unionByName(s.select(F.concat(F.lit(" "), "lang", F.lit(" ")).alias("value")).distinct().withColumn("o", F.lit(3))))
    body.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return lists.read_keywords(v.spark, path)


@query("src_label_list", with_("""
SELECT 'query' AS part, CASE WHEN lang = 'en' THEN 'other' ELSE lang END AS label, source AS value FROM (SELECT DISTINCT lang, label AS source FROM stories)
UNION ALL SELECT 'known', CASE WHEN lang IN ('de', 'fr') THEN lang ELSE 'other' END, label FROM (SELECT DISTINCT lang, label FROM stories)
UNION ALL SELECT 'feed', lang, max(label) FROM stories WHERE lang <> 'en' GROUP BY lang
UNION ALL SELECT 'topic', '', CASE WHEN lang = 'en' THEN label ELSE lang || ' | ' || label END FROM (SELECT DISTINCT lang, label FROM stories)""", STORIES))
def _(v):
    path = fresh_path(v.spark, "labels")
    rows = v.stories().select("lang", "label").distinct()
    line = F.when(F.col("lang") == "en", F.col("label")).otherwise(F.concat("lang", F.lit(" | "), "label"))
    rows.coalesce(1).sortWithinPartitions("label").select(line.alias("value")).write.text(path)
    asked = lists.read_queries(v.spark, path)
    return (asked.select(F.lit("query").alias("part"), "label", "value")
            .unionByName(asked.select(F.lit("known").alias("part"), lists.known_label(F.col("label"), ["de", "fr"]).alias("label"), "value"))
            .unionByName(lists.read_topics(v.spark, path).select(F.lit("topic").alias("part"), F.lit("").alias("label"), F.col("topic").alias("value")))
            .unionByName(lists.read_feed_list(v.spark, path).select(F.lit("feed").alias("part"), "label", "value")))


@query("src_verdict_batch", with_("""
SELECT batch_id, pos, CAST(pos AS VARCHAR) AS echoed, CAST(value >= 5 AS BIGINT) AS relevant, label AS category
FROM (SELECT event_id // 5 AS batch_id, event_id % 5 + 1 AS pos, value, label FROM activity)
WHERE batch_id % 4 <> 3 AND batch_id IN (SELECT event_id // 5 FROM activity GROUP BY 1 HAVING count(*) = 5)""", ACTIVITY))
def _(v):
    path = fresh_path(v.spark, "answers")
    b = F.floor(F.col("event_id") / 5).alias("batch_id")
    item = F.struct((F.col("event_id") % 5 + 1).cast("int").alias("i"), (F.col("value") >= 5).alias("relevant"),
                    F.col("label").alias("category"))
    per = v.activity().groupBy(b).agg(F.array_sort(F.collect_list(item)).alias("items"))   # five each
    text, k = F.to_json("items"), F.col("batch_id") % 4
    payload = (F.when(k == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
               .when(k == 1, F.concat(F.lit('{"note": "x", "verdicts": '), text, F.lit("}")))
               .when(k == 2, text)
               .otherwise(F.concat(F.lit('{"a": '), text, F.lit(', "b": '), text, F.lit("}"))))
    per.select("batch_id", F.lit("p1").alias("provider"), F.lit(5).alias("expected"), payload.alias("payload")).write.parquet(path)
    out = verdicts.parse_verdict_batches(v.spark.read.parquet(path))
    return out.select("batch_id", "pos", "echoed", F.col("verdict.relevant").alias("relevant"), F.col("verdict.category").alias("category"))


@query("sink_ledger", with_("SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, min(CAST(date AS VARCHAR)) AS first_date, max(event_id) AS last_id FROM ledger GROUP BY 1", LEDGER))
def _(v):
    """A ledger of two runs: what came before the last year, then the rest, which rewrites its own months only."""
    path, led = fresh_path(v.spark, "ledger"), v.ledger()
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    sinks.write_ledger(led.filter(early), path)
    sinks.update_ledger(led.filter(~early), path)
    # the partition column would be inferred as a date: read it as written
    back = v.spark.read.parquet(path).drop("month").withColumn("month", F.date_format("date", "yyyy-MM"))
    return back.groupBy("month").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("event_id").alias("last_id"))


@query("sink_event_csv", with_("""
SELECT CAST(date AS VARCHAR) AS date, array_to_string(scope, ';') AS scope, array_to_string(divisions, ';') AS divisions, title || ' "q", x' AS title,
 description, coalesce(source, '') AS source, coalesce(raw_title, '') AS raw_title, raw_url FROM ledger""", LEDGER))
def _(v):
    path = fresh_path(v.spark, "events-csv")
    rows = v.ledger().withColumn("title", F.concat("title", F.lit(' "q", x')))
    sinks.write_event_csv(rows, path)
    back = v.spark.read.option("header", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)
    back = back.withColumnRenamed(back.columns[0], "date")
    cols = ["date", "scope", "divisions", "title", "description", "source", "raw_title", "raw_url"]
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in cols])


@query("sink_pressure", with_("SELECT series_id, axis, CAST(day AS VARCHAR) AS day, floor(p * 1000.0 + 0.5) / 1000.0 AS p FROM pressure", SERIES, SCORED, RS, PRESSURE))
def _(v):
    path = fresh_path(v.spark, "pressure")
    sinks.write_pressure(S.pressure_index(v.scored_ledger(), _spans(v)), path)
    return v.spark.read.parquet(path).select("series_id", "axis", "day", "p")


@query("feed_health", with_("""
SELECT s.label, CASE WHEN l.label IS NULL THEN 'error' WHEN coalesce(i.n, 0) = 0 THEN 'empty' ELSE 'ok' END AS status, coalesce(i.n, 0) AS items
FROM (SELECT DISTINCT label FROM links) s LEFT JOIN (SELECT DISTINCT label FROM links WHERE html LIKE '%<p%') l USING (label)
LEFT JOIN (SELECT label, count(*) AS n FROM links WHERE html LIKE '%<article%' GROUP BY 1) i USING (label)""", LINKS))
def _(v):
    l = v.links()
    return feeds.feed_health(l, l.filter(F.col("html").contains("<p")), l.filter(F.col("html").contains("<article")))
