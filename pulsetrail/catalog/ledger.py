"""Expression, filter and ledger-hygiene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrail import vocab
from pulsetrail.catalog.bindings import (ACTIVITY, ALL, CUR, DICT, LEDGER, LINKS, SCORED, STORIES, STORY_LEDGER,
                                         VERDICTS, in_list, normalised_sql, with_)
from pulsetrail.catalog.registry import query
from pulsetrail.catalog.series import c4, day, r4
from pulsetrail.functions import dates as D, measures as M, text as X
from pulsetrail.operators import ledger as L, ranking as K, raters as R, scope as SC, sets

KEEP, DROP = ["ereth", "eaux", "casino", "Zeit"], ["worthless", "http://", "spam"]
TOPICS = ["onth", "ereth"]


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w.lower()}')" for w in words) + ")"


# --- filters -------------------------------------------------------------------
@query("keyword_gate", with_(f"""
SELECT arrival, CAST(NOT {_any('t', DROP)} AND {_any('t', KEEP)} AS BIGINT) AS passed
FROM (SELECT arrival, lower(title || ' ' || text) AS t FROM stories)""", STORIES))
def _(v):
    text = F.concat_ws(" ", F.col("title"), F.col("text"))
    return v.stories().select("arrival", L.keyword_gate(text, KEEP, DROP).alias("passed"))


@query("keyword_fold", with_(f"""
SELECT label, count(*) AS items, count(*) FILTER (NOT {_any('t', DROP)} AND {_any('t', KEEP + TOPICS)}) AS passed
FROM (SELECT label, lower(title || ' ' || text) AS t FROM stories) GROUP BY 1""", STORIES))
def _(v):
    text = F.concat_ws(" ", F.col("title"), F.col("text"))
    gate = L.keyword_gate(text, L.fold_keywords(KEEP, TOPICS), DROP)
    return v.stories().groupBy("label").agg(F.count("*").alias("items"), F.count_if(gate).alias("passed"))


SELECTED = ["NATION_3", "NATION_7"]


@query("scope_filter", with_(f"""
SELECT event_id FROM ledger WHERE list_has_any(scope, ['ALL', {in_list(SELECTED)}])
 OR scope[1] IN (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name IN ({in_list(SELECTED)}))""", LEDGER))
def _(v):
    return SC.scope_filter(v.ledger(), v.places(), SELECTED).select("event_id")


@query("division_filter", with_("SELECT event_id FROM ledger WHERE list_contains(divisions, 'DA')", LEDGER))
def _(v):
    return L.division_filter(v.ledger(), "DA").select("event_id")


@query("period_filter", with_(f"SELECT event_id, CAST(date AS VARCHAR) AS date FROM ledger WHERE date BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}'", LEDGER))
def _(v):
    return L.period_filter(v.ledger(), *CUR).select("event_id", "date")


@query("origin_filter", with_("""
SELECT CASE WHEN event_id LIKE 'E%' THEN 'seed' WHEN event_id LIKE 'A%' THEN 'news' ELSE 'feed' END AS origin, count(*) AS n FROM ledger GROUP BY 1""", LEDGER))
def _(v):
    return v.ledger().groupBy(L.origin(F.col("event_id")).alias("origin")).agg(F.count("*").alias("n"))


@query("untranslated_report", with_("""
SELECT category, count(*) AS rows, count(*) FILTER (NOT regexp_matches(d, '[가-힣]')) AS untranslated, count(*) FILTER (d = raw_desc) AS unchanged,
 floor(count(*) FILTER (NOT regexp_matches(d, '[가-힣]')) / count(*) * 100 * 100.0 + 0.5) / 100.0 AS untranslated_pct
FROM (SELECT category, CASE WHEN confidence = 'low' THEN impact ELSE description END AS d, impact AS raw_desc FROM ledger WHERE event_id LIKE 'FP%') GROUP BY 1""", LEDGER))
def _(v):
    feed = v.ledger().filter(L.origin(F.col("event_id")) == "feed").select(
        "category", F.when(F.col("confidence") == "low", F.col("impact")).otherwise(F.col("description")).alias("description"),
        F.col("impact").alias("raw_desc"))
    return L.untranslated_report(feed, by="category")


JUDGED = """
judged AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE value >= 5 END AS relevant,
 CASE WHEN label IN ('click', 'view') THEN '가격 ' || label ELSE label END AS title,
 CASE WHEN value > 20 THEN '영향' ELSE '' END AS impact FROM activity)"""


def _judged(v):
    return v.activity().select(
        "event_id", F.when(F.col("user_id") % 10 != 0, F.col("value") >= 5).alias("relevant"),
        F.when(F.col("label").isin("click", "view"), F.concat(F.lit("가격 "), "label")).otherwise(F.col("label")).alias("title"),
        F.when(F.col("value") > 20, "영향").otherwise("").alias("impact"))


@query("verdict_accept", with_("""
SELECT event_id, CASE WHEN relevant IS NULL THEN 'missing' WHEN NOT relevant THEN 'irrelevant'
 WHEN NOT regexp_matches(title, '[가-힣]') THEN 'rejected' ELSE 'accepted' END AS outcome FROM judged""", ACTIVITY, JUDGED))
def _(v):
    return _judged(v).select("event_id", L.accept_verdict(F.col("relevant"), F.col("title"), F.col("impact")).alias("outcome"))


PINNED = ["NATION_1", "ATLANTIS"]
NAMED = f"""
used AS (SELECT DISTINCT unnest(scope) AS name FROM ledger), named AS (SELECT name FROM used WHERE name <> 'ALL' UNION SELECT unnest([{in_list(PINNED)}])),
pairs AS (SELECT r_name AS region, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey),
claimed AS (SELECT name FROM pairs UNION SELECT region FROM pairs)"""


@query("facet_list", with_("""
SELECT region, name AS country FROM pairs SEMI JOIN named USING (name)
UNION ALL SELECT region, name FROM pairs WHERE region IN (SELECT name FROM named) AND region NOT IN (SELECT region FROM pairs SEMI JOIN named USING (name))
UNION ALL SELECT '기타', name FROM named ANTI JOIN claimed USING (name)""", LEDGER, NAMED))
def _(v):
    return SC.facet_list(v.ledger(), v.places(), PINNED)


@query("except_unclaimed", with_("SELECT name FROM (SELECT CASE WHEN name = 'NATION_4' THEN 'ATLANTIS' ELSE name END AS name FROM used WHERE name <> 'ALL') ANTI JOIN claimed USING (name)", LEDGER, NAMED))
def _(v):
    led = v.ledger().withColumn("scope", F.transform("scope", lambda s: F.when(s == "NATION_4", "ATLANTIS").otherwise(s)))
    return SC.unclaimed(led, v.places())


# --- places ---------------------------------------------------------------------
@query("scope_normalise", with_("SELECT arrival, scope FROM canon", LEDGER, DICT, normalised_sql("ledger", "arrival", "raw_scope", "canon")))
def _(v):
    return v.ledger().select("arrival", SC.normalise_scope(F.col("raw_scope"), v.places()).alias("scope"))


LEGACY = ["N1", "N2", "N3"]
MIGRATED = """
old AS (SELECT arrival, array_to_string(scope, ';') AS stored,
 coalesce(nullif(CASE WHEN category = 'holiday' THEN 'N3;N1;x;N2' ELSE raw_scope END, ''), array_to_string(scope, ';')) AS old FROM ledger)"""
NEWS = """
mig AS (SELECT arrival, stored, old, CASE WHEN list_has_all(string_split(old, ';'), ['N1', 'N2', 'N3']) THEN 'ALL' ELSE canon.scope END AS new FROM old JOIN canon USING (arrival))"""


@query("scope_migrate", with_("""
SELECT 'before' AS part, tok AS old, '' AS new, count(*) AS n FROM (SELECT unnest(string_split(old, ';')) AS tok FROM mig) WHERE tok <> '' GROUP BY tok
UNION ALL SELECT 'after', tok, '', count(*) FROM (SELECT unnest(string_split(new, ';')) AS tok FROM mig) GROUP BY tok
UNION ALL SELECT * FROM (SELECT 'rewrite', old, new, count(*) AS n FROM mig WHERE new <> stored GROUP BY old, new ORDER BY n DESC, old, new LIMIT 8)""",
                              LEDGER, DICT, MIGRATED, normalised_sql("old", "arrival", "old", "canon"), NEWS))
def _(v):
    led = v.ledger().withColumn("raw_scope", F.when(F.col("category") == "holiday", "N3;N1;x;N2").otherwise(F.col("raw_scope")))
    return SC.scope_migration_report(led, v.places(), LEGACY)


@query("superset_test", with_("""
SELECT arrival, CAST(list_has_all(divisions, ['MX', 'VD', 'DA']) AS BIGINT) AS covers FROM ledger""", LEDGER))
def _(v):
    return v.ledger().select("arrival", sets.covers_all("divisions", vocab.DIVISIONS).alias("covers"))


@query("country_region", with_("""
SELECT event_id, coalesce(r_name, 'ALL') AS region FROM ledger LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON n_name = scope[1]""", LEDGER))
def _(v):
    return v.ledger().select("event_id", SC.country_region(F.element_at("scope", 1), v.places()).alias("region"))


@query("multi_label", with_("""
SELECT event_id, scope[1] AS scope_label, CASE WHEN len(divisions) = 0 OR list_has_all(divisions, ['MX', 'VD', 'DA']) THEN '전체' ELSE array_to_string(divisions, ', ') END AS division_label FROM ledger""", LEDGER))
def _(v):
    return v.ledger().select("event_id", SC.scope_label(F.col("scope")).alias("scope_label"),
                             SC.division_label(F.col("divisions")).alias("division_label"))


# --- simple cleaners --------------------------------------------------------------
@query("axis_clean", with_("""
SELECT event_id, CASE WHEN lower(trim(a)) IN ('demand', 'share', 'supply') THEN lower(trim(a)) ELSE '' END AS axis
FROM (SELECT event_id, CASE WHEN category = 'AI' THEN ' ' || upper(axis) || ' ' WHEN category = 'company' THEN 'x' || axis ELSE axis END AS a FROM ledger)""", LEDGER))
def _(v):
    a = (F.when(F.col("category") == "AI", F.concat(F.lit(" "), F.upper("axis"), F.lit(" ")))
         .when(F.col("category") == "company", F.concat(F.lit("x"), "axis")).otherwise(F.col("axis")))
    return v.ledger().select("event_id", M.clean_axis(a).alias("axis"))


@query("date_strict", with_("""
SELECT event_id, CAST(try_strptime(trim(t), '%Y-%m-%d')::DATE AS VARCHAR) AS parsed FROM (SELECT event_id, CASE user_id % 4
 WHEN 0 THEN strftime(ts, '%Y-%-m-%-d') WHEN 1 THEN strftime(ts, ' %Y-%m-%d ') WHEN 2 THEN strftime(ts, '%Y-%m-00') ELSE strftime(ts, '%Y/%m/%d') END AS t FROM activity)""", ACTIVITY))
def _(v):
    u = F.col("user_id") % 4
    t = (F.when(u == 0, F.date_format("ts", "yyyy-M-d")).when(u == 1, F.date_format("ts", " yyyy-MM-dd "))
         .when(u == 2, F.date_format("ts", "yyyy-MM-'00'")).otherwise(F.date_format("ts", "yyyy/MM/dd")))
    return v.activity().select("event_id", D.parse_strict(t).alias("parsed"))


TODAY = "2001-08-02"
PARSED = r"""
parsed AS (SELECT *, try_strptime(llm_date, '%Y-%m-%d')::DATE AS ld, try_strptime(raw_date, '%Y-%m-%d')::DATE AS pd FROM ledger),
urls AS (SELECT *, coalesce(
  try_strptime(nullif(regexp_extract(raw_url, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|[-_.])', 1), '') || '-' || regexp_extract(raw_url, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|[-_.])', 2) || '-' || regexp_extract(raw_url, '/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|[-_.])', 3), '%Y-%m-%d')::DATE,
  try_strptime(regexp_extract(raw_url, '[-_](20\d{2})(\d{2})(\d{2})[-_.]', 1) || regexp_extract(raw_url, '[-_](20\d{2})(\d{2})(\d{2})[-_.]', 2) || regexp_extract(raw_url, '[-_](20\d{2})(\d{2})(\d{2})[-_.]', 3), '%Y%m%d')::DATE,
  try_strptime(nullif(regexp_extract(raw_url, '/(20\d{2})/(\d{1,2})/', 1), '') || '-' || regexp_extract(raw_url, '/(20\d{2})/(\d{1,2})/', 2) || '-1', '%Y-%m-%d')::DATE) AS ud FROM parsed),
repaired AS (SELECT *, CASE WHEN event_id LIKE 'E%' THEN 'seed_skipped' WHEN captured_date IS NULL THEN 'unfixable'
  WHEN ud IS NOT NULL AND captured_date - ud BETWEEN 0 AND 120 THEN CASE WHEN ud IS DISTINCT FROM ld THEN 'from_url' ELSE 'ok' END
  WHEN ld IS NULL OR captured_date - ld > 180 OR ld > captured_date THEN 'from_capture' ELSE 'ok' END AS outcome FROM urls),
fixed AS (SELECT *, CASE outcome WHEN 'from_url' THEN ud WHEN 'from_capture' THEN captured_date ELSE ld END AS new_date FROM repaired)"""


@query("date_validate", with_(f"""
SELECT event_id, CAST(CASE WHEN ok THEN ld ELSE ref END AS VARCHAR) AS date, CASE WHEN ok THEN 'llm' WHEN pd IS NOT NULL THEN 'url' ELSE 'capture' END AS date_source
FROM (SELECT *, coalesce(pd, DATE '{TODAY}') AS ref, coalesce(ld <= coalesce(pd, DATE '{TODAY}') AND coalesce(pd, DATE '{TODAY}') - ld <= 180, FALSE) AS ok FROM parsed)""", LEDGER, PARSED))
def _(v):
    return (v.ledger().select("event_id", D.validate(F.col("llm_date"), F.col("raw_date"), day(TODAY)).alias("w"))
            .select("event_id", "w.date", "w.date_source"))


@query("date_from_url", with_("SELECT event_id, CAST(ud AS VARCHAR) AS url_day FROM urls", LEDGER, PARSED))
def _(v):
    return v.ledger().select("event_id", D.from_url(F.col("raw_url")).alias("url_day"))


def _with_llm_date(v):
    """The ledger as stored with the judge's own (sometimes wrong) date."""
    return v.ledger().withColumn("date", D.parse_strict(F.col("llm_date")))


@query("date_provenance_infer", with_("""
SELECT event_id, CASE WHEN ld IS NULL THEN 'capture' WHEN ud = ld THEN 'url' WHEN pd IS NOT NULL THEN CASE WHEN pd = ld THEN 'url' ELSE 'llm' END
 WHEN captured_date = ld THEN 'capture' ELSE 'llm' END AS inferred FROM urls""", LEDGER, PARSED))
def _(v):
    return _with_llm_date(v).select("event_id", D.infer_source(
        F.col("date"), D.parse_strict(F.col("raw_date")), F.col("captured_date"),
        D.from_url(F.col("raw_url"))).alias("inferred"))


@query("date_repair", with_("""
SELECT event_id, outcome, CAST(new_date AS VARCHAR) AS new_date, CASE outcome WHEN 'from_url' THEN 'url' WHEN 'from_capture' THEN 'capture' ELSE date_source END AS new_source FROM fixed""", LEDGER, PARSED))
def _(v):
    return L.date_repair(_with_llm_date(v)).select("event_id", "outcome", "new_date", "new_source")


@query("reason_counts", with_("SELECT outcome AS reason, count(*) AS n FROM fixed GROUP BY 1", LEDGER, PARSED))
def _(v):
    return L.date_repair(_with_llm_date(v)).groupBy(F.col("outcome").alias("reason")).agg(F.count("*").alias("n"))


@query("dedup_date_title", with_("""
SELECT 'whole' AS form, CAST(date AS VARCHAR) AS date, event_id, arrival FROM ledger QUALIFY row_number() OVER (PARTITION BY date, title ORDER BY arrival) = 1
UNION ALL SELECT 'curated', CAST(date AS VARCHAR), 'E' || (100 + row_number() OVER (ORDER BY date, title, arrival)), arrival FROM (
 SELECT *, row_number() OVER (PARTITION BY date, substr(title, 1, 40) ORDER BY arrival) AS r FROM ledger) WHERE r = 1""", LEDGER))
def _(v):
    """The whole title for stored events, its head for curated rows, which are numbered anew."""
    whole = L.dedup_date_title(v.ledger()).select(F.lit("whole").alias("form"), "date", "event_id", "arrival")
    curated = L.number_curated(L.dedup_date_title(v.ledger(), vocab.CURATED_TITLE_CHARS))
    return whole.unionByName(curated.select(F.lit("curated").alias("form"), "date", "event_id", "arrival"))


@query("feed_date", with_("""
SELECT event_id, CASE WHEN user_id % 3 = 2 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS published FROM activity""", ACTIVITY))
def _(v):
    u = F.col("user_id") % 3
    t = (F.when(u == 0, F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
         .when(u == 1, F.date_format("ts", "EEE, d MMMM yyyy HH:mm:ss 'GMT'")).otherwise("soon"))
    return v.activity().select("event_id", D.feed_stamp(t).alias("published"))


@query("compact_date", with_(f"""
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '{TODAY}' END AS date FROM activity""", ACTIVITY))
def _(v):
    t = F.when(F.col("user_id") % 3 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyyMMddHHmm"))
    return v.activity().select("event_id", D.compact(t, day(TODAY)).alias("date"))


NT = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\[[^\]]*\]', ' ', 'g'), '[^0-9a-z가-힣]+', ' ', 'g'))"
SETS = rf"""
norm AS (SELECT *, {NT.format('title')} AS n, replace({NT.format('title')}, ' ', '') AS flat FROM stories),
sets AS (SELECT arrival, n, CASE WHEN length(flat) >= 8 THEN list_sort(list_distinct([substr(flat, i, 3) FOR i IN range(1, length(flat) - 1)])) END AS grams,
 CASE WHEN length(flat) >= 8 THEN list_sort(list_distinct([w FOR w IN string_split(n, ' ') IF length(w) > 1])) END AS words FROM norm)"""


@query("title_normalise", with_("SELECT arrival, n AS norm FROM norm", STORIES, SETS))
def _(v):
    return v.stories().select("arrival", X.normalise_title(F.col("title")).alias("norm"))


@query("title_shingles", with_("SELECT arrival, array_to_string(grams, ';') AS grams, array_to_string(words, ';') AS words FROM sets", STORIES, SETS))
def _(v):
    n = X.normalise_title(F.col("title"))
    return v.stories().select("arrival", F.array_sort(X.title_grams(n)).alias("grams"), F.array_sort(X.title_words(n)).alias("words"))


NU = r"regexp_replace(split_part(split_part(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '^www\.', ''), '#', 1), '?', 1), '/+$', '')"


@query("url_normalise", with_(f"SELECT arrival, {NU.format('url')} AS norm FROM links", LINKS))
def _(v):
    return v.links().select("arrival", X.normalise_url(F.col("url")).alias("norm"))


@query("url_host", with_("SELECT arrival, label AS host FROM links", LINKS))
def _(v):
    return v.links().select("arrival", X.url_host(F.col("url")).alias("host"))


@query("event_id_hash", with_("""
SELECT arrival, 'A' || substr(md5(title || CAST(date AS VARCHAR)), 1, 8) AS news_id, 'FP' || substr(md5(label || title), 1, 8) AS feed_id FROM stories""", STORIES))
def _(v):
    return v.stories().select("arrival", L.news_event_id(F.col("title"), D.iso(F.col("date"))).alias("news_id"),
                              L.feed_event_id(F.col("label"), F.col("title")).alias("feed_id"))


MARK = "eau|onth"


def _sentence_sql():
    edge = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    return rf"""
ss AS (SELECT arrival, text, [s FOR s IN [{edge.format('x')} FOR x IN string_split(regexp_replace({edge.format('text')}, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1))] IF s <> ''] AS s FROM stories),
kk AS (SELECT *, len(s) AS n, list_max([CASE WHEN i = 1 OR NOT regexp_matches(s[i], '{MARK}') THEN i ELSE 0 END FOR i IN range(1, len(s) + 1)]) AS lp FROM ss),
split AS (SELECT *, CASE WHEN n < 2 THEN n WHEN n = 2 THEN 1 WHEN lp = n THEN n - 1 ELSE lp END AS k FROM kk)"""


@query("fact_inference_split", with_("""
SELECT arrival, CAST(k AS BIGINT) AS fact_sentences, CAST(n - k AS BIGINT) AS inference_sentences, md5(array_to_string(s[1:k], ' ')) AS facts_md5,
 md5(array_to_string(s[k+1:n], ' ')) AS inference_md5 FROM split""", STORIES, _sentence_sql()))
def _(v):
    rows = v.stories().select("arrival", "text", X.sentences(F.col("text")).alias("s"))
    rows = rows.withColumn("k", X.fact_count(F.col("s"), MARK))
    out = L.split_facts(rows.withColumn("description", F.col("text")), MARK, raw=None)
    return out.select("arrival", F.col("k").alias("fact_sentences"), (F.size("s") - F.col("k")).alias("inference_sentences"),
                      F.md5("facts").alias("facts_md5"), F.md5("inference").alias("inference_md5"))


@query("fact_split_report", with_("""
SELECT count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, min(l) FILTER (changed) AS min_len,
 list_sort(list(l) FILTER (changed))[count(*) FILTER (changed) // 2 + 1] AS median_len
FROM (SELECT length(f) AS l, inf <> '' AND f <> text AS changed FROM (SELECT text, array_to_string(s[1:k], ' ') AS f, array_to_string(s[k+1:n], ' ') AS inf FROM split))""", STORIES, _sentence_sql()))
def _(v):
    return L.split_report(L.split_facts(v.stories(), MARK, text="text", raw=None))


@query("text_tag_strip", with_(r"""
SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(description, '\s*\[filter:[^\]]*\]', '', 'g'), '\s*\[source:[^\]]*\]', '', 'g'), '원문:\s*', '', 'g')) AS body FROM ledger""", LEDGER))
def _(v):
    return v.ledger().select("event_id", X.strip_body_tags(F.col("description")).alias("body"))


@query("country_alias", with_("""
SELECT event_id, CASE c WHEN 'UK' THEN 'GB' WHEN 'MX' THEN 'MX_C' WHEN 'GBR' THEN 'GB' WHEN 'USA' THEN 'US' WHEN 'KOR' THEN 'KR' ELSE c END AS country FROM (
 SELECT event_id, upper(trim(CASE label WHEN 'click' THEN ' uk' WHEN 'view' THEN 'MX' WHEN 'error' THEN 'usa ' ELSE label END)) AS c FROM activity)""", ACTIVITY))
def _(v):
    from pulsetrail.sources.traffic import country_code
    c = (F.when(F.col("label") == "click", " uk").when(F.col("label") == "view", "MX")
         .when(F.col("label") == "error", "usa ").otherwise(F.col("label")))
    return v.activity().select("event_id", country_code(c).alias("country"))


# --- records ----------------------------------------------------------------------
RAW_RECORDS = """
records AS (SELECT arrival, CASE WHEN arrival % 11 = 1 THEN 'soon' ELSE llm_date END AS date, CAST(NULL AS VARCHAR) AS captured_date, raw_scope AS scope,
 array_to_string(divisions, ', ') || ';XX' AS divisions, CASE WHEN metric = 'both' THEN 'Click,Click;Order' END AS kpi,
 CASE category WHEN 'AI' THEN 'ai' WHEN 'company' THEN 'competitor' WHEN 'culture' THEN 'gossip' ELSE category END AS category,
 CASE WHEN confidence = 'low' AND metric = 'both' THEN ' ' ELSE ' ' || title || ' ' END AS title, description, impact_direction,
 CASE impact_horizon WHEN 'weeks' THEN 'fortnight' ELSE impact_horizon END AS impact_horizon, confidence, upper(metric) AS metric,
 source, impact, CASE WHEN impact_strength = 5 THEN '9' WHEN impact_strength = 4 THEN 'big' ELSE CAST(impact_strength AS VARCHAR) END AS impact_strength, upper(axis) AS axis FROM ledger)"""


def _records(v):
    f = F.col
    return v.ledger().select(
        "arrival", F.when(f("arrival") % 11 == 1, "soon").otherwise(f("llm_date")).alias("date"),
        F.lit(None).cast("string").alias("captured_date"), f("raw_scope").alias("scope"),
        F.concat(F.array_join("divisions", ", "), F.lit(";XX")).alias("divisions"),
        F.when(f("metric") == "both", "Click,Click;Order").alias("kpi"),
        F.when(f("category") == "AI", "ai").when(f("category") == "company", "competitor")
        .when(f("category") == "culture", "gossip").otherwise(f("category")).alias("category"),
        F.when((f("confidence") == "low") & (f("metric") == "both"), " ")
        .otherwise(F.concat(F.lit(" "), "title", F.lit(" "))).alias("title"),
        "description", "impact_direction",
        F.when(f("impact_horizon") == "weeks", "fortnight").otherwise(f("impact_horizon")).alias("impact_horizon"),
        "confidence", F.upper("metric").alias("metric"), "source", "impact",
        F.when(f("impact_strength") == 5, "9").when(f("impact_strength") == 4, "big")
        .otherwise(f("impact_strength").cast("string")).alias("impact_strength"), F.upper("axis").alias("axis"))


@query("record_conform", with_(r"""
SELECT r.arrival, date, date AS captured_date, canon.scope, array_to_string([d FOR d IN list_distinct_ordered IF d IN ('MX', 'VD', 'DA')], ';') AS divisions,
 CASE WHEN kpi IS NULL THEN 'Traffic' ELSE 'Click;Order' END AS kpi,
 CASE category WHEN 'ai' THEN 'AI' WHEN 'competitor' THEN 'company' WHEN 'gossip' THEN 'economy' ELSE category END AS category, trim(title) AS title,
 trim(description) AS description, impact_direction, CASE WHEN impact_horizon = 'fortnight' THEN 'weeks' ELSE impact_horizon END AS impact_horizon, confidence,
 'traffic' AS metric, coalesce(source, '') AS source, impact, CAST(CASE impact_strength WHEN '9' THEN 5 WHEN 'big' THEN 2 ELSE CAST(impact_strength AS INTEGER) END AS BIGINT) AS impact_strength,
 lower(axis) AS axis
FROM (SELECT *, [trim(x) FOR x IN string_split_regex(divisions, '[;,]')] AS list_distinct_ordered FROM records) r JOIN canon USING (arrival)
WHERE regexp_matches(date, '^\d{4}-\d{2}-\d{2}$') AND trim(title) <> ''""", LEDGER, DICT, RAW_RECORDS, normalised_sql("records", "arrival", "scope", "canon")))
def _(v):
    return L.conform_records(_records(v), v.places())


EVENT_SHAPE = """
items AS (SELECT event_id AS arrival, 'T ' || label || ' ' || user_id AS title, CASE WHEN user_id % 3 > 0 THEN strftime(ts, '%Y-%m-%d') END AS published,
 label, CASE WHEN value > 10 THEN '제목 ' || user_id ELSE '' END AS jt, CASE WHEN value > 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'x' END AS jd,
 CASE WHEN value > 15 THEN 'AI' END AS cat, CASE WHEN value > 8 THEN 'high' END AS conf FROM activity),
dated AS (SELECT *, try_strptime(jd, '%Y-%m-%d')::DATE AS ld, try_strptime(published, '%Y-%m-%d')::DATE AS pd FROM items),
shaped AS (SELECT *, coalesce(pd, DATE '2024-02-15') AS ref, coalesce(ld <= coalesce(pd, DATE '2024-02-15') AND coalesce(pd, DATE '2024-02-15') - ld <= 180, FALSE) AS ok FROM dated)"""


@query("event_defaults", with_("""
SELECT 'news' AS channel, arrival, 'A' || substr(md5(title || CAST(CASE WHEN ok THEN ld ELSE ref END AS VARCHAR)), 1, 8) AS event_id, CAST(CASE WHEN ok THEN ld ELSE ref END AS VARCHAR) AS date,
 CASE WHEN ok THEN 'llm' WHEN pd IS NOT NULL THEN 'url' ELSE 'capture' END AS date_source, coalesce(cat, 'economy') AS category, CASE WHEN jt <> '' THEN jt ELSE title END AS title,
 coalesce(conf, 'low') AS confidence, '' AS kpi, 'ALL' AS scope, label AS source FROM shaped
UNION ALL SELECT 'feed', arrival, 'FP' || substr(md5(label || title), 1, 8), CAST(CASE WHEN ok THEN ld ELSE ref END AS VARCHAR),
 CASE WHEN ok THEN 'llm' WHEN pd IS NOT NULL THEN 'url' ELSE 'capture' END, coalesce(cat, 'platform'), '[' || label || '] ' || CASE WHEN jt <> '' THEN jt ELSE title END,
 coalesce(conf, 'med'), 'Traffic', 'ALL', label FROM shaped""", ACTIVITY, EVENT_SHAPE))
def _(v):
    f, null = F.col, F.lit(None)
    text_array = null.cast("array<string>")
    verdict = F.struct(
        F.when(f("value") > 10, F.concat(F.lit("제목 "), f("user_id").cast("string"))).otherwise("").alias("title"),
        null.cast("string").alias("impact"), null.cast("string").alias("description"),
        F.when(f("value") > 3, F.date_format("ts", "yyyy-MM-dd")).otherwise("x").alias("date"),
        text_array.alias("scope"), text_array.alias("divisions"), text_array.alias("kpi"),
        F.when(f("value") > 15, "AI").alias("category"), null.cast("string").alias("impact_direction"),
        null.cast("string").alias("impact_horizon"), null.cast("int").alias("impact_strength"),
        F.when(f("value") > 8, "high").alias("confidence"), null.cast("string").alias("metric"),
        null.cast("string").alias("axis"))
    items = v.activity().select(
        f("event_id").alias("arrival"), F.concat(F.lit("T "), "label", F.lit(" "), f("user_id").cast("string")).alias("title"),
        F.lit("").alias("desc"), null.cast("string").alias("url"), "label",
        F.when(f("user_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")).alias("published"),
        verdict.alias("verdict"), F.lit("j1").alias("llm"))
    places = v.places()
    cols = ["channel", "arrival", "event_id", "date", "date_source", "category", "title", "confidence", "kpi", "scope", "source"]
    make = lambda ch: L.build_events(items, ch, day("2024-02-15"), places).withColumn("channel", F.lit(ch)).select(*cols)
    return make("news").unionByName(make("feed"))


# --- sets and retention ---------------------------------------------------------------
@query("union_channels", with_("""
SELECT 'news' AS channel, label, count(*) AS items, count(url) AS with_url FROM stories GROUP BY label
UNION ALL SELECT 'pool', label, count(*), count(url) FROM links GROUP BY label""", STORIES, LINKS))
def _(v):
    both = sets.union_channels(news=v.stories().select("title", "url", "label", "date"),
                               pool=v.links().select("url", "label"))
    return both.groupBy("channel", "label").agg(F.count("*").alias("items"), F.count("url").alias("with_url"))


@query("union_curated", with_("""
SELECT category, count(*) AS n FROM (SELECT category FROM ledger WHERE confidence = 'high' UNION ALL SELECT category FROM ledger WHERE metric = 'both'
 UNION ALL SELECT category FROM ledger WHERE impact_direction = '+') GROUP BY 1""", LEDGER))
def _(v):
    l = v.ledger()
    return (sets.union_curated(l.filter("confidence = 'high'"), l.filter("metric = 'both'"), l.filter("impact_direction = '+'"))
            .groupBy("category").agg(F.count("*").alias("n")))


@query("dashboard_counts", with_("SELECT count(*) AS events, count(*) FILTER (impact_direction = '-') AS negatives FROM ledger WHERE list_contains(divisions, 'VD')", LEDGER))
def _(v):
    return K.dashboard_counts(L.division_filter(v.ledger(), "VD"))


@query("recent_titles", with_("""
SELECT origin, shown FROM (SELECT CASE WHEN event_id LIKE 'E%' THEN 'seed' WHEN event_id LIKE 'A%' THEN 'news' ELSE 'feed' END AS origin, coalesce(raw_title, title) AS shown, date, arrival FROM ledger
 WHERE category <> 'company' OR source IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY origin ORDER BY date DESC, arrival DESC) <= 25""", LEDGER))
def _(v):
    return K.recent_titles(v.ledger().withColumn("origin", L.origin(F.col("event_id")))).select("origin", "shown")


@query("recent_raw_items", with_("SELECT event_id, raw_title FROM ledger WHERE raw_title IS NOT NULL ORDER BY date DESC, arrival DESC LIMIT 40", LEDGER))
def _(v):
    return K.recent_raw_items(v.ledger(), 40).select("event_id", "raw_title")


FUNNEL_LOG = """
log AS (SELECT day, label, count(*) AS raw, count(*) FILTER (dup) AS dup, count(*) FILTER (dup_near) AS dup_near, count(*) FILTER (kw_pass) AS kw_pass, count(*) FILTER (kept) AS kept FROM activity GROUP BY ALL)"""


def funnel_log(v):
    flags = ["dup", "dup_near", "kw_pass", "kept"]
    return v.activity().groupBy("day", "label").agg(
        F.count("*").alias("raw"), *[F.count_if(c).alias(c) for c in flags])


@query("keep_last_records", with_("SELECT CAST(day AS VARCHAR) AS day, label, raw, kept FROM log WHERE day IN (SELECT DISTINCT day FROM log ORDER BY day DESC LIMIT 12)", ACTIVITY, FUNNEL_LOG))
def _(v):
    return K.keep_last_records(funnel_log(v), "day", 12).select("day", "label", "raw", "kept")


@query("keep_last_dates", with_("SELECT event_id, CAST(date AS VARCHAR) AS date FROM ledger WHERE date IN (SELECT DISTINCT date FROM ledger ORDER BY date DESC LIMIT 30)", LEDGER))
def _(v):
    return K.keep_last_dates(v.ledger(), "date", 30).select("event_id", "date")


@query("items_per_source_cap", with_("SELECT arrival, label FROM links QUALIFY row_number() OVER (PARTITION BY label ORDER BY arrival) <= 10", LINKS))
def _(v):
    return K.items_per_source_cap(v.links().select("arrival", "label"))


# --- raters -------------------------------------------------------------------------
PAIRS = """
pr AS (SELECT a.item_id, a.provider AS ap, b.provider AS bp, a.relevant AS ar, b.relevant AS br, a.direction = b.direction AS d, a.axis = b.axis AS x,
 a.strength = b.strength AS s, abs(a.strength - b.strength) <= 1 AS s1 FROM verdicts a JOIN verdicts b ON a.item_id = b.item_id AND a.provider < b.provider)"""


@query("rater_pairs", with_("SELECT item_id, ap AS a_provider, bp AS b_provider, CAST(ar = br AS BIGINT) AS agree FROM pr", VERDICTS, PAIRS))
def _(v):
    return R.rater_pairs(v.verdicts()).select("item_id", "a_provider", "b_provider",
                                              (F.col("a_relevant") == F.col("b_relevant")).alias("agree"))


def _rate(c, both="ar AND br"):
    return f"floor(avg(CAST({c} AS INTEGER)) FILTER ({both}) * 1000.0 + 0.5) / 1000.0"


@query("rater_agreement", with_(f"""
SELECT coalesce(pair, 'ALL') AS pair, {_rate('ar = br', 'TRUE')} AS relevant, {_rate('d')} AS direction, {_rate('x')} AS axis, {_rate('s')} AS strength,
 {_rate('s1')} AS strength_within_1, count(*) AS n FROM (SELECT *, ap || '|' || bp AS pair FROM pr) GROUP BY ROLLUP (pair)""", VERDICTS, PAIRS))
def _(v):
    return R.rater_agreement(v.verdicts())


@query("first_accepted_judge", with_("""
SELECT item_id, min(provider) AS provider, arg_min(direction, provider) AS direction, arg_min(strength, provider) AS strength
FROM verdicts WHERE relevant AND axis <> '' GROUP BY 1""", VERDICTS))
def _(v):
    return (R.first_accepted(v.verdicts(), F.col("relevant") & (F.col("axis") != ""), "provider")
            .select("item_id", "provider", "direction", "strength"))


@query("verdict_align", with_("""
SELECT event_id, CASE WHEN b % 3 = 0 THEN 6 - pos ELSE pos END AS seat, CAST(b % 3 = 0 OR b % 3 = 1 AND FALSE AS BIGINT) AS verified, CAST(b % 3 = 0 AS BIGINT) AS reordered
FROM (SELECT event_id, event_id // 5 AS b, event_id % 5 + 1 AS pos FROM activity)""", ACTIVITY))
def _(v):
    b, pos = F.floor(F.col("event_id") / 5), F.col("event_id") % 5 + 1
    rows = v.activity().select("event_id", b.alias("batch_id"), pos.alias("pos"),
                               F.when(b % 3 == 0, (6 - pos).cast("string")).when(b % 3 == 1, F.least(pos, F.lit(3)).cast("string"))
                               .otherwise("x").alias("echoed"))
    return R.align_batches(rows).select("event_id", "seat", "verified", "reordered")


CALLS = """
calls AS (SELECT provider, count(*) AS attempt, count(*) - count(*) FILTER (axis = '') AS ok, count(*) FILTER (axis = '') AS language_reject, count(*) FILTER (NOT relevant) AS empty FROM verdicts GROUP BY 1)"""


def calls(v):
    one = lambda name, n: F.struct(F.lit(name).alias("counter"), n.alias("n"))
    counters = F.array(one("attempt", F.lit(1)), one("ok", F.lit(1)),
                       one("language_reject", (F.col("axis") == "").cast("int")),
                       one("empty", (~F.col("relevant")).cast("int")))
    return v.verdicts().select("provider", F.inline(counters))


def provider_log(v):
    """One run per provider's calls, written as the log keeps them and read back."""
    from pulsetrail.session import fresh_path
    from pulsetrail.sources.ledger import read_provider_log
    per = calls(v).groupBy(F.col("provider").cast("string").alias("provider"), "counter").agg(F.sum("n").cast("long").alias("n"))
    counts = per.groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("counter", "n"))).alias("c"))   # four counters
    run = counts.select(F.lit("2024-01-05").alias("date"), F.concat(F.lit("2024-01-05T0"), "provider").alias("at"), F.lit("judge").alias("stage"),
                        F.col("c.attempt").alias("total_attempts"), F.create_map("provider", "c").alias("providers"))
    path = fresh_path(v.spark, "provider-log")
    run.write.json(path)
    return read_provider_log(v.spark, path, multi_line=False)


@query("provider_usage", with_("""
SELECT CAST(provider AS VARCHAR) AS provider, attempt, ok, language_reject, empty, attempt AS total_attempts FROM calls""", VERDICTS, CALLS))
def _(v):
    log = provider_log(v)
    usage = R.provider_usage(log, ["attempt", "ok", "language_reject", "empty"])
    total = R.total_attempts(log).select(F.substring("run_at", -1, 1).alias("provider"), "total_attempts")
    return usage.join(total, "provider")
