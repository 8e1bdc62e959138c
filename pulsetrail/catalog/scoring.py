"""Credibility and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrail import vocab
from pulsetrail.catalog.bindings import BUYERS, CMP, CUR, RIVALS, SCORED, SERIES, SUBJECT, VITALS, with_
from pulsetrail.catalog.registry import query
from pulsetrail.catalog.series import (CHANGE, COMP, MARKET, MEASURED, MERGED, VERDICT, ZERO,
                                       _measured, c4, day, means, periods, r4)
from pulsetrail.functions import measures as M
from pulsetrail.operators import (attribution as A, periods as P, ranking as K, scoring as S,
                                  series as O)
from pulsetrail.plans import reports

RS = RIVALS + """,
reach AS (SELECT series_id, min(day) AS d0, max(day) AS d1 FROM series GROUP BY 1),
dated AS (SELECT series_id, min(date) AS e0, max(date) AS e1 FROM scored_ledger GROUP BY 1),
span AS (SELECT series_id, greatest(d0, e0) AS s, least(d1, e1) AS e FROM reach JOIN dated USING (series_id) WHERE least(d1, e1) > greatest(d0, e0)),
weighted AS (SELECT *, greatest(1, least(5, coalesce(nullif(impact_strength, 0), 2)))
  * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'med' THEN 0.66::DOUBLE ELSE 0.33::DOUBLE END
  * CASE impact_direction WHEN '+' THEN 1.0::DOUBLE WHEN '-' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS w,
  CASE impact_horizon WHEN 'immediate' THEN 3 WHEN 'weeks' THEN 14 ELSE 60 END AS hl,
  CASE impact_horizon WHEN 'immediate' THEN 7 WHEN 'weeks' THEN 28 ELSE 90 END AS win FROM scored_ledger),
axes AS (SELECT unnest(['demand', 'share', 'supply', 'all']) AS axis)"""
PRESSURE = """
days AS (SELECT series_id, unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM span),
impulse AS (SELECT x.series_id, a.axis, date, hl, sum(w) AS w FROM weighted x JOIN axes a ON a.axis = 'all' OR a.axis = x.axis WHERE w <> 0 GROUP BY ALL),
spread AS (SELECT series_id, axis, date + age AS day, sum(w * pow(0.5, age / hl)) AS p
 FROM (SELECT *, unnest(range(0, 4 * hl + 1))::INTEGER AS age FROM impulse) GROUP BY ALL),
pressure AS (SELECT series_id, axis, day, coalesce(p, 0) AS p FROM (SELECT series_id, axis, day FROM days, axes) LEFT JOIN spread USING (series_id, axis, day))"""
DENSE_START = """
months AS (SELECT series_id, unnest(generate_series(date_trunc('month', s)::TIMESTAMP, date_trunc('month', e)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m, s, e FROM span),
month_n AS (SELECT x.series_id, m, s, e, count(l.date) AS n FROM months x LEFT JOIN scored_ledger l ON l.series_id = x.series_id AND date_trunc('month', l.date)::DATE = m GROUP BY ALL),
dense_w AS (SELECT series_id, CASE WHEN max(m) FILTER (n < {minimum}) IS NULL THEN min(s)
  WHEN max(m) FILTER (n < {minimum}) < max(m) THEN (max(m) FILTER (n < {minimum}) + INTERVAL 1 MONTH)::DATE END AS dense_start, max(e) AS e FROM month_n GROUP BY 1)"""


@query("event_weight", with_(f"SELECT event_id, series_id, {r4('w')} AS weight FROM weighted", SERIES, SCORED, RS))
def _(v):
    w = M.event_weight(F.col("impact_strength"), F.col("confidence"), F.col("impact_direction"))
    return v.scored_ledger().select("event_id", "series_id", M.half_up(w, 4).alias("weight"))


def _spans(v):
    """One row a series, kept in the shared folder: a report reads it many times, and each time would read the ledger again."""
    if "spans()" not in v._tables:
        v._tables["spans()"] = S.overlap_span(v.scored_ledger(), v.stored_series()).checkpoint()
    return v._tables["spans()"]


@query("pressure_index", with_(f"SELECT series_id, axis, CAST(day AS VARCHAR) AS day, {r4('p')} AS p FROM pressure", SERIES, SCORED, RS, PRESSURE))
def _(v):
    return S.pressure_index(v.scored_ledger(), _spans(v)).select("series_id", "axis", "day", c4("p"))


MINIMA = (1, vocab.MONTH_MINIMUM, 100000)


@query("dense_window", with_(" UNION ALL ".join(
    f"SELECT series_id, CAST({m} AS BIGINT) AS minimum, CAST(dense_start AS VARCHAR) AS dense_start FROM d{m}" for m in MINIMA),
                             SERIES, SCORED, RS,
                             *[DENSE_START.format(minimum=m).replace("dense_w", f"d{m}").replace("month_n", f"mn{m}").replace("months", f"ms{m}")
                               for m in MINIMA]))
def _(v):
    led, spans = v.scored_ledger(), _spans(v)
    out = None
    for m in MINIMA:
        one = S.dense_window(led, spans, m).select("series_id", F.lit(m).alias("minimum"), "dense_start")
        out = one if out is None else out.unionByName(one)
    return out


WINDOWS = """
ev AS (SELECT w.*, (SELECT avg(value) FROM series s WHERE s.series_id = w.series_id AND s.day BETWEEN w.date - 14 AND w.date - 1) AS before_mean,
  (SELECT avg(value) FROM series s WHERE s.series_id = w.series_id AND s.day BETWEEN w.date + 1 AND w.date + win) AS after_mean,
  (SELECT count(*) FROM series s WHERE s.series_id = w.series_id AND s.day BETWEEN w.date + 1 AND w.date + win) AS after_n FROM weighted w
 WHERE series_id IN (SELECT series_id FROM series)),
scored AS (SELECT *, CASE WHEN impact_direction NOT IN ('+', '-') THEN 'skipped' WHEN after_n / win < 0.95 THEN 'unfinished'
  WHEN coalesce(before_mean, 0) = 0 THEN 'skipped' ELSE 'scored' END AS status,
  (after_mean - before_mean) / before_mean AS move FROM ev),
outcome AS (SELECT *, CASE WHEN status = 'scored' THEN floor(move * 100 * 100.0 + 0.5) / 100.0 END AS actual_pct,
  CASE WHEN status = 'scored' THEN CAST((move > 0) = (impact_direction = '+') AS BIGINT) END AS hit FROM scored)"""


@query("event_window_join", with_(f"""
SELECT event_id, series_id, {r4('before_mean')} AS before_mean, {r4('after_mean')} AS after_mean, CAST(after_n AS BIGINT) AS after_n FROM ev""",
                                  SERIES, SCORED, RS, WINDOWS))
def _(v):
    return S.event_windows(v.scored_ledger(), v.stored_series()).select(
        "event_id", "series_id", c4("before_mean"), c4("after_mean"), "after_n")


@query("hit_scores", with_("SELECT event_id, series_id, status, actual_pct, hit FROM outcome", SERIES, SCORED, RS, WINDOWS))
def _(v):
    return S.hit_scores(v.scored_ledger(), v.stored_series()).select("event_id", "series_id", "status", "actual_pct", "hit")


@query("hit_summary", with_(f"""
SELECT series_id, block, coalesce(CAST(strength AS VARCHAR), '') AS strength, coalesce(confidence, '') AS confidence, count(*) AS n,
 floor(avg(hit) * 1000.0 + 0.5) / 1000.0 AS hit_rate, floor(avg(abs(actual_pct)) * 100.0 + 0.5) / 100.0 AS mean_abs_move_pct
FROM (SELECT series_id, b AS block, impact_strength AS strength, confidence, hit, actual_pct FROM (
 SELECT *, unnest(['all', CASE WHEN date_source = 'capture' THEN 'retrospective' ELSE 'foreknown' END, nullif(axis, '')]) AS b
 FROM outcome WHERE status = 'scored') WHERE b IS NOT NULL)
GROUP BY GROUPING SETS ((series_id, block), (series_id, block, strength), (series_id, block, confidence))""", SERIES, SCORED, RS, WINDOWS))
def _(v):
    return S.hit_summary(S.hit_scores(v.scored_ledger(), v.stored_series()))


TARGETS = """
share_strict AS (SELECT m.subject_id, m.day, s.value / (s.value + m.value) AS value FROM market_strict m JOIN series s ON s.series_id = m.subject_id AND s.day = m.day),
levels AS (SELECT series_id, 'all' AS axis, day, value FROM series UNION ALL SELECT series_id, 'supply', day, value FROM series
 UNION ALL SELECT subject_id, 'demand', day, value FROM market_strict UNION ALL SELECT subject_id, 'share', day, value FROM share_strict),
lev_cal AS (SELECT series_id, axis, unnest(generate_series(least(min(day), any_value(s))::TIMESTAMP, greatest(max(day), any_value(e))::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day
 FROM levels JOIN span USING (series_id) GROUP BY 1, 2),
targets AS (SELECT x.series_id, axis, day, (n - p) / p AS change FROM (
 SELECT series_id, axis, day, avg(value) OVER (PARTITION BY series_id, axis ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS p,
  avg(value) OVER (PARTITION BY series_id, axis ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING) AS n
 FROM lev_cal LEFT JOIN levels USING (series_id, axis, day)) x JOIN span ON span.series_id = x.series_id WHERE p <> 0 AND n IS NOT NULL AND day BETWEEN s AND e)"""


def corr_sql(x, y):
    return (f"CASE WHEN count({x}) >= 3 AND var_pop({x}) * var_pop({y}) > 0 "
            f"THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END")


@query("pearson_r", with_(f"""
SELECT b.series_id, {r4(corr_sql('a.value', 'b.value'))} AS r, count(*) AS n
FROM series a JOIN series b ON a.day = b.day AND a.series_id = '{SUBJECT}' AND b.series_id <> '{SUBJECT}' GROUP BY ALL""", SERIES))
def _(v):
    """The subject against every other series on shared days."""
    s = v.stored_series()
    own = s.filter(F.col("series_id") == SUBJECT).select("day", F.col("value").alias("x"))
    others = s.filter(F.col("series_id") != SUBJECT).select("series_id", "day", F.col("value").alias("y"))
    return (others.join(own, "day").groupBy("series_id")
            .agg(M.half_up(M.pearson("x", "y"), 4).alias("r"), F.count("*").alias("n")))


@query("pressure_correlation", with_(f"""
SELECT series_id, stretch, axis, {r4(corr_sql('p', 'change'))} AS r, count(*) AS n FROM (
 SELECT t.series_id, unnest(CASE WHEN d.dense_start IS NULL OR t.day >= d.dense_start THEN ['full', 'dense'] ELSE ['full'] END) AS stretch, t.axis, p.p, t.change
 FROM targets t JOIN pressure p USING (series_id, axis, day) JOIN dense_w d ON d.series_id = t.series_id) GROUP BY ALL""",
                                     SERIES, SCORED, RS, MARKET, PRESSURE, TARGETS, DENSE_START.format(minimum=vocab.MONTH_MINIMUM)))
def _(v):
    led, spans = v.scored_ledger(), _spans(v)
    t = S.axis_targets(v.stored_series(), v.rivals(), spans)
    return (S.pressure_correlation(S.pressure_index(led, spans), t, S.dense_window(led, spans))
            .select("series_id", "stretch", "axis", c4("r"), "n"))


@query("permutation_test")
def _(v):
    """1000 redrawn ledgers for every series over its dense stretch (all of its span where it has none)."""
    out = reports.credibility(v.scored_ledger(), v.stored_series(), v.rivals(), vocab.MONTH_MINIMUM)["permutation"]
    return out.select("series_id", "axis", c4("observed_r"), "permutations", c4("p_value"), c4("null_p95_abs_r"), "significant")


# --- attribution -----------------------------------------------------------------
LOGS = f"""
{VITALS.strip()},
vm AS (SELECT avg(p75) FILTER (period_end BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}') AS v1,
 avg(p75) FILTER (period_end BETWEEN DATE '{CMP[0]}' AND DATE '{CMP[1]}') AS v0 FROM vitals),
tm AS ({means('series')}), dm AS ({means('market_zero', key='subject_id')}),
g0 AS (SELECT tm.series_id, ln(tm.c1 / tm.c0) AS gt, ln(dm.c1 / dm.c0) AS gm, (v1 - v0) / v0 * 100 AS lcp
 FROM tm JOIN dm ON tm.series_id = dm.subject_id, vm WHERE tm.c0 <> 0 AND dm.c0 <> 0 AND tm.c1 IS NOT NULL AND dm.c1 IS NOT NULL),
g1 AS (SELECT *, gt - gm AS rest, CASE WHEN lcp > 10 AND gt < 0 AND gt - gm < 0 THEN least(0.25::DOUBLE, (lcp - 10) / 100) ELSE 0 END AS part FROM g0 WHERE abs(gt) > 1e-6),
parts AS (SELECT series_id, gt, lcp, 'demand' AS axis, gm AS g FROM g1 UNION ALL SELECT series_id, gt, lcp, 'share', rest - rest * part FROM g1
 UNION ALL SELECT series_id, gt, lcp, 'supply', rest * part FROM g1),
alloc AS (SELECT *, CASE WHEN drove THEN abs(g) / sum(CASE WHEN drove THEN abs(g) ELSE 0 END) OVER (PARTITION BY series_id) ELSE 0 END AS allocation
 FROM (SELECT *, CASE WHEN gt < 0 THEN g < -1e-9 ELSE g > 1e-9 END AS drove FROM parts))"""


def _attribution(v):
    s = v.series(CUR, CMP)
    return A.log_attribution(s, s, v.rivals(), periods(v), v.vitals())


@query("log_attribution", with_(f"""
SELECT series_id, axis, {r4('g')} AS g, {r4('allocation')} AS allocation, {r4('exp(g) - 1')} AS effect,
 {r4('(exp(gt) - 1) * 100')} AS total_pct, {r4('lcp')} AS vitals_pct FROM alloc""", SERIES, RIVALS, ZERO, LOGS))
def _(v):
    return _attribution(v).select("series_id", "axis", c4("g"), c4("allocation"), c4("effect"),
                                  c4("total_pct"), c4("vitals_pct"))


WCUR, WCMP = ("1999-09-01", "1999-09-28"), ("1999-08-01", "1999-08-28")
SEASON = f"""
reps AS (SELECT k, DATE '{WCUR[0]}' - 31 * k AS cf, DATE '{WCUR[1]}' - 31 * k AS ct, DATE '{WCUR[0]}' - 31 * (k + 1) AS pf, DATE '{WCUR[1]}' - 31 * (k + 1) AS pt
 FROM (SELECT unnest(range(1, 11))::INTEGER AS k)),
rlog AS (SELECT series_id, k, ln(avg(value) FILTER (day BETWEEN cf AND ct) / avg(value) FILTER (day BETWEEN pf AND pt)) AS g
 FROM series, reps WHERE pf >= (SELECT min(day) FROM series x WHERE x.series_id = series.series_id) GROUP BY ALL),
med AS (SELECT series_id, median(g) AS m, count(g) AS n FROM rlog WHERE g IS NOT NULL GROUP BY 1 HAVING count(g) >= 3),
mad AS (SELECT r.series_id, median(abs(g - m)) * 1.4826 AS sigma FROM rlog r JOIN med USING (series_id) GROUP BY 1)"""


@query("seasonal_baseline", with_(f"""
SELECT series_id, {r4('m')} AS expected_log, {r4('sigma')} AS sigma, n AS replays, {r4('(exp(m) - 1) * 100')} AS expected_pct,
 {r4('(exp(gt - m) - 1) * 100')} AS residual_pct, {r4('(gt - m) / sigma')} AS z, CAST(abs((gt - m) / sigma) >= 2 AS BIGINT) AS unusual
FROM med JOIN mad USING (series_id) JOIN (SELECT series_id, ln(c1 / c0) AS gt FROM ({means('series', WCUR, WCMP)})) USING (series_id)""",
                                  SERIES, SEASON))
def _(v):
    p = P.fixed_periods(v.series_ids(), WCUR, WCMP)
    base = A.seasonal_baseline(v.stored_series(), p)
    moves = A.log_attribution(v.stored_series(), v.stored_series(), v.rivals(), p)
    return A.seasonal_residual(moves, base).select(
        "series_id", c4("expected_log"), c4("sigma"), "replays", c4("expected_pct"),
        c4("residual_pct"), c4("z"), "unusual")


@query("basis_gap", with_(f"""
SELECT series_id, CAST(c1 IS NULL OR coalesce(c0, 0) = 0 AS BIGINT) AS gap
FROM (SELECT 'C' || c_custkey AS series_id FROM customer) LEFT JOIN ({means('part')}) USING (series_id)""", BUYERS,
                          "part AS (SELECT series_id, day, units AS value FROM buyers)"))
def _(v):
    """Units measured for every customer: many bought nothing in one of the periods."""
    part = v.buyers(CUR, CMP).select("series_id", "day", F.col("units").alias("value"))
    return A.basis_gap(part, P.fixed_periods(v.buyer_ids(), CUR, CMP)).select("series_id", "gap")


MOVED = f"""
mv AS (SELECT l.*, o.direction AS move, o.pct FROM scored_ledger l JOIN own o ON o.series_id = l.series_id),
inp AS (SELECT *, impact_direction = move AS explains FROM mv WHERE date BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}')"""


def _moved(v):
    own = P.period_verdict(v.series(CUR, CMP), periods(v))
    return A.with_move(v.scored_ledger(), own)


@query("direction_match", with_("SELECT event_id, series_id, CAST(explains AS BIGINT) AS explains FROM inp", SERIES, SCORED, VERDICT, MOVED))
def _(v):
    return A.direction_match(_moved(v)).select("event_id", "series_id", "explains")


_GROUPS = " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in vocab.CATEGORY_GROUPS.items())
CATEGORY = f"""
cat AS (SELECT series_id, CASE category {_GROUPS} ELSE '기타' END AS category_group, count(*) AS events, any_value(pct) AS pct,
 sum(impact_strength * CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'med' THEN 0.66::DOUBLE WHEN 'low' THEN 0.33::DOUBLE ELSE 0.5 END) AS weight
 FROM inp WHERE explains AND move IN ('+', '-') GROUP BY 1, 2)"""


@query("category_attribution", with_(f"""
SELECT series_id, category_group, events, {r4('weight')} AS weight, {r4('weight / sum(weight) OVER (PARTITION BY series_id)')} AS share,
 {r4('weight / sum(weight) OVER (PARTITION BY series_id) * abs(pct)')} AS points FROM cat""", SERIES, SCORED, VERDICT, MOVED, CATEGORY))
def _(v):
    return A.category_attribution(_moved(v)).select(
        "series_id", "category_group", "events", c4("weight"), c4("share"), c4("points"))


@query("movement_explained", with_(f"""
SELECT o.series_id, {r4('o.pct')} AS pct, direction, category_group, events, {r4('weight / sum(weight) OVER (PARTITION BY o.series_id)')} AS share,
 {r4('weight / sum(weight) OVER (PARTITION BY o.series_id) * abs(o.pct)')} AS points FROM own o LEFT JOIN cat USING (series_id)""", SERIES, SCORED, VERDICT, MOVED, CATEGORY))
def _(v):
    out = reports.movement_explained(v.scored_ledger(), v.series(CUR, CMP), periods(v))
    return out.select("series_id", c4("pct"), "direction", "category_group", "events", c4("share"), c4("points"))


CARRY = f"""
carry AS (SELECT DISTINCT event_id, series_id, axis, category, title, impact, description, kind FROM (SELECT *, CASE
 WHEN date > DATE '{CMP[1]}' AND date < DATE '{CUR[0]}' THEN CASE WHEN impact_horizon = 'months' AND impact_direction = move THEN 'carry' END
 WHEN date BETWEEN DATE '{CMP[0]}' AND DATE '{CMP[1]}' AND impact_direction = (CASE move WHEN '-' THEN '+' ELSE '-' END) THEN 'base' END AS kind FROM mv) WHERE kind IS NOT NULL)"""


@query("carry_base_factors", with_("SELECT event_id, series_id, kind FROM carry", SERIES, SCORED, VERDICT, MOVED, CARRY))
def _(v):
    return A.carry_base_factors(_moved(v)).select("event_id", "series_id", "kind")


OWN_WORDS, RIVAL_WORDS, SUPPLY_WORDS = ["building"], ["machinery", "household"], ["furniture"]


def axis_used():
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("impact", F.lit("")),
                               F.coalesce("description", F.lit(""))))
    return M.classify_axis(F.col("axis"), text, F.col("category"), OWN_WORDS, RIVAL_WORDS, SUPPLY_WORDS)


def axis_sql():
    t = "lower(title || ' ' || impact || ' ' || description)"
    rival = " OR ".join(f"contains({t}, '{w}')" for w in RIVAL_WORDS)
    return (f"CASE WHEN axis IN ('demand', 'share', 'supply') THEN axis WHEN contains({t}, 'furniture') THEN 'supply' "
            f"WHEN category IN ('platform', 'AI', 'marketing') THEN CASE WHEN {rival} THEN 'share' ELSE 'demand' END "
            f"WHEN category = 'company' THEN CASE WHEN contains({t}, 'building') THEN 'demand' ELSE 'share' END ELSE 'demand' END")


@query("axis_classify", with_(f"SELECT event_id, series_id, {axis_sql()} AS axis_used FROM scored_ledger", SCORED))
def _(v):
    return v.scored_ledger().select("event_id", "series_id", axis_used().alias("axis_used"))


@query("axis_event_lists", with_(f"""
SELECT series_id, axis_used, coalesce(events, 0) AS events, coalesce(excluded, 0) AS excluded, CAST(coalesce(events, 0) = 0 AND coalesce(allocation, 0) >= 0.02 AS BIGINT) AS gap
FROM (SELECT series_id, axis AS axis_used, allocation FROM alloc)
FULL JOIN (SELECT series_id, {axis_sql()} AS axis_used, count(*) FILTER (explains) AS events, count(*) FILTER (NOT explains) AS excluded FROM inp GROUP BY 1, 2) USING (series_id, axis_used)""",
                                 SERIES, SCORED, RIVALS, ZERO, LOGS, VERDICT, MOVED))
def _(v):
    moved = _moved(v).withColumn("axis_used", axis_used())
    return A.axis_event_lists(moved, _attribution(v)).select("series_id", "axis_used", "events", "excluded", "gap")


@query("event_changepoint_link", with_("""
SELECT event_id, l.series_id, CAST(min(m.day) AS VARCHAR) AS change_day, min(m.day - l.date)::BIGINT AS gap_days
FROM scored_ledger l JOIN merged m ON m.series_id = l.series_id AND m.day - l.date BETWEEN 0 AND 7
 AND l.impact_direction = CASE WHEN m.pct < 0 THEN '-' ELSE '+' END GROUP BY 1, 2""", SERIES, SCORED, CHANGE, MERGED))
def _(v):
    pts = O.change_point_merge(O.change_points(v.series()))
    return A.event_changepoint_link(v.scored_ledger(), pts).select("event_id", "series_id", "change_day", "gap_days")


# --- ranking --------------------------------------------------------------------
ORDER = """CASE WHEN move IN ('+', '-') THEN CASE WHEN impact_direction = move THEN 0 WHEN impact_direction = 'neutral' THEN 2 ELSE 1 END ELSE 0 END,
 -(CASE confidence WHEN 'high' THEN 3 WHEN 'med' THEN 2 WHEN 'low' THEN 1 ELSE 0 END), CASE WHEN impact_direction = 'neutral' THEN 1 ELSE 0 END, date DESC, arrival"""


@query("rank_events", with_(f"SELECT event_id, series_id, row_number() OVER (PARTITION BY series_id ORDER BY {ORDER}) AS rank FROM mv", SERIES, SCORED, VERDICT, MOVED))
def _(v):
    return K.rank_events(_moved(v)).select("event_id", "series_id", "rank")


@query("topk_events", with_(f"SELECT event_id, series_id, CAST(date AS VARCHAR) AS date FROM mv QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY {ORDER}) <= 10", SERIES, SCORED, VERDICT, MOVED))
def _(v):
    return K.topk_events(_moved(v)).select("event_id", "series_id", "date")


@query("first_rank_by_date", with_(f"""
SELECT series_id, CAST(date AS VARCHAR) AS date, min(rank) AS first_rank FROM (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY {ORDER}) AS rank FROM mv) GROUP BY 1, 2""",
                                   SERIES, SCORED, VERDICT, MOVED))
def _(v):
    return K.first_rank_by_date(K.rank_events(_moved(v)))


@query("topk_per_axis", with_(f"""
SELECT series_id, axis_used, event_id, axis_rank, CAST(weight AS BIGINT) AS weight, greatest(n - 3, 0) AS remaining FROM (
 SELECT *, row_number() OVER (PARTITION BY series_id, axis_used ORDER BY weight DESC, arrival) AS axis_rank, count(*) OVER (PARTITION BY series_id, axis_used) AS n FROM (
 SELECT series_id, event_id, arrival, {axis_sql()} AS axis_used, impact_strength * CASE confidence WHEN 'high' THEN 3 WHEN 'med' THEN 2 ELSE 1 END AS weight FROM inp WHERE explains))
WHERE axis_rank <= 3""", SERIES, SCORED, VERDICT, MOVED))
def _(v):
    ev = A.direction_match(_moved(v)).filter("explains").withColumn("axis_used", axis_used())
    return K.topk_per_axis(ev, "axis_used").select("series_id", "axis_used", "event_id", "axis_rank", "weight", "remaining")
