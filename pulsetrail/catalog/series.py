"""Series, period and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsetrail import vocab
from pulsetrail.catalog.bindings import (ACTIVITY, AS_OF, BUYER_LEDGER, BUYERS, CMP, CUR, LEDGER, RIVALS, SALES, SCORED,
                                         SERIES, SERIES_DIVISION, SUBJECT, VITALS, with_)
from pulsetrail.catalog.registry import query
from pulsetrail.functions import measures as M
from pulsetrail.operators import attribution as A, periods as P, ranking as K, scoring as S, series as O

R4 = "floor({0} * 10000.0 + 0.5) / 10000.0"


def r4(e):
    return R4.format(f"({e})")


def c4(name):
    return M.half_up(F.col(name), 4).alias(name)


day = lambda v: F.lit(v).cast("date")


# --- combination -------------------------------------------------------------
def _older(v):
    """Stored copy of the series: as it was before the last 40 days arrived."""
    return v.sales().filter(F.col("order_id") % 3 != 0).groupBy("series_id", "day").agg(
        F.sum("cents").cast("double").alias("value"))


@query("series_upsert", with_(f"""
SELECT series_id, CAST(day AS VARCHAR) AS day, coalesce(n.value, o.value) AS value
FROM (SELECT * FROM old WHERE day >= DATE '{AS_OF}' - 730) o
FULL JOIN (SELECT * FROM series WHERE day >= DATE '{AS_OF}' - 730 AND day >= DATE '2000-12-01') n
USING (series_id, day)""", SERIES, """
old AS (SELECT series_id, day, CAST(sum(cents) AS DOUBLE) AS value FROM sales
 WHERE order_id % 3 <> 0 GROUP BY ALL)"""))
def _(v):
    fresh = v.series().filter(F.col("day") >= day("2000-12-01"))
    return O.series_upsert(_older(v), fresh, day(AS_OF))


MARKET = """
market_strict AS (
 SELECT m.subject_id, m.day, m.value FROM (
  SELECT r.subject_id, s.day, sum(s.value) AS value, count(*) AS n FROM rivals r JOIN series s USING (series_id) GROUP BY ALL) m
 JOIN (SELECT subject_id, count(DISTINCT series_id) AS need FROM rivals WHERE series_id IN (SELECT series_id FROM series) GROUP BY 1) q USING (subject_id)
 SEMI JOIN series s ON s.series_id = m.subject_id AND s.day = m.day WHERE n = need)"""
ZERO = """
market_zero AS (
 SELECT o.series_id AS subject_id, o.day, o.value AS own, o.value + coalesce(m.value, 0) AS value
 FROM series o LEFT JOIN (SELECT r.subject_id, s.day, sum(s.value) AS value FROM rivals r JOIN series s USING (series_id) GROUP BY ALL) m
 ON m.subject_id = o.series_id AND m.day = o.day)"""


@query("market_strict", with_("SELECT subject_id, CAST(day AS VARCHAR) AS day, value FROM market_strict",
                              SERIES, RIVALS, MARKET))
def _(v):
    return O.market_strict(v.series(), v.rivals())


WANTED = """
wanted AS (SELECT DISTINCT series_id AS subject_id, unnest(CASE division WHEN 'OWN' THEN ['VD', 'DA'] ELSE [division] END) AS division FROM series_division),
contest AS (SELECT DISTINCT w.subject_id, d.series_id FROM wanted w JOIN series_division d USING (division) WHERE d.series_id <> w.subject_id)"""


@query("market_zero_fill", with_("""
SELECT o.series_id AS subject_id, CAST(o.day AS VARCHAR) AS day, o.value AS own, any_value(o.value) + coalesce(sum(s.value), 0) AS value
FROM series o LEFT JOIN (SELECT c.subject_id, x.day, x.value FROM contest c JOIN series x USING (series_id)) s ON s.subject_id = o.series_id AND s.day = o.day
WHERE o.series_id IN (SELECT subject_id FROM contest) GROUP BY o.series_id, o.day, o.value""", SERIES, SERIES_DIVISION, WANTED))
def _(v):
    """Every series against the competitors of its divisions; the subject's own site looks at two."""
    divisions = v.series_divisions()
    own = F.when(F.col("division") == "OWN", F.array(F.lit("VD"), F.lit("DA"))).otherwise(F.array("division"))
    wanted = divisions.select(F.col("series_id").alias("subject_id"), F.explode(own).alias("division")).distinct()
    return O.market_zero_fill(v.series(), K.rivals_of_divisions(divisions, wanted))


@query("share_series", with_(f"""
SELECT 'zero_fill' AS variant, subject_id, CAST(day AS VARCHAR) AS day, {r4('own / value * 100')} AS value
FROM market_zero WHERE value <> 0
UNION ALL SELECT 'strict', m.subject_id, CAST(m.day AS VARCHAR), {r4('s.value / (s.value + m.value)')}
FROM market_strict m JOIN series s ON s.series_id = m.subject_id AND s.day = m.day
WHERE s.value + m.value <> 0""", SERIES, RIVALS, MARKET, ZERO))
def _(v):
    s, r = v.series(), v.rivals()
    return (O.share_zero_fill(s, r).withColumn("variant", F.lit("zero_fill"))
            .unionByName(O.share_strict(s, r).withColumn("variant", F.lit("strict")))
            .select("variant", "subject_id", "day", c4("value")))


def _measured(v, *spans):
    """Measured traffic stand-in: units sold, per series and day."""
    return (v.sales(*spans).groupBy("series_id", "day")
            .agg(F.count("*").cast("double").alias("value")))


MEASURED = """
measured AS (SELECT series_id, day, CAST(count(*) AS DOUBLE) AS value FROM sales GROUP BY ALL)"""


@query("capture_series", with_(f"""
SELECT subject_id, CAST(day AS VARCHAR) AS day, {r4('b.value / m.value * 1e6')} AS value
FROM measured b JOIN market_zero m ON b.series_id = m.subject_id AND b.day = m.day WHERE m.value <> 0""".replace("CAST(day", "CAST(b.day"),
                               SERIES, RIVALS, ZERO, MEASURED))
def _(v):
    out = O.capture_series(_measured(v), O.market_zero_fill(v.series(), v.rivals()))
    return out.select("subject_id", "day", M.half_up(F.col("value") * 1e6, 4).alias("value"))


def series_documents(v):
    """Series files as they land: a map of arrays, here one document a series and day."""
    views = F.when(F.col("order_id") % 17 != 0, F.col("cents").cast("double"))
    # of points that repeat a place the largest comes last and so wins: no task holds a table of all places
    points = F.array_sort(F.collect_list(F.struct((F.col("order_id") * 8 + F.col("line")).alias("at"),
                                                  F.date_format("day", "yyyy-M-d").alias("date"), views.alias("views"))))
    docs = v.sales().groupBy("series_id", "day").agg(points.alias("points"))
    return docs.select(F.create_map("series_id", F.transform("points", lambda p: F.struct(p["date"].alias("date"), p["views"].alias("views")))).alias("series"))


@query("src_series", with_("""
SELECT series_id, CAST(day AS VARCHAR) AS day,
 coalesce(arg_max(CASE WHEN order_id % 17 = 0 THEN 0 ELSE cents END, order_id * 8 + line), 0)::DOUBLE AS value
FROM (SELECT series_id, day, order_id, line, max(cents) AS cents FROM sales GROUP BY ALL) GROUP BY ALL""", SALES))
def _(v):
    """Series files, read and flattened."""
    from pulsetrail.session import fresh_path
    from pulsetrail.sources.series import points_to_series, read_series_files
    path = fresh_path(v.spark, "series-files")
    series_documents(v).write.json(path)
    return points_to_series(read_series_files(v.spark, path, multi_line=False))


# --- windows -------------------------------------------------------------------
@query("centered_ma", with_(f"""
SELECT series_id, CAST(day AS VARCHAR) AS day, value, {r4('''avg(value) OVER (PARTITION BY series_id ORDER BY day
 ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)''')} AS smooth FROM series""", SERIES))
def _(v):
    return O.centered_ma(v.series()).select("series_id", "day", "value", c4("smooth"))


DENSE = """
dense AS (SELECT c.series_id, c.day, s.value FROM (
 SELECT series_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM series GROUP BY 1) c
 LEFT JOIN series s USING (series_id, day))"""


@query("forward_change", with_(f"""
SELECT series_id, CAST(day AS VARCHAR) AS day, {r4('(n - p) / p')} AS change FROM (
 SELECT series_id, day, avg(value) OVER (PARTITION BY series_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS p,
  avg(value) OVER (PARTITION BY series_id ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING) AS n
 FROM dense) WHERE p <> 0 AND n IS NOT NULL""", SERIES, DENSE))
def _(v):
    return O.forward_change(v.series()).select("series_id", "day", c4("change"))


CHANGE = """
cp AS (
 SELECT series_id, day, before, after, (after - before) / before * 100 AS pct FROM (
  SELECT *, avg(smooth) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS before,
   avg(smooth) OVER (w ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS after,
   row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM (SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth
   FROM series)
  WINDOW w AS (PARTITION BY series_id ORDER BY day))
 WHERE n >= 11 AND i BETWEEN 6 AND n - 4 AND before <> 0 AND abs((after - before) / before * 100) >= 8)"""
MERGED = """
seq AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM cp),
walk AS (
 SELECT series_id, i, day AS kday, pct AS kpct, 1 AS slot FROM seq WHERE i = 1
 UNION ALL
 SELECT s.series_id, s.i,
  CASE WHEN s.day - w.kday < 10 AND abs(s.pct) <= abs(w.kpct) THEN w.kday ELSE s.day END,
  CASE WHEN s.day - w.kday < 10 AND abs(s.pct) <= abs(w.kpct) THEN w.kpct ELSE s.pct END,
  CASE WHEN s.day - w.kday < 10 THEN w.slot ELSE w.slot + 1 END
 FROM walk w JOIN seq s ON s.series_id = w.series_id AND s.i = w.i + 1),
merged AS (SELECT series_id, arg_max(kday, i) AS day, arg_max(kpct, i) AS pct FROM walk GROUP BY series_id, slot)"""


@query("change_points", with_(f"""
SELECT series_id, CAST(day AS VARCHAR) AS day, {r4('pct')} AS pct, CASE WHEN pct < 0 THEN '-' ELSE '+' END AS direction FROM cp""",
                              SERIES, CHANGE))
def _(v):
    return O.change_points(v.series()).select("series_id", "day", c4("pct"), "direction")


@query("change_point_merge", with_(f"SELECT series_id, CAST(day AS VARCHAR) AS day, {r4('pct')} AS pct FROM merged",
                                   SERIES, CHANGE, MERGED))
def _(v):
    return (O.change_point_merge(O.change_points(v.series()))
            .select("series_id", "day", c4("pct")))


@query("calendar_gaps", with_(f"""
SELECT series_id, rank, CAST(gap_start AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end FROM (
 SELECT series_id, min(day) AS gap_start, max(day) AS gap_end,
  row_number() OVER (PARTITION BY series_id ORDER BY min(day) DESC) AS rank
 FROM (SELECT series_id, day, day - CAST(row_number() OVER (PARTITION BY series_id ORDER BY day) AS INTEGER) AS island
  FROM (SELECT series_id, unnest(generate_series(greatest(min(day), DATE '{AS_OF}' - 730)::TIMESTAMP, (DATE '{AS_OF}' - 2)::TIMESTAMP,
   INTERVAL 1 DAY))::DATE AS day FROM buyers GROUP BY 1) ANTI JOIN buyers USING (series_id, day))
 GROUP BY series_id, island) WHERE rank <= 2""", BUYERS))
def _(v):
    return O.calendar_gaps(v.buyers(), day(AS_OF))


@query("series_coverage", with_(f"""
SELECT s.series_id, CAST(w.a AS VARCHAR) AS start, CAST(w.b AS VARCHAR) AS "end", count(t.day) AS present,
 CAST(w.b - w.a + 1 AS BIGINT) AS expected, {r4('count(t.day) / (w.b - w.a + 1)')} AS coverage
FROM (SELECT DISTINCT series_id FROM buyers) s,
 (SELECT DATE '{CUR[0]}' AS a, DATE '{CUR[1]}' AS b UNION ALL SELECT DATE '{CMP[0]}', DATE '{CMP[1]}') w
LEFT JOIN buyers t ON t.series_id = s.series_id AND t.day BETWEEN w.a AND w.b
GROUP BY s.series_id, w.a, w.b""", BUYERS))
def _(v):
    buyers = v.buyers()
    windows = buyers.select("series_id").distinct().select("series_id", F.explode(F.array(
        *[F.struct(day(a).alias("start"), day(b).alias("end")) for a, b in (CUR, CMP)])).alias("w"))
    return (O.series_coverage(buyers, windows.select("series_id", "w.*"))
            .select("series_id", "start", "end", "present", "expected", c4("coverage")))


@query("asof_series_point", with_(f"""
SELECT l.event_id, l.series_id, CAST(s.day AS VARCHAR) AS obs_day, s.value AS obs_value
FROM buyer_ledger l ASOF JOIN inside s ON l.series_id = s.series_id AND l.date >= s.day
JOIN (SELECT series_id, max(day) AS last_day FROM inside GROUP BY 1) e ON e.series_id = l.series_id AND l.date <= e.last_day""", BUYERS, BUYER_LEDGER,
                                   f"inside AS (SELECT * FROM buyers WHERE day BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}')"))
def _(v):
    probes = v.buyer_ledger().select("event_id", "series_id", F.col("date").alias("day"))
    return O.asof_point(probes, v.buyers(CUR), *CUR).select("event_id", "series_id", "obs_day", "obs_value")


@query("tail_window", with_("""
SELECT metric, CAST(period_end AS VARCHAR) AS period_end, p75 FROM vitals
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period_end DESC) <= 26""", VITALS))
def _(v):
    pts = v.vitals().withColumnsRenamed({"metric": "series_id", "period_end": "day"})
    return O.last_n_points(pts, 26).withColumnsRenamed({"series_id": "metric", "day": "period_end"})


@query("vitals_regression", with_(f"""
SELECT metric, latest, median, {r4('(latest - median) / median * 100')} AS delta_pct,
 CAST((latest - median) / median * 100 > 10 AS BIGINT) AS regression,
 CASE WHEN latest <= 2500 THEN 'good' WHEN latest > 4000 THEN 'poor' ELSE 'needs_improvement' END AS band
FROM (SELECT metric, max(p75) FILTER (r = 1) AS latest, list_sort(list(p75) FILTER (r > 1))[(count(*) - 1) // 2 + 1] AS median
 FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period_end DESC) AS r FROM vitals) WHERE r <= 9 GROUP BY 1)""", VITALS))
def _(v):
    return O.vitals_regression(v.vitals()).withColumn("delta_pct", M.half_up(F.col("delta_pct"), 4))


def _monthly(v):
    """Country indicators: candidate 1 has only months far above the mean, and may have none; candidate 2 has all."""
    m = F.date_format("day", "yyyy-MM")
    full = v.sales().groupBy("nation_id", F.col("series_id").alias("indicator"), m.alias("period")).agg(
        F.sum("cents").cast("double").alias("value")).withColumn("candidate_no", F.lit(2))
    mean = full.groupBy("nation_id", "indicator").agg(F.avg("value").alias("mean"))
    sparse = (full.join(mean, ["nation_id", "indicator"]).filter(F.col("value") > 2.5 * F.col("mean"))
              .drop("mean").withColumn("candidate_no", F.lit(1)))
    return sparse.unionByName(full)


MONTHLY = """
full_m AS (SELECT nation_id, series_id AS indicator, strftime(day, '%Y-%m') AS period, CAST(sum(cents) AS DOUBLE) AS value FROM sales GROUP BY ALL),
mean_m AS (SELECT nation_id, indicator, avg(value) AS mean FROM full_m GROUP BY ALL),
monthly AS (SELECT full_m.*, 1 AS candidate_no FROM full_m JOIN mean_m USING (nation_id, indicator) WHERE value > 2.5::DOUBLE * mean UNION ALL SELECT *, 2 FROM full_m),
chosen AS (SELECT * FROM monthly m WHERE candidate_no = (SELECT min(candidate_no) FROM monthly x WHERE x.nation_id = m.nation_id AND x.indicator = m.indicator))"""


@query("first_nonempty_series", with_("""
SELECT CAST(nation_id AS BIGINT) AS nation_id, indicator, period, value, CAST(candidate_no AS BIGINT) AS candidate_no FROM chosen""", SALES, MONTHLY))
def _(v):
    return O.first_nonempty(_monthly(v), ["nation_id", "indicator"])


@query("indicator_last_change", with_(f"""
SELECT CAST(nation_id AS BIGINT) AS nation_id, indicator, period, value, recency,
 CASE WHEN recency = 1 AND prev IS NOT NULL THEN {r4('coalesce((value - prev) / prev * 100, 0)')} END AS change_pct
FROM (SELECT *, row_number() OVER w AS recency, lead(value) OVER w AS prev FROM chosen
 WINDOW w AS (PARTITION BY nation_id, indicator ORDER BY period DESC)) WHERE recency <= 6""", SALES, MONTHLY))
def _(v):
    pts = O.first_nonempty(_monthly(v), ["nation_id", "indicator"])
    return (O.indicator_last_change(pts, ["nation_id", "indicator"])
            .select("nation_id", "indicator", "period", "value", "recency", c4("change_pct")))


@query("measured_rollup", with_("""
SELECT CAST(day AS VARCHAR) AS day, coalesce(CAST(nation_id AS VARCHAR), 'ALL') AS country, CAST(sum(cents) AS DOUBLE) AS traffic
FROM sales GROUP BY GROUPING SETS ((day, nation_id), (day))""", SALES))
def _(v):
    return O.measured_rollup(_traffic(v)).select("day", F.when(F.col("is_total"), "ALL").otherwise(F.col("country")).alias("country"), "traffic")


def _traffic(v):
    return v.sales().select(F.col("nation_id").cast("string").alias("country"), "day", F.col("cents").cast("double").alias("traffic"))


@query("measured_summary", with_("""
SELECT count(DISTINCT day) AS days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(DISTINCT nation_id) AS countries FROM sales""", SALES))
def _(v):
    return O.measured_summary(_traffic(v))


@query("measured_preferred", with_("""
SELECT series_id, CAST(day AS VARCHAR) AS day, value, 'measured' AS basis FROM measured WHERE series_id IN (SELECT series_id FROM series_division WHERE division = 'DA')
UNION ALL SELECT series_id, CAST(day AS VARCHAR), value, 'proxy' FROM series WHERE series_id NOT IN (SELECT series_id FROM series_division WHERE division = 'DA')""",
                                   SERIES, MEASURED, SERIES_DIVISION))
def _(v):
    """Traffic is measured for the sites of one division; the others keep their proxy."""
    sites = v.series_divisions().filter(F.col("division") == "DA").select("series_id")
    return O.prefer_measured(_measured(v).join(sites, "series_id", "left_semi"), v.series()).select("series_id", "day", "value", "basis")


# --- periods -------------------------------------------------------------------
def _todays(v):
    return O.span_of(v.series()).select("series_id", F.col("end").alias("today"))


_KINDS = list(vocab.PERIOD_BASES)
TODAYS = "todays AS (SELECT series_id, max(day) AS t FROM series GROUP BY 1)"
CURRENT = TODAYS + """,
current_p AS (
 SELECT series_id, kind, CASE kind WHEN 'day' THEN t WHEN 'week' THEN t - 6 WHEN 'month' THEN date_trunc('month', t) WHEN 'mtd' THEN date_trunc('month', t)
   WHEN 'quarter' THEN date_trunc('quarter', t) WHEN 'qtd' THEN date_trunc('quarter', t) ELSE date_trunc('year', t) END::DATE AS s,
  CASE kind WHEN 'month' THEN last_day(t) WHEN 'quarter' THEN (date_trunc('quarter', t) + INTERVAL 3 MONTH - INTERVAL 1 DAY)
   WHEN 'year' THEN (date_trunc('year', t) + INTERVAL 1 YEAR - INTERVAL 1 DAY) ELSE t END::DATE AS e
 FROM todays, (SELECT unnest(['day','week','month','quarter','year','mtd','qtd','ytd']) AS kind))"""


def _shift(d, basis):
    m = lambda k: f"(date_trunc('month', {d}) - INTERVAL {k} MONTH)::DATE + CAST(day({d}) - 1 AS INTEGER)"
    return (f"CASE {basis} WHEN 'DoD' THEN {d} - 1 WHEN 'WoW' THEN {d} - 7 WHEN 'MoM' THEN {m(1)} "
            f"WHEN 'QoQ' THEN {m(3)} WHEN 'YoY' THEN {m(12)} END")


@query("period_current", with_("SELECT series_id, kind, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS \"end\" FROM current_p", SERIES, CURRENT))
def _(v):
    kinds = _todays(v).withColumn("kind", F.explode(F.array(*map(F.lit, _KINDS))))
    return (kinds.withColumn("p", P.current_period(F.col("kind"), F.col("today")))
            .select("series_id", "kind", "p.start", "p.end"))


@query("period_shift", with_(f"""
SELECT DISTINCT CAST(day AS VARCHAR) AS day, basis, CAST({_shift('day', 'basis')} AS VARCHAR) AS shifted
FROM series, (SELECT unnest(['DoD', 'WoW', 'MoM', 'QoQ', 'YoY']) AS basis)""", SERIES))
def _(v):
    days = v.series().select("day").distinct().withColumn(
        "basis", F.explode(F.array(*map(F.lit, ["DoD", "WoW", "MoM", "QoQ", "YoY"]))))
    return days.withColumn("shifted", P.shift_day(F.col("day"), F.col("basis")))


PAIRS = "pairs(kind, basis, is_default) AS (VALUES " + ", ".join(
    f"('{k}', '{b}', {1 if b == bs[-1] else 0})" for k, bs in vocab.PERIOD_BASES.items() for b in bs) + ")"
GRID = CURRENT + "," + PAIRS + f""",
grid AS (SELECT series_id, kind, basis, is_default, s AS cur_start, e AS cur_end,
 {_shift('s', 'basis')} AS cmp_start, {_shift('e', 'basis')} AS cmp_end FROM current_p JOIN pairs USING (kind)),
grid_means AS (SELECT series_id, kind, basis, is_default, avg(value) FILTER (day BETWEEN cur_start AND cur_end) AS cur_avg,
  avg(value) FILTER (day BETWEEN cmp_start AND cmp_end) AS cmp_avg FROM grid JOIN series USING (series_id) GROUP BY ALL)"""


@query("period_grid", with_(f"""
SELECT series_id, kind, basis, CAST(is_default AS BIGINT) AS is_default, {r4('cur_avg')} AS cur_avg, {r4('cmp_avg')} AS cmp_avg,
 {r4('(cur_avg - cmp_avg) / cmp_avg * 100')} AS pct FROM grid_means WHERE cur_avg IS NOT NULL AND cmp_avg <> 0""", SERIES, GRID))
def _(v):
    s = v.series()
    return (P.period_verdict(s, P.period_grid(_todays(v)))
            .select("series_id", "kind", "basis", "is_default", c4("cur_avg"), c4("cmp_avg"), c4("pct")))


@query("period_default", with_("""
SELECT DISTINCT CAST(day AS VARCHAR) AS today, CAST(date_trunc('year', day)::DATE AS VARCHAR) AS cur_start, CAST(day AS VARCHAR) AS cur_end,
 CAST((date_trunc('year', day) - INTERVAL 1 YEAR)::DATE AS VARCHAR) AS cmp_start,
 CAST((day - INTERVAL 1 YEAR)::DATE AS VARCHAR) AS cmp_end FROM series""", SERIES))
def _(v):
    return (v.series().select(F.col("day").alias("today")).distinct()
            .select("today", P.default_period(F.col("today")).alias("p")).select("today", "p.*"))


def means(src, cur=CUR, cmp=CMP, key="series_id"):
    return (f"SELECT {key}, avg(value) FILTER (day BETWEEN DATE '{cur[0]}' AND DATE '{cur[1]}') AS c1, "
            f"avg(value) FILTER (day BETWEEN DATE '{cmp[0]}' AND DATE '{cmp[1]}') AS c0 FROM {src} GROUP BY 1")


VERDICT = f"""
own_means AS ({means('series')}),
own AS (SELECT series_id, c1, c0, (c1 - c0) / c0 * 100 AS pct,
 CASE WHEN c1 < c0 THEN '-' WHEN c1 > c0 THEN '+' ELSE 'neutral' END AS direction FROM own_means WHERE c1 IS NOT NULL AND c0 <> 0)"""
COMP = """
comp AS (SELECT series_id, c1, c0, (c1 - c0) / c0 * 100 AS pct, CASE WHEN c1 < c0 THEN '-' WHEN c1 > c0 THEN '+' ELSE 'neutral' END AS direction
 FROM (SELECT r.subject_id AS series_id, sum(c1) AS c1, sum(c0) AS c0 FROM rivals r JOIN own_means m USING (series_id) GROUP BY 1)
 WHERE c1 IS NOT NULL AND c0 <> 0)"""


def periods(v, cur=CUR, cmp=CMP):
    return P.fixed_periods(v.series_ids(), cur, cmp)


@query("period_verdict", with_(f"SELECT series_id, {r4('c1')} AS cur_avg, {r4('c0')} AS cmp_avg, {r4('pct')} AS pct, direction FROM own", SERIES, VERDICT))
def _(v):
    return P.period_verdict(v.series(CUR, CMP), periods(v)).select(
        "series_id", c4("cur_avg"), c4("cmp_avg"), c4("pct"), "direction")


@query("competitor_verdict", with_(f"SELECT series_id, {r4('c1')} AS cur_avg, {r4('c0')} AS cmp_avg, {r4('pct')} AS pct, direction FROM comp",
                                   SERIES, RIVALS, VERDICT, COMP))
def _(v):
    return P.competitor_verdict(v.series(CUR, CMP), v.rivals(), periods(v)).select(
        "series_id", c4("cur_avg"), c4("cmp_avg"), c4("pct"), "direction")


@query("market_vs_own", with_("""
SELECT o.series_id, o.direction, m.direction AS market_direction, CASE WHEN m.direction IS NULL THEN 'no_market_data'
 WHEN m.direction = 'neutral' THEN 'own_move' WHEN m.direction = o.direction THEN 'market_wide' ELSE 'own_move' END AS reading
FROM own o LEFT JOIN comp m USING (series_id) WHERE o.direction <> 'neutral'""", SERIES, RIVALS, VERDICT, COMP))
def _(v):
    own = P.period_verdict(v.series(CUR, CMP), periods(v))
    return P.market_vs_own(own, P.competitor_verdict(v.series(CUR, CMP), v.rivals(), periods(v))).select(
        "series_id", "direction", "market_direction", "reading")


@query("period_overlay", with_(f"""
SELECT series_id, ordinal, max(value) FILTER (part = 'cur') AS cur_value, max(value) FILTER (part = 'cmp') AS cmp_value,
 coalesce(max(market) FILTER (part = 'cur'), 0) AS market, max(measured) FILTER (part = 'cur') AS cur_measured,
 max(measured) FILTER (part = 'cmp') AS cmp_measured
FROM (SELECT s.series_id, part, row_number() OVER (PARTITION BY s.series_id, part ORDER BY s.day) AS ordinal, s.value,
  z.value - z.own AS market, m.value AS measured
 FROM series s JOIN (SELECT 'cur' AS part, DATE '{CUR[0]}' AS a, DATE '{CUR[1]}' AS b UNION ALL SELECT 'cmp', DATE '{CMP[0]}', DATE '{CMP[1]}') p
  ON s.day BETWEEN a AND b
 LEFT JOIN market_zero z ON z.subject_id = s.series_id AND z.day = s.day
 LEFT JOIN measured m ON m.series_id = s.series_id AND m.day = s.day) GROUP BY ALL""", SERIES, RIVALS, ZERO, MEASURED))
def _(v):
    return P.period_overlay(v.series(CUR, CMP), v.rivals(), periods(v), _measured(v, CUR, CMP))
