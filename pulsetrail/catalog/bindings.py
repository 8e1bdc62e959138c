"""Logical inputs derived from the given tables, once in Spark and once in SQL.

``Views`` builds each input lazily as a DataFrame; the string constants hold
the same derivation as common table expressions for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsetrail import vocab
from pulsetrail.session import shared_dir

SUBJECT = "BUILDING"
ALL = "ALL"
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# periods used by the registered queries (inclusive)
CUR = ("1999-07-01", "1999-09-30")
CMP = ("1998-07-01", "1998-09-30")
AS_OF = "2001-03-15"


class Views:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._tables[name]

    # ---- L -----------------------------------------------------------------
    def ledger(self) -> DataFrame:
        if "ledger()" not in self._tables:
            self._tables["ledger()"] = self._ledger()
        return self._tables["ledger()"]

    def _ledger(self, *more) -> DataFrame:
        k = F.col("arrival")
        o = self.table("orders").select(
            F.col("o_orderkey").alias("arrival"), "o_custkey", "o_orderstatus",
            F.to_date("o_orderdate").alias("date"), "o_orderpriority")
        c = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        n = self.table("nation")
        r = self.table("region")
        seg = F.col("c_mktsegment")

        def pick(expr, values):
            out = F.when(expr == 0, F.lit(values[0]))
            for i, v in enumerate(values[1:], 1):
                out = out.when(expr == i, F.lit(v))
            return out

        text_day = F.date_format("date", "yyyy-MM-dd")
        url_day = F.date_add("date", (k % 5).cast("int"))
        return (
            o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                k,
                F.concat(F.when(k % 10 == 0, "E").when(k % 10 < 7, "A").otherwise("FP"),
                         k.cast("string")).alias("event_id"),
                "date",
                pick(k % 4, ["url", "llm", "capture", "seed"]).alias("date_source"),
                F.date_add("date", (k % 10).cast("int")).alias("captured_date"),
                F.array(F.when(k % 5 == 0, F.lit(ALL)).when(k % 7 == 0, F.col("r_name"))
                        .otherwise(F.col("n_name"))).alias("scope"),
                F.when(seg == "AUTOMOBILE", F.array(F.lit("MX")))
                .when(seg == "BUILDING", F.array(*map(F.lit, vocab.DIVISIONS)))
                .when(seg == "FURNITURE", F.array(F.lit("VD")))
                .when(seg == "HOUSEHOLD", F.array(F.lit("VD"), F.lit("DA")))
                .otherwise(F.array().cast("array<string>")).alias("divisions"),
                pick(k % 10, list(vocab.CATEGORIES)).alias("category"),
                F.concat(F.lit("Story "), (k % 211).cast("string"), F.lit(" "),
                         F.lower(seg)).alias("title"),
                F.when(k % 9 != 0, F.concat(F.lit("Raw "), (k % 307).cast("string")))
                .alias("raw_title"),
                F.lower("o_orderpriority").alias("impact"),
                F.concat(F.lit("[source: desk "), (k % 7).cast("string"), F.lit("] "),
                         F.lower(seg), F.lit(" moved. 원문: report "),
                         (k % 13).cast("string"), F.lit(" [filter:kw]"))
                .alias("description"),
                F.when(F.col("o_orderstatus") == "F", "-")
                .when(F.col("o_orderstatus") == "O", "+")
                .otherwise("neutral").alias("impact_direction"),
                pick(k % 3, list(vocab.HORIZONS)).alias("impact_horizon"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("impact_strength"),
                pick(F.floor(k / 3) % 3, list(vocab.CONFIDENCES)).alias("confidence"),
                pick(F.floor(k / 9) % 4, [*vocab.AXES, ""]).alias("axis"),
                pick(k % 3, list(vocab.METRICS)).alias("metric"),
                F.when(k % 8 != 0, F.concat(F.lit("src"), (k % 8).cast("string")))
                .alias("source"),
                F.when(k % 2 == 0, text_day).alias("raw_date"),
                F.when(k % 11 == 0, "2024-05-00")
                .when(k % 11 == 1, F.date_format(F.date_add("date", 400), "yyyy-MM-dd"))
                .when(k % 11 == 2, F.date_format(F.date_sub("date", 400), "yyyy-MM-dd"))
                .otherwise(text_day).alias("llm_date"),
                F.when(k % 3 == 0, F.concat(F.lit("https://www.x.example/"),
                                            F.date_format(url_day, "yyyy/M/d"),
                                            F.lit("/"), k.cast("string")))
                .when(k % 3 == 1, F.concat(F.lit("https://www.x.example/a-"),
                                           F.date_format(url_day, "yyyyMMdd"),
                                           F.lit("-"), k.cast("string"), F.lit(".html")))
                .otherwise(F.concat(F.lit("https://www.x.example/"),
                                    F.date_format(url_day, "yyyy/M"),
                                    F.lit("/"), k.cast("string"))).alias("raw_url"),
                F.when(k % 6 == 0, "ww")
                .when(k % 6 == 1, F.concat(F.lit(" n"), F.col("n_nationkey").cast("string"),
                                           F.lit(". ;??")))
                .when(k % 6 == 2, F.concat(F.lower("n_name"), F.lit(";"), F.col("n_name")))
                .when(k % 6 == 3, F.lower("r_name"))
                .when(k % 6 == 4, F.concat("n_name", F.lit(";"), "r_name"))
                .otherwise("").alias("raw_scope"),
                *more,
            ))

    def places(self):
        """Place dictionary: nations with an ``N<key>`` alias, regions of five."""
        from pulsetrail.operators.scope import Places
        n, r = self.table("nation"), self.table("region")
        countries = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"),
                             F.array(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))
                             .alias("aliases"))
        regions = (n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
                   .groupBy(F.col("r_name").alias("region"), F.col("r_regionkey").alias("ord"))
                   .agg(F.array_sort(F.collect_list("n_name")).alias("members")))
        return Places.from_frames(countries, regions, all_words=("WW", "WORLDWIDE"), all_name=ALL)

    # ---- T -----------------------------------------------------------------
    def sales(self, *periods: tuple[str, str]) -> DataFrame:
        """Unaggregated series points: (series_id, day, cents, arrival, nation).

        With ``periods`` (first and last day of each) only their points: the
        bounds are literals on the stored column, so they reach the scan.
        """
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate",
                                           "l_extendedprice")
        if periods:
            kind, inside = li.schema["l_shipdate"].dataType, F.lit(False)
            for first, last in periods:
                start, stop = F.lit(first).cast(kind), F.date_add(F.lit(last).cast("date"), 1).cast(kind)
                inside |= (F.col("l_shipdate") >= start) & (F.col("l_shipdate") < stop)
            li = li.filter(inside)
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(c, F.col("o_custkey") == F.col("c_custkey"))
                .select(F.col("c_mktsegment").alias("series_id"),
                        F.to_date("l_shipdate").alias("day"),
                        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
                        F.col("l_orderkey").alias("order_id"),
                        F.col("l_linenumber").alias("line"),
                        F.col("c_nationkey").alias("nation_id"), F.col("o_custkey").alias("customer_id")))

    def buyers(self, *periods: tuple[str, str]) -> DataFrame:
        """Daily series of every customer: at this grain days without points are the rule."""
        return (self.sales(*periods).groupBy(F.concat(F.lit("C"), F.col("customer_id").cast("string")).alias("series_id"), "day")
                .agg(F.sum("cents").cast("double").alias("value"), F.count("*").cast("double").alias("units")))

    def buyer_ids(self) -> DataFrame:
        return self.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("series_id"))

    def buyer_ledger(self) -> DataFrame:
        """Ledger with each event tied to the series of its customer."""
        return self._ledger(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("series_id"))

    def series(self, *periods: tuple[str, str]) -> DataFrame:
        return (self.sales(*periods).groupBy("series_id", "day")
                .agg(F.sum("cents").cast("double").alias("value")))

    def stored_series(self) -> DataFrame:
        """The daily series kept in the shared folder: they are small next to
        the rows they sum, and a report reads them many times."""
        if "series()" not in self._tables:
            shared_dir(self.spark)
            self._tables["series()"] = self.series().checkpoint()
        return self._tables["series()"]

    def series_divisions(self) -> DataFrame:
        """(series_id, division): which competitors belong to which division."""
        seg = self.table("customer").select(F.col("c_mktsegment").alias("series_id")).distinct()
        return seg.select("series_id", F.explode(
            F.when(F.col("series_id") == "AUTOMOBILE", F.array(F.lit("MX")))
            .when(F.col("series_id") == "FURNITURE", F.array(F.lit("VD")))
            .when(F.col("series_id") == "HOUSEHOLD", F.array(F.lit("VD"), F.lit("DA")))
            .when(F.col("series_id") == "MACHINERY", F.array(F.lit("DA")))
            .otherwise(F.array(F.lit("OWN")))).alias("division"))

    def rivals(self, subject: str | None = None) -> DataFrame:
        """(subject_id, series_id): every segment competes with the others."""
        seg = self.table("customer").select(F.col("c_mktsegment").alias("subject_id")).distinct()
        out = (seg.withColumn("series_id", F.explode(F.array(*map(F.lit, SEGMENTS))))
               .filter(F.col("series_id") != F.col("subject_id")))
        return out.filter(F.col("subject_id") == subject) if subject else out

    def series_ids(self) -> DataFrame:
        return self.table("customer").select(F.col("c_mktsegment").alias("series_id")).distinct()

    def scored_ledger(self) -> DataFrame:
        """Ledger with each event tied to the series of its own segment."""
        if "scored()" not in self._tables:
            self._tables["scored()"] = self._ledger(F.col("c_mktsegment").alias("series_id"))
        return self._tables["scored()"]

    def vitals(self) -> DataFrame:
        """Weekly (metric, period_end, p75)."""
        week = F.date_add(F.trunc("l_shipdate", "week"), 6)
        return (self.table("lineitem")
                .groupBy(week.alias("period_end"))
                .agg((F.percentile("l_quantity", F.lit(0.75)) * 100).alias("p75"))
                .select(F.lit("lcp_ms").alias("metric"), "period_end", "p75"))

    # ---- V -----------------------------------------------------------------
    def activity(self) -> DataFrame:
        """Event stream rows with the funnel flags they stand for."""
        u = F.col("user_id") % 10
        dup, near = u == 0, u == 1
        kw = ~dup & ~near & (F.col("value") >= 5)
        return self.table("events").select(
            "event_id", "ts", "user_id", F.col("event_type").alias("label"), "value",
            "props", F.to_date("ts").alias("day"), dup.alias("dup"),
            near.alias("dup_near"), kw.alias("kw_pass"),
            (kw & (F.col("value") >= 20)).alias("kept"))

    # ---- D -----------------------------------------------------------------
    def stories(self) -> DataFrame:
        k = F.col("doc_id")
        return self.table("documents").select(
            k.alias("arrival"), F.col("source").alias("label"), "lang", "text",
            F.substring_index("text", "\n", 1).alias("title"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("date"),
            F.when(k % 5 == 0, F.concat(F.lit("https://www.n.example/a/"),
                                        (k % 450).cast("string"), F.lit("?u="),
                                        k.cast("string"))).alias("url"))

    def story_ledger(self) -> DataFrame:
        """Stories as ledger rows for the duplicate rules."""
        k = F.col("arrival")
        second = F.substring_index(F.substring_index("text", "\n", 2), "\n", -1)
        return self.stories().select(
            k, F.concat(F.when(k % 10 == 0, "E").otherwise("A"), k.cast("string"))
            .alias("event_id"), "label", F.col("title").alias("raw_title"),
            F.concat(F.lit("["), "label", F.lit("] "), second).alias("title"),
            F.col("url").alias("raw_url"), "date",
            F.date_add("date", (k % 4).cast("int")).alias("captured_date"),
            F.when(k % 3 == 0, F.date_sub("date", 2)).alias("raw_date"))

    # ---- P -----------------------------------------------------------------
    def links(self) -> DataFrame:
        host = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1),
                                r"^www\.", "")
        return self.table("pages").select(F.col("page_id").alias("arrival"), "url",
                                          host.alias("label"), "html")

    # ---- R -----------------------------------------------------------------
    def verdicts(self) -> DataFrame:
        """One verdict per (item, provider)."""
        return (self.table("lineitem").groupBy(F.col("l_orderkey").alias("item_id"),
                           F.col("l_linenumber").cast("long").alias("provider"))
                .agg(F.min("l_linestatus").alias("st"), F.min("l_returnflag").alias("direction"),
                     F.min("l_quantity").alias("q"))
                .select("item_id", "provider", (F.col("st") == "O").alias("relevant"),
                        "direction", (F.col("q") % 5 + 1).cast("long").alias("strength"),
                        F.when(F.col("q") % 4 < 3, F.element_at(
                            F.array(*map(F.lit, vocab.AXES)), (F.col("q") % 4 + 1).cast("int")))
                        .otherwise("").alias("axis")))


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_pick(expr: str, values) -> str:
    return ("CASE " + " ".join(f"WHEN {expr} = {i} THEN '{v}'" for i, v in enumerate(values))
            + " END")


LEDGER = f"""
l0 AS (
 SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority,
        c_mktsegment AS seg, o_custkey, n_nationkey, n_name, r_name
 FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ledger AS (
 SELECT k AS arrival,
  (CASE WHEN k % 10 = 0 THEN 'E' WHEN k % 10 < 7 THEN 'A' ELSE 'FP' END) || k AS event_id,
  d AS date, {sql_pick('k % 4', ['url', 'llm', 'capture', 'seed'])} AS date_source,
  d + CAST(k % 10 AS INTEGER) AS captured_date,
  [CASE WHEN k % 5 = 0 THEN 'ALL' WHEN k % 7 = 0 THEN r_name ELSE n_name END] AS scope,
  CASE seg WHEN 'AUTOMOBILE' THEN ['MX'] WHEN 'BUILDING' THEN ['MX', 'VD', 'DA']
   WHEN 'FURNITURE' THEN ['VD'] WHEN 'HOUSEHOLD' THEN ['VD', 'DA'] ELSE [] END AS divisions,
  {sql_pick('k % 10', vocab.CATEGORIES)} AS category,
  'Story ' || (k % 211) || ' ' || lower(seg) AS title,
  CASE WHEN k % 9 <> 0 THEN 'Raw ' || (k % 307) END AS raw_title,
  lower(o_orderpriority) AS impact,
  '[source: desk ' || (k % 7) || '] ' || lower(seg) || ' moved. 원문: report ' || (k % 13)
   || ' [filter:kw]' AS description,
  CASE o_orderstatus WHEN 'F' THEN '-' WHEN 'O' THEN '+' ELSE 'neutral' END AS impact_direction,
  {sql_pick('k % 3', vocab.HORIZONS)} AS impact_horizon,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS impact_strength,
  {sql_pick('(k // 3) % 3', vocab.CONFIDENCES)} AS confidence,
  {sql_pick('(k // 9) % 4', [*vocab.AXES, ''])} AS axis,
  {sql_pick('k % 3', vocab.METRICS)} AS metric,
  CASE WHEN k % 8 <> 0 THEN 'src' || (k % 8) END AS source,
  CASE WHEN k % 2 = 0 THEN strftime(d, '%Y-%m-%d') END AS raw_date,
  CASE WHEN k % 11 = 0 THEN '2024-05-00'
       WHEN k % 11 = 1 THEN strftime(d + 400, '%Y-%m-%d')
       WHEN k % 11 = 2 THEN strftime(d - 400, '%Y-%m-%d')
       ELSE strftime(d, '%Y-%m-%d') END AS llm_date,
  CASE k % 3 WHEN 0 THEN 'https://www.x.example/' || strftime(d + CAST(k % 5 AS INTEGER), '%Y/%-m/%-d') || '/' || k
   WHEN 1 THEN 'https://www.x.example/a-' || strftime(d + CAST(k % 5 AS INTEGER), '%Y%m%d') || '-' || k || '.html'
   ELSE 'https://www.x.example/' || strftime(d + CAST(k % 5 AS INTEGER), '%Y/%-m') || '/' || k END AS raw_url,
  CASE k % 6 WHEN 0 THEN 'ww' WHEN 1 THEN ' n' || n_nationkey || '. ;??'
   WHEN 2 THEN lower(n_name) || ';' || n_name WHEN 3 THEN lower(r_name)
   WHEN 4 THEN n_name || ';' || r_name ELSE '' END AS raw_scope
 FROM l0)"""

SALES = """
sales AS (
 SELECT c_mktsegment AS series_id, CAST(l_shipdate AS DATE) AS day,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_orderkey AS order_id,
        l_linenumber AS line, c_nationkey AS nation_id, o_custkey AS customer_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SERIES = SALES + """,
series AS (
 SELECT series_id, day, CAST(sum(cents) AS DOUBLE) AS value FROM sales GROUP BY ALL)"""

BUYERS = SALES + """,
buyers AS (
 SELECT 'C' || customer_id AS series_id, day, CAST(sum(cents) AS DOUBLE) AS value, CAST(count(*) AS DOUBLE) AS units FROM sales GROUP BY ALL)"""

RIVALS = """
segs AS (SELECT DISTINCT c_mktsegment AS series_id FROM customer),
rivals AS (SELECT a.series_id AS subject_id, b.series_id FROM segs a JOIN segs b ON a.series_id <> b.series_id)"""

SERIES_DIVISION = """
series_division AS (
 SELECT DISTINCT c_mktsegment AS series_id, unnest(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['MX']
  WHEN 'FURNITURE' THEN ['VD'] WHEN 'HOUSEHOLD' THEN ['VD', 'DA']
  WHEN 'MACHINERY' THEN ['DA'] ELSE ['OWN'] END) AS division FROM customer)"""

VITALS = """
vitals AS (
 SELECT 'lcp_ms' AS metric, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS period_end,
        quantile_cont(l_quantity, 0.75) * 100 AS p75
 FROM lineitem GROUP BY ALL)"""

ACTIVITY = """
activity AS (
 SELECT event_id, ts, user_id, event_type AS label, value, props, CAST(ts AS DATE) AS day,
  user_id % 10 = 0 AS dup, user_id % 10 = 1 AS dup_near,
  user_id % 10 > 1 AND value >= 5 AS kw_pass, user_id % 10 > 1 AND value >= 20 AS kept
 FROM events)"""

DICT = """
dict AS (SELECT upper(n_name) AS alias, 1 AS kind, n_nationkey AS ord, n_name AS name FROM nation
 UNION ALL SELECT 'N' || n_nationkey, 1, n_nationkey, n_name FROM nation
 UNION ALL SELECT upper(r_name), 2, r_regionkey, r_name FROM region
 UNION ALL SELECT unnest(['WW', 'WORLDWIDE', 'ALL']), 0, 0, 'ALL')"""


def normalised_sql(src: str, key: str, col: str, out: str) -> str:
    """CTE ``out``(key, scope) with the canonical ``;``-joined names of ``src.col``."""
    return f"""
{out}_t AS (SELECT {key}, upper(trim(trim(unnest(string_split(coalesce({col}, ''), ';'))), '.,\''"[]')) AS tok FROM {src}),
{out}_d AS (SELECT DISTINCT {key}, kind, ord, name FROM {out}_t LEFT JOIN dict ON alias = tok),
{out} AS (SELECT {key}, CASE WHEN min(kind) IS NULL OR min(kind) = 0 THEN 'ALL'
  ELSE string_agg(name, ';' ORDER BY kind, ord) FILTER (kind IS NOT NULL) END AS scope FROM {out}_d GROUP BY 1)""".replace("\\''", "''")


STORIES = """
stories AS (
 SELECT doc_id AS arrival, source AS label, lang, text,
  split_part(text, chr(10), 1) AS title,
  DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date,
  CASE WHEN doc_id % 5 = 0 THEN 'https://www.n.example/a/' || (doc_id % 450) || '?u=' || doc_id END AS url
 FROM documents)"""

STORY_LEDGER = STORIES + """,
story_ledger AS (
 SELECT arrival, (CASE WHEN arrival % 10 = 0 THEN 'E' ELSE 'A' END) || arrival AS event_id,
  label, title AS raw_title,
  '[' || label || '] ' || CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 2)
   ELSE text END AS title,
  url AS raw_url, date, date + CAST(arrival % 4 AS INTEGER) AS captured_date,
  CASE WHEN arrival % 3 = 0 THEN date - 2 END AS raw_date
 FROM stories)"""

LINKS = r"""
links AS (
 SELECT page_id AS arrival, url,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\.', '') AS label, html
 FROM pages)"""

VERDICTS = f"""
verdicts AS (
 SELECT item_id, provider, st = 'O' AS relevant, direction,
  CAST(q % 5 + 1 AS BIGINT) AS strength,
  {sql_pick('q % 4', [*vocab.AXES, ''])} AS axis
 FROM (SELECT l_orderkey AS item_id, CAST(l_linenumber AS BIGINT) AS provider,
  min(l_linestatus) AS st, min(l_returnflag) AS direction, min(l_quantity) AS q
  FROM lineitem GROUP BY ALL))"""


SCORED = LEDGER + """,
scored_ledger AS (SELECT l.*, l0.seg AS series_id FROM ledger l JOIN l0 ON l0.k = l.arrival)"""


BUYER_LEDGER = LEDGER + """,
buyer_ledger AS (SELECT l.*, 'C' || l0.o_custkey AS series_id FROM ledger l JOIN l0 ON l0.k = l.arrival)"""


def with_(body: str, *ctes: str) -> str:
    """Assemble prelude fragments and a body into one statement."""
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + body
