"""Fixed values of the domain (enumerations, weights, windows, text patterns)."""

# --- fixed values: these must stay as they are for results to agree ---------
CATEGORIES = ("culture", "marketing", "platform", "holiday", "economy",
              "social_issue", "geopolitics", "AI", "company", "regulation")
CATEGORY_FIXES = {"competitor": "company", "ai": "AI", "ecommerce": "economy",
                  "tech": "company", "environment": "geopolitics",
                  "politics": "geopolitics"}
DIVISIONS = ("MX", "VD", "DA")
KPIS = ("Impression", "Click", "Traffic", "Order", "CVR", "Revenue", "AOV")
DIRECTIONS = ("+", "-", "neutral", "unknown")
HORIZONS = ("immediate", "weeks", "months")
CONFIDENCES = ("high", "med", "low")
METRICS = ("traffic", "revenue", "both")
AXES = ("demand", "share", "supply")

HALF_LIFE_DAYS = {"immediate": 3, "weeks": 14, "months": 60}
WINDOW_DAYS = {"immediate": 7, "weeks": 28, "months": 90}
DEFAULT_HORIZON = "weeks"
CONFIDENCE_WEIGHT = {"high": 1.0, "med": 0.66, "low": 0.33}
RANK_WEIGHT = {"high": 3, "med": 2, "low": 1}
DIRECTION_SIGN = {"+": 1.0, "-": -1.0}
DECAY_HALF_LIVES = 4
BASELINE_DAYS = 14
MIN_COVERAGE = 0.95
FORWARD_DAYS = 7
MONTH_MINIMUM = 20
CURATED_TITLE_CHARS = 40

DEDUP_WINDOW_DAYS = 7
RAW_TITLE_THRESHOLD = 0.50
JUDGED_TITLE_THRESHOLD = 0.70
MIN_TITLE_CHARS = 8
MAX_BACKDATE_DAYS = 180
URL_PLAUSIBLE_DAYS = 120

SCOPE_ALL = "전체"

# dashboard group of each category; anything absent falls to OTHER_GROUP
CATEGORY_GROUPS = {"competitor": "경쟁", "company": "경쟁", "economy": "경제",
                   "geopolitics": "지정학", "social_issue": "사회",
                   "marketing": "마케팅", "platform": "AI·플랫폼",
                   "ai": "AI·플랫폼", "regulation": "규제", "culture": "문화",
                   "other": "기타"}
OTHER_GROUP = "기타"

PERIOD_BASES = {"day": ("DoD", "WoW", "YoY"), "week": ("WoW", "YoY"),
                "month": ("MoM", "YoY"), "quarter": ("QoQ", "YoY"),
                "year": ("YoY",), "mtd": ("MoM", "YoY"),
                "qtd": ("QoQ", "YoY"), "ytd": ("YoY",)}

# country codes of uploaded traffic files that map to another code
TRAFFIC_COUNTRY_ALIASES = {"UK": "GB", "MX": "MX_C", "GBR": "GB", "USA": "US",
                           "KOR": "KR"}

# tags and legacy prefixes removed from stored body text, applied in order
BODY_TAG_PATTERNS = (r"\s*\[출처:[^\]]*\]", r"\s*\[filter:[^\]]*\]",
                     r"\s*\[source:[^\]]*\]",
                     r"1차 출처 업데이트[^—]*—\s*", r"원문:\s*")

# words that make an event a supply-side one when its axis was never judged
SUPPLY_WORDS = ("인덱싱", "크롤링", "indexing", "crawling", "다운타임", "downtime",
                "장애", "outage", "core web vitals", "사이트 속도", "robots.txt",
                "sitemap")

# publication dates embedded in article addresses and how to read them, most
# specific first; a month alone means its first day
URL_DATE_PATTERNS = ((r"/(20\d{2}/\d{1,2}/\d{1,2})(?:/|[-_.])", "yyyy/M/d"),
                     (r"[-_](20\d{2}\d{2}\d{2})[-_.]", "yyyyMMdd"),
                     (r"/(20\d{2}/\d{1,2})/", "yyyy/M"))

TRAFFIC_HEADER_WORDS = ("date", "날짜", "country", "국가", "traffic")
DROP_MARKER = "---DROP---"
EXPORT_COLUMNS = ("date", "scope", "divisions", "kpi", "title", "impact",
                  "description", "impact_direction", "confidence", "llm",
                  "source", "raw_title", "raw_desc", "raw_url")
CHANGE_THRESHOLD_PCT = 8
CHANGE_MERGE_DAYS = 10
LINK_DAYS = 7
# --- end of fixed values ----------------------------------------------------
