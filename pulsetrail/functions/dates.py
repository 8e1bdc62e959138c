"""Date parsing, validation and provenance expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsetrail import vocab
from pulsetrail.functions.text import strip


def parse_strict(c: Column) -> Column:
    """Calendar-valid ``Y-M-D`` text to DATE, otherwise null."""
    shaped = F.regexp_extract(strip(c), r"^\d{4}-\d{1,2}-\d{1,2}$", 0)
    return F.try_to_date(shaped, "yyyy-M-d")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def validate(value: Column, published: Column, today: Column,
             max_backdate: int = vocab.MAX_BACKDATE_DAYS) -> Column:
    """STRUCT(date, date_source) for a judged date.

    The judged date survives when it is real, not after the reference day and
    not more than ``max_backdate`` days before it.  The reference day is the
    publication date when there is one, else ``today``.
    """
    day, pub = parse_strict(value), parse_strict(published)
    ref = F.coalesce(pub, today)
    good = day.isNotNull() & (day <= ref) & (F.datediff(ref, day) <= max_backdate)
    return F.struct(
        F.when(good, day).otherwise(ref).alias("date"),
        F.when(good, F.lit("llm")).when(pub.isNotNull(), F.lit("url"))
        .otherwise(F.lit("capture")).alias("date_source"))


def from_url(url: Column) -> Column:
    """Publication date embedded in an address; first pattern that is valid."""
    return F.coalesce(*[F.try_to_date(F.regexp_extract(url, pattern, 1), fmt)
                        for pattern, fmt in vocab.URL_DATE_PATTERNS])


def infer_source(day: Column, published: Column, captured: Column,
                 url_day: Column) -> Column:
    """Where a stored date must have come from (DATE inputs)."""
    return (F.when(day.isNull(), "capture")
            .when(url_day == day, "url")
            .when(published.isNotNull(), F.when(published == day, "url").otherwise("llm"))
            .when(captured == day, "capture")
            .otherwise("llm"))


def repair_outcome(day: Column, captured: Column, url_day: Column, is_collected: Column,
                   threshold: int = vocab.MAX_BACKDATE_DAYS,
                   plausible: int = vocab.URL_PLAUSIBLE_DAYS) -> Column:
    """Counter name of what repairing one stored row does.

    A date in the address shortly before capture wins; otherwise a missing,
    far too old or future date becomes the capture day.
    """
    url_ok = F.coalesce(F.datediff(captured, url_day).between(0, plausible), F.lit(False))
    bad = day.isNull() | (F.datediff(captured, day) > threshold) | (day > captured)
    return (F.when(~is_collected, "seed_skipped")
            .when(captured.isNull(), "unfixable")
            .when(url_ok, F.when(url_day.eqNullSafe(day), "ok").otherwise("from_url"))
            .when(bad, "from_capture").otherwise("ok"))


def feed_stamp(c: Column) -> Column:
    """``YYYY-MM-DD`` text from an ISO or RFC-822 stamp, else ''."""
    iso_part = F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1)
    rfc = r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    months = F.lit("jan feb mar apr may jun jul aug sep oct nov dec")
    name = F.lower(F.regexp_extract(c, rfc, 2))
    at = F.when(name != "", F.instr(months, name)).otherwise(0)
    text = F.concat_ws("-", F.regexp_extract(c, rfc, 3),
                       F.lpad(((at + 3) / 4).cast("int").cast("string"), 2, "0"),
                       F.lpad(F.regexp_extract(c, rfc, 1), 2, "0"))
    return F.coalesce(F.when(iso_part != "", iso_part)
                      .when(at > 0, text), F.lit(""))


def compact(c: Column, today: Column) -> Column:
    """Eight digits to ``YYYY-MM-DD`` text, anything else to ``today``."""
    return (F.when(c.rlike(r"^\d{8}$"),
                   F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2),
                               F.substring(c, 7, 2)))
            .otherwise(iso(today)))


def shift_months(day: Column, months) -> Column:
    """Calendar month shift that overflows: 31 March less a month is 3 March."""
    first = F.add_months(F.trunc(day, "MM"), months)
    return F.date_add(first, F.dayofmonth(day) - 1)
