"""Numeric and event-weight expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsetrail import vocab
from pulsetrail.functions.text import contains_any, one_of, strip


def half_up(c: Column, digits: int) -> Column:
    """Rounding with a single definition on every engine (ties go up)."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def ratio(num: Column, den: Column) -> Column:
    """num/den, null when den is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def strength(c: Column) -> Column:
    """Impact strength clamped to 1..5; missing, zero or unreadable is 2."""
    n = c.try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.nullif(n, F.lit(0)), F.lit(2))))


def horizon(c: Column) -> Column:
    h = F.lower(strip(c))
    return F.when(h.isin(*vocab.HORIZONS), h).otherwise(vocab.DEFAULT_HORIZON)


def clean_axis(c: Column) -> Column:
    a = F.lower(strip(c))
    return F.when(a.isin(*vocab.AXES), a).otherwise(F.lit(""))


def confidence_weight(c: Column, default: float = 0.33) -> Column:
    return one_of(F.lower(c), vocab.CONFIDENCE_WEIGHT, default)


def direction_sign(c: Column) -> Column:
    """+1, -1, or null for a row that predicts nothing."""
    return one_of(c, vocab.DIRECTION_SIGN)


def event_weight(strength_c: Column, confidence_c: Column, direction_c: Column) -> Column:
    """Signed magnitude an event contributes on its own day."""
    return (strength(strength_c) * confidence_weight(confidence_c)
            * F.coalesce(direction_sign(direction_c), F.lit(0.0)))


def classify_axis(axis: Column, text: Column, category: Column, own_words,
                  rival_words, supply_words=vocab.SUPPLY_WORDS) -> Column:
    """Stored axis, else a keyword and category rule over lower-case text."""
    rival, own = contains_any(text, rival_words), contains_any(text, own_words)
    return (F.when(axis.isin(*vocab.AXES), axis)
            .when(contains_any(text, supply_words), "supply")
            .when(category.isin("platform", "AI", "marketing"),
                  F.when(rival, "share").otherwise("demand"))
            .when(category == "company", F.when(own, "demand").otherwise("share"))
            .otherwise("demand"))


def pearson(x: str, y: str) -> Column:
    """Pearson r over the rows of a group where both columns are present.

    Null below three rows or at zero variance.  Built on the population
    moments, which keep a partial aggregate per map task.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.var_pop(a) * F.var_pop(b)
    return F.when((F.count(a) >= 3) & (spread > 0),
                  F.covar_pop(a, b) / F.sqrt(spread))


def direction_of(pct: Column) -> Column:
    return F.when(pct < 0, "-").when(pct > 0, "+").when(pct == 0, "neutral")
