"""Operator 2: quality rules with thresholds that adapt to each language and source.

Measures are counted on whole texts in numpy. Each language and source gets quantiles of every
measure from a mergeable sketch (``percentile_approx``: partial sketches per task, merged), and a
document is rejected if a measure lies far outside its group: beyond the median by ``spread`` times
the distance from the median to the outer quantile, and by at least ``margin``. A group that is
clean throughout thus loses nothing, and one noisy source doesn't set the bar for another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail.llm.common import coded, column, keyed, public_id, row_of, slices, stored, text_buffer, word_bounds

#: fixed values: characters that count as symbols
SYMBOLS = b"#*$%&|<>"
#: words a text needs, and how many percent of them may lie in repeated five-word windows
LEAST_WORDS, MOST_REPEATED = 10, 20
GRAM = 5


@dataclass(frozen=True)
class Rule:
    """A measure, on which sides it can be too far out, and what is never too far."""
    measure: str
    high: bool
    margin: float
    spread: float = 4.0
    low: bool = False


RULES = (
    Rule("symbol_ratio", True, 0.05),     # symbols per character of words
    Rule("dup_line_ratio", True, 0.30),   # repeated lines per line with a word
    Rule("repeat_ratio", True, 0.20),     # words in repeated windows per word
    Rule("word_length", True, 3.0, low=True),
)


def counts_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: words, code points in words, symbols, lines with a word, repeated lines, words in repeated windows."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    row = row_of(first)
    out = {"n_words": np.diff(first)}
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    out["word_chars"] = np.bincount(row, lead[ends] - lead[starts], n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=marks[1:])
    out["n_symbols"] = marks[offsets[1:]] - marks[offsets[:-1]]

    # lines: cut at every newline and at row ends
    newline = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    line_row = np.searchsorted(offsets[1:], begin, side="right") if len(begin) else begin
    # lines without a word don't count, so rows without text and ends of rows need no line of their own
    keep = (line_row < n)
    begin, line_row = begin[keep], line_row[keep]
    stop = np.append(newline, len(data))[np.searchsorted(newline, begin)]
    stop = np.minimum(stop, offsets[line_row + 1])
    full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_row = begin[full], stop[full], line_row[full]
    _, again = repeats(line_row, coded(data, begin, stop)[0])
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)

    # windows of five words, by exact numbers
    word, _ = coded(data, starts, ends)
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) >= GRAM:
        w = word
        for k in range(1, GRAM):
            w = np.unique(w[:-1] * (int(word.max()) + 1) + word[k:], return_inverse=True)[1]
        at = np.flatnonzero(row[:len(w)] == row[GRAM - 1:])
        twice, _ = repeats(row[at], w[at])
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + GRAM, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(row[inside], minlength=n)
    return out


def repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers within rows: which occur twice or more, and which have occurred before."""
    order = np.lexsort((h, row))  # stable: equals stay in order of position
    r, s = row[order], h[order]
    same = np.zeros(len(s), bool)
    same[1:] = (r[1:] == r[:-1]) & (s[1:] == s[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    a, b = np.zeros(len(s), bool), np.zeros(len(s), bool)
    a[order], b[order] = twice, same
    return a, b


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """Each document's counts; ``docs`` has ``doc_id``, ``text``, ``lang``, ``source``."""
    carried = ["doc_id", "lang", "source", *carry]
    schema = docs.select(*carried).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                got = counts_of(*text_buffer(column(b, "text")))
                yield pa.RecordBatch.from_arrays([*(column(b, c) for c in carried), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)],
                                                 names=[*carried, *COUNTS])

    return docs.select(*carried, *(["text"] if "text" not in carried else [])).mapInArrow(run, schema)


def measure(name: str) -> Column:
    part, whole = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
                   "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}[name]
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def thresholds(counts: DataFrame, rules: tuple[Rule, ...] = RULES, outer: float = 0.75, accuracy: int = 1000) -> DataFrame:
    """Per ``lang`` and ``source`` (nulls are groups too): ``low_`` and ``high_`` of every measure, from sketches of the documents that pass the base rules."""
    sketches = [F.percentile_approx(measure(r.measure), [1 - outer, 0.5, outer], accuracy).alias(r.measure) for r in rules]
    q = counts.where("not base_failed").groupBy("lang", "source").agg(*sketches)
    cols = []
    for r in rules:
        low, mid, high = (F.col(r.measure)[i] for i in range(3))
        far = F.lit(float("inf"))
        cols += [(mid - F.greatest(r.spread * (mid - low), F.lit(r.margin)) if r.low else -far).alias(f"low_{r.measure}"),
                 (mid + F.greatest(r.spread * (high - mid), F.lit(r.margin)) if r.high else far).alias(f"high_{r.measure}")]
    return q.select(F.col("lang").alias("group_lang"), F.col("source").alias("group_source"), *cols)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, carried columns, the counts, ``base_failed`` and ``kept`` for every document.

    A null or empty text has no words and fails the base rules. Documents whose language or source is
    null form groups of their own. A group in which nothing passes the base rules keeps nothing. Ties
    at a threshold are kept. ``docs`` has ``doc_id, text, lang, source``.
    """
    docs = keyed(docs, "lang", "source", *[c for c in carry if c not in ("text", "lang", "source")])
    # stored: the thresholds and the verdicts both read them, and texts are measured once
    counts = stored(measured(docs, *[c for c in carry if c not in ("lang", "source")]), "quality-counts")
    counts = counts.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    limits = thresholds(counts, rules)
    within = F.lit(True)
    for r in rules:
        within &= (measure(r.measure) >= F.col(f"low_{r.measure}")) & (measure(r.measure) <= F.col(f"high_{r.measure}"))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("group_lang")) & F.col("source").eqNullSafe(F.col("group_source")), "left")
    return joined.select(public_id(), *[c for c in carry if c != "doc_id"], "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))
