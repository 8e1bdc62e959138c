"""SQL for the operators that DuckDB can express whole."""

from __future__ import annotations

from pulsetrail.llm.phrases import INSIDE, LEAST, REPORTED
from pulsetrail.llm.quality import GRAM, LEAST_WORDS, MOST_REPEATED, RULES

WORDS = r"""
d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""


def substring_dedup(width: int = 50) -> str:
    return f"""WITH {WORDS},
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)),
late AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY h) USING (h) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS k FROM late),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def quality_rules() -> str:
    ratio = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
             "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    measures = ", ".join(f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0) AS {m}" for m, (a, b) in ratio.items())
    # the q-quantile is the value of rank ceil(q * n), as of a sketch that has lost nothing
    at = lambda m, q: f"list_sort(list({m}))[CAST(greatest(1, ceil({q} * count(*))) AS INTEGER)]"
    quantiles = ", ".join(f"{at(r.measure, q)} AS {r.measure}_{n}" for r in RULES for n, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75)))
    spread = lambda r, a, b: f"greatest({r.spread}::DOUBLE * ({r.measure}_{a} - {r.measure}_{b}), {r.margin}::DOUBLE)"
    tests = [f"m.{r.measure} <= {r.measure}_mid + {spread(r, 'high', 'mid')}" for r in RULES if r.high]
    tests += [f"m.{r.measure} >= {r.measure}_mid - {spread(r, 'mid', 'low')}" for r in RULES if r.low]
    return f"""WITH {WORDS},
line AS (SELECT doc_id, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS real FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM line WHERE real GROUP BY 1, 2) GROUP BY 1),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {GRAM - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)),
repeated AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {GRAM})) AS k FROM twice) GROUP BY 1),
c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
 CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
 FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {measures} FROM c),
q AS (SELECT lang, source, {quantiles} FROM m WHERE NOT base_failed GROUP BY 1, 2)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND coalesce({' AND '.join(tests)}, FALSE) AS kept
FROM m LEFT JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source"""


def collocations(least: int = LEAST, inside: int = INSIDE, reported: int = REPORTED) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    score = "1000000::HUGEINT * a * a // ({l}::HUGEINT * {r})".format
    return f"""WITH doc AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {lower} AS text FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM doc)),
gram AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM piece
 UNION ALL SELECT lang, 2, array_to_string(w[i:i + 1], ' ') FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM piece)
 UNION ALL SELECT lang, 3, array_to_string(w[i:i + 2], ' ') FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM piece)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM gram GROUP BY 1, 2, 3),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= {least}),
cut AS MATERIALIZED (SELECT lang, phrase, a, w, c, array_to_string(w[:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
small AS MATERIALIZED (SELECT lang, phrase, a FROM f WHERE a >= {least}),
parts AS (SELECT c.lang, c.phrase, c.a, c.w, c.c, l.a AS l, r.a AS r FROM cut c JOIN small l ON l.lang = c.lang AND l.phrase = c.lp JOIN small r ON r.lang = c.lang AND r.phrase = c.rp),
low AS (SELECT lang, phrase, a, w, arg_min({{'l': l, 'r': r}}, ({score(l='l', r='r')}, c)) AS p, min({score(l='l', r='r')}) AS score FROM parts GROUP BY 1, 2, 3, 4),
held AS (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase, a AS longer FROM cand WHERE k = 3),
left_out AS (SELECT DISTINCT h.lang, h.phrase FROM held h JOIN cand c USING (lang, phrase) WHERE 100 * longer >= {inside} * c.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, p.l AS l, p.r AS r, CAST(score AS BIGINT) AS score
 FROM low ANTI JOIN left_out USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {reported}"""
