"""String, address and token-set expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsetrail import vocab

# whitespace of any kind, for trimming both ends
_SPACES = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
           + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (null -> '')."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(_SPACES))


def one_of(c: Column, mapping: dict, default=None) -> Column:
    """Small constant lookup written as a CASE expression."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def normalise_title(c: Column) -> Column:
    """Lower case, bracketed prefixes and punctuation collapsed to one space."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(bare, "[^0-9a-z가-힣]+", " "))


def title_grams(norm: Column) -> Column:
    """Distinct character 3-grams of a normalised title; null when too short."""
    flat = F.replace(norm, F.lit(" "), F.lit(""))
    # a look-ahead match per position: one pass over the text
    grams = F.array_distinct(F.regexp_extract_all(flat, F.lit("(?=(...))"), 1))
    return F.when(F.length(flat) >= vocab.MIN_TITLE_CHARS, grams)


def title_words(norm: Column) -> Column:
    """Distinct words longer than one character; null when the title is short."""
    flat = F.replace(norm, F.lit(" "), F.lit(""))
    words = F.array_distinct(F.filter(F.split(norm, " "), lambda w: F.length(w) > 1))
    return F.when(F.length(flat) >= vocab.MIN_TITLE_CHARS, words)


def gram_codes(grams: Column) -> Column:
    """3-grams as LONGs: three code points of 21 bits each, so no collisions."""
    code = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(grams, lambda g: (F.shiftleft(code(g, 1), 42) + F.shiftleft(code(g, 2), 21)
                                         + code(g, 3)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two duplicate-free arrays; 0 if either is empty."""
    shared = F.transform(F.array(F.size(F.array_intersect(a, b))),
                         lambda s: s / (F.size(a) + F.size(b) - s))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared[0]).otherwise(F.lit(0.0))


def normalise_url(c: Column) -> Column:
    """Address without scheme, ``www.``, fragment, query and end slashes."""
    u = F.lower(strip(c))
    u = F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", "")
    u = F.substring_index(F.substring_index(u, "#", 1), "?", 1)
    return F.regexp_replace(u, "/+$", "")


def url_host(c: Column) -> Column:
    """Host without ``www.``; an unparsable address is returned as it is."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))),
                                       r"^www\.", ""), c)


def strip_body_tags(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for pattern in vocab.BODY_TAG_PATTERNS:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def has_hangul(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[가-힣]")


def substring_pattern(words) -> str:
    """Pattern matching any of the literal words, with shared prefixes merged.

    Merging keeps a scan near one branch per position for lists of hundreds of
    words.  A word that starts with a shorter listed word adds nothing.
    """
    tree: dict = {}
    for word in sorted(set(words), key=len):
        node = tree
        for ch in word:
            if "" in node:
                break
            node = node.setdefault(ch, {})
        else:
            node[""] = None

    def emit(node) -> str:
        if "" in node:
            return ""
        arms = []
        for ch, below in node.items():
            arms.append(("\\" + ch if not (ch.isalnum() or ch.isspace()) else ch) + emit(below))
        return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"

    return emit(tree)


def contains_any(text: Column, words) -> Column:
    """True when any of the literal substrings occurs in ``text``.

    One pattern, so a row is scanned once whatever the list size.
    """
    words = [w for w in words if w]
    return text.rlike(substring_pattern(words)) if words else F.lit(False)


def sentences(c: Column) -> Column:
    """Non-empty trimmed sentences; only ``. ! ?`` followed by space end one."""
    parts = F.split(strip(c), r"(?<=[.!?])[\s\p{Z}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def fact_count(s: Column, site_pattern: str) -> Column:
    """How many leading sentences of ``s`` are facts rather than inference."""
    n = F.size(s)
    last_plain = F.array_max(F.transform(
        s, lambda x, i: F.when((i == 0) | ~x.rlike(site_pattern), i + 1).otherwise(0)))
    return (F.when(n < 2, n).when(n == 2, F.lit(1))
            .when(last_plain == n, n - 1).otherwise(last_plain))
