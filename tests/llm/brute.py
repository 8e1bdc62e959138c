"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def held(doc_id: int, mod: int, remainder: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % mod == remainder


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    times, inside = Counter(grams), [False] * len(words)
    for k, g in enumerate(grams):
        if times[g] > 1:
            inside[k:k + 5] = [True] * 5
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    repeated = sum(inside)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, repeated,
            len(words) < 10 or 100 * repeated > 20 * len(words))


def cut_bytes(rows: list[tuple[int, str | None]], width: int = 100) -> dict[int, tuple]:
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if seen.setdefault(raw[p:p + width], (doc, p)) != (doc, p):
                gone[p:p + width] = b"\1" * width
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[doc] = (len(raw), sum(gone), runs, sha(bytes(c for c, g in zip(raw, gone) if not g)))
    return out


def cut_words(rows: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple]:
    first, out = {}, {}
    words = {doc: (text or "").encode().split() for doc, text in rows}
    for doc in sorted(words):
        for p in range(len(words[doc]) - width + 1):
            first.setdefault(tuple(words[doc][p:p + width]), doc)
    for doc, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < doc:
                gone[p:p + width] = [True] * width
        out[doc] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def base_scores(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    tokens = {doc: lower(text).split() + [None] for doc, text in rows}
    c = Counter(t for doc, ts in tokens.items() if not held(doc, 7, 2) for t in ts)
    n, v = sum(c.values()), len(c)
    return {doc: (len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for doc, ts in tokens.items()}


def fingerprint(text: str | None) -> int:
    words = lower(text).split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h)) if h else 0


def groups(prints: dict[int, int], distance: int = 3) -> dict[int, int]:
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def nearest(rows: list[tuple[int, list[float]]], k: int = 20, every: int = 20) -> dict[int, list[tuple[int, float]]]:
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collocations(rows: list[tuple[str | None, str | None]], least: int = 10, inside: int = 50, reported: int = 2000) -> set[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = set()
    for lang, c in f.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(x >= least and 100 * x >= inside * a for q, x in c.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(kept)[:reported], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, n[lang], -score))
    return out


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def variants(rows: list[tuple[int | None, str | None]], least: int = 2, times: int = 10) -> dict[str, tuple]:
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and edits(v, w) == 1] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= times * n[w] else None for w, v in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def tree_scores(texts, depth=4, least_count=20, least_gain=10.0, least_string=3, weight=3.0, ask=None):
    """(log10 probability of every text, sizes of kept contexts), from all training strings in dictionaries.

    With ``ask``, the log10 probability of its last token (None: the end) after the others instead."""
    end = None
    rows = {doc: [end, *lower(text).split(), end] for doc, text in texts}
    unigrams, follow = Counter(), {}
    for doc, row in rows.items():
        if held(doc, 7, 2):
            continue
        unigrams.update(row[1:])
        for i in range(1, len(row)):
            for size in range(1, min(depth, i) + 1):
                follow.setdefault(tuple(row[i - size:i]), Counter())[row[i]] += 1
    floor = sum(unigrams.values()) + len(unigrams) + 1
    kept = {}

    def shape(context):
        seen = {t: n for t, n in follow[context].items() if n >= least_string}
        rest = follow[context].total() - sum(seen.values())
        return seen, sum(seen.values()), rest, weight * len(seen) + rest

    def p(context, token):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (unigrams[token] + 1) / floor
        seen, total, _, prior = kept[context]
        return (seen.get(token, 0) + prior * p(context[1:], token)) / (total + prior)

    for context in sorted(follow, key=len):
        seen, total, rest, prior = shape(context)
        if total + rest < least_count or not seen:
            continue
        gain = rest * math.log(prior / (total + prior))
        for token, n in seen.items():
            q = p(context[1:], token)
            gain += n * math.log((n - 1 + prior * q) / (total - 1 + prior) / q)
        if gain >= least_gain:
            kept[context] = seen, total, rest, prior
    if ask is not None:
        return math.log10(p((end, *ask[:-1])[-depth:], ask[-1])), ()
    return {doc: sum(math.log10(p(tuple(row[max(i - depth, 0):i]), row[i])) for i in range(1, len(row))) for doc, row in rows.items()}, {len(c) for c in kept}
