"""Exact repeats of a fixed width across a corpus, without gathering positions: the shared part of operators 3 and 4.

A window is ``width`` consecutive units (bytes or words) of one document. Equal windows choose the
same unit run inside them as their anchor: the ``gram`` units of least hash, the leftmost of equals.
Consecutive windows that share an anchor form a run, one row for some forty windows:

1. Anchors that occur once in the corpus are dropped by a join with their counts (counted before the
   shuffle, so a common passage is one row a task; adaptive execution splits a hot anchor in the join).
2. Runs of equal content (XXH3 of 64 bits, among runs of one anchor) form a class. All but its first run are late as a whole: no text is compared.
3. Only where one anchor has several classes must windows be compared. The first run of each class is
   fetched, pieces meet by anchor, and the longest previous factors of their windows, from the previous
   and next smaller places in suffix order, tell which of them came before.
   An anchor with more than ``CROWD`` classes is dealt out by window content instead, so no task gets
   more than its share; equal windows still meet.

What is removed is the union of late windows. Nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail.llm.common import NULL_ID, SLICE, column, longs, mix, slices, span_hashes, stored, text_buffer, whole_groups, word_bounds, word_hashes

#: classes of one anchor beyond which its windows are dealt out by content
CROWD = 1 << 13
#: what names a document: its id, and a hash of its text as null and repeated ids may have several
PAIR = ["doc_id", "twin"]
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number in byte order (zeros after the end)."""
    raw = np.concatenate([data, np.zeros(8 + -len(data) % 8, np.uint8)])
    out = np.empty(len(raw) - 8, ">u8")
    for k in range(8):
        out[k::8] = raw[k:k + len(out)].view(">u8")
    return out[:len(data)].astype(np.uint64)


def bytes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of the words, unchanged, and where each row's begin."""
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def byte_grams(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 or more) from every position."""
    x = packed(units)
    n = len(units) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in [*range(0, gram - 8, 8), gram - 8]:
        h ^= x[k:k + n]
        h *= _A
        h ^= h >> np.uint64(31)
    return mix(h)


def word_grams(units: np.ndarray, gram: int) -> np.ndarray:
    n = len(units) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ units[k:k + n]) * _B
        h ^= h >> np.uint64(31)
    return mix(h)


@dataclass(frozen=True)
class Kind:
    """What a unit is, and how wide windows and anchors are."""
    width: int
    gram: int
    units: Callable
    grams: Callable
    by_position: bool  # late after an earlier start in the same document too, or only after a smaller doc_id


def byte_kind(width: int = 100, gram: int = 24) -> Kind:
    return Kind(width, min(gram, width), bytes_of, byte_grams, True)


def word_kind(width: int = 50, gram: int = 8) -> Kind:
    return Kind(width, min(gram, width), words_of, word_grams, False)


def segments(data: np.ndarray, offsets: np.ndarray, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(units, offsets, row of each part, start of each part in its row); only very long rows are cut, with overlap."""
    units, first = kind.units(data, offsets)
    rows = np.arange(len(first) - 1)
    if len(units) <= 2 * SLICE or len(rows) > 1:
        yield units, first, rows, np.zeros(len(rows), np.int64)
        return
    for lo in range(0, max(1, len(units) - kind.width + 1), SLICE):
        part = units[lo:lo + SLICE + kind.width - 1]
        yield part, np.array([0, len(part)]), np.zeros(1, np.int64), np.array([lo])


def anchor_runs(units: np.ndarray, offsets: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: anchor hash, first window, number of windows, part."""
    windows = np.maximum(np.diff(offsets) - kind.width + 1, 0)
    total = int(windows.sum())
    none = np.zeros(0, np.int64)
    if not total:
        return none.astype(np.uint64), none, none, none
    h = kind.grams(units, kind.gram)
    low = np.uint64(0xFFFFFF)
    best = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    span, have = kind.width - kind.gram + 1, 1
    while have * 2 <= span:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if span > have:
        best = np.minimum(best[:-(span - have)], best[span - have:])
    part = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][part]
    anchor = best[at] & low
    cut = np.empty(total, bool)
    cut[0] = True
    cut[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    begin = np.flatnonzero(cut)
    # an anchor's number wraps at 2**24 units; parts are shorter than that or one row's, so add what was lost
    where = at[begin]
    full = (where & ~np.int64(0xFFFFFF)) | anchor[begin].astype(np.int64)
    full[full < where] += 1 << 24
    return h[full], where, np.diff(np.append(begin, total)), part[begin]


def runs(docs: DataFrame, kind: Kind, anchors_only: bool = False) -> DataFrame:
    """``anchor`` and, unless only that is asked for, ``content, doc_id, twin, start, n`` of every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                doc, twin = longs(b, "doc_id"), longs(b, "twin")
                for units, offsets, rows, shift in segments(*text_buffer(column(b, "text")), kind):
                    anchor, where, n, part = anchor_runs(units, offsets, kind)
                    out = [pa.array(anchor.view(np.int64))]
                    if not anchors_only:
                        raw, size = memoryview(np.ascontiguousarray(units)).cast("B"), units.itemsize
                        digest = xxhash.xxh3_64_intdigest
                        content = np.fromiter((digest(raw[a:e]) for a, e in zip((where * size).tolist(), ((where + n + kind.width - 1) * size).tolist())),
                                              np.uint64, len(where))
                        out += [pa.array(content.view(np.int64)), pa.array(doc[rows[part]]), pa.array(twin[rows[part]]), pa.array(where - offsets[part] + shift[part]),
                                pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(out, names=["anchor", "content", "doc_id", "twin", "start", "n"][:len(out)])

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "anchor long" if anchors_only else "anchor long, content long, doc_id long, twin long, start long, n int")


def squeezed(docs: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, twin``, the text's bytes compressed as ``z`` (null stays null), and columns to carry: what a shuffle of texts moves."""
    schema = docs.select("doc_id", "twin", *carry).schema.add("z", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in slices(batch):
                z = [None if t is None else press.compress(t.encode("utf-8", "replace")) for t in column(b, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("doc_id", "twin", *carry)), pa.array(z, pa.binary())], names=["doc_id", "twin", *carry, "z"])

    return docs.select("doc_id", "twin", *carry, "text").mapInArrow(run, schema)


def unsqueezed(z: bytes | None) -> bytes:
    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def window_ranks(keys: np.ndarray, covers: int, width: int) -> np.ndarray:
    """The place in suffix order, up to ``width`` units, of every position (equal windows share one).

    ``keys`` orders positions by their first ``covers`` units; prefix doubling does the rest. A rank
    means something only where the window lies within its piece.
    """
    def dense(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        s = x[order]
        new = np.empty(len(s), np.int64)
        new[:1] = 0
        new[1:] = s[1:] != s[:-1]
        out = np.empty(len(s), np.int64)
        out[order] = np.cumsum(new)
        return out

    rank = dense(keys)
    n = len(rank)
    while covers < width:
        step = min(covers, width - covers)
        after = np.zeros(n, np.int64)
        after[:max(n - step, 0)] = rank[step:] + 1
        rank, covers = dense(rank * (n + 1) + after), covers + step
    return rank


def suffix_places(words: np.ndarray, at: np.ndarray, steps: list[int]) -> np.ndarray:
    """The places in suffix order of distinct windows that begin at ``at``; ``words[at + step]`` are their units in order."""
    order = np.lexsort([words[at + k] for k in steps[2::-1]])
    tied = np.zeros(len(at), bool)
    if len(steps) > 3:
        same = np.ones(len(at) - 1, bool)
        for k in steps[:3]:
            w = words[at[order] + k]
            same &= w[1:] == w[:-1]
        tied[1:] |= same
        tied[:-1] |= same
    t = np.flatnonzero(tied)
    if len(t):
        run = np.cumsum(np.append(True, ~same))[t]
        order[t] = order[t][np.lexsort([words[at[order[t]] + k] for k in steps[:2:-1]] + [run])]
    out = np.empty(len(at), np.int64)
    out[order] = np.arange(len(at))
    return out


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """The nearest earlier place with a smaller value, for every place (-1: none).

    Most are the neighbour; the others climb a tree of block minima to the first block on their left
    with a smaller value and go down to its last one, all places at once.
    """
    n = len(v)
    out = np.arange(-1, n - 1)
    i = np.flatnonzero(np.append(False, v[:-1] >= v[1:]))
    levels = [v]
    while len(levels[-1]) > 1:
        last = levels[-1]
        last = np.append(last, last[-1]) if len(last) % 2 else last
        levels.append(np.minimum(last[::2], last[1::2]))
    block, at = i.copy(), np.full(len(i), -1)
    up = np.arange(len(i))
    for k, least in enumerate(levels):
        left = block[up]
        hit = (left % 2 == 1) & (least[np.maximum(left - 1, 0)] < v[i[up]])
        block[up[hit]] -= 1
        at[up[hit]] = k
        up = up[~hit]
        block[up] >>= 1
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(at >= k)
        right = np.minimum(2 * block[down] + 1, len(levels[k - 1]) - 1)
        block[down] = np.where(levels[k - 1][right] < v[i[down]], right, 2 * block[down])
    out[i] = np.where(at >= 0, block, -1)
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, kind: Kind) -> np.ndarray:
    """How many units, up to the width, the strings at ``a`` and ``b`` have in common."""
    if kind.units is bytes_of:
        steps, per = [*range(0, kind.width - 8, 8), kind.width - 8], 8
    else:
        steps, per = list(range(kind.width)), 1
    out, left = np.full(len(a), kind.width), np.arange(len(a))
    for k in steps:
        x = words[a[left] + k] ^ words[b[left] + k]
        stop = np.flatnonzero(x)
        # whole bytes of the number before its first one that differs
        shared = np.zeros(len(stop), np.int64)
        for cut in range(1, per):
            shared += x[stop] < np.uint64(1 << (64 - 8 * cut))
        out[left[stop]] = k + shared
        left = left[x == 0]
    return out


def longest_previous_factors(words: np.ndarray, at: np.ndarray, order: np.ndarray, place: np.ndarray, kind: Kind) -> np.ndarray:
    """For every string at ``at``, the longest prefix, up to the width, that a string of smaller ``place`` begins with.

    ``order`` is the suffix order, equal strings by place. The string of smaller place with the longest
    common prefix is the previous or the next smaller place in that order; both are compared.
    """
    n, sorted_at, v = len(at), at[order], place[order]
    longest = np.zeros(n, np.int64)
    for near in (previous_smaller(v), n - 1 - previous_smaller(v[::-1])[::-1]):
        some = np.flatnonzero((near >= 0) & (near < n))
        longest[some] = np.maximum(longest[some], common_prefix(words, sorted_at[some], sorted_at[near[some]], kind))
    out = np.empty(n, np.int64)
    out[order] = longest
    return out


def late_windows(units: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the pieces that an earlier one equals: (piece, window in it).

    A window whose hash no other has is equal to none, so its longest previous factor is shorter than
    the width. The others are put into suffix order, and those are late whose longest previous
    factor (``longest_previous_factors``, by comparing units) reaches the width.
    """
    windows = np.maximum(np.diff(offsets) - kind.width + 1, 0)
    piece = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = offsets[:-1][piece] + inside
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    item = units.itemsize
    raw = np.ascontiguousarray(units).view(np.uint8)
    h = span_hashes(raw, at * item, (at + kind.width) * item)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    shared = np.append(False, same) | np.append(same, False)
    some = order[shared]
    if not len(some):
        return none, none
    first = np.append(True, ~same)[shared]
    group, rep = np.cumsum(first) - 1, at[some[first]]
    in_bytes = kind.units is bytes_of
    words = packed(units) if in_bytes else units
    steps = [*range(0, kind.width - 8, 8), kind.width - 8] if in_bytes else list(range(kind.width))
    equal = np.ones(len(some), bool)
    for k in steps:
        equal &= words[at[some] + k] == words[rep[group] + k]
    if equal.all():
        rank = suffix_places(words, rep, steps)[group]
    else:  # two contents under one hash: order everything by prefix doubling
        some = np.arange(len(at))
        rank = window_ranks(words, 8 if in_bytes else 1, kind.width)[at]
    place = doc[piece[some]]
    if kind.by_position:  # places are numbered in order of document and start
        begin = start[piece[some]] + inside[some]
        ordered = np.lexsort((begin, place))
        moved = np.append(False, (np.diff(place[ordered]) != 0) | (np.diff(begin[ordered]) != 0))
        place = np.empty(len(some), np.int64)
        place[ordered] = np.cumsum(moved)
    factors = longest_previous_factors(words, at[some], np.lexsort((place, rank)), place, kind)
    hit = np.sort(some[factors >= kind.width])
    return piece[hit], inside[hit]


def find(docs: DataFrame, kind: Kind) -> DataFrame:
    """Late windows as ranges: ``doc_id, twin, start, n`` (window starts ``start`` to ``start + n - 1``).

    A document is a pair of ``doc_id`` and ``twin`` (see ``paired``), and pairs are in order; only where a
    smaller ``doc_id`` counts, pairs of one id that isn't null come neither before nor after each other.
    """
    # each side of a join is a table of its own, so that adaptive execution can split a hot anchor
    counts = stored(runs(docs, kind, anchors_only=True).groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    repeated = stored(runs(docs, kind).join(counts, "anchor"), "repeated-runs")
    apart = F.when(F.col("doc_id") == NULL_ID, F.col("twin")).otherwise(0).alias("apart")
    place: Column = F.struct("doc_id", "twin", "start") if kind.by_position else F.struct("doc_id", apart)
    classes = stored(repeated.groupBy("anchor", "content").agg(F.min(place).alias("first")), "run-classes")
    crowded = stored(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "crowded-anchors")
    marked = stored(repeated.join(classes, ["anchor", "content"]).withColumn("late", place > F.col("first")).drop("first", "content"), "marked-runs")
    # a document has no more runs than windows, so its list is bounded by its length
    asked = marked.where("not late").join(crowded, "anchor").groupBy("doc_id", "twin").agg(F.collect_list(F.struct("anchor", "classes", "start", "n")).alias("runs"))
    pieces = _pieces(squeezed(docs).join(asked, PAIR), kind)
    dealt = pieces.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal")
    return marked.where("late").select(*PAIR, "start", F.col("n").cast("long").alias("n")).unionAll(_compared(dealt, kind))


def _pieces(asked: DataFrame, kind: Kind) -> DataFrame:
    """The units of every run that must be compared, whole or, where an anchor is crowded, window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[tuple] = []
            size = 0
            for doc, twin, z, wanted in zip(longs(b, "doc_id").tolist(), longs(b, "twin").tolist(), column(b, "z"), column(b, "runs")):
                data = np.frombuffer(unsqueezed(z.as_py()), np.uint8)
                units, _ = kind.units(data, np.array([0, len(data)]))
                raw, item = memoryview(np.ascontiguousarray(units)).cast("B") if len(units) else memoryview(b""), units.itemsize
                for w in wanted.as_py():
                    lo, n = w["start"], w["n"]
                    if w["classes"] <= CROWD:
                        out.append((w["anchor"], 0, doc, twin, lo, bytes(raw[lo * item:(lo + n + kind.width - 1) * item])))
                        size += len(out[-1][-1])
                        continue
                    deals = -(-w["classes"] // CROWD)
                    for k in range(lo, lo + n):
                        x = bytes(raw[k * item:(k + kind.width) * item])
                        out.append((w["anchor"], 1 + digest(x) % deals, doc, twin, k, x))
                        size += len(x)
                if size > SLICE:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return asked.mapInArrow(run, "anchor long, deal long, doc_id long, twin long, start long, units binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 5, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["anchor", "deal", *PAIR, "start", "units"])


def _compared(pieces: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["anchor", "deal"], 1 << 11):
            raw = t.column("units").combine_chunks()
            raw = raw if isinstance(raw, pa.Array) else raw.chunk(0)
            raw = raw.cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64, raw.offset + len(raw) + 1)[raw.offset:]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            units = data if kind.units is bytes_of else np.frombuffer(data.tobytes(), np.uint64)
            offsets = (offsets - offsets[0]) // units.itemsize
            doc, twin, start = (t.column(c).to_numpy() for c in (*PAIR, "start"))
            apart = twin if kind.by_position else np.where(doc == NULL_ID, twin, 0)
            order = np.lexsort((apart, doc))
            number = np.empty(len(doc), np.int64)  # of the document, in order
            number[order] = np.cumsum(np.append(False, (doc[order][1:] != doc[order][:-1]) | (apart[order][1:] != apart[order][:-1])))
            piece, inside = late_windows(units, offsets, number, start, kind)
            cut = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1] + 1))) if len(piece) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc[piece[cut]]), pa.array(twin[piece[cut]]), pa.array(start[piece[cut]] + inside[cut]),
                                              pa.array(np.diff(np.append(cut, len(piece))))], names=[*PAIR, "start", "n"])

    return pieces.mapInArrow(run, "doc_id long, twin long, start long, n long")


def removed(ranges: list[dict] | None, size: int, width: int) -> np.ndarray:
    """Which of ``size`` units late windows cover."""
    edge = np.zeros(size + 1, np.int64)
    for r in ranges or ():
        edge[r["start"]] += 1
        edge[min(size, r["start"] + r["n"] + width - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_ranges(docs: DataFrame, ranges: DataFrame, *carry: str) -> DataFrame:
    """Every document, compressed, with the list of its late ranges (null if it has none)."""
    found = ranges.groupBy(*PAIR).agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    return squeezed(docs, *carry).join(found, PAIR, "left")
