"""Operator 12: spelling variants, by dynamic programming over sorted vocabularies.

Two words are near if one code point is inserted, deleted or replaced. Of two near words, either the
first half or the second half of the shorter one is shared, so the vocabulary is dealt into blocks of
words that share such a half (a block over ``CROWD`` words is dealt on by halves of what its words don't
share, until it is small). In a block the words are sorted by the part that isn't shared. Every word is
compared with the whole list: the three cells of a row of the edit matrix that can be one edit or less
are kept for each shared prefix, so a range of words with a common prefix (adjacent LCPs give the
ranges) has its rows worked out once, and a range whose prefix is already more than one edit away is
skipped with all its words. The ranges of all words of a block advance together in numpy, one code
point at a time. Each near pair is found in exactly one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail.llm.common import LOWER, NULL_ID, coded, column, keyed, longs, slices, stored, text_buffer, whole_groups

#: code points and occurrences that a word needs; times that a form is more frequent; every how many-th run loses a code point
SHORTEST, LEAST, TIMES, EVERY = 7, 2, 10, 31
#: words of a block that aren't dealt on, words compared with their lists at once, text that a task works on at once
CROWD, TOGETHER, RUN = 16_384, 16_384, 4 << 20
#: block sizes that are broadcast at most
BROADCAST = 100_000

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC0:] = True
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point, its number up to U+00FF where it is ASCII or from U+00C0, else 0; and row offsets."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    out = data[lead]
    high = out >= 128
    latin = np.flatnonzero(out == 0xC3)
    out[high] = 0
    out[latin] = data[lead[latin] + 1] + 0x40
    return out, np.searchsorted(lead, offsets)


def crc32(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run in UTF-8, going on from ``begun``."""
    crc = begun ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")  # longest first
    size = (ends - starts)[order]
    state = crc[order]
    for k in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -k, side="left"))  # runs of more than k
        c = points[starts[order[:live]] + k]
        s = state[:live]
        wide = c >= 128
        s = np.where(wide, CRC[(s ^ 0xC3) & 0xFF] ^ (s >> 8), s)
        state[:live] = CRC[(s ^ np.where(wide, c - 0x40, c)) & 0xFF] ^ (s >> 8)
    crc[order] = state
    return crc ^ np.uint32(0xFFFFFFFF)


def runs(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of letters."""
    inside = np.concatenate([[False], LETTER[points], [False]])
    edge = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(points))]
    both = cut[inside[cut] & inside[cut + 1]]  # a run that goes on in the next row
    if len(both):
        starts, ends = np.sort(np.append(starts, both)), np.sort(np.append(ends, both))
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def tallied(points: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct words of a slice and their occurrences, after the deletions that the hashes ask for."""
    points = LOWER[points]
    starts, ends, row = runs(points, offsets)
    long = ends - starts >= SHORTEST
    starts, ends, row = starts[long], ends[long], row[long]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    named = np.array([zlib.crc32(b":" if i == NULL_ID else b"%d:" % i) for i in ids.tolist()], np.uint32)
    h = crc32(points, starts, ends, named[row])
    hit = h % EVERY == 0
    spans = []
    if not hit.all():
        s, e = starts[~hit], ends[~hit]
        number, words = coded(points, s, e)
        spans.append((words.to_pylist(), np.bincount(number)))
    size = ends - starts
    cut = np.flatnonzero(hit & (size > SHORTEST))
    shorter = [points[a:a + k].tobytes() + points[a + k + 1:b].tobytes() for a, b, k in zip(starts[cut].tolist(), ends[cut].tolist(), (h[cut] % size[cut]).tolist())]
    spans.append((shorter, np.ones(len(shorter), np.int64)))
    return [w.decode("latin-1") for words, _ in spans for w in words], np.concatenate([n for _, n in spans])


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``word, n``: the distinct words of at least ``SHORTEST`` code points and ``least`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=RUN):
                words, n = tallied(*code_points(*text_buffer(column(b, "text"))), longs(b, "doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    return keyed(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- blocks ------------------------------------------------------------------------
def shared_part() -> Column:
    return F.concat(F.expr("substring(word, 1, a)"), F.lit("\0"), F.expr("substring(word, len - b + 1, b)"))


def halved(block: str) -> Column:
    """Blocks that share half of what ``block`` (m, a, b, within) doesn't share: the first half, or else the second."""
    m, a, b, within = (F.col(f"{block}.{x}") for x in ("m", "a", "b", "within"))
    half = F.floor((m - a - b) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), (a + half).alias("a"), b.alias("b"), within.alias("within")),
                   F.struct(m.alias("m"), a.alias("a"), (m - a - half).alias("b"), (a + half).alias("within")))


def blocks(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Every word in its blocks: words of ``m`` and ``m + 1`` code points that share the first ``a`` and the last ``b``; pairs count where they share fewer than ``within`` in front."""
    nothing = F.lit(0).cast("int")
    start = F.filter(F.array(*(F.struct((F.col("len") - d).alias("m"), nothing.alias("a"), nothing.alias("b"), F.lit(2**31 - 1).alias("within")) for d in (0, 1))),
                     lambda x: x["m"] >= SHORTEST)
    rows = words.withColumn("len", F.char_length("word").cast("int")).withColumn("block", F.explode(start))
    name = ("m", "a", "b", "shared")

    def dealt(df: DataFrame) -> DataFrame:
        out = df.select("word", "n", "len", F.explode(halved("block")).alias("block")).select("word", "n", "len", "block.*")
        return out.withColumn("shared", shared_part())

    rows = stored(dealt(rows), "spelling-blocks")
    while True:
        large = stored(rows.where("m - a - b > 1").groupBy(*name).agg(F.count("*").alias("size")).where(F.col("size") > crowd).drop("size").withColumn("large", F.lit(True)), "spelling-large")
        many = large.count()
        if not many:
            return rows
        marked = rows.join(F.broadcast(large) if many <= BROADCAST else large, list(name), "left")
        small = marked.where("large is null").select(*rows.columns)
        on = dealt(marked.where("large").withColumn("block", F.struct("m", "a", "b", "within")))
        rows = stored(small.unionByName(on.select(*rows.columns)), "spelling-blocks")


# --- comparison --------------------------------------------------------------------
def shared_prefix(points: np.ndarray, one: np.ndarray, one_size: np.ndarray, two: np.ndarray, two_size: np.ndarray) -> np.ndarray:
    """Common first code points of the parts that begin at ``one`` and at ``two``."""
    out = np.zeros(len(one), np.int64)
    live = np.arange(len(one))
    most = np.minimum(one_size, two_size)
    k = 0
    while len(live):
        live = live[most[live] > k]
        live = live[points[one[live] + k] == points[two[live] + k]]
        k += 1
        out[live] = k
    return out


def near(points: np.ndarray, begin: np.ndarray, size: np.ndarray, block: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking row, row) at one edit of each other, within blocks.

    Rows are sorted by block and part; ``points[begin:begin + size]`` is a row's part. Asking rows are the
    shorter of a block's two sizes.
    """
    n = len(begin)
    lcp = np.full(n + 1, -1, np.int64)  # with the row before; -1 starts a block
    same = np.flatnonzero(block[1:] == block[:-1]) + 1
    lcp[same] = shared_prefix(points, begin[same - 1], size[same - 1], begin[same], size[same])
    edges = np.append(np.flatnonzero(lcp[:-1] < 0), n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(asking), TOGETHER):
        q = asking[k:k + TOGETHER]
        at = np.searchsorted(edges, q, side="right")
        low, high = edges[at - 1], edges[at]
        # the row of the edit matrix for the prefix of length d: cells d - 1, d, d + 1 of the asking word
        p0, p1, p2 = np.full(len(q), 2), np.zeros(len(q), np.int64), np.ones(len(q), np.int64)
        d = 0
        while len(q):
            d += 1
            cuts = np.flatnonzero(lcp < d)  # where ranges of a common prefix of d begin; the last is n
            starts = cuts[:-1][size[cuts[:-1]] >= d]
            a, z = np.searchsorted(starts, low), np.searchsorted(starts, high)
            many = z - a
            child = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            q, p0, p1, p2 = (np.repeat(x, many) for x in (q, p0, p1, p2))
            low = starts[child]
            high = cuts[np.searchsorted(cuts, low, side="right")]
            c, own = points[begin[low] + d - 1], size[q]

            def unlike(j: int) -> np.ndarray:
                """Does the asking word's code point j differ (2, beyond reach, if there is none)?"""
                if j < 0:
                    return np.full(len(q), 2)
                inside = j < own
                return np.where(inside, points[np.where(inside, begin[q] + j, 0)] != c, 2)

            x0 = np.minimum(p0 + unlike(d - 2), p1 + 1)
            x0[own < d - 1] = 2
            x1 = np.minimum(np.minimum(p1 + unlike(d - 1), p2 + 1), x0 + 1)
            x1[own < d] = 2
            x2 = np.minimum(p2 + unlike(d), x1 + 1)
            x2[own < d + 1] = 2
            ends = size[low] == d
            edits = np.where(own == d, x1, np.where(own == d - 1, x0, 2))
            hit = ends & (edits == 1)
            found.append((q[hit], low[hit]))
            alive = np.minimum(np.minimum(x0, x1), x2) <= 1
            q, low, high, p0, p1, p2 = (x[alive] for x in (q, low, high, x0, x1, x2))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def compared(rows: DataFrame) -> DataFrame:
    """Per word and block with a near word: ``word, n_near, best_n, best``."""
    names = ["m", "a", "b", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, names):
            t = t.combine_chunks()
            new = np.zeros(t.num_rows, bool)
            for c in names:
                v = t.column(c).chunk(0)
                new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            points, offsets = code_points(*text_buffer(t.column("part")))
            begin, size = offsets[:-1], np.diff(offsets)
            m, a, b, within, n = (t.column(c).to_numpy().astype(np.int64) for c in ("m", "a", "b", "within", "n"))
            one, two = near(points, begin, size, np.cumsum(new), np.flatnonzero(size == m - a - b))
            first = shared_prefix(points, begin[one], size[one], begin[two], size[two]) + a[one] < within[one]
            one, two = one[first], two[first]
            back = size[two] > size[one]  # a longer word doesn't ask
            one, two = np.append(one, two[back]), np.append(two, one[back])
            if not len(one):
                continue
            word = t.column("word").chunk(0)
            rank = np.empty(t.num_rows, np.int64)
            rank[pc.sort_indices(word).to_numpy()] = np.arange(t.num_rows)
            order = np.lexsort((rank[two], -n[two], one))
            who, top, many = np.unique(one[order], return_index=True, return_counts=True)
            best = two[order[top]]
            yield pa.RecordBatch.from_arrays([word.take(pa.array(who)), pa.array(many), pa.array(n[best]), word.take(pa.array(best))], names=["word", "n_near", "best_n", "best"])

    part = F.expr("substring(word, a + 1, len - a - b)")
    sent = rows.select(*names, "within", "word", "n", part.alias("part")).repartition(*names).sortWithinPartitions(*names, "part")
    return sent.mapInArrow(run, "word string, n_near long, best_n long, best string")


def variants(docs: DataFrame, times: int = TIMES, crowd: int = CROWD, least: int = LEAST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    ``docs`` has ``doc_id`` and ``text``. A null text has no words; a null ``doc_id`` is empty in the hashed
    string, and rows that repeat a document count again. Of near words with equal counts the smallest by code points is the form. An empty
    table has no words.
    """
    words = stored(vocabulary(docs, least), "spelling-words")
    found = compared(blocks(words, crowd)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    taken = (-F.col("best.n")) >= F.col("n") * times
    out = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.word")).alias("form"),
                                                   F.when(taken, -F.col("best.n")).alias("form_n"))
    out = stored(out, "spelling-forms")
    return out.join(roots(out.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form: the chain of forms, doubled until none goes on. Counts grow along a chain, so it ends."""
    chain = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        chain = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return chain
