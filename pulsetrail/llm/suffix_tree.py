"""Operator 5: scoring texts with a probabilistic suffix tree over words.

A text is its tokens: its words, then an end; one more end stands before it. Contexts are the
strings of up to ``depth`` tokens before a token. A context that came ``least_count`` times is kept
if its next tokens diverge from those of the longest kept context that ends it: the sum over its
occurrences of ln(p of the context / p of the shorter one), each occurrence left out of its own
estimate, must reach ``least_gain``. So chance repeats, which a plain divergence takes for structure,
don't pass, and what is kept grows with the text: there is no limit to the number of contexts.

A kept context's distribution is (n + prior * p) / (total + prior), with p that of the next shorter
kept one. Next tokens that came at least ``least_string`` times there are told apart; n and total are
of these, and prior is ``weight`` times their number of kinds and the occurrences of all others, which
are thus left to the shorter context. At the root p is the base score's (c + 1) / (N + V + 1). A token's probability is that of its longest kept context. Its logarithm is a sum of numbers by key: the token's base score, for each
kept context log(prior / (total + prior)), and for each next token seen there log((n + prior * p) /
(prior * p)). So scoring is a lookup: numbers of frequent keys (a bounded table) are found in the
task, the others are dealt by key in compressed bundles, met by the numbers there, and their sums
dealt back by row; neither the tree nor a text's tokens ever stand in one place. Texts are read once: their tokens' hashes are stored.

Levels are counted one after the other, each in two runs over the tokens: one in which packed hashes
tell the strings that may come often enough (left out where contexts are few), one that counts these exactly. A string of ``m`` tokens has a 64-bit number made of those
of its last and of its first ``m - 1`` tokens; a bit filter of fixed size tells which contexts came
often enough to be counted. Its false hits cost work and are dropped by the exact counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsetrail.llm.common import (LOWER, column, dropped, give_back, held_out, keyed, longs, mix, public_id, row_of, slices, stored,
                                   text_buffer, word_bounds, word_hashes)
from pulsetrail.llm.phrases import Filter, repeated
from pulsetrail.session import shuffles_removed

DEPTH = 4
#: occurrences of a context, and nats it must gain, to be kept; occurrences of a next token there to be told apart; weight of the shorter context per kind of these
LEAST_COUNT, LEAST_GAIN, LEAST_STRING, WEIGHT = 20, 10.0, 3, 3.0
#: keys whose numbers every task holds
FREQUENT = 1 << 18
END_TOKEN = -1
#: filter of 2^27 bits: 2^21 words of 64
FILTER_WORDS = 21
#: most bits of a filter of strings
STRING_BITS = 1 << 29
#: distinct strings that a counting task holds
HELD = 1 << 20
#: contexts that come less often than one token in so many, all together, are counted in one run
FEW = 4
#: tokens that a task works on at once
RUN = 1 << 17
#: bytes of distinct hashes that a file of tokens lists; where a file has more, they are written in full
DICTIONARY = 1 << 24


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token in order, ends among them; where rows begin)"""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    n, row = len(first) - 1, row_of(first)
    begin = first + np.arange(n + 1)
    key = np.full(begin[-1], END_TOKEN, np.int64)
    key[np.arange(len(starts)) + row] = word_hashes(data, starts, ends).view(np.int64)
    return key, begin


def tokenized(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named and ``tokens`` (hashes of a text's tokens, in order): texts are read and hashed once, not in every run over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                key, begin = tokens(*text_buffer(column(b, "text")))
                found = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(key))
                yield pa.RecordBatch.from_arrays([*(column(b, c) for c in keep), found], names=[*keep, "tokens"])

    docs = docs.select(*keep, "text")
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("tokens", T.ArrayType(T.LongType()))]))


def only_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("tokens") if "tokens" in docs.columns else tokenized(docs)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about ``RUN`` tokens, each with its ``tokens``: hashes, and where rows begin among them."""
    offsets, lo = column(batch, "tokens").offsets.to_numpy(), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN, side="right")) - 1)
        key = column(batch, "tokens").values[offsets[lo]:offsets[hi]].to_numpy()
        yield batch.slice(lo, hi - lo), key, (offsets[lo:hi + 1] - offsets[lo]).astype(np.int64)
        lo = hi
    give_back()


def joined(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of a string, from those of it without its first token and without its last."""
    return mix(last * np.uint64(0x9E3779B97F4A7C15) + first)


@F.pandas_udf(T.LongType())
def joined_column(last: pd.Series, first: pd.Series) -> pd.Series:
    return pd.Series(joined(last.to_numpy(np.int64).view(np.uint64), first.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def levels(key: np.ndarray, begin: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For sizes 1 to ``depth``: places of tokens (an end before each row not counted) that have a context of that size,
    its number, and that of the string one token later."""
    n = len(begin) - 1
    row = row_of(begin)
    s = np.full(len(key) + n, END_TOKEN, np.int64)
    s[np.arange(len(key)) + row + 1] = key
    s = s.view(np.uint64)
    since = np.arange(len(s)) - np.repeat(begin[:-1] + np.arange(n), np.diff(begin) + 1)
    owner = np.repeat(np.arange(n), np.diff(begin) + 1)
    for size in range(1, depth + 1):
        at = np.flatnonzero(since >= size)
        yield owner[at], s[at - 1], s[at]
        longer = np.zeros_like(s)
        longer[1:] = joined(s[1:], s[:-1])
        s = longer


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[(keys >> np.uint64(64 - FILTER_WORDS)).astype(np.int64)] >> (keys & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(keys: DataFrame, name: str) -> np.ndarray:
    """Keys as bits of a table of fixed size; at most 2^21 rows reach the driver, however many keys there are."""
    rows = (keys.groupBy(F.shiftrightunsigned(name, 64 - FILTER_WORDS).cast("int").alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits")).toArrow())
    out = np.zeros(1 << FILTER_WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts added up by the first key, which determines the others."""
    order = np.argsort(keys[0])
    k = keys[0][order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return [x[order[first]] for x in keys], np.add.reduceat(counts[order], first) if len(k) else counts


def folded(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Occurrences (columns of keys, the first one telling them apart) counted within the task; at most about ``HELD`` are held."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    pending = 0

    def merged() -> tuple[list[np.ndarray], np.ndarray]:
        return summed([np.concatenate(x) for x in zip(*(keys for keys, _ in held))], np.concatenate([n for _, n in held]))

    def out() -> Iterator[pa.RecordBatch]:
        keys, n = merged()
        for lo in range(0, len(n), 1 << 17):
            cut = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([*(pa.array(k[cut].view(np.int64)) for k in keys), pa.array(n[cut])], names=[*names, "n"])

    for keys in parts:
        if not len(keys[0]):
            continue
        held.append(summed(keys, np.ones(len(keys[0]), np.int64)))
        pending += len(held[-1][1])
        if pending > HELD:
            held = [merged()]
            pending = len(held[0][1])
            if pending > HELD // 2:
                yield from out()
                held, pending = [], 0
    if held:
        yield from out()


def token_counts(docs: DataFrame) -> DataFrame:
    """``key`` (hash), ``n`` of every distinct token of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded(([key] for batch in batches for _, key, _ in runs(batch)), ["key"])

    return only_tokens(docs).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def following(batch: pa.RecordBatch, size: int, bits: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Strings, contexts of ``size`` tokens that are in the filter, and strings of ``size`` tokens that end one later."""
    for _, key, begin in runs(batch):
        *_, (_, ctx, last) = levels(key, begin, size)
        some = in_filter(bits, ctx)
        ctx, last = ctx[some], last[some]
        yield [joined(last, ctx), ctx, last]


def string_counts(docs: DataFrame, size: int, contexts: np.ndarray, parts: int, segment_bits: int, least: int, few: bool) -> DataFrame:
    """``ctx, last, n``, stored: contexts of ``size`` tokens in the filter with the string of ``size`` tokens that ends one later, if found ``least`` times.

    Where they are ``few``, they are counted at once, without the run that tells which may come often enough.
    """
    docs, sc = only_tokens(docs), docs.sparkSession.sparkContext
    bits = sc.broadcast(contexts)
    often = sc.broadcast(None if few else repeated(docs, lambda batch: (found[0] for found in following(batch, size, bits.value)), parts, segment_bits, least))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        may: Filter | None = often.value
        for batch in batches:
            for found in following(batch, size, bits.value):
                if may is not None:
                    some = may.has(found[0])
                    found = [x[some] for x in found]
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in folded(kept(batches), ["string", "ctx", "last"]):
            yield b.select(["ctx", "last", "n"])

    counts = docs.mapInArrow(run, "ctx long, last long, n long").groupBy("ctx", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = stored(counts, f"strings-{size}")
    for b in (bits, often):
        b.destroy()
    return counts


def largest(rows: DataFrame, value: str, most: int) -> DataFrame:
    """The rows of largest ``value`` (1 or more), at most ``most``: whole steps of a fine logarithmic scale.

    The steps are counted first (at most some 2,000), so no task ever holds the best of all tasks.
    """
    step = F.floor(F.log2(F.greatest(F.col(value).cast("double"), F.lit(1.0))) * 32).cast("int")
    room, least = most, None
    for r in sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    return rows.where(F.lit(False)) if least is None else rows.where(step >= least)


def smoothed(n: Column, total: Column, p: Column, prior: Column) -> Column:
    return (n + prior * p) / (total + prior)


def shares(train: int) -> int:
    """Some 4 MB of text for each."""
    return max(1 << max(train >> 19, 1).bit_length(), 16)


def learn(docs: DataFrame, words: DataFrame, train: int, floor: float, depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN,
          least_string: int = LEAST_STRING, weight: float = WEIGHT) -> DataFrame | None:
    """The tree as numbers by key: ``key, n, value``, the logarithms to add where a text has that context (its number's
    complement is the key) or that string (its number). ``words`` are the counts of the ``train`` tokens of ``docs``. None without contexts."""
    parts = shares(train)
    segment_bits = max(min(1 << (2 * train).bit_length(), STRING_BITS) // parts, 64)
    shorter = words.select(F.col("key").alias("last"), ((F.col("n") + 1) / F.lit(floor)).alias("p"))
    often = words.select(F.col("key").alias("ctx"), F.col("n").alias("times"))
    found, steps = [], []
    n, total, p, prior, rest = (F.col(c) for c in ("n", "total", "p", "prior", "rest"))
    for size in range(1, depth + 1):
        often = often.where(F.col("times") >= least_count)
        bits = bit_filter(often, "ctx")
        if not bits.any():
            break
        found_at_most = often.agg(F.sum("times")).first()[0]
        counts = string_counts(docs, size, bits, parts, segment_bits, least_string, found_at_most < train // FEW)
        shape = (counts.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(often, "ctx")
                 .select("ctx", "total", (F.col("times") - total).alias("rest"), (weight * F.col("kinds") + F.col("times") - total).alias("prior")))
        rated = stored(counts.join(shape, "ctx").join(shorter, "last"), f"rated-{size}")
        own = F.sum(n * F.log(smoothed(n - 1, total - 1, p, prior) / p))
        others = F.first(rest * F.log(prior / (total + prior)))
        kept = stored(rated.groupBy("ctx").agg((own + others).alias("gain"), F.first("total").alias("total"), F.first("prior").alias("prior"))
                      .where(F.col("gain") >= least_gain).select("ctx", "total", "prior"), f"kept-{size}")
        level = stored(rated.join(kept.select("ctx", F.lit(True).alias("kept")), "ctx", "left")
                       .select(joined_column("last", "ctx").alias("string"), "n", "p", "prior", F.coalesce("kept", F.lit(False)).alias("kept"),
                               F.when(F.col("kept"), smoothed(n, total, p, prior)).otherwise(p).alias("q")), f"level-{size}")
        dropped(counts, rated)
        steps += [kept, level]
        found.append(kept.select(F.bitwise_not("ctx").alias("key"), total.alias("n"), F.log10(prior / (total + prior)).alias("value")))
        found.append(level.where("kept").select(F.col("string").alias("key"), "n", F.log10(1 + n / (prior * p)).alias("value")))
        shorter = level.select(F.col("string").alias("last"), F.col("q").alias("p"))
        often = level.select(F.col("string").alias("ctx"), F.col("n").alias("times"))
    if not found:
        return None
    tree = stored(reduce(DataFrame.unionAll, found), "tree")
    dropped(*steps)
    return tree


def score(docs: DataFrame, mod: int = 7, remainder: int = 2, depth: int = DEPTH, frequent: int = FREQUENT, least_count: int = LEAST_COUNT,
          least_gain: float = LEAST_GAIN, least_string: int = LEAST_STRING, weight: float = WEIGHT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text.

    Learns from the documents whose ``crc32(doc_id) mod 7`` is not 2. A null or empty text is one end
    token. Repeated rows are scored each. Without training text every count is 0, and both scores are 0.
    """
    spark = docs.sparkSession
    with shuffles_removed(spark):
        docs = stored(tokenized(keyed(docs).withColumn("held_out", held_out(mod, remainder)), "doc_id", "held_out"), "tokens", **{"parquet.dictionary.page.size": DICTIONARY})
        training = docs.where("not held_out")
        words = stored(token_counts(training), "token-counts")
        seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
        train, floor = int(seen["N"]), float(seen["N"] + seen["V"] + 1)
        numbers = words.select("key", "n", F.log10(F.col("n") + 1).alias("base"), F.lit(0.0).alias("value"), F.lit(1).alias("known"))
        bits = np.zeros(1 << FILTER_WORDS, np.uint64)
        tree = learn(training, words, train, floor, depth, least_count, least_gain, least_string, weight)
        if tree is not None:
            bits = bit_filter(tree, "key")
            numbers = numbers.unionAll(tree.select("key", "n", F.lit(0.0).alias("base"), "value", F.lit(0).alias("known")))
        top = largest(numbers, "n", frequent).toArrow()
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, bits, *(top.column(c).to_numpy() for c in ("key", "base", "value", "known"))))

    shift = 65 - shares(train).bit_length()
    found = (_scored(docs, shared, depth, floor, shift).unionAll(numbers.mapInArrow(_dealt(shift), BUNDLES))
             .repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_resolved, BUNDLES)
             .repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_summed, "doc_id long, held_out boolean, n_tokens long, known long, base double, value double"))
    return found.select(public_id(), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
                        F.col("base").alias("base_score"), (F.col("base") + F.col("value")).alias("score"))


class Numbers:
    """Rows by 64-bit key: most are found at the slot of their first bits, those that share a slot in a sorted list."""

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys).bit_length() + 2, 4)
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.key, self.row = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.key[0] = -1  # empty slots hold a key of another slot
        self.key[slot[first]], self.row[slot[first]] = keys[first], first
        left = np.setdiff1d(np.arange(len(keys)), first)
        self.more = left[np.argsort(keys[left])]
        self.sorted = keys[self.more]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.row[slot], -1)
        if len(self.sorted):
            miss = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.sorted, keys[miss]), len(self.sorted) - 1)
            out[miss] = np.where(self.sorted[at] == keys[miss], self.more[at], -1)
        return out


_MODEL: dict[str, tuple] = {}


def _model(shared: Broadcast) -> tuple:
    name, bits, keys, *values = shared.value
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = (bits, Numbers(keys), *values)
    return _MODEL[name]


#: kinds of bundles: numbers by key, rare keys with the rows that have them; rows with their sums over frequent keys, and over rare ones
NUMBERS, RARE, ROWS, SUMS = range(4)
#: first ones are dealt by the first bits of a key, the others by slots of 2^13 rows
BUNDLES, SLOT = "part long, kind int, data array<binary>", 13


def bundle(part: int, kind: int, *arrays: np.ndarray) -> dict:
    """Arrays of one part, compressed; of their numbers the first bytes stand together, then the second ones and so on."""
    press = zstandard.ZstdCompressor(level=1)
    return {"part": part, "kind": kind, "data": [press.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]}


def opened(data: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The arrays of a bundle."""
    plain = (np.frombuffer(zstandard.ZstdDecompressor().decompress(d), np.uint8) for d in data)
    return [np.ascontiguousarray(a.reshape(np.dtype(k).itemsize, -1).T).reshape(-1).view(k) for a, k in zip(plain, kinds)]


def batch_of(bundles: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(bundles, schema=pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.list_(pa.binary()))]))


def by_part(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(part, first, last and one more) for sorted keys: parts are their first bits."""
    part = (keys >> keys.dtype.type(shift)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
    yield from ((int(part[lo]), lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi > lo)


def _dealt(shift: int):
    """Numbers by key, dealt to parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            keys, base, value, known = (t.column(c).to_numpy() for c in ("key", "base", "value", "known"))
            order = np.argsort(keys.view(np.uint64))
            keys, base, value, known = keys.view(np.uint64)[order], base[order], value[order], known[order].astype(np.int8)
            return batch_of([bundle(p, NUMBERS, np.diff(keys[lo:hi], prepend=np.uint64(0)), base[lo:hi], value[lo:hi], known[lo:hi]) for p, lo, hi in by_part(keys, shift)])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return run


def _rare(rows: np.ndarray, keys: np.ndarray, shift: int) -> pa.RecordBatch:
    """Each key with the rows that have it, once for every time, dealt to parts."""
    order = np.argsort(keys)
    keys, rows = keys[order], rows[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(new, len(keys))
    keys, least = keys[new], rows.min()
    rows = (rows - least).astype(np.uint32)
    return batch_of([bundle(p, RARE, np.diff(keys[lo:hi], prepend=np.uint64(0)), np.diff(ends[lo:hi + 1]).astype(np.uint32),
                            rows[ends[lo]:ends[hi]], np.array([least])) for p, lo, hi in by_part(keys, shift)])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bundles by key, numbers first: sums over rare keys, as bundles by slots of rows."""
    part, numbers, table = None, [], None
    held, pending = [], 0

    def merged() -> list[np.ndarray]:
        rows, *sums = (np.concatenate(x) for x in zip(*held))
        rows, at = np.unique(rows, return_inverse=True)
        return [rows, *(np.bincount(at, x) for x in sums)]

    def out(rows: np.ndarray, known: np.ndarray, base: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        place, known = (rows & ((1 << SLOT) - 1)).astype(np.uint16), known.astype(np.uint32)
        return batch_of([bundle(slot, SUMS, place[lo:hi], known[lo:hi], base[lo:hi], value[lo:hi]) for slot, lo, hi in by_part(rows, SLOT)])

    for batch in batches:
        for here, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kind == ROWS:
                slot, *data = data
                yield batch_of([{"part": int.from_bytes(slot, "little"), "kind": ROWS, "data": data}])
                continue
            if here != part:
                part, numbers, table = here, [], None
            if kind == NUMBERS:
                keys, *rest = opened(data, "u8", "f8", "f8", "i1")
                numbers.append([np.cumsum(keys, dtype=np.uint64), *rest])
                continue
            if table is None and numbers:
                table = [np.concatenate(x) for x in zip(*numbers)]
                order = np.argsort(table[0])
                table, numbers = [x[order] for x in table], []
            if table is None:
                continue
            keys, counts, rows, least = opened(data, "u8", "u4", "u4", "i8")
            keys = np.cumsum(keys, dtype=np.uint64)
            at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
            at = np.repeat(np.where(table[0][at] == keys, at, -1), counts)
            hit = at >= 0
            at, rows = at[hit], rows[hit]
            if not len(rows):
                continue
            found = np.flatnonzero(np.bincount(rows))
            held.append([found + least[0], *(np.bincount(rows, table[c][at])[found] for c in (3, 1, 2))])
            pending += len(found)
            if pending > HELD:
                held = [merged()]
                pending = len(held[0][0])
                if pending > HELD // 2:
                    yield out(*held[0])
                    held, pending = [], 0
        give_back()
    if held:
        yield out(*merged())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bundles by slots of rows: the rows with all their sums."""
    slot, docs, sums = None, [], None

    def out() -> Iterator[pa.RecordBatch]:
        for place, doc, apart, n, *by in docs:
            known, base, value = (x + more[place] for x, more in zip(by, sums))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(apart.astype(bool)), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(value)],
                                             names=["doc_id", "held_out", "n_tokens", "known", "base", "value"])

    for batch in batches:
        for here, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if here != slot:
                yield from out()
                slot, docs, sums = here, [], np.zeros((3, 1 << SLOT))
            if kind == ROWS:
                docs.append(opened(data, "u2", "i8", "i1", "i8", "i8", "f8", "f8"))
            else:
                place, *more = opened(data, "u2", "u4", "f8", "f8")
                for total, x in zip(sums, more):
                    total[place] += x   # a place comes once in a bundle
    yield from out()


def _scored(docs: DataFrame, shared: Broadcast, depth: int, floor: float, shift: int) -> DataFrame:
    """Bundles of rows with their sums over frequent keys and, to be passed on, their slots; and of the other keys of these rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits, numbers, base, value, known = _model(shared)
        task = TaskContext.get().partitionId()
        number, part = task << 40, task % (1 << (64 - shift))
        held, pending = [], 0
        for batch in batches:
            for b, key, begin in runs(batch):
                n = len(begin) - 1
                sums = [-np.diff(begin) * np.log10(floor), np.zeros(n), np.zeros(n)]

                def look(owner: np.ndarray, keys: np.ndarray) -> int:
                    at = numbers.find(keys)
                    hit = at >= 0
                    for total, by in zip(sums, (base, value, known)):
                        total += np.bincount(owner[hit], by[at[hit]], n)
                    held.append((number + owner[~hit], keys[~hit].view(np.uint64)))
                    return len(held[-1][0])

                pending += look(row_of(begin), key)
                if bits.any():
                    for owner, ctx, last in levels(key, begin, depth):
                        some = in_filter(bits, ~ctx)
                        owner, ctx, last = owner[some], ctx[some], last[some]
                        pending += look(owner, (~ctx).view(np.int64))
                        string = joined(last, ctx)
                        some = in_filter(bits, string)
                        pending += look(owner[some], string[some].view(np.int64))
                rows = number + np.arange(n)
                fields = [(rows & ((1 << SLOT) - 1)).astype(np.uint16), longs(b, "doc_id"), column(b, "held_out").to_numpy(zero_copy_only=False).astype(np.int8), np.diff(begin),
                          sums[2].astype(np.int64), sums[0], sums[1]]
                some = [(slot, bundle(part, ROWS, *(x[lo:hi] for x in fields))) for slot, lo, hi in by_part(rows, SLOT)]
                yield batch_of([{**x, "data": [slot.to_bytes(8, "little"), *x["data"]]} for slot, x in some])
                number += n
                if pending > HELD:
                    yield _rare(*(np.concatenate(x) for x in zip(*held)), shift)
                    held, pending = [], 0
        if pending:
            yield _rare(*(np.concatenate(x) for x in zip(*held)), shift)

    return docs.mapInArrow(run, BUNDLES)
