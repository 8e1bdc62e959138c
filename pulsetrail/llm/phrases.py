"""Operator 11: phrase collocations, counted by double-array tries of Apriori-safe candidates.

A phrase can only be frequent if all phrases inside it are. Level by level, tasks count hashes of
words, then of pairs of frequent words, then of triples of frequent pairs; the hashes are shuffled as
packed arrays, and those that reach the least count set bits of a filter of bounded size. Unlike
phrases that share a hash only let more through, so nothing frequent is lost. Phrases that pass are
the candidates. One more run over the text finds them: a task packs the distinct ones of about
``HELD`` with how often it saw each, by part of the hash, and the packs are shuffled. A part's
candidates are laid out in double-array tries over exact word numbers, of at most ``TRIE`` entries
each, and the tries add up what was seen. Only these exact counts enter the result. So the text is
run over four times, however many candidates there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from pulsetrail.llm import double_array
from pulsetrail.llm.common import LOWER, coded, column, group_starts, mix, row_of, slices, stored, text_buffer, word_bounds

#: fixed values: what ends a piece, and what separates words besides
ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: words of a phrase, occurrences of a candidate, percent of a phrase's occurrences inside a longer one that drop it, phrases reported per language
LONGEST, LEAST, INSIDE, REPORTED = 3, 10, 50, 2000
#: bits of a hash beyond its part: a part has some 200,000 different ones, however large the input
LOW_BITS = 24
#: entries of a trie, bits of a filter, hashes or phrases that a task holds, text that a task works on at once
TRIE, FILTER_BITS, HELD, RUN = 1_250_000, 1 << 29, 1 << 20, 2 << 20
UNKNOWN = "und"

END = np.zeros(256, bool)
END[list(ENDS)] = True
APART = END.copy()
APART[list(GAPS)] = True
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of text: exact numbers into ``distinct``, their rows, and which are followed by a word of the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_buffer(column(batch, "text"))
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets, APART)
        self.row, n = row_of(first), len(starts)
        langs = column(batch, "lang").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[self.row]
        if not n:
            self.code, self.distinct, self.joined = np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, bool)
            return
        self.code, self.distinct = coded(data, starts, ends)
        before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(END[data], out=before[1:])
        self.joined = np.zeros(n, bool)
        self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (before[starts[1:]] == before[ends[:-1]])

    def hashes(self) -> np.ndarray:
        """Of every word with its language."""
        word = np.array([xxhash.xxh3_64_intdigest(w) for w in self.distinct.to_pylist()], np.uint64)
        lang = np.array([xxhash.xxh3_64_intdigest(v) for v in self.langs.to_pylist()], np.uint64)
        return mix(word[self.code] ^ lang[self.lang] * SPREAD) if len(self.code) else word


class Filter:
    """Bits of hashes that reached the least count, in equal segments by the hash's first bits; two bits a hash, none is missed."""

    def __init__(self, parts: int, segment_bits: int, bits: np.ndarray):
        self.parts, self.segment_bits, self.bits = parts, segment_bits, bits

    @staticmethod
    def probes(key: np.ndarray, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
        g, inside = mix(key * SPREAD), np.uint64(segment_bits - 1)
        return (g & inside).astype(np.int64), ((g >> np.uint64(32)) & inside).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        key = keys(h, self.parts)
        base = (key >> np.uint64(LOW_BITS)).astype(np.int64) * self.segment_bits
        out = np.ones(len(h), bool)
        for p in self.probes(key, self.segment_bits):
            p += base
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def keys(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash's part, and ``LOW_BITS`` more."""
    return h >> np.uint64(64 - LOW_BITS - (parts.bit_length() - 1))


def written(low: np.ndarray) -> bytes:
    """Ascending numbers of ``LOW_BITS``: all first bytes, which compress well, then the other two of each."""
    return (low >> 16).astype(np.uint8).tobytes() + low.astype(np.uint16).tobytes()


def read(raw: bytes) -> np.ndarray:
    n = len(raw) // 3
    return (np.frombuffer(raw, np.uint8, n).astype(np.uint32) << np.uint32(16)) | np.frombuffer(raw, np.uint16, n, n)


def chains(words: Words, filters: list[Filter]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of words, then of pairs, then of triples whose parts pass the filters so far."""
    h = words.hashes()
    yield np.arange(len(h)), h
    if not filters:
        return
    ok = filters[0].has(h)
    at = np.flatnonzero(words.joined[:-1] & ok[:-1] & ok[1:]) if len(h) else np.zeros(0, np.int64)
    pair = mix(h[at] * np.uint64(3) + mix(h[at + 1]))
    yield at, pair
    if len(filters) < 2:
        return
    ok = filters[1].has(pair)
    at, pair = at[ok], pair[ok]
    next_too = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
    yield at[next_too], mix(pair[next_too] * np.uint64(5) + mix(h[at[next_too] + 2]))


def packed(held: list[np.ndarray], parts: int, least: int) -> pa.RecordBatch:
    """A row per part: sorted hashes, and how often each was seen, at most ``least``."""
    key, many = np.unique(keys(np.concatenate(held), parts), return_counts=True)
    many = np.minimum(many, least).astype(np.min_scalar_type(least))
    part, low = (key >> np.uint64(LOW_BITS)).astype(np.int64), (key & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32)
    which = np.unique(part)
    ends = np.append(np.searchsorted(part, which), len(part))
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([written(low[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()),
                                       pa.array([many[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["part", "hashes", "seen"])


def frequent(docs: DataFrame, filters: list, level: int, parts: int, segment_bits: int, least: int) -> Filter:
    """The filter of phrases of ``level`` words; ``filters`` are broadcasts of those of shorter ones."""
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        have = [f.value for f in filters]
        for b in slices(batch, limit=RUN):
            *_, (_, h) = chains(Words(b), have)
            yield h

    return repeated(docs, hashes, parts, segment_bits, least)


def repeated(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], parts: int, segment_bits: int, least: int) -> Filter:
    """The filter of the hashes found ``least`` times or more in all batches; none of them is missed."""
    kind = np.min_scalar_type(least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for h in hashes(batch):
                held.append(h)
                n += len(h)
                if n >= HELD:
                    yield packed(held, parts, least)
                    held, n = [], 0
        if n:
            yield packed(held, parts, least)

    def folded(low: list[np.ndarray], seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, where = np.unique(np.concatenate(low), return_inverse=True)
        return key, np.minimum(np.bincount(where, np.concatenate(seen)), least).astype(kind)

    def segment(part: int, low: list[np.ndarray], seen: list[np.ndarray]) -> pa.RecordBatch:
        key, many = folded(low, seen)
        key = key[many >= least].astype(np.uint64) | np.uint64(part << LOW_BITS)
        bits = np.zeros(segment_bits, bool)
        for p in Filter.probes(key, segment_bits):
            bits[p] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, seen, n = None, [], [], 0
        for b in batches:
            for part, x, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                if part != now and now is not None:
                    yield segment(now, low, seen)
                    low, seen, n = [], [], 0
                now = part
                low.append(read(x))
                seen.append(np.frombuffer(y, kind))
                n += len(low[-1])
                if n > 2 * len(low[0]) + HELD:
                    low, seen = ([v] for v in folded(low, seen))
                    n = len(low[0])
        if now is not None:
            yield segment(now, low, seen)

    rows = docs.mapInArrow(hashed, "part int, hashes binary, seen binary").repartition("part").sortWithinPartitions("part")
    bits = np.zeros(parts * segment_bits // 8, np.uint8)
    size = segment_bits // 8
    for b in rows.mapInArrow(merged, "part int, bits binary").toArrow().to_batches():  # at most FILTER_BITS bits
        for part, segment_of in zip(b.column(0).to_pylist(), b.column(1)):
            bits[part * size:(part + 1) * size] = np.frombuffer(segment_of.as_buffer(), np.uint8)
    return Filter(parts, segment_bits, bits)


def candidates(docs: DataFrame, filters: list, parts: int) -> DataFrame:
    """``part, lang, phrases, seen, n``: what tasks found of the words, pairs and triples that pass the filters, and how often; and per language rows of part -1 whose ``n`` counts all words.

    Tasks pack what they have found by part of the hash, sorted and compressed, so that a phrase costs a few bytes of shuffle a task.
    All places of a phrase share their hashes, so they pass together and its counts are exact.
    """
    def bundles(held: list[tuple], texts: list[pa.Array], names: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        word, lang = (pa.concat_arrays(x).dictionary_encode() for x in (texts, names))
        order = pc.sort_indices(word.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)  # 0 is behind a phrase's end
        rank = np.append(rank[word.indices.to_numpy()], 0)
        part, of, *at, seen = (np.concatenate(x) for x in zip(*held))
        group = part.astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()[of]
        at = [rank[x] for x in at]
        row = np.lexsort((*at[::-1], group))
        group, at = group[row], [x[row] for x in at]
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (group, *at)])))
        seen = np.add.reduceat(seen[row], first).astype(np.uint32)
        group, spoken = group[first], word.dictionary.take(pa.array(order))
        phrase = pc.binary_join_element_wise(*(spoken.take(pa.array(x[first] - 1, mask=x[first] == 0)) for x in at), pa.scalar(" ", pa.large_string()), null_handling="skip")
        cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        press = zstandard.ZstdCompressor(level=3)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cut), phrase), pa.scalar("\n", pa.large_string()))  # no word holds a newline
        packed, many = ([press.compress(x) for x in y] for y in ((x.as_buffer() for x in joined), (seen[lo:hi].tobytes() for lo, hi in zip(cut, cut[1:]))))
        group = group[cut[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array((group // len(lang.dictionary)).astype(np.int32)), lang.dictionary.take(pa.array(group % len(lang.dictionary))),
                                          pa.array(packed, pa.binary()), pa.array(many, pa.binary()), pa.nulls(len(group), pa.int64())], names=["part", "lang", "phrases", "seen", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [f.value for f in filters]
        held, texts, names, rows, words, many = [], [], [], 0, 0, 0
        for batch in batches:
            for b in slices(batch, limit=RUN):
                w = Words(b)
                total = np.bincount(w.lang, minlength=len(w.langs))
                langs = w.langs.cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), -1, np.int32)), langs, pa.nulls(len(total), pa.binary()), pa.nulls(len(total), pa.binary()), pa.array(total)],
                                                 names=["part", "lang", "phrases", "seen", "n"])
                for size, ((at, h), f) in enumerate(zip(chains(w, have[:-1]), have), 1):
                    ok = f.has(h)
                    at, part = at[ok], (h[ok] >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int32)
                    if not len(at):
                        continue
                    # distinct by exact numbers
                    number, below = w.lang[at], len(w.langs)
                    for k in range(size):
                        if below * len(w.distinct) >= 1 << 63:
                            number = np.unique(number, return_inverse=True)[1]
                            below = len(number)
                        number, below = number * len(w.distinct) + w.code[at + k], below * len(w.distinct)
                    _, first, seen = np.unique(number, return_index=True, return_counts=True)
                    at, part = at[first], part[first]
                    held.append((part, w.lang[at] + many, *(w.code[at + k] + words if k < size else np.full(len(at), -1) for k in range(LONGEST)), seen))
                    rows += len(at)
                texts.append(w.distinct.cast(pa.large_binary()).cast(pa.large_string()))
                names.append(langs)
                words, many = words + len(w.distinct), many + len(langs)
                if rows >= HELD:
                    yield from bundles(held, texts, names)
                    held, texts, names, rows, words, many = [], [], [], 0, 0, 0
        if held:
            yield from bundles(held, texts, names)

    return docs.mapInArrow(run, "part int, lang string, phrases binary, seen binary, n long")


def spelled(phrases: pa.Array) -> list[pa.Array]:
    """First, second and third words; null behind a phrase's end."""
    words = pc.split_pattern(phrases, " ")
    begin, many, flat = np.asarray(words.offsets)[:-1], pc.list_value_length(words).to_numpy(), words.values
    return [flat.take(pa.array(begin + k, mask=many <= k)) for k in range(LONGEST)]


class Trie:
    """Entries ``lang, a, b, c`` (an Arrow table) as a double-array trie with a root per language."""

    def __init__(self, entries: pa.Table):
        langs = entries.column("lang").combine_chunks().dictionary_encode()
        parts = [entries.column(c).combine_chunks().cast(pa.large_string()) for c in ("a", "b", "c")]
        coded = pa.concat_arrays(parts).dictionary_encode()
        many = np.bincount(pc.drop_null(coded.indices).to_numpy(), minlength=len(coded.dictionary))
        order = np.argsort(-many, kind="stable")  # common words get low numbers, so their nodes are shared
        number = np.empty(len(order) + 1, np.int32)
        number[order], number[-1] = np.arange(len(order)), -1
        symbols = number[pc.fill_null(coded.indices, -1).to_numpy()].reshape(3, -1).T
        self.words = coded.dictionary.take(pa.array(order))
        self.langs = langs.dictionary
        self.size = entries.num_rows
        self.array = double_array.build(len(self.langs), langs.indices.to_numpy(), symbols)

    def count(self, lang: str, words: list[pa.Array], seen: np.ndarray, counts: np.ndarray) -> None:
        """Add to the entries how often they were seen, told by phrases of one language: their first, second and third words."""
        root = self.langs.to_pylist().index(lang)
        at, state = np.arange(len(seen)), np.full(len(seen), root, np.int32)

        def add() -> None:
            entry = self.array.entry[state[over]]
            counts[:] += np.bincount(entry[entry >= 0], seen[at[over]][entry >= 0], minlength=self.size).astype(np.int64)

        for column in words:
            over = ~column.is_valid().to_numpy(zero_copy_only=False)[at]
            add()
            at, state = at[~over], state[~over]
            code = pc.fill_null(pc.index_in(column, value_set=self.words), -1).to_numpy().astype(np.int64)
            known, digits = code[at] >= 0, double_array.digits(np.maximum(code, 0))
            at, state = at[known], state[known]
            for d in digits:
                alive, state = self.array.step(state, d[at])
                at, state = at[alive], state[alive]
        over = np.ones(len(at), bool)
        add()


def counted(found: DataFrame, least: int, trie: int) -> DataFrame:
    """``lang, a, b, c, f`` of the candidates seen ``least`` times or more, and a row without words whose ``n`` counts all words of the language.

    A part's phrases of a language are laid out in tries of at most ``trie`` entries, which add up what the tasks saw.
    """
    def unpacked(raw: list[tuple[bytes, bytes]]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        unpress, phrases, seen, rows = zstandard.ZstdDecompressor(), [], [], 0
        for k, (x, y) in enumerate(raw):
            phrases.append(pa.array(unpress.decompress(x).split(b"\n"), pa.large_binary()))
            seen.append(np.frombuffer(unpress.decompress(y), np.uint32))
            rows += len(seen[-1])
            if rows >= HELD or k == len(raw) - 1:
                yield pa.concat_arrays(phrases).cast(pa.large_string()), np.concatenate(seen)
                phrases, seen, rows = [], [], 0

    def told(lang: str, raw: list[tuple[bytes, bytes]], n: int) -> Iterator[pa.RecordBatch]:
        names = ["lang", "a", "b", "c", "f", "n"]
        if not raw:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), *[pa.nulls(1, pa.string())] * LONGEST, pa.array([0]), pa.array([n])], names=names)
            return
        distinct = None
        for phrases, _ in unpacked(raw):
            distinct = pc.unique(phrases if distinct is None else pa.concat_arrays([distinct, phrases]))
        for lo in range(0, len(distinct), trie):
            entries = spelled(distinct.slice(lo, trie))
            t = Trie(pa.table([pa.repeat(lang, len(entries[0])), *entries], names=names[:4]))
            counts = np.zeros(t.size, np.int64)
            for phrases, seen in unpacked(raw):
                t.count(lang, spelled(phrases), seen, counts)
            often = np.flatnonzero(counts >= least)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(often)), *[e.take(pa.array(often)).cast(pa.string()) for e in entries], pa.array(counts[often]), pa.repeat(0, len(often))], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw, n = None, [], 0
        for b in batches:
            for part, lang, phrases, seen, more in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (part, lang) != now and now is not None:
                    yield from told(now[1], raw, n)
                    raw, n = [], 0
                now = part, lang
                if phrases is None:
                    n += more
                else:
                    raw.append((phrases, seen))
        if now is not None:
            yield from told(now[1], raw, n)

    rows = found.repartition("part", "lang").sortWithinPartitions("part", "lang")
    return rows.mapInArrow(summed, "lang string, a string, b string, c string, f long, n long")


def scored(phrases: DataFrame, least: int, inside: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of candidates that no longer candidate mostly holds; ``phrases`` has all counts."""
    pairs = phrases.where(f"b is not null and c is null and f >= {least}")
    triples = phrases.where(f"c is not null and f >= {least}")
    word = phrases.where("b is null").select(F.col("lang").alias("wl"), F.col("a").alias("word"), F.col("f").alias("wf"))
    pair = pairs.select(F.col("lang").alias("pl"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("f").alias("pf"))

    def of_word(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.join(word, (F.col("lang") == F.col("wl")) & (F.col(name) == F.col("word"))).drop("wl", "word").withColumnRenamed("wf", out)

    def of_pair(df: DataFrame, one: str, two: str, out: str) -> DataFrame:
        return df.join(pair, (F.col("lang") == F.col("pl")) & (F.col(one) == F.col("pa")) & (F.col(two) == F.col("pb"))).drop("pl", "pa", "pb").withColumnRenamed("pf", out)

    def score(left: str, right: str):
        wide = {c: f"cast({c} as decimal(15,0))" for c in ("f", left, right)}
        return F.expr(f"(1000000BD * ({wide['f']} * {wide['f']})) div ({wide[left]} * {wide[right]})")

    longer = triples.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "f")
    longer = longer.groupBy(F.col("lang").alias("xl"), F.col("p.a").alias("xa"), F.col("p.b").alias("xb")).agg(F.max("f").alias("most"))
    two = of_word(of_word(pairs, "a", "l"), "b", "r").withColumn("score", score("l", "r"))
    two = two.join(longer, (F.col("lang") == F.col("xl")) & (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb")), "left")
    two = two.where(f"most is null or 100 * most < {inside} * f").select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    three = of_pair(of_pair(of_word(of_word(triples, "a", "l1"), "c", "r2"), "b", "c", "r1"), "a", "b", "l2")
    three = three.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    return two.unionByName(three.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                                        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score")))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, reported: int = REPORTED, trie: int = TRIE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``reported`` strongest phrases of two or three words.

    ``docs`` has ``text`` and ``lang``. A null text is empty; a null language is ``und``, together with
    documents that name it so; rows that repeat a document count again. A language without a phrase of
    ``least`` occurrences has no rows; an empty table gives none. Ties go by higher count, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    parts = min(max(1 << max(size >> 22, 1).bit_length(), 16), 1 << 20)  # some 4 MB of text for each
    share = spark.sparkContext.broadcast
    filters = []
    for level in range(1, LONGEST + 1):
        bits = min(1 << max(size >> (5 if level == 1 else 2), 1).bit_length(), filter_bits)
        filters.append(share(frequent(docs, filters, level, parts, max(bits // parts, 64), least)))
    counts = stored(counted(candidates(docs, filters, parts), least, trie), "phrase-counts")
    for f in filters:
        f.destroy()
    del filters[:], f  # their bits are kept by the driver until then
    every = counts.where("a is not null").drop("n")
    out = scored(every, least, inside)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of many shares first, so that no language is sorted in one task
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    for share in (F.col("share"), F.col("share") % 8):
        out = out.withColumn("k", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("k") <= reported)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    total = counts.where("a is null").select("lang", "n")
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
