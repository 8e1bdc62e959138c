"""Operator 7: SimHash near-duplicates with a byte-position inverted index and count filtering.

Fingerprints of at most three differing bits differ in at most three of their eight bytes, so they
share at least five bytes by position. Any three byte positions lie in one of the fourteen blocks of
the Steiner system S(3, 4, 8), so such a pair agrees on all four bytes of some other block: the index
lists every fingerprint under its fourteen positional quadruples, and no linked pair is missed.
Within a list, shared positional bytes are tallied, pairs with fewer than five are dropped, the rest
verified bit by bit. Equal fingerprints are one entry from the start. A list hands on a tree of real
links that joins what its pairs would join, so edges grow with entries, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail.llm.common import LOWER, NULL_ID, column, paired, public_id, slices, stored, text_buffer, whole_groups, word_bounds
from pulsetrail.llm.components import components

DISTANCE, SHINGLE, SEED = 3, 3, 42
#: four of eight byte positions whose numbers xor to zero, and all complements of those: every three lie in one
QUADRUPLES = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, twin, bits`` (long): a bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                data, offsets = text_buffer(column(b, "text"))
                data = LOWER[data]
                starts, ends, first = word_bounds(data, offsets)
                # words with one space after each
                length = ends - starts + 1
                begin = np.concatenate([[0], np.cumsum(length)])
                inside = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
                joined = np.full(begin[-1], 32, np.uint8)
                real = inside < np.repeat(length - 1, length)
                joined[real] = data[(np.repeat(starts, length) + inside)[real]]
                del inside, real
                words = np.diff(first)
                n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
                row = np.repeat(np.arange(len(n)), n)
                lo = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
                hi = np.minimum(lo + shingle, first[1:][row])
                raw = joined.tobytes()
                parts = map(raw.__getitem__, map(slice, begin[lo].tolist(), (begin[hi] - 1).tolist()))
                h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(row))
                out = np.zeros(len(n), np.uint64)
                some = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[some]
                for bit in range(64):
                    if len(some):
                        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at)
                        out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "twin"), pa.array(out.view(np.int64))], names=["doc_id", "twin", "bits"])

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "doc_id long, twin long, bits long")


def quadruple(bits: Column, block: tuple[int, ...]) -> Column:
    """The bytes at four positions, in place."""
    mask = sum(0xFF << 8 * p for p in block)
    return bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def linked(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Tally shared positional bytes, keep pairs that reach the guaranteed number, verify."""
    x = a ^ b
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    differ = np.bitwise_count((((x & low) + low) | x) & ~low)
    near = 8 - differ.astype(np.int64) >= 8 - distance
    near[near] = np.bitwise_count(x[near]) <= distance
    return near


def tree(bits: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (indices) that join what all links among these distinct fingerprints join; each is a real link."""
    left, out = np.arange(len(bits)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            seeds, front = front[:256], front[256:]
            new = []
            for s in seeds:
                near = linked(np.broadcast_to(bits[s], len(left)), bits[left], distance)
                if near.any():
                    hit = left[near]
                    out += [(int(s), int(h)) for h in hit]
                    new.append(hit)
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate([front, *new])
    return out


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges ``u, v`` (ids) between distinct fingerprints ``bits`` with their ids ``rep``."""
    keys = F.array(*[F.struct(F.lit(i).alias("block"), quadruple(F.col("bits"), q).alias("value")) for i, q in enumerate(QUADRUPLES)])
    index = prints.select("rep", "bits", F.explode(keys).alias("k")).select("k.block", "k.value", "rep", "bits")
    lists = index.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    listed = index.join(lists, ["block", "value"]).repartition("block", "value").sortWithinPartitions("block", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["block", "value"]):
            block, value = t.column("block").to_numpy(), t.column("value").to_numpy()
            rep, bits = t.column("rep").to_numpy(), t.column("bits").to_numpy().view(np.uint64)
            cut = np.append(np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (value[1:] != value[:-1]))), len(block))
            # lists of two are most: all at once
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            near = linked(bits[two], bits[two + 1], distance)
            out = [np.stack([rep[two[near]], rep[two[near] + 1]], 1)]
            for lo, hi in zip(cut[:-1][size > 2], cut[1:][size > 2]):
                found = tree(bits[lo:hi], distance)
                if found:
                    out.append(rep[lo:hi][np.array(found)])
            e = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])

    return listed.mapInArrow(run, "u long, v long").distinct()


def grouped(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, twin`` (see ``paired``), ``bits``, ``component`` (the group's key) and ``component_id`` (its smallest id) for every row.

    Fingerprints are the nodes, so an id of several texts, as null may be, links nothing.
    """
    if distance > 3:
        raise ValueError("the index guarantees links of at most three bits")
    marks = stored(fingerprints(paired(docs), shingle), "fingerprints")
    prints = stored(marks.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-prints")
    nodes = components(links(prints.select(F.col("bits").alias("rep"), "bits"), distance))
    named = stored(prints.join(nodes, prints["bits"] == nodes["node"], "left")
                   .select("bits", "least", F.coalesce("component", "bits").alias("component")), "named-prints")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marks.join(named.drop("least").join(ids, "component"), "bits")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, bits, component_id`` (the smallest id reachable over links, itself included) for every document.

    Texts without words (null and empty ones too) have fingerprint zero and are linked like any other;
    fewer than ``shingle`` words are one shingle. Different texts of one id, as of null, are documents
    of their own. ``distance`` is at most 3, for which the index is exact.
    """
    return grouped(docs, distance, shingle).select(public_id(), "bits", public_id("component_id"))


def firsts(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate group, as it came: that of the smallest id, of its texts the one of least hash."""
    best = grouped(docs, distance, shingle).groupBy("component").agg(F.min(F.struct("doc_id", "twin")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("kept_id"), F.col("b.twin").alias("kept_twin"))
    one = docs.withColumns({"kept_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "kept_twin": F.xxhash64(F.col("text").cast("string"))})
    keys = ["kept_id", "kept_twin"]
    return one.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)  # one shuffle for both
