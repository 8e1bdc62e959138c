"""Operator 13: quality by votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of terms: its words, the shapes of its words (runs of letters, capitals, digits
and each other character, without their lengths), pairs of adjacent shapes, and whether a word
repeats the one before. Terms are weighted by the square root of their share of the document and by
inverse document frequency; the main directions of a bounded sample of labelled documents (a truncated
singular value decomposition) make the latent space. The sample's vectors and labels are broadcast;
tasks take the cosines of every document with all of them, in blocks, and the nearest vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsetrail.llm.common import LOWER, NULL_ID, column, held_out, keyed, mix, public_id, row_of, slices, span_hashes, stored, text_buffer, word_bounds

#: bounds of what is fitted and broadcast: labelled documents, terms, dimensions; then voters, documents of a block, and the score of a good document
SAMPLE, TERMS, DIMENSIONS, VOTERS, BLOCK, GOOD = 4000, 2048, 64, 25, 512, 0.3
#: documents of the sample that a term needs
RARE = 3

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
#: the kinds of terms, and how much each weighs
WORD, FORM, PAIR, AGAIN = np.uint64(1), np.uint64(2), np.uint64(3), np.uint64(4)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, share of the row's words) of all distinct terms of each row."""
    starts, ends, first = word_bounds(data, offsets)
    row = row_of(first)
    if not len(row):
        return row, np.zeros(0, np.uint64), np.zeros(0)
    kind = SHAPE[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    place = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(new, out=place[1:])
    shape = span_hashes(kind[new], place[starts], place[ends])
    word = span_hashes(LOWER[data], starts, ends)
    after = np.flatnonzero(row[1:] == row[:-1]) + 1
    again = (word[after] == word[after - 1]).astype(np.uint64)
    rows = np.concatenate([row, row, row[after], row[after]])
    h = np.concatenate([mix(word ^ WORD), mix(shape ^ FORM), mix(shape[after] * np.uint64(3) + mix(shape[after - 1]) ^ PAIR), mix(again * np.uint64(7) ^ AGAIN)])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(fresh)
    many = np.diff(np.append(at, len(h)))
    rows = rows[at]
    return rows, h[at], many / np.diff(first)[rows]


class Voters:
    """Terms with their weights, latent directions, and the labelled vectors of unit length."""

    def __init__(self, keys: np.ndarray, idf: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, voters: int):
        self.keys, self.idf, self.directions, self.vectors, self.labels, self.prior = keys, idf, directions, vectors, labels, prior
        self.voters = min(voters, len(labels))

    def bags(self, n: int, row: np.ndarray, h: np.ndarray, share: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(self.keys)), np.float32)
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            out[row[hit], at[hit]] = np.sqrt(share[hit]) * self.idf[at[hit]]
        return out

    def place(self, bags: np.ndarray) -> np.ndarray:
        v = bags @ self.directions
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, size, out=np.zeros_like(v), where=size > 1e-12)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean label of the nearest, weighted by similarity; all that tie with the last of them vote. Texts like none get the share of good labels."""
        n = len(offsets) - 1
        row, h, share = terms(data, offsets)
        out = np.full(n, self.prior)
        for k in range(0, n, BLOCK):
            a, z = np.searchsorted(row, [k, k + BLOCK])
            v = self.place(self.bags(min(BLOCK, n - k), row[a:z] - k, h[a:z], share[a:z]))
            near = v @ self.vectors.T
            last = np.partition(near, len(self.labels) - self.voters, axis=1)[:, len(self.labels) - self.voters, None]
            weight = np.where(near >= last, np.maximum(near, 0), 0).astype(np.float64)
            total = weight.sum(axis=1)
            some = total > 1e-9
            out[k:k + BLOCK][some] = np.clip((weight @ self.labels)[some] / total[some], 0, 1)
        return out


def sampled(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``label, row, hashes, shares`` of at most ``size`` labelled training documents, stored. An id with both labels isn't used; of texts of one id the smallest is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(5, 0))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    known = known.join(docs.where(F.col("doc_id") != NULL_ID).select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(size)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                row, h, share = terms(*text_buffer(column(b, "text")))
                ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(b, "label"), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(share))],
                                                 names=["label", "hashes", "shares"])

    return stored(texts.select("label", "text").mapInArrow(run, "label int, hashes array<long>, shares array<double>"), "votes-sample")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = TERMS, dimensions: int = DIMENSIONS, voters: int = VOTERS) -> Voters | None:
    """What the driver gets: ``size`` terms, and of each sampled document the shares of those."""
    rows = sampled(docs, labels, sample)
    n = rows.count()
    if not n:
        return None
    seen = rows.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    best = seen.where(F.col("df") >= min(RARE, n)).orderBy(F.desc("df"), "h").limit(size).toArrow()
    keys, df = best.column("h").to_numpy().view(np.uint64), best.column("df").to_numpy()
    order = np.argsort(keys)
    keys, idf = keys[order], np.log((1 + n) / (1 + df[order])) + 0.1
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, share = column(b, "hashes"), column(b, "shares").flatten().to_numpy()
            flat, ends = h.flatten().to_numpy().view(np.uint64), np.asarray(h.offsets) - h.offsets[0].as_py()
            hit = np.isin(flat, shared.value)
            total = pa.array(np.concatenate([[0], np.cumsum(hit)])[ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([column(b, "label"), pa.ListArray.from_arrays(total, pa.array(flat[hit].view(np.int64))), pa.ListArray.from_arrays(total, pa.array(share[hit]))],
                                             names=["label", "hashes", "shares"])

    found = rows.mapInArrow(run, rows.schema).toArrow().combine_chunks()
    lists = found.column("hashes").combine_chunks() if isinstance(found.column("hashes"), pa.ChunkedArray) else found.column("hashes")
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    y = found.column("label").to_numpy().astype(np.float64)
    model = Voters(keys, idf, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), y, float(y.mean()), voters)
    x = model.bags(n, np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().view(np.uint64), found.column("shares").combine_chunks().flatten().to_numpy())
    spread, directions = np.linalg.eigh((x.T @ x).astype(np.float64))  # ascending
    keep = spread > 1e-9 * max(spread[-1], 1e-30) if len(spread) else np.zeros(0, bool)
    model.directions = directions[:, keep][:, -dimensions:].astype(np.float32)
    model.vectors = model.place(x)
    return model


def vote(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **bounds: int) -> DataFrame:
    """``doc_id``, carried columns, ``held_out, score, predicted`` of every text.

    Labels are read only where ``crc32(doc_id) mod 5`` is not 0; null labels and labels of null ids are not
    used. A text without a known term (as null or empty ones) gets the share of good labels in the
    sample. Without a labelled document every score is 0.
    """
    docs = keyed(docs, *[c for c in carry if c != "text"]).withColumn("held_out", held_out(5, 0))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels, **bounds))
    kept = ["doc_id", *carry, "held_out"]
    schema = docs.select(*kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                s = model.value.score(*text_buffer(column(b, "text"))) if model.value else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*(column(b, c) for c in kept), pa.array(s)], names=[*kept, "score"])

    out = docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)
    return out.select(public_id(), *carry, "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
