"""Operator 6: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all training text, labelled or not, is the
unlabelled set, in which a share ``prior`` (estimated from the training labels) is toxic too. A
linear classifier in numpy minimises the risk ``prior * R_P+ + max(0, R_U- - prior * R_P-)``: where the
unlabelled part would turn negative, the step goes the other way instead, so positives hidden among
the unlabelled are not learned as clean. Features are words and word beginnings, present or not; the
few that tell positives from unlabelled text best are kept: those of which, at the prior, most
documents would be toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsetrail.llm.common import LOWER, NULL_ID, column, held_out, keyed, public_id, slices, span_hashes, stored, text_buffer

#: bounds of the samples that the classifier is fitted on, and of its features
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 1024
BEGINNINGS = (4, 5)
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters (a-z and bytes beyond ASCII) of lower-cased data."""
    inside = np.concatenate([[False], LETTER[data], [False]])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    edge = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    both = cut[inside[cut] & inside[cut + 1]] if len(cut) else cut  # a run that goes on in the next row
    if len(both):
        starts, ends = np.sort(np.append(starts, both)), np.sort(np.append(ends, both))
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash): whole words and their first bytes."""
    data = LOWER[data]
    starts, ends, row = letter_runs(data, offsets)
    rows, out = [row], [span_hashes(data, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts >= n
        rows.append(row[long])
        out.append(span_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
    return np.concatenate(rows), np.concatenate(out)


def sampled(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """Training rows as ``positive`` (1 or 0) and distinct ``features``; and the class prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(5, 0))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"] or 0.0
    shuffled = F.xxhash64("doc_id", F.lit(6))
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(shuffled, "doc_id").limit(positives).withColumn("positive", F.lit(1))
    rest = docs.where(~held_out(5, 0) & (F.col("doc_id") != NULL_ID)).select("doc_id").orderBy(shuffled, "doc_id").limit(unlabelled).withColumn("positive", F.lit(0))
    chosen = toxic.unionAll(rest.distinct())  # at most positives + unlabelled ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                row, f = features(*text_buffer(column(b, "text")))
                pairs = np.unique(np.stack([row.astype(np.uint64), f], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0].astype(np.int64), minlength=b.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(b, "positive"), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[:, 1].copy().view(np.int64)))],
                                                 names=["positive", "features"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInArrow(run, "positive int, features array<long>")
    return stored(rows, "toxicity-sample"), float(share)


class Classifier:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.keys.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, f = features(data, offsets)
        maybe = self.hint[(f >> np.uint64(44)).astype(np.int64)]
        row, f = row[maybe], f[maybe].view(np.int64)
        margin = np.full(n, self.bias)
        if len(f) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = self.keys[at] == f
            pair = np.unique(row[hit].astype(np.int64) * len(self.keys) + at[hit])
            margin += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Non-negative risk with the logistic loss, by Adam on the whole sample."""
    p, u = x[positive], x[~positive]
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def grad(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope @ rows, slope.sum()) / len(rows)

    for t in range(1, steps + 1):
        gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        unlabelled = grad(u, su) - prior * grad(p, sp)
        g = prior * grad(p, sp - 1) + unlabelled if negative >= 0 else -unlabelled
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, size: int = FEATURES) -> Classifier | None:
    """The classifier, or none without a confirmed toxic document; ``size`` features and the samples reach the driver."""
    rows, prior = sampled(docs, labels, positives, unlabelled)
    n = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(1, 0), n.get(0, 0)
    if not n_p or not n_u:
        return None
    seen = rows.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    a, b = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt(a * (1 - a) / n_p + b * (1 - b) / n_u) + 1.0 / n_p
    # prior * a / b estimates how many of the documents with the feature are toxic; a is taken low, as few examples may deceive
    low = (F.col("p") - 1.0 * F.sqrt("p")) / n_p
    telling = (F.col("p") > 2) & (prior * low >= 0.5 * b)
    best = seen.where(telling).withColumn("z", (a - b) / spread).orderBy(F.desc("z"), "f").limit(size).toArrow()
    keys = np.sort(best.column("f").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = column(b, "features")
            flat, ends = lists.flatten().to_numpy(), np.asarray(lists.offsets)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(shared.value, flat), max(len(shared.value) - 1, 0))
            hit = shared.value[at] == flat if len(shared.value) else np.zeros(len(flat), bool)
            total = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays([column(b, "positive"), pa.ListArray.from_arrays(pa.array(total[ends].astype(np.int32)), pa.array(at[hit].astype(np.int32)))],
                                             names=["positive", "features"])

    sample = rows.mapInArrow(run, "positive int, features array<int>").toArrow()
    lists = sample.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    x = np.zeros((len(lists), len(keys)), np.float32)
    x[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
    weights, bias = fit(x, sample.column("positive").to_numpy() == 1, prior)
    return Classifier(keys, weights, bias)


def rate(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, carried columns, ``held_out, score, predicted`` of every text.

    Labels are read only where ``crc32(doc_id) mod 5`` is not 0. A null or empty text has no features
    and gets the score of the bias. Without a confirmed toxic document every score is 0.
    """
    docs = keyed(docs, *[c for c in carry if c != "text"]).withColumn("held_out", held_out(5, 0))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select("doc_id", "text"), labels))
    kept = ["doc_id", *[c for c in carry if c != "text"], "text", "held_out"] if "text" in carry else ["doc_id", *carry, "held_out"]
    schema = docs.select(*kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                s = model.value.score(*text_buffer(column(b, "text"))) if model.value else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*(column(b, c) for c in kept), pa.array(s)], names=[*kept, "score"])

    out = docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)
    return out.select(public_id(), *[c for c in carry], "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
