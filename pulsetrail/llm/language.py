"""Operator 8: language by unigrams of pieces, summed over all segmentations.

Words are split in every way into pieces of a fixed public vocabulary (and single bytes). For each
language a piece has a probability, and a word's probability is the sum over its segmentations,
which a forward pass gives; the piece probabilities come from expectation-maximisation (forward and
backward) on word counts of a bounded sample of labelled documents. All distinct words of a slice of
text are scored together, then added up by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from pulsetrail.llm.common import LOWER, column, held_out, keyed, public_id, slices, span_hashes, text_buffer
from pulsetrail.llm.toxicity import letter_runs

#: documents of a language, and its commonest words, that the model is fitted on
SAMPLE, WORDS = 1500, 20_000
LONGEST_PIECE, LONGEST_WORD = 10, 40
ROUNDS = 4
HAS_LETTER = regex.compile(r"\p{L}")


def public_pieces(path: str) -> list[bytes]:
    """Pieces of letters only, the word mark as a space; and every single byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            p = sp.id_to_piece(i).replace("▁", " ").encode()
            body = p[1:] if p[:1] == b" " else p
            if len(p) <= LONGEST_PIECE and all(97 <= b <= 122 or b >= 128 for b in body):
                found.add(p)
    return sorted(found)


class Pieces:
    """Where pieces lie in words; words are of equal arrays of bytes, ordered by length, each led by a space."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(size) - size
        h = span_hashes(raw, begin, begin + size)
        self.tables = []
        for n in range(1, LONGEST_PIECE + 1):
            at = np.flatnonzero(size == n)
            order = np.argsort(h[at])
            hint = np.zeros(1 << 18, bool)
            hint[(h[at] >> np.uint64(46)).astype(np.int64)] = True
            self.tables.append((h[at][order], at[order], hint))

    def lay(self, data: np.ndarray) -> np.ndarray:
        """For every position and length: the piece there, or ``count``."""
        out = np.full((LONGEST_PIECE, len(data) + 1), self.count, np.int32)
        at = np.arange(len(data))
        for n, (keys, index, hint) in enumerate(self.tables, 1):
            if len(keys) and len(data) >= n:
                h = span_hashes(data, at[:len(data) - n + 1], at[:len(data) - n + 1] + n)
                maybe = np.flatnonzero(hint[(h >> np.uint64(46)).astype(np.int64)])
                k = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[k] == h[maybe]
                out[n - 1, maybe[hit]] = index[k[hit]]
        return out


def forward(laid: np.ndarray, begin: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: words longest first; ``p`` has a row of zeros for no piece."""
    alpha = np.zeros((len(size), int(size.max(initial=0)) + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, alpha.shape[1]):
        live = int(np.searchsorted(-size, -j, side="right"))  # words of at least j bytes
        for n in range(1, min(j, LONGEST_PIECE) + 1):
            piece = laid[n - 1, begin[:live] + j - n]
            some = np.flatnonzero(piece < len(p) - 1)
            if len(some):
                alpha[some, j] += alpha[some, j - n] * p[piece[some]]
    return alpha


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased data, start, end, row) of letter runs; runs over ``LONGEST_WORD`` bytes are cut."""
    data = LOWER[data]
    starts, ends, row = letter_runs(data, offsets)
    parts = -(-(ends - starts) // LONGEST_WORD)
    if parts.max(initial=1) > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, row = np.repeat(starts, parts) + k * LONGEST_WORD, np.repeat(ends, parts), np.repeat(row, parts)
        ends = np.minimum(ends, starts + LONGEST_WORD)
    return data, starts, ends, row


def arranged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words longest first, each after a space: (order, data, begin, size)."""
    order = np.argsort(starts - ends, kind="stable")
    size = (ends - starts)[order] + 1
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    inside = np.arange(len(out)) - np.repeat(begin, size)
    real = inside > 0
    out[real] = data[(np.repeat(starts[order] - 1, size) + inside)[real]]
    return order, out, begin, size


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages = Pieces(pieces), languages
        self.p, self.log_prior = np.vstack([p, np.zeros(p.shape[1])]), np.log(prior)

    def log_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        order, flat, begin, size = arranged(data, starts, ends)
        laid = self.pieces.lay(flat)
        out = np.empty((len(starts), len(self.languages)))
        for lo in range(0, len(size), 1 << 15):
            s = size[lo:lo + (1 << 15)]
            alpha = forward(laid, begin[lo:lo + len(s)], s, self.p)
            out[order[lo:lo + len(s)]] = np.log(np.maximum(alpha[np.arange(len(s)), s], 1e-300))
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and its probability for every row."""
        data, starts, ends, row = words_of(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(starts):
            h = span_hashes(data, starts, ends)
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            each = self.log_words(data, starts[first], ends[first])
            for g in range(total.shape[1]):
                total[:, g] = np.bincount(row, each[which, g], len(total))
        total += self.log_prior
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def expectation_maximisation(pieces: Pieces, words: list[bytes], times: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from its words and how often each came."""
    size = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(size) - size
    order, flat, begin, size = arranged(raw, begin, begin + size)
    times = times[order].astype(float)
    laid = pieces.lay(flat)
    p = np.full(pieces.count, 1.0 / pieces.count)
    for _ in range(rounds):
        q = np.append(p, 0.0)[:, None]
        expected = np.zeros(pieces.count + 1)
        for lo in range(0, len(size), 1 << 15):
            s, b, t = size[lo:lo + (1 << 15)], begin[lo:lo + (1 << 15)], times[lo:lo + (1 << 15)]
            alpha = forward(laid, b, s, q)[:, :, 0]
            beta = np.zeros_like(alpha)
            i = np.arange(len(s))
            beta[i, s] = 1
            weight = t / np.maximum(alpha[i, s], 1e-300)
            for j in range(alpha.shape[1] - 2, -1, -1):
                for n in range(1, min(LONGEST_PIECE, alpha.shape[1] - 1 - j) + 1):
                    live = int(np.searchsorted(-s, -(j + n), side="right"))
                    piece = laid[n - 1, b[:live] + j]
                    got = q[piece, 0] * beta[:live, j + n]
                    beta[:live, j] += got
                    np.add.at(expected, piece, alpha[:live, j] * got * weight[:live])
        p = expected[:-1] + 0.02
        p /= p.sum()
    return p


def train(docs: DataFrame, vocabulary: str, sample: int = SAMPLE, words: int = WORDS) -> Model | None:
    """From ``lang`` and ``text`` of training rows: at most ``sample`` documents and ``words`` words a language."""
    docs = docs.where("lang is not null")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id")
    chosen = docs.select("lang", "doc_id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample).select("doc_id").distinct()
    some = docs.join(F.broadcast(chosen), "doc_id").select("lang", "text")  # sample x languages ids
    prior = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not prior:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                langs = column(b, "lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.uint64)
                data, starts, ends, row = words_of(*text_buffer(column(b, "text")))
                key = span_hashes(data, starts, ends) * np.uint64(len(names) + 1) + number[row]
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([names[int(number[row[i]])] for i in at], pa.string()),
                                                  pa.array([raw[starts[i]:ends[i]] for i in at], pa.binary()), pa.array(n)], names=["lang", "word", "n"])

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts = some.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counts.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= words).select("lang", "word", "n").collect()
    by: dict[str, list] = {lang: [] for lang in sorted(prior)}
    for r in rows:
        by[r["lang"]].append((bytes(r["word"]), r["n"]))
    pieces = public_pieces(vocabulary)
    laid = Pieces(pieces)
    p = [expectation_maximisation(laid, [w for w, _ in ws], np.array([n for _, n in ws])) if ws else np.full(len(pieces), 1 / len(pieces)) for ws in by.values()]
    share = np.array([prior[x] for x in by], float)
    return Model(pieces, list(by), np.array(p).T, share / share.sum())



def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every text.

    Learns from rows whose ``crc32(doc_id) mod 4`` is not 2 and whose ``lang`` is not null. ``und`` with
    score 0 where a text is null or has no letter, or where nothing could be learned. The score is the
    probability of the language among those learned.
    """
    docs = keyed(docs, F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(4, 2))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where("not held_out"), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for b in slices(batch):
                texts = column(b, "text").to_pylist()
                letters = np.array([bool(t) and HAS_LETTER.search(t) is not None for t in texts], bool)
                if m is None:
                    names, score = ["und"] * len(texts), np.zeros(len(texts))
                else:
                    best, score = m.predict(*text_buffer(column(b, "text")))
                    names = [m.languages[g] if ok else "und" for g, ok in zip(best.tolist(), letters)]
                    score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "held_out"), pa.array(names, pa.string()), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    out = docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
    return out.select(public_id(), "held_out", "lang_pred", "score")
