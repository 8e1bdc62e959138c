"""Operator 9: encoding and decoding with a public word-level BPE vocabulary.

Frequent words are counted over the whole corpus, each task keeping its most frequent ones, and
compiled with their ids into a minimal acyclic transducer (``bpe.Lexicon``), at most ``WORDS`` words and
so a few MB. It is broadcast, and each executor maps it into memory from a file; words that it lacks are
merged exactly.
The choice of frequent words only changes speed: every text gets the ids of the vocabulary.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from pulsetrail.llm.bpe import Encoder, Lexicon, Spelling, merge_table
from pulsetrail.llm.common import column, keyed, longs, public_id, slices

WORDS = 1 << 16
TASK_WORDS = 1 << 15


def rows_of(batch: pa.RecordBatch) -> list[list[bytes]]:
    """The chunks of each text between spaces and 0x09-0x0D."""
    return [t.encode("utf-8", "replace").split() if t else [] for t in column(batch, "text").to_pylist()]


def frequent_pieces(docs: DataFrame, vocabulary: str, words: int = WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """The ``words`` most frequent pieces (``piece``, ``n``) of the texts.

    Every text is counted. A task hands on its ``task_words`` most frequent pieces, so what is
    shuffled is bounded by tasks, and a piece rare in each task may be missed: it is only slower then.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = merge_table(vocabulary), Counter()

        def top() -> Counter:
            return Counter(dict(held.most_common(task_words)))

        for batch in batches:
            for part in slices(batch):
                chunks = Counter()
                for r in rows_of(part):
                    chunks.update(r)
                keys = list(chunks)
                pieces, begin = table.pieces(keys)
                times = np.repeat(np.fromiter(chunks.values(), np.int64, len(keys)), np.diff(begin)).tolist()
                for p, n in zip(pieces, times):
                    held[p] += n
            if len(held) > 8 * task_words:
                held = top()
        best = [(p, n) for p, n in top().items() if p not in table.special]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in best], pa.string()),
                                          "n": pa.array([n for _, n in best], pa.int64())})

    return (docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "piece").limit(words))


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = WORDS) -> Lexicon:
    """The transducer of the frequent pieces; at most ``words`` of them reach the driver."""
    found = sorted(r.piece.encode() for r in frequent_pieces(docs, vocabulary, words).collect())
    ids, begin = merge_table(vocabulary).merge(found)
    return Lexicon.build(found, ids, begin)


_MAPPED: dict[str, Lexicon] = {}


def mapped(shared: Broadcast) -> Lexicon:
    """The lexicon that was broadcast, as a file of this executor mapped once into each Python worker."""
    name, raw = shared.value
    if name not in _MAPPED:
        _MAPPED.clear()
        with tempfile.NamedTemporaryFile(suffix=".lexicon") as f:  # the mapping outlives its name
            f.write(raw)
            f.flush()
            _MAPPED[name] = Lexicon.load(f.name)
    return _MAPPED[name]


def encode(docs: DataFrame, vocabulary: str, lexicon: Broadcast) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merge_table(vocabulary), mapped(lexicon))
        for batch in batches:
            for part in slices(batch):
                rows = rows_of(part)
                known = encoder.learn(rows)
                raw = [b"".join(map(known.__getitem__, r)) for r in rows]
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), ids], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, words: int = WORDS) -> DataFrame:
    """Encode every text and decode its ids again, as digests.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and
    ``decoded_sha256`` (the ids' strings joined by one space, as the vocabulary has no decoder).
    A null or empty text has no ids; both digests are then those of the empty string. Special
    strings in a text become their own ids.
    """
    docs = keyed(docs)
    lexicon = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, build_lexicon(docs, vocabulary, words).to_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merge_table(vocabulary), mapped(lexicon))
        strings = [n.encode() for n in encoder.table.names]
        names, decimals = Spelling(strings), Spelling([str(i).encode() for i in range(len(strings))])
        written: dict[bytes, bytes] = {}
        spelled: dict[bytes, bytes] = {}
        for batch in batches:
            for part in slices(batch):
                rows = rows_of(part)
                new = encoder.new_chunks(rows, written)
                if len(spelled) > len(written):
                    spelled = {c: spelled[c] for c in written}
                for lo in range(0, len(new), 1 << 15):
                    chunks = new[lo:lo + (1 << 15)]
                    ids, begin = encoder.encode_chunks(chunks)
                    written.update(zip(chunks, decimals.chunks(ids, begin)))
                    spelled.update(zip(chunks, names.chunks(ids, begin)))
                n, ids_sha, text_sha = [], [], []
                for r in rows:
                    ids = b"".join(map(written.__getitem__, r))
                    n.append(ids.count(b" "))
                    ids_sha.append(hashlib.sha256(ids[:-1]).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(spelled.__getitem__, r))[:-1]).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(longs(part, "doc_id")), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                                  pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .select(public_id(), "n_tokens", "ids_sha256", "decoded_sha256"))
