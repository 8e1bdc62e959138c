"""Operator 4: removing passages that a smaller ``doc_id`` already has, by seed and extend.

Seeds are winnowed anchors of eight words. Documents are joined on them (``repeats``); each seed is
extended over the windows around it, for all documents that share it at once, by ordering their
contexts instead of comparing pairs; neighbouring hits are joined to maximal repeats, and those of
at least ``width`` words are removed wherever a smaller ``doc_id`` has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsetrail.llm.common import column, paired, public_id
from pulsetrail.llm.repeats import find, removed, unsqueezed, with_ranges, word_kind

WIDTH = 50


def remove_passages(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, spans`` (maximal removed runs, in words) and ``kept`` (kept words joined by one space).

    Words are the runs between spaces and 0x09-0x0D, unchanged. Texts of fewer than ``width`` words
    stay whole; a null or empty text has none. Passages repeated within one document stay. Rows that
    repeat a ``doc_id`` and its text count as one document. Different texts of null ids are
    documents in order of their hashes; those of another id leave one another whole.
    """
    kind = word_kind(width)
    docs = paired(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                size, gone, spans, kept = [], [], [], []
                for z, ranges in zip(column(part, "z").to_pylist(), column(part, "ranges").to_pylist()):
                    words = unsqueezed(z).split()
                    size.append(len(words))
                    if ranges:
                        mask = removed(ranges, len(words), width)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        gone.append(int(mask.sum()))
                        spans.append([{"start": a, "end": e} for a, e in edge.reshape(-1, 2).tolist()])
                        words = [words[i] for i in np.flatnonzero(~mask).tolist()]
                    else:
                        gone.append(0)
                        spans.append([])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    out = with_ranges(docs, find(docs, kind)).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept string")
    return out.select(public_id(), "n_words", "n_removed", "spans", "kept")
