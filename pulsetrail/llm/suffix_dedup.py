"""Operator 3: removing later copies of byte strings by longest previous factors.

A byte goes if a string of ``width`` bytes over it also starts earlier: in a smaller ``doc_id``, or
earlier in the same document; different texts of one id, as of null, are documents in order of their hashes. ``repeats`` cuts the corpus into pieces so that equal strings meet;
in each set of pieces the windows that may have an equal are put into suffix order, the previous and
next smaller positions in it give their longest previous factors, and those that reach ``width`` are
later copies (``repeats.late_windows``). Runs equal to an earlier run as a whole need no such look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsetrail.llm.common import column, paired, public_id
from pulsetrail.llm.repeats import byte_kind, find, removed, unsqueezed, with_ranges

WIDTH = 100


def remove_copies(docs: DataFrame, width: int = WIDTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, carried columns, ``n_bytes``, ``n_removed``, ``spans`` (array of start and end, maximal removed runs), ``kept`` (binary).

    Texts shorter than ``width`` stay whole. A null or empty text has no bytes; ``kept`` is null only
    for a null text. ``width`` is at least 24.
    """
    kind = byte_kind(width)
    docs = paired(docs, *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                size, gone, spans, kept = [], [], [], []
                for z, ranges in zip(column(part, "z").to_pylist(), column(part, "ranges").to_pylist()):
                    raw = unsqueezed(z)
                    mask = removed(ranges, len(raw), width) if ranges else None
                    size.append(len(raw))
                    if mask is None:
                        gone.append(0)
                        spans.append([])
                        kept.append(None if z is None else raw)
                        continue
                    data = np.frombuffer(raw, np.uint8)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    gone.append(int(mask.sum()))
                    spans.append([{"start": a, "end": e} for a, e in edge.reshape(-1, 2).tolist()])
                    kept.append(data[~mask].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(column(part, c) for c in ("doc_id", *carry)), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", *carry, "n_bytes", "n_removed", "spans", "kept"])

    found = with_ranges(docs, find(docs, kind), *carry)
    out = found.mapInArrow(run, schema + ", n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.select(public_id(), *carry, "n_bytes", "n_removed", "spans", "kept")
