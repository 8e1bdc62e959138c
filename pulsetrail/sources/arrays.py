"""Reading files that hold one JSON array each, split into its elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: a part of a file as one task reads it; what it holds is bounded by ``spark.sql.files.maxPartitionBytes``
SPLIT = ["file", "block"]
CORRUPT = "_corrupt_record"


def _unescaped(marks: np.ndarray, slashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of ``marks`` that an even number of backslashes precedes; ``first`` are the places where fragments begin."""
    new = np.append(True, np.diff(slashes) > 1) | np.isin(slashes, first)
    begin = slashes[np.maximum.accumulate(np.where(new, np.arange(len(slashes)), 0))]
    at = np.searchsorted(slashes, marks) - 1    # the backslash before a mark
    behind = (at >= 0) & (slashes[at] == marks - 1) & ~np.isin(marks, first)
    return marks[~(behind & ((marks - begin[at]) % 2 == 1))]


def _marks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every fragment its quotes, and its opening braces outside strings where it starts outside (row 0) and inside one (row 1)."""
    texts, n = texts.cast(pa.large_string()), len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    quotes, braces, slashes = (np.flatnonzero(data == ord(c)) for c in '"{\\')
    if len(slashes):
        quotes, braces = (_unescaped(m, slashes, offsets[:-1]) for m in (quotes, braces))
    before = np.searchsorted(quotes, offsets)
    fragment = np.searchsorted(offsets, braces, side="right") - 1
    within = (np.searchsorted(quotes, braces) - before[fragment]) % 2
    return np.diff(before), np.stack([np.bincount(fragment[within == side], minlength=n) for side in (0, 1)])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First and last row (not included) of each split in a batch: a task reads one after the other."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(2):
        v = batch.column(k)
        new |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    yield from zip(cuts[:-1], cuts[1:])


def _steps(quotes: np.ndarray, opens: np.ndarray, odd: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(does a fragment's brace close an object, the depth after it) for fragments that follow ``odd`` quotes at ``depth``; then both behind them."""
    after = odd + np.cumsum(quotes)
    inside = np.append(odd, after[:-1]) % 2
    closes = after % 2 == 0
    depths = depth + np.cumsum(np.where(inside == 1, opens[1], opens[0]) - closes)
    return closes, depths, int(after[-1]) % 2, int(depths[-1])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows a split, for a start outside and inside a string: is its number of quotes odd, the change of depth, and at which depths how many braces close."""
    key, state = None, []

    def row() -> Iterator[pa.RecordBatch]:
        for start, (odd, depth, closed) in enumerate(state):
            yield pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "start": start, "odd": odd != start, "change": depth,
                                               "depths": list(closed), "counts": list(closed.values())}], schema=_SUMMARY)

    for batch in batches:
        if not batch.num_rows:
            continue
        quotes, opens = _marks(batch.column(2))
        for lo, hi in _runs(batch):
            here = tuple(batch.column(k)[lo].as_py() for k in range(2))
            if here != key:
                yield from row()
                key, state = here, [(0, 0, {}), (1, 0, {})]
            for start, (odd, depth, closed) in enumerate(state):
                closes, depths, odd, depth = _steps(quotes[lo:hi], opens[:, lo:hi], odd, depth)
                for d, n in zip(*(x.tolist() for x in np.unique(depths[closes], return_counts=True))):
                    closed[d] = closed.get(d, 0) + n
                state[start] = odd, depth, closed
    yield from row()


_SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("odd", pa.bool_()), ("change", pa.int64()),
                      ("depths", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _splits(parts: DataFrame) -> DataFrame:
    """What precedes every split in its file: is the number of quotes ``odd``, the ``depth``, the number of whole elements (``element``). One row a split."""
    both = parts.mapInArrow(_summaries, "file string, block long, start int, odd boolean, change long, depths array<long>, counts array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda amount: F.coalesce(F.sum(amount).over(earlier), F.lit(0))
    column = lambda name: F.col(f"s.{name}")
    splits = (both.groupBy(*SPLIT).agg(F.array_sort(F.collect_list(F.struct("start", "odd", "change", "depths", "counts"))).alias("starts"))
              .withColumn("at", (before(F.col("starts")[0]["odd"].cast("int")) % 2).cast("int"))
              .select(*SPLIT, F.col("at").alias("odd"), F.element_at("starts", F.col("at") + 1).alias("s"))
              .withColumn("depth", before(column("change"))))
    ends = F.coalesce(F.try_element_at(F.map_from_arrays(column("depths"), column("counts")), -F.col("depth")), F.lit(0))
    return splits.withColumn("ends", ends).select(*SPLIT, "odd", "depth", before(F.col("ends")).alias("element"))


def _pieces(whole: bool):
    """Elements that lie within one split, or, if not ``whole``, the pieces at the borders of splits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun, odd, depth, element = None, [], True, 0, 0, 0

        def out(texts: pa.Array, first: int) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]).take(pa.array(np.zeros(n, np.int64))), pa.array(np.full(n, key[1])),
                                               pa.array(first + np.arange(n)), texts], names=[*SPLIT, "element", "value"])

        def left() -> Iterator[pa.RecordBatch]:
            if held and not whole:
                yield out(_joined(pa.concat_arrays(held), np.zeros(0, np.int64)), element)

        for batch in batches:
            if not batch.num_rows:
                continue
            quotes, opens = _marks(batch.column(2))
            for lo, hi in _runs(batch):
                here = tuple(batch.column(k)[lo].as_py() for k in range(2))
                if here != key:
                    yield from left()
                    key, held, begun = here, [], here[1] == 0
                    odd, depth, element = (batch.column(k)[lo].as_py() for k in (3, 4, 5))
                closes, depths, odd, depth = _steps(quotes[lo:hi], opens[:, lo:hi], odd, depth)
                ends = np.flatnonzero(closes & (depths == 0)) + 1
                texts = batch.column(2).slice(lo, hi - lo)
                if not len(ends):
                    held.append(texts)
                    continue
                last, skip = int(ends[-1]), 0 if begun else 1
                if whole:
                    texts_of = _joined(pa.concat_arrays([*held, texts.slice(0, last)]), ends[:-1] + sum(map(len, held)))
                    yield out(texts_of.slice(skip), element + skip)
                elif skip:
                    yield out(_joined(pa.concat_arrays([*held, texts.slice(0, int(ends[0]))]), np.zeros(0, np.int64)), element)
                held, begun, element = [texts.slice(last)] if last < hi - lo else [], True, element + len(ends)
        yield from left()

    return run


def _joined(fragments: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Fragments between cuts as one text each, with the braces they were cut at."""
    offsets = np.concatenate([[0], cuts, [len(fragments)]]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), fragments), "}")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, element`` (number in the file, from 0) and ``value`` (text) of every object in the arrays.

    Files are cut at closing braces, as Spark's reader cuts lines, so one file is read by many tasks.
    Whether a fragment starts inside a string is the parity of the quotes before it, its depth the
    braces outside strings before it, its element the ends at depth 0 before it: sums within a split,
    that a task takes as it reads, and, with one row a split, over the splits of a file. So only
    elements that lie in several splits are shuffled. Elements that
    aren't objects are left out; what follows the last whole element is one element of its own.
    """
    meta = F.col("_metadata")
    # no brace follows a lone backslash in JSON, so no escape crosses a cut
    parts = (spark.read.option("lineSep", "}").text(path)
             .select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value"))
    # a row a split of files that the driver lists anyway
    known = parts.join(F.broadcast(_splits(parts)), SPLIT).select(*SPLIT, "value", "odd", "depth", "element")
    form = "file string, block long, element long, value string"
    pieces = F.array_sort(F.collect_list(F.struct("block", "value")))
    cut = (known.mapInArrow(_pieces(whole=False), form).groupBy("file", "element")
           .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "}").alias("value")))
    elements = known.mapInArrow(_pieces(whole=True), form).select("file", "element", "value").unionAll(cut)
    text = F.regexp_replace("value", r"^[\s,\[﻿]+", "")
    return elements.select("file", "element", F.concat(text, F.lit("}")).alias("value")).filter(F.startswith("value", F.lit("{")))


def read_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of JSON array files; an unreadable one is kept as text in ``_corrupt_record`` if the schema has it."""
    rows = array_elements(spark, path).select(
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("row"))
    return rows.select("row.*")
