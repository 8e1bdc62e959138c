"""Helpers shared by the text operators: inputs, Arrow text buffers, words, stored steps, groups in a stream.

Conventions of every operator here, unless its docstring says otherwise:

* only ``doc_id`` and ``text`` (and what the docstring names) are read, so other columns, whatever
  their names, never clash;
* a null text counts as empty; a null ``doc_id`` is kept, sorts before all others and comes back null;
* rows that repeat a ``doc_id`` are given back once each; those that also repeat its text are one document;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsetrail.session import fresh_path

#: stands for a null id inside an operator
NULL_ID = -(2**63)
#: bytes of text that a task works on at once
SLICE = 1 << 19
#: bytes that separate words: space and 0x09-0x0D
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: lower-cases A-Z and leaves every other byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (never null, see ``NULL_ID``), ``text`` and the columns named."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.col("text").cast("string").alias("text"), *more)


def paired(docs: DataFrame, *more: str) -> DataFrame:
    """As ``keyed``, with ``twin``, a 64-bit hash of the text: it tells documents apart that share an id, as those of null ids do."""
    return keyed(docs, *more).withColumn("twin", F.xxhash64("text"))


def public_id(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


def held_out(mod: int, remainder: int) -> Column:
    """Does crc32 of the id, as text, leave this remainder? A null id is never held out."""
    c = F.col("doc_id")
    return F.when(c == NULL_ID, False).otherwise(F.crc32(c.cast("string").cast("binary")) % mod == remainder)


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write a step to the shared folder and read it back: cuts lineage, survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*steps: DataFrame) -> None:
    """Delete ``stored`` steps that nothing will read again."""
    for df in steps:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset:]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the machine: workers outlive their tasks, and what they keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes not ``apart``), and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_TABLE = np.random.default_rng(20011).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_STEP), -1, 2**64))
        for name, factor in (("up", _STEP), ("down", inverse)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each ``data[start:end]`` among the distinct ones, these); spans follow one another. Numbers are exact: equal bytes, equal numbers."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    bounds = np.empty(2 * n, np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    found = spans.dictionary_encode()  # spans, and the gaps between them
    number = found.indices.to_numpy()[::2]
    used = np.zeros(len(found.dictionary), bool)
    used[number] = True
    return (np.cumsum(used) - 1)[number], found.dictionary.take(pa.array(np.flatnonzero(used)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of 64 bits of each ``data[start:end]``; spans follow one another, and each distinct one is hashed once."""
    number, distinct = coded(data, starts, ends)
    if not len(distinct):
        return np.zeros(0, np.uint64)
    _, offsets, raw = distinct.buffers()
    cuts, raw = np.frombuffer(offsets, np.int64)[distinct.offset:distinct.offset + len(distinct) + 1].tolist(), raw.to_pybytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[lo:hi]) for lo, hi in zip(cuts, cuts[1:])), np.uint64, len(distinct))[number]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, from running sums; equal bytes give equal hashes anywhere.

    For features, and where equal hashes are verified: certain unlike spans of regular structure share one.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_of(first_word: np.ndarray) -> np.ndarray:
    """The row of every word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))


def group_starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows but the first whose key differs from the row before."""
    new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for k in keys:
        v = rows.column(rows.schema.get_field_index(k))
        new |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False) if isinstance(v, pa.Array) else pc.not_equal(v[1:], v[:-1]).to_numpy()
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[pa.Table]:
    """From batches sorted by ``keys`` (never null): tables of about ``least`` rows, or one key's rows, in which no key is cut.

    A batch is looked at once, whatever its key holds already.
    """
    def cut(t: pa.Table) -> Iterator[pa.Table]:
        begin = np.concatenate([[0], group_starts(t, keys), [t.num_rows]])
        lo = 0
        while lo < t.num_rows:
            hi = int(begin[min(np.searchsorted(begin, lo + least), len(begin) - 1)])
            yield t.slice(lo, hi - lo)
            lo = hi

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        begin = group_starts(b, keys)
        if held:
            edge = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]).combine_chunks()
            if len(group_starts(edge, keys)):
                begin = np.append(0, begin)
        end = int(begin[-1]) if len(begin) else 0
        if len(begin) and rows + end >= least:
            yield from cut(pa.Table.from_batches([*held, b.slice(0, end)]))
            held, rows = [], 0
            b = b.slice(end)
        held.append(b)
        rows += b.num_rows
    if held:
        yield from cut(pa.Table.from_batches(held))


#: rows that Spark hands to Python at once: texts may be long, and its default of 10,000 makes batches of 50 MB and more
BATCH_ROWS = 2000


def importable(spark: SparkSession) -> None:
    """Let executors import this package where neither their path nor their folder holds it.

    Also lowers Spark's rows per Arrow batch to ``BATCH_ROWS`` unless the session has a smaller number.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    import os
    import shutil
    import tempfile

    import pulsetrail

    sc, package = spark.sparkContext, os.path.dirname(os.path.abspath(pulsetrail.__file__))
    root = os.path.dirname(package)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or os.path.exists("pulsetrail") or getattr(sc, "_pulsetrail_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="pulsetrail-code-")  # stays: executors that start later fetch it too
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "pulsetrail"), "zip", root, "pulsetrail"))
    sc._pulsetrail_sent = True
