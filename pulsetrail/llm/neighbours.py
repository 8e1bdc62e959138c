"""Operator 10: nearest neighbours by inner product with multiprobe p-stable hashing.

Inner products become distances by one more component that brings every vector to the largest norm.
Each of ``tables`` tables projects on ``functions`` random Gaussian directions (a 2-stable law) and
rounds to cells; a vector lies in the bucket of its cells. A query visits buckets in the order of
their estimated success: the squared distances, over all directions, from its projection to the
cells, summed; it goes on until the buckets seen so far hold ``visit`` of the vectors of a table,
judged by the buckets' counts. Candidates of all tables are merged and ranked by their exact product
in double precision.

Equal vectors are one entry that carries its smallest ids, as many as an answer can need, so a very
common vector costs no more than another. Buckets are read in blocks of bounded size, with as many
blocks as the bucket needs, so none is capped and none is one task's burden.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsetrail.llm.common import column, longs, stored, whole_groups

TABLES, FUNCTIONS, CELL, VISIT = 4, 6, 2.0, 0.40
#: rows of a bucket that are compared at once, on either side
BLOCK = 4096
#: what a task may have of buckets' counts: no more buckets than this are told apart in a table
CELLS = 3


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Hashing:
    """``tables`` x ``functions`` projections; a cell is the rounded projection, the outer cells being open."""

    def __init__(self, size: int, norm: float, spread: float, tables: int, functions: int, cell: float):
        rng = np.random.default_rng(size * 1009 + 10)
        self.a = rng.standard_normal((tables, functions, size + 1))
        self.width = max(cell * spread, 1e-12)
        self.b = rng.uniform(0, self.width, (tables, functions))
        self.norm = norm

    def project(self, x: np.ndarray) -> np.ndarray:
        """Places in cells: [row, table, function]; 1.5 is the middle of the middle cell."""
        more = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        y = np.einsum("nd,tfd->ntf", np.column_stack([x, more]), self.a, optimize=True)
        return (y + self.b - self.width / 2) / self.width + CELLS / 2

    def query(self, x: np.ndarray) -> np.ndarray:
        y = np.einsum("nd,tfd->ntf", np.column_stack([x, np.zeros(len(x))]), self.a, optimize=True)
        return (y + self.b - self.width / 2) / self.width + CELLS / 2


def buckets(place: np.ndarray) -> np.ndarray:
    cells = np.clip(np.floor(place), 0, CELLS - 1).astype(np.int64)
    return cells @ CELLS ** np.arange(place.shape[-1])


def probes(place: np.ndarray, counts: np.ndarray, visit: float) -> list[np.ndarray]:
    """For every query of one table: buckets in the order of estimated success until they hold ``visit`` of the rows."""
    n, f = place.shape
    score = np.zeros((n, 1))
    edges = np.arange(CELLS)
    for k in range(f):  # the first function is the lowest digit
        p = place[:, k, None]
        low = np.where(edges == 0, -np.inf, edges)
        high = np.where(edges == CELLS - 1, np.inf, edges + 1)
        gap = np.maximum(np.maximum(low - p, p - high), 0) ** 2
        score = (score[:, None, :] + gap[:, :, None]).reshape(n, -1)
    score[:, counts == 0] = np.inf
    order = np.argsort(score, axis=1, kind="stable")
    held = np.cumsum(counts[order], axis=1)
    stop = (held < visit * counts.sum()).sum(axis=1) + 1
    return [order[i, :min(s, int((counts > 0).sum()))] for i, s in enumerate(stop)]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * x).sum(axis=-1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, functions: int = FUNCTIONS, cell: float = CELL,
            visit: float = VISIT, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query (``vec_id`` divisible by ``every``).

    ``vectors`` has ``vec_id`` and ``embedding``. Rows with a null id or an unusable vector take no part.
    Vectors of different lengths are never compared. Ties go to the smaller id; an id that comes
    twice with the same vector counts once. A small table has its buckets visited as far as ``k``
    asks: with at most ``8 * k`` vectors of a length all are compared.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are equal
    # an entry for each distinct vector, named by its least id
    nth = Window.partitionBy("v").orderBy("id")
    entries = stored(rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1).groupBy("v")
                     .agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "v").join(entries.select("v", "entry"), "v").select("query_id", "entry")
    asked = stored(asked, "queries")
    seekers = entries.join(asked.select("entry").distinct(), "entry").select("entry", "v")

    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = entries.select(F.size("v").alias("d"), norm2.alias("n2")).groupBy("d").agg(F.max("n2").alias("most"), F.avg("n2").alias("mean"), F.count("*").alias("n")).collect()
    hashing = {r["d"]: Hashing(r["d"], float(np.sqrt(r["most"])), float(np.sqrt(r["most"])), tables, functions, cell) for r in stats}
    shared = spark.sparkContext.broadcast(hashing)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(column(b, "v")):
                got = buckets(shared.value[d].project(x))
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * tables, d)), pa.array(np.tile(np.arange(tables), n)), pa.array(got.ravel()),
                     *(column(b, c).take(pa.array(np.repeat(at, tables))) for c in ("entry", "ids", "v"))], names=["d", "t", "bucket", "entry", "ids", "v"])

    index = stored(entries.mapInArrow(place, "d long, t long, bucket long, entry long, ids array<long>, v array<double>"), "index")
    sizes = index.groupBy("d", "t", "bucket").agg(F.count("*").alias("n")).collect()  # at most 3 ** functions buckets a table and length
    counts = {(d, t): np.zeros(CELLS**functions, np.int64) for d in hashing for t in range(tables)}
    for r in sizes:
        counts[r["d"], r["t"]][r["bucket"]] = r["n"]
    known = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in by_length(column(b, "v")):
                at_place = shared.value[d].query(x)
                for t in range(tables):
                    n = known.value[d, t]
                    share = max(visit, min(1.0, 8 * k / max(n.sum(), 1)))
                    for lo in range(0, len(at), 256):
                        found = probes(at_place[lo:lo + 256, t], n, share)
                        which = np.repeat(at[lo:lo + 256], [len(f) for f in found])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(which), d)), pa.array(np.full(len(which), t)), pa.array(np.concatenate(found)),
                             *(column(b, c).take(pa.array(which)) for c in ("entry", "v"))], names=["d", "t", "bucket", "entry", "v"])

    visits = seekers.mapInArrow(probe, "d long, t long, bucket long, entry long, v array<double>")
    # blocks: part i of a bucket's rows meets part j of its visitors
    sized = index.groupBy("d", "t", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asking = visits.groupBy("d", "t", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("shares"))
    grid = stored(sized.join(asking, ["d", "t", "bucket"]), "grid")
    left = (index.join(grid, ["d", "t", "bucket"]).withColumn("i", F.pmod(F.xxhash64("entry"), "parts").cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("d", "t", "bucket", "i", "j", F.lit(0).alias("side"), "entry", "ids", "v"))
    right = (visits.join(grid, ["d", "t", "bucket"]).withColumn("j", F.pmod(F.xxhash64("entry"), "shares").cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("d", "t", "bucket", "i", "j", F.lit(1).alias("side"), "entry", F.array().cast("array<long>").alias("ids"), "v"))
    keys = ["d", "t", "bucket", "i", "j"]
    met = left.unionAll(right).repartition(*keys).sortWithinPartitions(*keys, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 1 << 12):
            key = np.stack([table.column(c).to_numpy() for c in keys])
            cut = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), table.num_rows)
            side, entry = table.column("side").to_numpy(), table.column("entry").to_numpy()
            lists = table.column("ids").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            weight = np.asarray(lists.value_lengths())
            flat, start = lists.flatten().to_numpy(), np.cumsum(weight) - weight
            vectors = table.column("v").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            values, begin = vectors.flatten().to_numpy(), np.asarray(vectors.offsets) - np.asarray(vectors.offsets)[0]
            for lo, hi in zip(cut[:-1], cut[1:]):
                mid = lo + int((side[lo:hi] == 0).sum())
                if mid in (lo, hi):
                    continue
                d = int(key[0, lo])
                x, q = values[begin[lo]:begin[mid]].reshape(-1, d), values[begin[mid]:begin[hi]].reshape(-1, d)
                for s in range(0, len(q), 512):
                    product = q[s:s + 512] @ x.T
                    # all that may be among the k + 1 best once rounding is undone
                    top = min(k + 5, product.shape[1])
                    best = np.argpartition(-product, top - 1, axis=1)[:, :top] if top < product.shape[1] else np.tile(np.arange(top), (len(product), 1))
                    rows = np.repeat(np.arange(len(product)), top)
                    cols = best.ravel()
                    score = exact(q[s + rows], x[cols])
                    at = lo + cols
                    n = weight[at]
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    ids = flat[np.repeat(start[at], n) + inside]
                    who, value = np.repeat(entry[mid + s + rows], n), np.repeat(score, n)
                    order = np.lexsort((ids, -value, who))
                    w = who[order]
                    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                    place_in = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
                    keep = order[place_in <= k]
                    yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(ids[keep]), pa.array(value[keep])], names=["entry", "vec_id", "score"])

    found = met.mapInArrow(compare, "entry long, vec_id long, score double").groupBy("entry", "vec_id").agg(F.max("score").alias("score"))
    near = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    lists = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("entry", "vec_id", "score")
    answer = asked.join(lists, "entry").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answer.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of each length: (length, their rows, matrix)."""
    n = np.asarray(vectors.value_lengths())
    offsets, values = np.asarray(vectors.offsets), vectors.values.to_numpy(zero_copy_only=False)
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield int(d), at, values[offsets[at][:, None] + np.arange(d)]
