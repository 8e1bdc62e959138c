"""Operator 1: packing documents into sequences by bin completion.

Only the lengths of pieces decide how they are packed, and there are at most ``capacity`` of them.
So Spark counts pieces per length, the driver packs the counts (never the documents), and every
piece takes its place by its number among the pieces of its length. A plan of at most ``capacity``
fillings with how often each is used fits a hundred pieces or a trillion.

The counts are packed by bin completion: around the largest piece left, the undominated fillings of
the rest of the bin are enumerated over runs of equal lengths, without recursion, by branch and bound,
with the best-fit filling as the first incumbent. That plan and a plain best-fit plan are held against
a lower bound; where both miss it, fillings are backtracked over until a plan meets the bound, none is
left to try or ``NODES`` choices are made. Each filling's search ends after ``SEARCH`` steps, and a
filling is used as often as pieces allow, or once: so a plan above the bound isn't proven least.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsetrail.llm.bpe import encoder
from pulsetrail.llm.common import column, keyed, longs, public_id, slices, stored
from pulsetrail.llm.tokens import rows_of

CAPACITY = 4096
#: steps of one filling's search
SEARCH = 4000
#: choices of fillings that backtracking may make where both greedy plans miss the bound
NODES = 2000


def best_fit(room: int, counts: np.ndarray) -> list[int]:
    """Largest piece that fits, again and again."""
    left, out = counts.copy(), []
    sizes = np.flatnonzero(left)
    while True:
        k = int(np.searchsorted(sizes, room, side="right")) - 1
        while k >= 0 and left[sizes[k]] == 0:
            k -= 1
        if k < 0:
            return out
        take = min(int(left[sizes[k]]), room // int(sizes[k]))
        out += [int(sizes[k])] * take
        left[sizes[k]] -= take
        room -= take * int(sizes[k])


def fillings(room: int, counts: np.ndarray, search: int, most: list[int]) -> Iterator[tuple[list[int], int]]:
    """Undominated fillings of ``room`` with the waste of each, larger pieces first, as runs of (length, count) are tried.

    Only those that waste at most ``most[0]``, which the caller may lower meanwhile; ends after ``search`` steps.
    A filling is dominated if a piece left over fits beside it or in place of a smaller one.
    """
    sizes = np.flatnonzero(counts[:room + 1])[::-1]
    have = counts[sizes]
    rest = np.append(np.cumsum((sizes * have)[::-1])[::-1], 0).tolist()  # all that pieces from here on could fill
    sizes, have = sizes.tolist(), have.tolist()
    falling = [-s for s in sizes]
    used, chosen = [0] * len(sizes), []
    k, left = 0, room

    def dominated() -> bool:
        fit = bisect_left(falling, -left)
        if any(have[j] > used[j] for j in range(fit, len(sizes))):
            return True
        for i in chosen:
            j = i - 1
            while j >= 0 and sizes[j] <= sizes[i] + left:
                if have[j] > used[j]:
                    return True
                j -= 1
        return False

    for _ in range(search):
        k = max(k, bisect_left(falling, -left))
        if k < len(sizes) and left - rest[k] <= most[0]:
            used[k] = min(have[k], left // sizes[k])
            left -= used[k] * sizes[k]
            chosen.append(k)
            k += 1
            continue
        if left <= most[0] and k == len(sizes) and not dominated():
            yield [sizes[i] for i in chosen for _ in range(used[i])], left
        if not chosen:
            return
        i = chosen[-1]
        used[i] -= 1
        left += sizes[i]
        k = i + 1
        if not used[i]:
            chosen.pop()


def completion(room: int, counts: np.ndarray, search: int = SEARCH) -> list[int]:
    """The filling of ``room`` that wastes least; of equals, the one with the largest pieces."""
    best = best_fit(room, counts)
    most = [room - sum(best) - 1]
    if most[0] >= 0:
        for best, waste in fillings(room, counts, search, most):
            most[0] = waste - 1
            if not waste:
                break
    return best


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on sequences: by the fullest that one can be, and by pieces too long to share one."""
    sizes = np.arange(capacity + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * sizes)
    if not n[-1]:
        return 0
    sums, mask = 1, (1 << capacity + 1) - 1
    for s in np.flatnonzero(counts).tolist():
        have, step = min(int(counts[s]), capacity // s), 1
        while have:
            step = min(step, have)
            sums |= sums << s * step & mask
            have -= step
            step *= 2
    bound, half = -(-int(total[-1]) // (sums.bit_length() - 1)), capacity // 2
    for a in [0, *np.flatnonzero(counts[:half + 1]).tolist()]:
        big, middle = int(n[-1] - n[capacity - a]), int(n[capacity - a] - n[half])
        room = middle * capacity - int(total[capacity - a] - total[half])
        small = int(total[half] - (total[a - 1] if a else 0))
        bound = max(bound, big + middle + max(0, -(-(small - room) // capacity)))
    return bound


def size_of(plan_: list[tuple[int, list[int]]]) -> int:
    return sum(t for t, _ in plan_)


def backtracked(counts: np.ndarray, capacity: int, best: list[tuple[int, list[int]]], bound: int, search: int, nodes: int) -> list[tuple[int, list[int]]]:
    """A plan of fewer sequences than ``best``, if one is found in ``nodes`` choices; ends at ``bound``.

    Each choice is a filling around the largest piece left and how often it is used; every other undominated
    filling, and each once only, is tried where the plan that follows wastes more than one sequence less may.
    """
    left, total = counts.copy(), int((counts * np.arange(capacity + 1)).sum())
    allowed = (size_of(best) - 1) * capacity - total

    def options(waste: int) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray, int]]:
        largest = int(np.flatnonzero(left)[-1])
        others = left.copy()
        others[largest] -= 1
        first = completion(capacity - largest, others, search)
        room = allowed - waste
        for f in chain([first], (f for f, _ in fillings(capacity - largest, others, search, [room]) if f != first)):
            filling = [largest, *f]
            lost = capacity - sum(filling)
            kinds, used = np.unique(filling, return_counts=True)
            times = int((left[kinds] // used).min())
            if lost:
                times = min(times, (allowed - waste) // lost)
            for t in (times, 1) if times > 1 else (times,):
                if t > 0:
                    yield t, filling, kinds, used, lost * t

    stack, path, waste = [options(0)], [], 0
    while stack and nodes > 0 and allowed >= 0 and size_of(best) > bound:
        choice = next(stack[-1], None)
        if choice is None or waste + choice[4] > allowed:
            if choice is None:
                stack.pop()
                if path:
                    t, _, kinds, used, lost = path.pop()
                    left[kinds] += t * used
                    waste -= lost
            continue
        nodes -= 1
        t, _, kinds, used, lost = choice
        path.append(choice)
        left[kinds] -= t * used
        waste += lost
        if left.any():
            stack.append(options(waste))
            continue
        best = [(c[0], c[1]) for c in path]
        allowed = (size_of(best) - 1) * capacity - total
        path.pop()
        left[kinds] += t * used
        waste -= lost
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY, search: int = SEARCH, nodes: int = NODES) -> list[tuple[int, list[int]]]:
    """(times, lengths) for every filling: each piece once, every filling at most ``capacity`` long."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bound = least_bins(counts, capacity)
    plans = []
    for fill in (lambda room, left: completion(room, left, search), best_fit):
        left, out = counts.copy(), []
        while (some := np.flatnonzero(left)).size:
            largest = int(some[-1])
            left[largest] -= 1
            filling = [largest, *fill(capacity - largest, left)]
            left[largest] += 1
            used = np.bincount(filling, minlength=capacity + 1)
            kinds = np.flatnonzero(used)
            times = int((left[kinds] // used[kinds]).min())
            left[kinds] -= times * used[kinds]
            out.append((times, filling))
        plans.append(out)
        if size_of(out) == bound:
            break
    return backtracked(counts, capacity, min(plans, key=size_of), bound, search, nodes)


def places(fillings: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length, runs of piece numbers: from ``rank`` on, ``each`` pieces a sequence from ``sequence``, at ``offset``."""
    rows, rank, sequence = [], {}, 0
    for times, filling in fillings:
        offset, i = 0, 0
        while i < len(filling):
            size, each = filling[i], 1
            while i + each < len(filling) and filling[i + each] == size:
                each += 1
            first = rank.get(size, 0)
            rows.append((size, first, each, sequence, offset))
            rank[size] = first + each * times
            offset += each * size
            i += each
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), a.T))


def pieces(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every document's tokens and an end id, cut only where longer than ``capacity``.

    ``doc_id, piece, start, length, ids_crc32`` and ``task, nth``: where the piece was made and its
    number there among the pieces of its length. An empty or null text is the end id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        known_words, tail = encoder(vocabulary), np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows = rows_of(part)
                known = known_words.learn(rows)
                out: list[tuple[int, int, int, int, int]] = []
                for doc, r in zip(longs(part, "doc_id").tolist(), rows):
                    raw = b"".join(map(known.__getitem__, r)) + tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        x = raw[at:at + 4 * capacity]
                        out.append((doc, k, at // 4, len(x) // 4, zlib.crc32(x)))
                a = np.array(out, np.int64).reshape(-1, 5)
                order = np.argsort(a[:, 3], kind="stable")
                sizes, first, n = np.unique(a[order, 3], return_index=True, return_counts=True)
                nth = np.zeros(len(a), np.int64)
                nth[order] = np.arange(len(a)) - np.repeat(first, n) + np.repeat(seen[sizes], n)
                seen[sizes] += n
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1].astype(np.int32)), *map(pa.array, a[:, 2:].T),
                                                  pa.array(np.full(len(a), task)), pa.array(nth)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long")


def pack(docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY, search: int = SEARCH) -> DataFrame:
    """Pack all documents into as few sequences as can be found.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. The table of
    pieces (small: no text, no ids) is written once, so that numbers stay the same if a task is
    repeated. Repeated rows are packed as often as they come; an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = stored(pieces(keyed(docs), vocabulary, end, capacity), "pieces")
    counts = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = spark.sparkContext.broadcast(places(plan(histogram, capacity, search)))  # <= capacity fillings

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        keys = at["length"] << 48 | at["rank"]
        for b in batches:
            length, rank = longs(b, "length"), longs(b, "rank")
            k = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            inside = rank - at["rank"][k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(column(b, n) for n in names), pa.array(at["sequence"][k] + inside // at["each"][k]),
                 pa.array(at["offset"][k] + inside % at["each"][k] * length)], names=[*names, "sequence_id", "offset"])

    ranked = made.join(counts.select("length", "task", "before"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(public_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
