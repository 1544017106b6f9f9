"""Best-fit packing of token sequences with linear grouping of the large ones.

Lengths are whole numbers up to the capacity, so the packing is decided on the histogram of lengths alone: at most
`capacity` rows come to the driver, whatever the corpus. There,

1. lengths above `large` x capacity are sorted and cut into `groups` groups of equal cardinality, and each length is
   rounded up to its group's largest (linear grouping);
2. for these few sizes a cutting-stock programme is solved by column generation: a knapsack finds the configuration of
   best value, a simplex the multiplicities; these are rounded down and what is left is put by best fit;
3. actual documents replace the rounded ones, each slot taking a run of its group's sorted lengths, but for a
   configuration's last: rounding leaves gaps that few pieces fit, so its slot is filled by the actual length that fits best;
4. pieces not placed so far and the small ones, longest first, go by best fit into the room that the actual lengths
   leave, then into new sequences.

Sequences with the same history are kept as runs, so the plan is rows (length, first rank, count, first sequence,
offset): the pieces of a length with ranks in a run go to consecutive sequences at one offset. Tasks number the pieces of
each length (a count for each task and length, summed over tasks), and look their place up in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, utf8
from .encode import encoder

CAPACITY = 2048
Run = tuple[int, int, int]  # length, first rank, count


def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole multiplicities for few sizes: Gilmore-Gomory columns, rounded down.

    A configuration holds few pieces, since all are large: the knapsack is solved one piece more at a time, for every
    room at once.
    """
    k, whole = len(sizes), sizes.astype(int)
    basis = np.diag(np.floor(capacity / sizes))  # one configuration for each size to begin with
    most = int(capacity // sizes.min())
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = np.ones(k) @ inverse
        best, choice = np.zeros(capacity + 1), []
        for _ in range(most):
            after, last = best.copy(), np.full(capacity + 1, -1)
            for i, s in enumerate(whole):
                value = best[: capacity + 1 - s] + price[i]
                better = np.flatnonzero(value > after[s:] + 1e-12)
                after[s + better], last[s + better] = value[better], i
            choice.append(last)
            best = after
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for last in reversed(choice):
            if last[c] >= 0:
                column[last[c]] += 1
                c -= whole[last[c]]
        use, way = inverse @ need, inverse @ column
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    use = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, j].astype(int), int(use[j] + 1e-9)) for j in range(k)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = 1 / 3, groups: int = 24) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(rows (length, first rank, count, first sequence, offset), number of sequences) for counts of lengths.

    Every rank of every length gets one place, and no sequence exceeds the capacity. An empty histogram gives no rows.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    count, used = {n: c for n, c in histogram.items() if c}, 0
    if any(n < 1 or n > capacity for n in count):
        raise ValueError("a length outside 1..capacity")
    given: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free -> runs of sequences (first, count)

    def take(n: int, c: int) -> int:
        given[n] += c
        return given[n] - c

    if capacity in count:
        rows.append((capacity, take(capacity, count[capacity]), count[capacity], used, 0))
        used += count[capacity]
    big = sorted((n for n in count if large * capacity < n < capacity), reverse=True)
    if big:
        total = sum(count[n] for n in big)
        target = -(-total // groups)
        # equal cardinality: runs of sorted lengths, cut inside a length where need be
        cells: list[list[Run]] = [[]]
        filled = 0
        for n in big:
            left, rank = count[n], 0
            while left:
                c = min(left, target - filled)
                cells[-1].append((n, rank, c))
                left, rank, filled = left - c, rank + c, filled + c
                if filled == target and (left or n != big[-1]):
                    cells.append([])
                    filled = 0
        sizes = np.array([g[0][0] for g in cells], float)
        merged, where = np.unique(sizes, return_inverse=True)  # groups of one size are one
        pool: list[list[Run]] = [[] for _ in merged]
        for g, i in zip(cells, where, strict=True):
            pool[i] += g
        need = np.array([sum(c for _, _, c in g) for g in pool], float)

        def draw(i: int, c: int) -> list[Run]:
            got = []
            while c:
                n, rank, have = pool[i].pop(0)
                if have > c:
                    pool[i].insert(0, (n, rank + c, have - c))
                    have = c
                got.append((n, rank, have))
                c -= have
            return got

        for config, times in _configurations(merged, need, capacity):
            if not times:
                continue
            open_runs: list[tuple[int, int, int]] = [(used, times, 0)]  # first sequence, count, filled
            used += times
            slots = [int(i) for i in np.flatnonzero(config)[::-1] for _ in range(config[i])]
            for i in slots[: max(1, len(slots) - 1)]:
                queue, after = draw(i, min(times, int(sum(c for _, _, c in pool[i])))), []
                for first, c, at in open_runs:
                    while c and queue:
                        n, rank, have = queue.pop(0)
                        m = min(c, have)
                        rows.append((n, rank, m, first, at))
                        after.append((first, m, at + n))
                        if have > m:
                            queue.insert(0, (n, rank + m, have - m))
                        first, c = first + m, c - m
                    if c:
                        after.append((first, c, at))
                open_runs = after
            for first, c, at in open_runs:
                room[capacity - at].append((first, c))
        rest = sorted((r for g in pool for r in g), reverse=True)
    else:
        rest = []
    rest += [(n, given[n], count[n]) for n in sorted((n for n in count if n <= large * capacity), reverse=True)]
    sizes_free = sorted(f for f, runs in room.items() if runs and f)
    free = np.zeros(capacity + 1, np.int64)
    for f in sizes_free:
        free[f] = sum(c for _, c in room[f])
    for n, rank, c in rest:
        while c:
            fits = np.flatnonzero(free[n:])
            if not len(fits):  # new sequences: as many as these pieces fill
                m = -(-c // (capacity // n))
                room[capacity].append((used, m))
                free[capacity] += m
                used += m
                continue
            f = n + int(fits[0])
            first, have = room[f].pop()
            m = min(c, have)
            if have > m:
                room[f].append((first + m, have - m))
            rows.append((n, rank, m, first, capacity - f))
            room[f - n].append((first, m))
            free[f] -= m
            free[f - n] += m if f > n else 0
            rank, c = rank + m, c - m
    return rows, used


def pieces(docs: DataFrame, vocabulary: str, spaces: str, end: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): pieces of whole texts; nth counts a task's pieces of a length.

    A document is its ids and `end`; only one that is longer than the capacity is cut. A null text is empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, seen = encoder(vocabulary, spaces), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            who = batch.column(0).to_pylist()
            ids, offsets = enc.encode_many(*utf8(batch.column(1)), end)
            n = np.diff(offsets)
            many = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            inside = piece * capacity
            length = np.minimum(capacity, n[owner] - inside)
            at = offsets[owner] + inside
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([pa.array([who[i] for i in owner], pa.int64()), pa.array(piece, pa.int32()), pa.array(inside, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(order), task), pa.int32()), pa.array(nth, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, vocabulary: str, spaces: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; in as few sequences as the plan finds.

    Defined results: a null or empty text is one piece of the end id; repeated rows are packed each; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored.
    """
    cut = materialize(pieces(docs, vocabulary, spaces, end, capacity), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    ahead = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * width + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(ahead, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
