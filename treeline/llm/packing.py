"""Mixture-controlled packing of token ids by deficit round-robin over source queues.

Each source is a queue of its documents' ids.  Every window of ``WINDOW`` sequences is filled
queue by queue.  A queue's quantum per window is its target share of the window's tokens; what
rounding leaves over is its deficit, which the next window pays.  The service order of ids is
that of the virtual time ``(2y + 1) / (2 * weight)`` of a queue's ``y``-th id, so the state after any
number of ids has a closed form (:meth:`Schedule.taken`).  Hence no task waits for another: each
takes up the deficits exactly where the windows before it, in whichever partition, left them.
A queue that runs dry leaves its share to the others in proportion to their weights.

Sequences hold ``LENGTH`` ids.  The ids left at the very end go into sequences whose lengths are
powers of two, so nothing is padded.

Cases: a null text is empty and holds only the end id; a null source is a queue of its own, and so is
every other source, however many there are; an empty table gives no pieces;
repeated rows are all packed; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import prepare, stage
from treeline.llm.tokens import encoder, id_batches

LENGTH = 2048
WINDOW = 16
#: Windows whose state a task remembers hold so many numbers in all, and are so many at most.
MEMO_NUMBERS, MEMO_WINDOWS = 1_300_000, 20_000
#: Offsets are broadcast up to so many rows of (task, queue); beyond, they are joined.
BROADCAST_ROWS = 200_000


class Schedule:
    """Which ids of which queue each window holds.  *totals* and *weights* by queue, integers."""

    def __init__(self, totals: list[int], weights: list[int] | None = None, window: int = LENGTH * WINDOW, length: int = LENGTH):
        self.totals, self.window, self.length = totals, window, length
        weights = weights or totals
        if any(n and w <= 0 for n, w in zip(totals, weights)):
            raise ValueError("a queue with ids needs a positive weight")
        self.all = sum(totals)
        self.windows = -(-self.all // window)
        # Phases between which a queue runs dry: (ids served before, taken by queue, weights of those left).
        self.phases: list[tuple[int, list[int], list[int]]] = []
        taken = [0] * len(totals)
        while sum(taken) < self.all:
            live = [w if t < n else 0 for w, t, n in zip(weights, taken, totals)]
            self.phases.append((sum(taken), taken, live))
            until = min(Fraction(n - t, w) for w, t, n in zip(live, taken, totals) if w)
            taken = [min(n, t + int(until * w + Fraction(1, 2))) for w, t, n in zip(live, taken, totals)]
        self._memo: dict[int, list[int]] = {}

    def taken(self, served: int) -> list[int]:
        """Ids taken from each queue when *served* ids have been served in all."""
        if served >= self.all:
            return self.totals
        begun, base, weights = next(p for p in reversed(self.phases) if p[0] <= served)
        k, total = served - begun, sum(weights)
        out = [(2 * k * w + total) // (2 * total) for w in weights]
        over = sum(out) - k
        sign = 1 if over > 0 else -1
        heap = [(sign * -Fraction(2 * c - sign, 2 * w), sign * -i, i) for i, (c, w) in enumerate(zip(out, weights)) if w] if over else []
        heapq.heapify(heap)
        for _ in range(abs(over)):
            i = heap[0][2]
            out[i] -= sign
            heapq.heapreplace(heap, (sign * -Fraction(2 * out[i] - sign, 2 * weights[i]), sign * -i, i))
        return [b + c for b, c in zip(base, out)]

    def at(self, k: int) -> list[int]:
        """Ids taken from each queue before window *k*."""
        if k not in self._memo:
            if len(self._memo) > min(MEMO_WINDOWS, MEMO_NUMBERS // len(self.totals)):
                self._memo.clear()
            self._memo[k] = self.taken(k * self.window)
        return self._memo[k]

    def window_of(self, queue: int, x: int, guess: int = 0) -> int:
        """The window that holds id *x* of *queue*."""
        for k in (guess, guess + 1):
            if k < self.windows and self.at(k)[queue] <= x < self.at(k + 1)[queue]:
                return k
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high) // 2
            if self.at(mid + 1)[queue] > x:
                high = mid
            else:
                low = mid + 1
        return low

    def slots(self, k: int, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of *n* ids from position *at* of window *k*."""
        per = self.window // self.length
        full = min(self.window, self.all - k * self.window) // self.length
        while n:
            seq, off = divmod(at, self.length)
            room = self.length - off
            if seq >= full:  # the end: lengths are powers of two, largest first
                left, begun, seq = (self.all - k * self.window) - full * self.length, full * self.length, full
                while True:
                    size = 1 << (left.bit_length() - 1)
                    if at < begun + size:
                        break
                    left, begun, seq = left - size, begun + size, seq + 1
                off, room = at - begun, begun + size - at
            m = min(n, room)
            yield k * per + seq, off, m
            at, n = at + m, n - m

    def pieces(self, queue: int, x: int, n: int, guess: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(window, sequence, offset, length) of ids *x* to *x + n* of *queue*, in order."""
        while n:
            k = guess = self.window_of(queue, x, guess)
            a, b = self.at(k), self.at(k + 1)
            m = min(n, b[queue] - x)
            at = sum(b[:queue]) - sum(a[:queue]) + x - a[queue]
            for seq, off, size in self.slots(k, at, m):
                yield k, seq, off, size
            x, n = x + m, n - m


def _queue_column():
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, so_far, size = TaskContext.get().partitionId(), {}, encoder(path).dtype.itemsize
        for batch, ids in id_batches(batches, path, end_id):
            queues, before = batch.column(2).to_pylist(), []
            for q, own in zip(queues, ids):
                before.append(so_far.get(q, 0))
                so_far[q] = before[-1] + len(own) // size
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([part] * n, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "before", "n", "ids"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, weights: dict[str | None, int] | None = None, length: int = LENGTH, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """Pieces of *docs* (doc_id, text, source): doc_id, start, length, ids (binary) or with *digest*
    ids_crc32, doc_tokens, sequence_id, offset.  *weights* are target proportions by source, positive integers; by default
    the sources' own shares of all ids, with which all queues end together.  Weights of absent sources don't count; a
    source without one raises ``ValueError``."""
    prepare(spark)
    queue = _queue_column()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), queue.alias("queue"))
    rows = stage(spark, rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, queue string, part int, before long, n long, ids binary"), "pack-ids")
    sums = rows.groupBy("part", "queue").agg(F.sum("n").alias("sum"))
    bases = stage(spark, sums.select("part", "queue", "sum", (F.sum("sum").over(Window.partitionBy("queue").orderBy("part")) - F.col("sum")).alias("base")), "pack-bases")
    totals = {r[0]: r[1] for r in bases.groupBy("queue").agg(F.sum("sum")).collect()}  # a row a source
    names = sorted(totals)
    own = {"-" if k is None else f"s{k}": v for k, v in (weights or {}).items()}
    if weights and (open_queues := [q for q in names if q not in own]):
        raise ValueError(f"{len(open_queues)} sources have no weight, such as {[q[1:] or None for q in open_queues[:5]]}")
    shares = [own[q] for q in names] if weights else None
    schedule = Schedule([totals[q] for q in names], shares, length * window, length)
    index, dtype = {q: i for i, q in enumerate(names)}, encoder(tokenizer).dtype
    bases = bases.select("part", "queue", "base")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [0] * len(names)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "queue", "before", "base", "n", "ids")]
            for d, q, before, base, n, ids in zip(*columns):
                i, start = index[q], 0
                raw = memoryview(np.frombuffer(ids, dtype).astype("<u4").tobytes())
                for k, seq, off, m in schedule.pieces(i, base + before, n, last[i]):
                    last[i] = k
                    part = raw[4 * start : 4 * (start + m)]
                    for column, v in zip(out, (d, start, m, zlib.crc32(part) if digest else bytes(part), n, seq, off)):
                        column.append(v)
                    start += m
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == 3 and not digest else pa.int64()) for k, v in enumerate(out)], NAMES)

    name = "ids_crc32" if digest else "ids"
    return rows.join(bases, ["part", "queue"]).mapInArrow(run, f"doc_id long, start long, length long, value {'long' if digest else 'binary'}, doc_tokens long, sequence_id long, offset long").withColumnRenamed("value", name)


NAMES = ["doc_id", "start", "length", "value", "doc_tokens", "sequence_id", "offset"]
