"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens (whole documents in storage order). A window of
``WINDOW`` tokens is filled in rounds: each queue's deficit grows by its quantum (its
target share of the window), whole tokens of the deficit are served, places left go to
the largest deficits, and what a queue is owed or has been advanced is carried to the
next window. The target is each queue's share of all tokens, so that no queue runs dry
before the end and windows hold the corpus mixture throughout.

Deficits are carried across partitions without a chain of tasks: what each queue has been
served at every ``BLOCK``-th window is the same fair order in closed form (token t of a
queue of n is due at (2t+1)/2n), so any task can start the round-robin at any block.
Documents are tokenised once into a table, with running offsets by partition and queue;
the queue totals of the partitions are summed, and pieces are cut where the table is read,
without shuffling ids.

The last, partly filled window is cut into sequences whose lengths are powers of two,
which need no padding; so there is none at all.

Sources beyond ``QUEUES`` are hashed into that many queues, so the state of a window is
bounded. Defined cases: null or empty text is its end id alone; a null source is a queue;
repeated rows are packed each; empty tables give no pieces; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .tokens import encoder

WINDOW = 2048
BLOCK = 256  # windows between closed-form states
QUEUES = 1024
END = 1
SLICE = 256  # rows worked on at once, so that a worker's memory does not follow Spark's batches


def served_before(window: int, totals: tuple[int, ...]) -> list[int]:
    """Tokens of each queue among the first ``window * WINDOW`` in fair order."""
    want = min(window * WINDOW, sum(totals))
    whole = sum(totals)
    if want == whole:
        return list(totals)
    # Due times up to want / whole; rounding leaves at most half a token a queue to settle.
    got = [min(n, (2 * n * want + whole) // (2 * whole)) for n in totals]
    missing = want - sum(got)
    if missing > 0:
        due = [((2 * got[s] + 1) / (2 * n), s) for s, n in enumerate(totals) if got[s] < n]
        heapq.heapify(due)
        for _ in range(missing):
            _, s = heapq.heappop(due)
            got[s] += 1
            if got[s] < totals[s]:
                heapq.heappush(due, ((2 * got[s] + 1) / (2 * totals[s]), s))
    else:
        due = [(-(2 * got[s] - 1) / (2 * n), -s) for s, n in enumerate(totals) if got[s] > 0]
        heapq.heapify(due)
        for _ in range(-missing):
            _, s = heapq.heappop(due)
            got[-s] -= 1
            if got[-s] > 0:
                heapq.heappush(due, (-(2 * got[-s] - 1) / (2 * totals[-s]), s))
    return got


def round_robin(block: int, totals: tuple[int, ...]) -> np.ndarray:
    """Tokens served to each queue before each window of a block, as rows; one row more
    for the end. The block's shares are fixed by the states at both ends."""
    first, whole = block * BLOCK, sum(totals)
    windows = min(BLOCK, -(-whole // WINDOW) - first)
    start = np.array(served_before(first, totals), np.int64)
    share = np.array(served_before(first + windows, totals), np.int64) - start
    size = int(share.sum())
    out = np.empty((windows + 1, len(totals)), np.int64)
    out[0] = start
    left, deficit = share.copy(), np.zeros(len(totals))
    for w in range(windows):
        room = min(WINDOW, size - w * WINDOW)
        deficit += share * (room / size)
        serve = np.clip(np.floor(deficit + 1e-9).astype(np.int64), 0, left)
        over = int(serve.sum()) - room
        if over > 0:  # tokens owed to several queues at once: the smallest deficits wait
            order = np.argsort(deficit - serve, kind="stable")
            order = order[serve[order] > 0]
            serve[order[:over]] -= 1
        while over < 0:
            open_ = np.flatnonzero(left > serve)
            pick = open_[np.argsort(-(deficit - serve)[open_], kind="stable")][:-over]
            serve[pick] += 1
            over += len(pick)
        deficit -= serve
        left -= serve
        out[w + 1] = out[w] + serve
    return out


def sequence_of(window: int, at: int, whole: int) -> tuple[int, int, int]:
    """(sequence, offset, room) of place ``at`` of a window; the last window is cut into powers of two."""
    rest = whole - window * WINDOW
    if rest >= WINDOW:
        return window, at, WINDOW - at
    sequence = window
    for bit in reversed(range(WINDOW.bit_length())):
        size = rest & 1 << bit
        if size:
            if at < size:
                return sequence, at, size - at
            at, sequence = at - size, sequence + 1
    raise ValueError("place beyond the last token")


class Packer:
    """Cuts runs of a queue's tokens at window borders. Nothing it keeps refers back to
    it, so its tables go with it and not when a worker next looks for cycles."""

    def __init__(self, totals: tuple[int, ...]):
        self.totals, self.whole = totals, sum(totals)
        table = lru_cache(maxsize=64)(lambda block: round_robin(block, totals))

        def column(block: int, queue: int) -> tuple[list[int], list[int]]:
            # Tokens of a queue served before each window of a block, and the places that
            # the queues before it take in each.
            rows = table(block)
            return rows[:, queue].tolist(), np.diff(rows[:, :queue], axis=0).sum(axis=1).tolist()

        self.column = lru_cache(maxsize=1024)(column)
        self.state = lru_cache(maxsize=4096)(lambda block: served_before(block * BLOCK, totals))
        self.blocks = -(-(-(-self.whole // WINDOW)) // BLOCK)

    def _window(self, queue: int, at: int) -> int:
        """The window that holds token ``at`` of a queue."""
        low, high = 0, self.blocks - 1
        guess = min(high, at * self.blocks // max(1, self.totals[queue]))
        while low < high:
            if self.state(guess)[queue] <= at:
                low = guess
                if guess + 1 > high or self.state(guess + 1)[queue] > at:
                    high = guess
                else:
                    low = guess + 1
            else:
                high = guess - 1
            guess = (low + high) // 2
        return low * BLOCK + bisect_right(self.column(low, queue)[0], at) - 1

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the run, length, sequence, offset)."""
        done, full = 0, self.whole // WINDOW
        window = self._window(queue, start)
        while done < length:
            served, before = self.column(window // BLOCK, queue)
            row = window % BLOCK
            run = min(length - done, served[row + 1] - start - done)
            at = before[row] + start + done - served[row]
            if run > 0 and window < full:
                yield done, run, window, at
                done, run = done + run, 0
            while run > 0:
                sequence, offset, room = sequence_of(window, at, self.whole)
                n = min(run, room)
                yield done, n, sequence, offset
                done, at, run = done + n, at + n, run - n
            window += 1


_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ``SLICE`` at a time at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def tokenised(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str | None) -> DataFrame:
    """(doc_id, queue, part, at, ids): ``at`` counts the queue's tokens before it in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, before = END.to_bytes(2, "little"), {}
        for batch in slices(batches):
            at, out = [], []
            for queue, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = ids_of(text.as_py()) + end
                at.append(before.get(queue, 0))
                before[queue] = at[-1] + len(ids) // 2
                out.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([part] * len(out), pa.int32()), pa.array(at, pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "queue", "part", "at", "ids"],
            )

    sources = docs.select(F.col(source_col).cast("string").alias("source")).distinct()
    if sources.limit(QUEUES + 1).count() > QUEUES:
        queue = F.concat(F.lit("h"), F.pmod(F.xxhash64(F.col(source_col).cast("string")), F.lit(QUEUES)).cast("string"))
    else:
        queue = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return stored(rows.mapInArrow(encode, "doc_id long, queue string, part int, at long, ids binary"), "token-ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: which ids of a document lie where in which sequence."""
    spark = docs.sparkSession
    ids = tokenised(docs, id_col, text_col, source_col, tokenizer)
    sums = ids.groupBy("queue", "part").agg(F.sum(F.expr("octet_length(ids) div 2")).alias("n"))
    bases = sums.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    # At most QUEUES rows.
    queues = sorted((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    names = {q: i for i, (q, _) in enumerate(queues)}
    totals = tuple(n for _, n in queues)
    # One short row a queue and partition: stored, so that Spark sees their size and ids stay where they are.
    bases = stored(bases.select("queue", "part", F.coalesce("base", F.lit(0)).alias("base")), "queue-bases")
    placed = ids.join(bases, ["queue", "part"])
    shared = spark.sparkContext.broadcast((names, totals))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, totals = shared.value
        packer = Packer(totals)
        for batch in slices(batches):
            found: list[tuple[int, ...]] = []
            for doc, queue, at, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                wide = np.frombuffer(data.as_py(), "<u2").astype("<u4")
                raw = memoryview(wide.tobytes())
                for start, length, sequence, offset in packer.pieces(names[queue], at, len(wide)):
                    found.append((doc, start, length, crc32(raw[4 * start : 4 * (start + length)]), len(wide), sequence, offset))
            columns = zip(*found) if found else ([],) * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

    return placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("at"), "ids").mapInArrow(cut, SCHEMA)
