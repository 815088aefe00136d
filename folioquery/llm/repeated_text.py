"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a ``WIDTH``-byte string that also starts anywhere else goes; all
strings are judged on the input.

1. Every window of ``WIDTH`` bytes has one seed, its least-hashed substring of ``SEED``
   bytes. Equal windows have equal seeds at equal places, so occurrences can only lie
   among the contexts (runs of windows) of one seed.
2. Equal contexts are added up before anything is gathered. A seed with one context is
   settled by that weight: the interval holds one string, which merging cannot refine.
3. The contexts of a seed are cut into shards, each shard's transform is built, the
   transforms are merged by interleave refinement, and intervals of 200 common bytes and
   weight two or more give the repeated starts.
4. A seed of more than ``MANY`` different contexts would not fit a task: its windows are
   grouped by (seed, window hash), 128 bits, as rows. Nothing is left out.

Texts are shuffled once, by document; contexts only where a seed has several.

Defined cases: null is empty; texts under ``WIDTH`` bytes lose nothing; repeated rows
count as documents of their own, so longer ones vanish whole; a null id is kept as null;
very long texts are hashed in stretches; empty tables give empty results; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_merge import repeated_starts
from .tables import as_bytes, stored
from .words import Rolling

WIDTH, SEED = 200, 64
STRETCH = 1 << 20  # window starts hashed at once
MANY = 4000  # different contexts of a seed that are merged in one task
BATCH = 1 << 16  # bytes of contexts merged together; block numbers then fit 16 bits
_NO_ID = -(1 << 63)


def contexts(data: bytes, width: int = WIDTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """(seed hash, context hash, first start, last start) of every run of windows, by stretches."""
    span = width - seed + 1
    for low in range(0, len(data) - width + 1, STRETCH):
        rolling = Rolling(data[low : low + STRETCH + width - 1])
        hashes = rolling.windows(seed)
        # The high half orders, the low half is the place: ties go to the leftmost.
        key = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
        count = len(hashes) - span + 1
        rows = -(-len(key) // span)
        padded = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        grid = padded.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[span - 1 : span - 1 + count])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [count]]) - 1
        yield hashes[place[first]], rolling.ranges(first, last + width), first + low, last + low


def _occurrences(texts: DataFrame) -> DataFrame:
    """(id, t, seed, ctx, first, last) of every context of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for doc, t, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                for seeds, ctx, first, last in contexts(data):
                    own = (np.full(len(seeds), doc), np.full(len(seeds), t), seeds.view(np.int64), ctx.view(np.int64), first, last)
                    for part, values in zip(parts, own, strict=True):
                        part.append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(p), pa.int64()) for p in parts], names=["id", "t", "seed", "ctx", "first", "last"]
            )

    return texts.mapInArrow(find, "id long, t long, seed long, ctx long, first long, last long")


def _merge_contexts(rows: DataFrame) -> DataFrame:
    """(seed, ctx, from, to): repeated starts inside each context; rows hold whole seeds, sorted."""

    def settle(held: list[dict]) -> pa.RecordBatch:
        flags = repeated_starts([r["data"] for r in held], [r["n"] for r in held], WIDTH)
        out = []
        for r, flag in zip(held, flags, strict=True):
            step = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1, strict=True):
                out.append((r["seed"], r["ctx"], int(a), int(b)))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["seed", "ctx", "from", "to"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= BATCH and row["seed"] != held[-1]["seed"]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["data"])
        if held:
            yield settle(held)

    return rows.mapInArrow(merge, "seed long, ctx long, `from` long, `to` long")


def _slices(joined: DataFrame) -> DataFrame:
    """Rows of (seed, ctx, n, data) cut from texts: joined has data and ``wanted``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for data, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = data.as_py()
                for w in wanted:
                    for column, value in zip(out, (w["seed"], w["ctx"], w["n"], data[w["first"] : w["last"] + WIDTH]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["seed", "ctx", "n", "data"])

    return joined.select("data", "wanted").mapInArrow(cut, "seed long, ctx long, n long, data binary")


def _windows(joined: DataFrame) -> DataFrame:
    """(id, t, seed, window, start) of every window of the wanted contexts."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t, data, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rolling = Rolling(data)
                first = np.array([w["first"] for w in wanted])
                count = np.array([w["last"] for w in wanted]) - first + 1
                start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                seeds = np.repeat(np.array([w["seed"] for w in wanted]), count)
                window = rolling.ranges(start, start + WIDTH).view(np.int64)
                columns = (np.full(len(start), doc), np.full(len(start), t), seeds, window, start)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "t", "seed", "window", "start"])

    return joined.select("id", "t", "data", "wanted").mapInArrow(hash_all, "id long, t long, seed long, window long, start long")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, removed runs, digest and bytes of what is kept."""
    data = as_bytes(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(data).alias("t"), data.alias("data"))
    found = _occurrences(texts)
    # Most seeds occur once: only the others' contexts go further.
    seeds = found.groupBy("seed").agg(F.count(F.lit(1)).alias("total")).filter("total > 1").select("seed")
    again = stored(found.join(seeds, "seed", "left_semi"), "repeats-contexts")
    weights = stored(again.groupBy("seed", "ctx").agg(F.count(F.lit(1)).alias("n")), "repeats-weights")
    kinds = weights.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"))
    hits = stored(again.join(weights.join(kinds, "seed"), ["seed", "ctx"]), "repeats-hits")

    several = hits.filter((F.col("kinds") > 1) & (F.col("kinds") <= MANY))
    # All occurrences of a context read the same: the first fields are of one and the same row.
    one = several.groupBy("seed", "ctx").agg(*[F.first(c).alias(c) for c in ("n", "id", "t", "first", "last")])
    listed = lambda rows: rows.groupBy("id", "t").agg(F.collect_list(F.struct("seed", "ctx", "n", "first", "last")).alias("wanted"))
    unique = lambda rows: texts.join(rows, ["id", "t"])
    sliced = _slices(unique(listed(one))).dropDuplicates(["seed", "ctx"])
    merged = _merge_contexts(sliced.repartition("seed").sortWithinPartitions("seed", "ctx"))
    by_merge = several.join(merged, ["seed", "ctx"]).select(
        "id", "t", (F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + WIDTH).alias("b")
    )
    by_weight = hits.filter((F.col("kinds") == 1) & (F.col("n") > 1)).select("id", "t", F.col("first").alias("a"), (F.col("last") + WIDTH).alias("b"))
    spans = stored(by_merge.unionByName(by_weight), "repeats-spans")

    crowded = hits.filter(F.col("kinds") > MANY)
    if not crowded.isEmpty():
        rows = _windows(unique(listed(crowded)))
        twice = rows.groupBy("seed", "window").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        spans = spans.unionByName(
            rows.join(twice, ["seed", "window"], "left_semi").select("id", "t", F.col("start").alias("a"), (F.col("start") + WIDTH).alias("b"))
        )
    ranges = spans.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, data, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, kept, at, runs = data.as_py(), [], 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if a > end:
                        kept.append(data[max(at, 0) : a])
                        runs += 1
                    at = end = max(end, b)
                kept = b"".join([*kept, data[at:]])
                values = (None if doc == _NO_ID else doc, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return texts.join(ranges, ["id", "t"], "left").select("id", "data", "spans").mapInArrow(cut, _OUT)
