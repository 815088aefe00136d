"""Near-duplicate vectors by spherical-cap filters with structured product codes.

A filter direction joins one random code word per block of coordinates, so a few small
codebooks give (words ** blocks) directions. Directions that share words lie close together
and find the same pairs, so only a random part of them counts, one in ``THIN`` or fewer. A
vector is turned at random, list-decoded by meeting two sorted halves of block sums, and
belongs to its best ``k`` of ``2 ** k`` directions: no vector has more, however large or
uneven the table. Vectors that share a filter are compared, and only a cosine of ``LEAST`` or
more in double precision links. ``k`` follows from the table (``filter_count``).

Buckets are cut into blocks by a hash of the id, and pairs of blocks are compared as
separate groups, so no task holds more than two blocks. Only the vector itself, as it came,
travels to its filters. A pair counts in the smallest of its common filters only; codebooks
follow from the table, so the filters of the few vectors with a near one are decoded again
where that is asked. Groups give counts per vector and a star per connected set, rows
in proportion to the vectors, not the pairs.

Defined cases: null, zero or non-finite vectors and those with null components link with
nothing; vectors of different length never link; rows that share an id share their links;
empty tables give empty results; other columns are not looked at. A null id is kept, alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .tables import stored

LEAST = 0.9
BLOCKS = 4  # code blocks
FILTERS, CELL = 6, 80_000  # least number of filters of a vector; vectors wanted in a bucket at most
THIN = 81  # directions of the product code for each that counts, at least
GROUP, USUAL_DIM = 160_000, 64  # vectors of the usual length in a block of a bucket, about
TILE, PAIRS = 768, 1_000_000  # vectors of a side compared at once; near pairs held at once, about


def filter_count(n: int) -> int:
    """k for a table of ``n`` vectors, so that buckets (``n * k / 2 ** k`` vectors on average)
    hold ``CELL`` at most. Of pairs at a cosine of 0.9 in 64 coordinates, 0.998 share one of the k."""
    k = FILTERS
    while n * k > CELL * 2**k:
        k += 1
    return k


def codebooks(dim: int, words: int) -> list[np.ndarray]:
    """Random unit code words for each block of coordinates."""
    rng = np.random.default_rng([dim, words])
    books = [rng.normal(size=(words, len(part))) for part in np.array_split(np.arange(dim), BLOCKS)]
    return [b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12) for b in books]


def decode(vector: np.ndarray, books: list[np.ndarray], least: float) -> np.ndarray:
    """Ids of all directions with inner product ``least`` or more with a unit vector."""
    words, parts = len(books[0]), np.array_split(vector, BLOCKS)
    sums = [book @ part for book, part in zip(books, parts, strict=True)]
    left, right = np.add.outer(sums[0], sums[1]).ravel(), np.add.outer(sums[2], sums[3]).ravel()
    order = np.argsort(right)
    low = np.searchsorted(right[order], least * BLOCKS**0.5 - left)
    count = len(right) - low
    at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.sort(np.repeat(np.arange(len(left)), count) * words**2 + order[at])


class Code:
    """The directions for vectors of one length, and how vectors are turned before decoding."""

    def __init__(self, dim: int, k: int):
        size = max(dim, 4 * BLOCKS)  # few coordinates alone would give the same directions again and again
        self.k, self.size = k, size
        self.words = ceil((THIN * 2**k) ** (1 / BLOCKS))
        rng = np.random.default_rng([dim, self.words, k])
        self.turn = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dim]
        self.books = codebooks(size, self.words)
        self.kept = np.zeros(self.words**BLOCKS, bool)
        self.kept[rng.permutation(self.words**BLOCKS)[: 2**k]] = True
        self.first = NormalDist().inv_cdf(1 - 2 * k / 2**k) / size**0.5  # reached by 2k directions, about

    def filters(self, x: np.ndarray) -> np.ndarray:
        """The k best directions of a unit vector."""
        x, least = self.turn @ x, self.first
        while True:
            found = decode(x, self.books, least)
            found = found[self.kept[found]]
            if len(found) >= self.k:
                break
            least -= 0.5 / self.size**0.5
        words = np.unravel_index(found, (self.words,) * BLOCKS)
        score = sum((b @ part)[w] for b, part, w in zip(self.books, np.array_split(x, BLOCKS), words, strict=True))
        return np.sort(found[np.argsort(-score, kind="stable")[: self.k]])


class Decoder:
    """The filters of unit vectors, with codes made once for each length."""

    def __init__(self, k: int):
        self.k, self.codes = k, {}

    def filters(self, x: np.ndarray) -> np.ndarray:
        if len(x) not in self.codes:
            self.codes[len(x)] = Code(len(x), self.k)
        return self.codes[len(x)].filters(x)


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Vectors, a row each, divided by their lengths."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares cannot overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, v, filters): each vector as it came, with its filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(k)
        for batch in batches:
            values, ends = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            found = [decoder.filters(unit_rows(values[None, a:b])[0]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["vec_id", "v", "filters"])

    kind = dict(vectors.dtypes)["v"]
    return vectors.mapInArrow(run, f"vec_id long, v {kind}, filters array<long>")


def near_pairs(units: np.ndarray, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) with a cosine of ``LEAST`` or more, some at a time: one from each side of
    ``split``, or i < j if that is 0. Single precision finds them, double precision decides."""
    n, dim = units.shape
    short, slack, end = units.astype(np.float32), (dim + 8) * 1.2e-7, split or n
    found, many = [], 0
    for at in range(0, end, TILE):
        for start in range(split or at, n, TILE):
            cosines = short[at : min(end, at + TILE)] @ short[start : start + TILE].T
            if cosines.max() < LEAST - slack:
                continue
            i, j = np.nonzero(cosines >= LEAST - slack)
            sure = cosines[i, j] >= LEAST + slack
            i, j = i + at, j + start
            doubt = np.flatnonzero(~sure)
            sure[doubt] = np.einsum("ab,ab->a", units[i[doubt]], units[j[doubt]]) >= LEAST
            sure &= i < j
            found.append((i[sure], j[sure]))
            many += len(found[-1][0])
            if many >= PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
                found, many = [], 0
    if many:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest rows of the connected sets, after the pairs (i, j) are joined."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        lower = np.arange(len(root))
        np.minimum.at(lower, np.maximum(a, b), np.minimum(a, b))
        while not (lower == (least := lower[lower])).all():
            lower = least
        root = lower[root]


def linked(ids: np.ndarray, units: np.ndarray, filters: Callable[[np.ndarray], np.ndarray], k: int, here: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, smallest row of the connected set) of each row of one group."""
    n = len(ids)
    links, root = np.zeros(n, np.int64), np.arange(n)
    mine, known = np.empty((n, k), np.int64), np.zeros(n, bool)
    for i, j in near_pairs(units, split):
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        asked = np.zeros(n, bool)
        asked[i] = asked[j] = True
        for row in np.flatnonzero(asked & ~known):
            mine[row] = filters(units[row])
        known |= asked
        for a in range(k):  # pairs with a smaller common filter count there; filters are sorted
            low = np.flatnonzero(mine[i, a] < here)
            if not len(low):
                break
            x, y, counted = mine[i[low], a], mine[j[low]], np.zeros(len(low), bool)
            for b in range(k):
                counted |= x == y[:, b]
            keep = np.ones(len(i), bool)
            keep[low[counted]] = False
            i, j = i[keep], j[keep]
        links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        root = joined(root, i, j)
    return links, root


def _compare(groups: DataFrame, k: int) -> DataFrame:
    """(vec_id, links, root) from rows sorted by (dim, filter, low, high, blk)."""
    key = ["dim", "filter", "low", "high"]

    def settle(decoder, own, held):
        ids, blocks, values = (np.concatenate(c) for c in zip(*held, strict=True))
        units = unit_rows(values.reshape(len(ids), own[0]))
        split = 0 if own[2] == own[3] else int(np.searchsorted(blocks, own[3]))
        links, root = linked(ids, units, decoder.filters, k, own[1], split)
        keep = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[keep], links[keep], ids[root[keep]])], names=["vec_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, decoder = None, [], Decoder(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
            ids, blocks = batch.column("vec_id").to_numpy(), batch.column("blk").to_numpy()
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for start, end in zip(starts, starts[1:], strict=False):
                own = tuple(int(x) for x in keys[start])
                if own != last:
                    if held:
                        yield settle(decoder, last, held)
                    last, held = own, []
                values = batch.column("v").slice(start, end - start).flatten().to_numpy(zero_copy_only=False)
                held.append((ids[start:end], blocks[start:end], values))
        if held:
            yield settle(decoder, last, held)

    return groups.mapInArrow(run, "vec_id long, links long, root long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: links, component and whether it represents its component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = rows.filter("vec_id is not null and v is not null").filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    k = filter_count(vectors.count())
    decoded = _decoded(sound, k)
    each = decoded.select("vec_id", "v", F.size("v").alias("dim"), F.explode("filters").alias("filter"))
    # Vectors are decoded once more for this, so that they need not be written with their filters.
    longer = F.greatest(F.lit(1.0), F.col("dim") / USUAL_DIM)
    parts = F.ceil(F.count(F.lit(1)) * F.max(longer) / GROUP).cast("int").alias("parts")
    large = each.groupBy("dim", "filter").agg(parts).filter("parts > 1")
    placed = each.join(F.broadcast(large), ["dim", "filter"], "left").fillna(1, ["parts"])
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("vec_id", "filter"), F.col("parts")).cast("int"))
    other = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = other.select("dim", "filter", F.least("blk", "with").alias("low"), F.greatest("blk", "with").alias("high"), "blk", "vec_id", "v")
    key = ["dim", "filter", "low", "high"]
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, 2**k)
    found = stored(_compare(groups.repartition(tasks, *key).sortWithinPartitions(*key, "blk"), k), "vector-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    classes = components(found.filter("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(classes.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )
