"""Approximate nearest neighbours by cross-polytope hashing.

Pseudo-rotations (three rounds of random signs and a fast Hadamard transform) turn a unit
vector; its nearest signed axis is one symbol, and a hash is the symbols of ``polytopes``
independent rotations. There are ``TABLES`` such hashes. A vector to search for probes the
hashes whose axes it is nearest to in sum, many to a table; all vectors stored under a
probed hash are compared with it exactly.

Equal vectors are one node that carries as many of its smallest ids as an answer can show,
so copies never meet in one place, and equal questions are asked once. Nodes and questions
meet on all symbols but the last, the last one is matched inside the group, so a vector
travels once to a table. Groups are cut by a hash of the node into blocks of about
``GROUP``; a question goes to each block. A task holds one block, questions stream past it.

The number of probes follows the number of nodes n as n ** -RHO of all hashes, which is
what a neighbour of cosine 0.45 in 64 coordinates asks for; recall is measured in the tests.
The number of symbols grows with the logarithm of n.

Defined cases: vectors that are null, zero or hold null or non-finite entries take no part,
nor do rows with a null id; vectors of different length never meet; rows that share an id
are rows of their own, and a question leaves out its own row only; with few candidates all
are returned as far as the probes reach them, and up to ``EXACT`` nodes are all reached;
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.session import join_small

from .matrices import by_length, finite_entries
from .tables import stored

TABLES = 8
GROUP = 1024  # expected nodes in a block
BUCKET = 64  # mean nodes of a hash never exceed this
SHARE, RHO = 1.0, 0.377  # probed share of a table's hashes: SHARE * n ** -RHO
EXACT = 32
QUESTIONS = 256  # questions compared at a time
KEY = ["dim", "table", "prefix", "part"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / n**0.5


def signed_axes(units: np.ndarray, table: int, symbol: int) -> np.ndarray:
    """Inner products of rotated vectors with all signed axes."""
    dim = units.shape[1]
    wide = 1 << max(0, dim - 1).bit_length()
    rng = np.random.default_rng([dim, table, symbol])
    x = np.pad(units, ((0, 0), (0, wide - dim)))
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], wide))
    return np.concatenate([x, -x], axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares cannot overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashes(units: np.ndarray, polytopes: int) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols but the last as one number, last symbol), a row per vector, a column per table."""
    prefix = np.zeros((len(units), TABLES), np.int64)
    last = np.zeros((len(units), TABLES), np.int32)
    for table in range(TABLES):
        for symbol in range(polytopes):
            axes = signed_axes(units, table, symbol)
            prefix[:, table] = prefix[:, table] * axes.shape[1] + last[:, table]
            last[:, table] = axes.argmax(axis=1)
    return prefix, last


def probes(units: np.ndarray, table: int, polytopes: int, wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(prefix, last symbol) of the ``wanted`` hashes of greatest summed inner product."""
    axes = [signed_axes(units, table, symbol) for symbol in range(polytopes)]
    wide = axes[0].shape[1]
    order = [np.argsort(-a, axis=1, kind="stable") for a in axes]
    # The sum at ranks (i, j) is outdone by (i + 1) * (j + 1) - 1 others: only small products count.
    some = np.arange(wanted)
    out = []
    for row in range(len(units)):
        keys, sums = np.zeros(1, np.int64), np.zeros(1)
        for a, o in zip(axes, order, strict=True):
            reach = np.minimum(wide, wanted // (some[: len(keys)] + 1))
            i = np.repeat(np.arange(len(keys)), reach)
            j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
            symbols = o[row, j]
            total = sums[i] + a[row, symbols]
            keep = np.argsort(-total, kind="stable")[:wanted]
            keys, sums = (keys[i] * wide + symbols)[keep], total[keep]
        out.append((keys // wide, (keys % wide).astype(np.int32)))
    return out


def size_of_hash(nodes: int, dim: int) -> tuple[int, int]:
    """(symbols, probes of a table) for so many nodes."""
    wide = 2 << max(0, dim - 1).bit_length()
    polytopes = max(2, ceil(log(max(nodes / BUCKET, 1)) / log(wide)))
    every = wide**polytopes
    return polytopes, every if nodes <= EXACT else max(1, min(every, ceil(every * SHARE * nodes**-RHO)))


def _placed(vectors: DataFrame, nodes: int, asking: bool) -> DataFrame:
    """(node, v, at): where each node is stored, or where it asks, as (table, prefix, last symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column(1)):
                units = unit_rows(x)
                polytopes, wanted = size_of_hash(nodes, units.shape[1])
                tables, prefixes, lasts, sizes, each = [], [], [], [], np.zeros(len(rows), np.int64)
                if asking:
                    of_row: list[list] = [[] for _ in rows]
                    for table in range(TABLES):
                        for row, (prefix, last) in enumerate(probes(units, table, polytopes, wanted)):
                            order = np.lexsort([last, prefix])
                            own, first = np.unique(prefix[order], return_index=True)
                            of_row[row].append((table, own, last[order], np.diff(np.append(first, len(order)))))
                    for row, found in enumerate(of_row):
                        for table, own, last, count in found:
                            tables.append(np.full(len(own), table)), prefixes.append(own), lasts.append(last), sizes.append(count)
                            each[row] += len(own)
                else:
                    prefix, last = hashes(units, polytopes)
                    tables, prefixes, lasts, sizes = [np.tile(np.arange(TABLES), len(rows))], [prefix.ravel()], [last.ravel()], [np.ones(last.size, np.int64)]
                    each[:] = TABLES
                offsets = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
                symbols = pa.ListArray.from_arrays(offsets(np.concatenate(sizes)), pa.array(np.concatenate(lasts), pa.int32()))
                places = pa.StructArray.from_arrays([pa.array(np.concatenate(tables), pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()), symbols], ["table", "prefix", "last"])
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.ListArray.from_arrays(offsets(each), places)], names=["node", "v", "at"])

    kind = dict(vectors.dtypes)["v"]
    return vectors.select("node", "v").mapInArrow(run, f"node long, v {kind}, at array<struct<table:int,prefix:bigint,last:array<int>>>")


def best(scores: np.ndarray, first_ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, node) of the ``top`` highest scores of each row, ties to the smaller id; -inf never counts."""
    if scores.shape[1] > top:
        least = np.partition(scores, scores.shape[1] - top, axis=1)[:, -top][:, None]
    else:
        least = np.full((len(scores), 1), -np.inf)
    q, n = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort([first_ids[n], -scores[q, n], q])
    q, n = q[order], n[order]
    begin = np.searchsorted(q, np.arange(len(scores)))
    keep = np.arange(len(q)) - begin[q] < top
    return q[keep], n[keep]


def _compare(met: DataFrame, top: int) -> DataFrame:
    """(asker, node, ids, score) from rows sorted by group, nodes before questions."""

    def settle(held, asking: pa.RecordBatch):
        units, last, node, ids = held
        for rows, x in by_length(asking.column("v")):
            wants, askers = asking.column("last").take(pa.array(rows)), asking.column("node").take(pa.array(rows))
            size = max(int(last.max()), int(wants.flatten().to_numpy().max())) + 1
            for at in range(0, len(x), QUESTIONS):
                part = unit_rows(x[at : at + QUESTIONS])
                own = wants.slice(at, len(part))
                open_to = np.zeros((len(part), size), bool)
                open_to[np.repeat(np.arange(len(part)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = True
                q, n = best(np.where(open_to[:, last], part @ units.T, -np.inf), ids[0], top)
                # A pair's score is summed alike wherever the pair meets.
                score = np.einsum("ij,ij->i", part[q], units[n])
                asker = askers.slice(at, len(part)).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([asker, node.take(pa.array(n)), ids[1].take(pa.array(n)), pa.array(score)], names=["asker", "node", "ids", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nodes, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (*KEY, "asks")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high == low:
                    continue
                key, rows = tuple(keys[:4, low].tolist()), batch.slice(low, high - low)
                if key != own:
                    own, nodes, held = key, [], None
                if not keys[4, low]:
                    nodes.append(rows)
                elif nodes:
                    if held is None:
                        table = pa.Table.from_batches(nodes).combine_chunks()
                        column = lambda name: table.column(name).combine_chunks()  # noqa: B023, E731
                        ids = column("ids")
                        units = np.concatenate([unit_rows(x) for _, x in by_length(column("v"))])
                        first = ids.flatten().to_numpy()[np.cumsum(ids.value_lengths().to_numpy()) - ids.value_lengths().to_numpy()]
                        held = units, column("last").flatten().to_numpy(), column("node"), (first, ids)
                    yield from settle(held, rows)

    return met.mapInArrow(run, "asker long, node long, ids array<long>, score double")


def nearest(vectors: DataFrame, asks: Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row that ``asks``, a
    condition on ``vec_id``; cosine in double precision, ties to the smaller id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null")
    rows = rows.filter(finite_entries("v")).filter(F.exists("v", lambda x: x != 0)).withColumn("asks", F.coalesce(asks, F.lit(False)))
    first = Window.partitionBy("h", "v", "asks").orderBy("vec_id")
    few = rows.withColumn("h", F.xxhash64("v")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= top + 1)
    nodes = few.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, top + 1).alias("ids"), F.max("asks").alias("asks"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nearest-nodes")
    n = nodes.count()
    at = [F.size("v").alias("dim"), F.col("at.table").alias("table"), F.col("at.prefix").alias("prefix"), F.col("at.last").alias("last")]
    placed = stored(_placed(nodes, n, False), "nearest-places")
    entries = placed.select("node", "v", F.explode_outer("at").alias("at")).select("node", "v", *at).filter("table is not null")
    crowded = entries.groupBy("dim", "table", "prefix").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")).filter("parts > 1")
    crowded = stored(crowded.withColumn("at", F.concat_ws(":", "dim", "table", "prefix")).select("at", "parts"), "nearest-crowded")
    spread = lambda df: join_small(df.withColumn("at", F.concat_ws(":", "dim", "table", "prefix")), crowded, "at", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = spread(entries).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(nodes.select("node", "ids"), "node")
    asked = _placed(nodes.filter("asks"), n, True).select("node", "v", F.explode_outer("at").alias("at")).select("node", "v", *at).filter("table is not null")
    asked = spread(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("ids", F.lit(None).cast("array<long>"))
    columns = [*KEY, "asks", "node", "v", "last", "ids"]
    met = entries.withColumn("asks", F.lit(0)).select(*columns).unionByName(asked.withColumn("asks", F.lit(1)).select(*columns))
    found = stored(_compare(met.repartition(*KEY).sortWithinPartitions(*KEY, "asks"), top + 1), "nearest-found")
    by_score = Window.partitionBy("asker").orderBy(F.desc("score"), "first")
    pairs = found.groupBy("asker", "node").agg(F.max("score").alias("score"), F.first("ids").alias("ids")).withColumn("first", F.get("ids", F.lit(0)))
    answers = pairs.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= top + 1)
    # The smallest sort first: falling score, then id. At most (top + 1) ** 2 rows of an asker meet.
    item = F.struct((-F.col("score")).alias("down"), F.col("id").alias("id"), "node")
    answers = answers.select("asker", "node", "score", F.explode("ids").alias("id")).groupBy("asker").agg(F.slice(F.array_sort(F.collect_list(item)), 1, top + 1).alias("hits"))
    asking = rows.filter("asks").withColumn("h", F.xxhash64("v")).join(nodes.filter("asks").select("h", "v", F.col("node").alias("asker")), ["h", "v"]).select("vec_id", "asker")
    asking = asking.withColumnRenamed("vec_id", "query_id").join(answers, "asker")
    own = F.array_position(F.transform("hits", lambda x: (x["id"] == F.col("query_id")) & (x["node"] == F.col("asker"))), F.lit(True))
    others = F.filter("hits", lambda x, i: i + 1 != own)
    return asking.select("query_id", F.posexplode(F.slice(others, 1, top)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.down")).alias("score")
    )
