"""Near duplicates by ProbMinHash, banding and verification.

A document is the weighted set of its runs of five words. Each element sends a Poisson
process of exponential arrivals whose rate is its weight; an arrival picks one of the
registers, and every register keeps the element that came first. An element stops when
its next arrival is later than all registers (early termination). Two documents agree in
a register with the probability Jaccard similarity
J(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i).
Registers are grouped in bands; documents that agree in a band are candidates, and only
an exact similarity of ``threshold`` or more makes a link. Classes are the components.

Equal weighted sets are one node from the start, and members of a bucket are compared
with a centre picked by hash and, where classes are mixed, with one of the members that
have most links, which settles most of a group of copies. Members left outside the bucket's largest class then meet the members of other classes, and only pairs
that two exact bounds admit leave the join: the triangle inequality (1 - J is a metric,
and all have distances to both centres), and a parity sketch. The sketch holds one
bit for each residue of the element hashes, so two sketches differ in at most as many bits
as the sets have elements not in common, and J is at most one less the share of those (see
``_most_apart``). A pair that shares several bands is made in the first of them, and large
buckets are dealt as a grid of cells. Thus no candidate link between classes is lost, and
no bucket, class or link list is collected.

Defined cases: null or empty text and text without words have no elements and are classes
of their own; fewer than five words are one element; rows that share an id are told apart
by their text and each keeps its links, so an id can stand in two classes, which count as one
where they get the same smallest id; a null id has a null class; ties pick the smallest id;
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .tables import as_bytes, discard, stored
from .words import mix, shingles

REGISTERS, ROWS = 100, 4  # 25 bands: a pair at 0.8 is missed with probability (1 - 0.8**4)**25 = 2e-6
THRESHOLD = 0.8
SLICE = 512  # rows whose signatures leave Python together
CELL = 200  # members on each side of a grid cell of a large bucket
_STEP = np.uint64(0x9E3779B97F4A7C15)


def probminhash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Element kept by each register."""
    times, values = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    at = np.zeros(len(elements))
    alive, made = np.arange(len(elements)), 0
    while alive.size:
        block = max(1, 512 // alive.size)  # few elements draw several arrivals at once
        k = np.arange(made, made + block, dtype=np.uint64)
        made += block
        draw = mix(elements[alive, None] ^ mix((k + np.uint64(1)) * _STEP))
        wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[alive, None]
        come = at[alive, None] + np.cumsum(wait, axis=1)
        at[alive] = come[:, -1]
        slot = (mix(draw ^ _STEP) % np.uint64(registers)).astype(np.int64).ravel()
        when, who = come.ravel(), np.repeat(elements[alive], block)
        early = when < times[slot]
        slot, when, who = slot[early], when[early], who[early]
        order = np.argsort(-when, kind="stable")  # the last assignment to a register is its earliest
        times[slot[order]], values[slot[order]] = when[order], who[order]
        alive = alive[at[alive] < times.max()]
    return values


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J of two weighted sets (sorted elements, weights)."""
    common, ix, iy = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not common.size:
        return 0.0
    wx, wy = x[1].astype(float), y[1].astype(float)
    a, b = wx[ix], wy[iy]
    # sum_j max(x_j / a, y_j / b): elements of one side alone count in full, common ones by their larger ratio.
    order = np.argsort(a / b, kind="stable")
    ratio = (a / b)[order]
    below = np.concatenate([[0.0], np.cumsum(b[order])])
    above = np.concatenate([np.cumsum(a[order][::-1])[::-1], [0.0]])
    cut = np.searchsorted(ratio, a / b, side="left")
    inverse = ((wx.sum() - a.sum()) + above[cut]) / a + ((wy.sum() - b.sum()) + below[cut]) / b
    return float((1.0 / inverse).sum())


def parity_sketch(elements: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the elements at each residue modulo a power of two of at least eight
    times their number and four times their ``total`` weight, as 64-bit words; and the same
    modulo its half. Weight counts because the bound it is held against grows with weight:
    few elements under a heavy one would else share residues long before they reach it."""
    bits = max(128, 1 << (max(8 * len(elements), 4 * total) - 1).bit_length())
    odd = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    fine = np.packbits(odd).view(np.int64)
    return fine, fine[: len(fine) // 2] ^ fine[len(fine) // 2 :]


def _unlike(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)


def _apart(x: str, y: str) -> Column:
    """Elements that two sets certainly do not have in common. Sketches more than one
    size apart tell nothing."""
    fine_x, fine_y, half_x, half_y = (F.col(f"{kind}_{of}") for kind in ("fine", "half") for of in (x, y))
    return (
        F.when(F.size(fine_x) == F.size(fine_y), _unlike(fine_x, fine_y))
        .when(F.size(half_x) == F.size(fine_y), _unlike(half_x, fine_y))
        .when(F.size(fine_x) == F.size(half_y), _unlike(fine_x, half_y))
        .otherwise(0)
    )


def _most_apart(x: str, y: str, far: float) -> Column:
    """Elements not in common that still allow 1 - J <= far.

    With m = sum_j max(x_j, y_j), J is at most 1 - (weight not in common) / m. As J is the
    chance of equal picks, the normalised sets differ by at most ``far`` in total variation,
    so m is at most the larger total plus ``far`` times the smaller. Also 2 m is the totals
    and the distance sum_j |x_j - y_j|, which is at most the elements not in common and the
    weight beyond one of each element (``extra``).
    """
    total, extra = F.col(f"total_{x}") + F.col(f"total_{y}"), F.col(f"extra_{x}") + F.col(f"extra_{y}")
    varied = F.greatest(f"total_{x}", f"total_{y}") + far * F.least(f"total_{x}", f"total_{y}")
    return F.least(far * varied, far * (total + extra) / (2.0 - far))


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, print_a, print_b, bands, total, extra, fine, half); no elements: null prints and no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            a, b, bands, total, extra, fine, half = [], [], [], [], [], [], []
            for data in batch.column(2):
                elements, weights = shingles(data.as_py())
                if not elements.size:
                    a.append(None), b.append(None), bands.append([]), total.append(0), extra.append(0), fine.append([]), half.append([])
                    continue
                for held, words in zip((fine, half), parity_sketch(elements, int(weights.sum())), strict=True):
                    held.append(words)
                total.append(int(weights.sum())), extra.append(int(weights.sum()) - len(weights))
                both = mix(elements ^ mix(weights.astype(np.uint64)))
                a.append(int(both.sum().view(np.int64)))
                b.append(int((both * both + mix(both)).sum().view(np.int64)))
                rows = mix(probminhash(elements, weights)).reshape(-1, ROWS)
                key = np.arange(len(rows), dtype=np.uint64) * _STEP
                for r in range(ROWS):
                    key = mix(key + rows[:, r])
                bands.append(key.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, longs)]
                + [pa.array(total, pa.int64()), pa.array(extra, pa.int64()), pa.array(fine, longs), pa.array(half, longs)],
                names=["doc_id", "hash", "print_a", "print_b", "bands", "total", "extra", "fine", "half"],
            )

    longs = pa.list_(pa.int64())
    return docs.mapInArrow(
        sign, "doc_id long, hash long, print_a long, print_b long, bands array<long>, total long, extra long, fine array<long>, half array<long>"
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, distance) of pairs (a, b), from whole texts."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("data").alias("left")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("data").alias("right")), "b").select("a", "b", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, None
        for batch in batches:
            out = []
            for b, left, right in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != held:
                    held, centre = b, shingles(right.as_py())
                out.append(1.0 - probability_jaccard(shingles(left.as_py()), centre))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "distance"])

    return both.mapInArrow(compare, "a long, b long, distance double")


def _ordered(measured: DataFrame) -> DataFrame:
    return measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def _mixed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the buckets with several classes, with their class ``cls``, the bucket's
    largest class ``main`` and the number of ``cells`` on each side of its grid."""
    placed = buckets.join(classes.withColumnRenamed("vertex", "node"), "node", "left")
    placed = placed.withColumn("cls", F.coalesce("component", "node")).drop("component")
    sizes = placed.groupBy("band", "key", "cls").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "key").agg(
        F.max(F.struct("n", F.col("cls").alias("main"))).alias("m"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("held")
    )
    main = main.filter("k > 1").select("band", "key", F.col("m.main").alias("main"), F.ceil(F.col("held") / CELL).cast("int").alias("cells"))
    return placed.join(main, ["band", "key"])


def _admitted(mixed: DataFrame, far: float) -> DataFrame:
    """Pairs (a, b), a < b, of members of different classes, one of them outside its
    bucket's largest class, that neither bound rules out; each pair once."""
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))

    def side(of: str) -> list[Column]:
        names = {"node": of} | {c: f"{c}_{of}" for c in ("cls", "d", "e")} | {c: f"{c}_{of}" for c in ("bands", "total", "extra", "fine", "half")}
        return [F.col(c).alias(to) for c, to in names.items()]

    rest = mixed.filter("cls <> main").select("band", "key", own.alias("row"), every.alias("column"), *side("x"))
    others = mixed.select("band", "key", own.alias("column"), every.alias("row"), (F.col("cls") == F.col("main")).alias("inside"), *side("y"))
    earlier = F.arrays_overlap(*(F.slice(f"bands_{of}", 1, F.col("rest.band")) for of in "xy"))
    same = [F.col(f"rest.{c}") == F.col(f"others.{c}") for c in ("band", "key", "row", "column")]
    near = (
        (F.col("cls_x") != F.col("cls_y")) & (F.col("inside") | (F.col("x") < F.col("y")))
        & (F.abs(F.col("d_x") - F.col("d_y")) <= far) & (F.abs(F.col("e_x") - F.col("e_y")) <= far)
        & ~earlier & (_apart("x", "y") <= _most_apart("x", "y", far))
    )
    met = rest.alias("rest").join(others.alias("others"), [*same, near])
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``class_id`` is the smallest id of its class, ``class_size``
    counts its documents, ``kept`` marks the one with that id."""
    far = 1.0 - threshold + 1e-9
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(as_bytes(text_col)).alias("hash"), as_bytes(text_col).alias("data"))
    signed = stored(_signatures(texts), "minhash-signatures")
    # A node is a weighted set with a number of its own: rows that share an id can differ in text.
    nodes = signed.filter("doc_id is not null and print_a is not null").groupBy("print_a", "print_b").agg(
        F.min(F.struct("doc_id", "hash")).alias("least"), *(F.first(c).alias(c) for c in ("bands", "total", "extra", "fine", "half"))
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    prints = stored(signed.select("doc_id", "print_a", "print_b"), "minhash-prints")
    discard(signed)  # the sketches live on in the nodes
    members = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # The centre is picked by a hash, so that different bands pick different centres.
    centres = members.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node")).alias("c")
    ).filter("n > 1").select("band", "key", F.col("c.node").alias("centre"))
    buckets = stored(members.join(centres, ["band", "key"]).select("band", "key", "node", "centre"), "minhash-buckets")
    involved = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "least.doc_id", "least.hash")
    whole = texts.join(involved, ["doc_id", "hash"]).select("node", "data").dropDuplicates(["node"])
    whole = stored(whole, "minhash-texts")

    stars = buckets.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    first = stored(_verified(stars, whole), "minhash-distances")
    links = first.filter(F.col("distance") <= far).select("a", "b")
    classes = components(links)
    mixed = stored(_mixed(buckets, classes), "minhash-mixed")

    # A second centre: one of the members with most links, picked by a hash among those of like number.
    ends = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    tier = F.floor(F.log2(F.coalesce("degree", F.lit(0)) + 1))
    hubs = mixed.join(ends, "node", "left").groupBy("band", "key").agg(
        F.max(F.struct(tier.alias("t"), F.xxhash64("node", "band").alias("h"), "node")).alias("m")
    )
    mixed = stored(mixed.join(hubs.select("band", "key", F.col("m.node").alias("hub")), ["band", "key"]), "minhash-hubs")
    spokes = mixed.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    second = stored(_verified(spokes.join(_ordered(first), ["a", "b"], "left_anti"), whole), "minhash-distances-2")
    measured = stored(_ordered(first).unionAll(second).groupBy("a", "b").agg(F.min("distance").alias("distance")), "minhash-measured")
    links = measured.filter(F.col("distance") <= far).select("a", "b")
    classes = components(links)

    # What is left: members of different classes that the exact bounds admit and nothing has measured.
    left = _mixed(mixed.select("band", "key", "node", "centre", "hub"), classes)
    for other, name in (("centre", "d"), ("hub", "e")):
        ends = [F.least("node", other).alias("a"), F.greatest("node", other).alias("b")]
        found = left.select("*", *ends).join(measured.withColumnRenamed("distance", name), ["a", "b"], "left").drop("a", "b")
        left = found.withColumn(name, F.when(F.col("node") == F.col(other), 0.0).otherwise(F.col(name)))
    left = stored(left, "minhash-left")
    marks = nodes.join(left.select("node").distinct(), "node", "left_semi").select("node", "bands", "total", "extra", "fine", "half")
    cross = _admitted(left.join(marks, "node"), far)
    third = stored(_verified(cross.join(measured, ["a", "b"], "left_anti"), whole), "minhash-distances-3")
    more = third.filter(F.col("distance") <= far).select("a", "b")
    if not more.isEmpty():
        classes = components(links.unionByName(more))

    named = nodes.select("print_a", "print_b", "node", F.col("least.doc_id").alias("own"))
    linked = named.join(classes.withColumnRenamed("vertex", "node"), "node")
    smallest = linked.groupBy("component").agg(F.min("own").alias("class_id"))
    linked = linked.join(smallest, "component").select("node", "class_id")
    by_print = named.join(linked, "node", "left").select("print_a", "print_b", F.coalesce("class_id", "own").alias("class_id"))
    named = prints.join(by_print, ["print_a", "print_b"], "left")
    named = named.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    sizes = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return named.join(sizes, "class_id", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (F.col("doc_id") == F.col("class_id")).alias("kept"),
    )
