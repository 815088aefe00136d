import numpy as np
from pyspark.sql import functions as F

from folioquery.llm import vector_links
from folioquery.llm.vector_links import BLOCKS, codebooks, decode, link_vectors


def brute(ids, units):
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
        if (low == root).all():
            return near, root
        root = low


def test_decoding_lists_every_exceeding_direction():
    rng = np.random.default_rng(3)
    books = codebooks(13, 6)
    for _ in range(20):
        x = rng.normal(size=13)
        x /= np.linalg.norm(x)
        sums = [b @ part for b, part in zip(books, np.array_split(x, BLOCKS), strict=True)]
        score = np.add.outer(np.add.outer(np.add.outer(sums[0], sums[1]), sums[2]), sums[3]).ravel() / 2
        assert decode(x, books, 0.35).tolist() == np.flatnonzero(score >= 0.35).tolist()


def test_recall_and_exactness_against_brute_force(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = table.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    rng = np.random.default_rng(1)
    x = np.array(data.embedding.tolist(), float)
    hot = x[0] + 0.2 * np.linalg.norm(x[0]) / 8 * rng.normal(size=(150, 64))
    x = np.vstack([x, hot])
    ids = np.arange(len(x))
    near, root = brute(ids, x / np.linalg.norm(x, axis=1, keepdims=True))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = []
    for group in (vector_links.GROUP, 20):
        monkeypatch.setattr(vector_links, "GROUP", group)
        got = link_vectors(df.withColumn("unit", F.lit("clash"))).orderBy("vec_id").collect()
        links = np.array([r.n_links for r in got])
        assert len(got) == len(ids) and (links <= near.sum(axis=1)).all()
        assert links.sum() >= 0.95 * near.sum()
        assert np.mean([r.component_id == i for r, i in zip(got, root, strict=True)]) > 0.95
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
        found.append(links.tolist())
    assert found[0] == found[1]


def test_odd_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (0, i, True) for i in range(3, 10))
    assert {got[1][0], got[2][0], got[10][0]} == {2} and {got[i][1] for i in (1, 2, 10)} == {1}
    assert link_vectors(df.limit(0)).count() == 0


def test_filters_stay_few_and_pairs_at_the_limit_share_one():
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + 0.19**0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n, most in ((500, 6), (600_000, 6), (3_000_000, 9), (10_000_000, 11)):
        k = vector_links.filter_count(n)
        assert k <= most and n * k / 2**k <= vector_links.CELL
        decoder = vector_links.Decoder(k)
        mine, its = ([set(decoder.filters(v).tolist()) for v in vectors] for vectors in (x, y))
        assert {len(found) for found in mine + its} == {k}
        assert np.mean([bool(a & b) for a, b in zip(mine, its, strict=True)]) >= 0.99


def test_vectors_travel_a_few_times_each(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24))
    x = np.vstack([x, x[:200] + 0.02 * rng.normal(size=(200, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    sent, compare = [], vector_links._compare

    def counted(groups, size):
        sent.append(groups.count())
        return compare(groups, size)

    monkeypatch.setattr(vector_links, "_compare", counted)
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df).collect()}
    assert sent[0] <= 8 * len(x)
    near, root = brute(np.arange(len(x)), x / np.linalg.norm(x, axis=1, keepdims=True))
    assert got == {i: (int(row.sum()), int(r)) for i, (row, r) in enumerate(zip(near, root, strict=True))}


def test_short_and_uneven_vectors_near_each_other_link(spark):
    rng = np.random.default_rng(2)
    flat = [[float(np.cos(a)), float(np.sin(a))] for a in rng.uniform(0, 2 * np.pi, 150)]
    spiky = [[0.0] * 60 + rng.normal(size=4).tolist() for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(flat + spiky)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in link_vectors(df).collect()}
    for at, vectors in ((0, flat), (150, spiky)):
        x = np.array(vectors)
        near, _ = brute(np.arange(len(x)), x / np.linalg.norm(x, axis=1, keepdims=True))
        links = np.array([got[at + i] for i in range(len(x))])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum()
