import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.llm.eigen import leading_pairs, sturm_counts, tridiagonal
from folioquery.llm.whitening import whiten


def symmetric(kind, n, rng):
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {"spread": rng.normal(size=n), "close": 1 + 1e-9 * np.arange(n), "equal": np.repeat([3.0, 1.0], [n // 2, n - n // 2]), "rank": np.r_[5.0, np.zeros(n - 1)], "steep": 10.0 ** -np.arange(n)}[kind]
    return (q * values) @ q.T


@pytest.mark.parametrize("kind", ["spread", "close", "equal", "rank", "steep"])
@pytest.mark.parametrize("n", [1, 2, 3, 17])
def test_leading_pairs_are_eigenpairs(kind, n):
    a = symmetric(kind, n, np.random.default_rng(n))
    a = (a + a.T) / 2
    values, units = leading_pairs(a, 6)
    want = np.linalg.eigvalsh(a)[::-1][:6]
    norm = np.abs(want).max()
    assert np.abs(values - want).max() <= 1e-13 * norm * n
    assert np.abs(units @ units.T - np.eye(len(units))).max() < 1e-12
    assert np.abs(a @ units.T - units.T * values).max() <= 1e-13 * norm * n


def test_decoupled_matrices_and_counts():
    for a in (np.zeros((4, 4)), np.eye(5), np.diag([2.0, 2.0, 1.0, 7.0])):
        values, units = leading_pairs(a, 3)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:3]) and np.allclose(units @ units.T, np.eye(3))
        assert np.allclose(a @ units.T, units.T * values)
    a = symmetric("spread", 12, np.random.default_rng(5))
    d, e, _ = tridiagonal(a)
    at = np.linspace(-3, 3, 50)
    assert (sturm_counts(d, e, at) == (np.linalg.eigvalsh(a)[None, :] < at[:, None]).sum(axis=1)).all()


def brute(rows):
    """Exact whole numbers, numpy's own eigenvectors."""
    x = {i: np.array([int(np.floor(64 * float(c))) + 1000000 for c in v], object) for i, v in rows}
    fit = np.array([list(t) for t in {tuple(v) for v in x.values()}], object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array((n * fit - s) / n, float)
    values, units = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, v in x.items():
        y = n * v - s
        out[i] = int((y**2).sum()), (np.array(y / n, float) @ units[:, ::-1]) / np.sqrt(np.maximum(values[::-1], 1e-300))
    return n, values[::-1] / values.sum(), out


def test_matches_plain_computation(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    doubled = table.unionByName(table.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 10_000)).withColumn("x", F.lit("clash")).withColumn("dim", F.lit(1))
    n, share, want = brute([(r.vec_id, r.embedding) for r in doubled.collect()])
    got = whiten(doubled).collect()
    assert len(got) == 16 * len(want)
    sign = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-10
        assert abs(r.explained - share[r.component - 1]) < 1e-12
        s = sign.setdefault(r.component, 1 if r.whitened * white[r.component - 1] >= 0 else -1)
        assert abs(r.whitened - s * white[r.component - 1]) < 1e-8


def test_odd_vectors_lengths_and_sizes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 1, 2, 4) for c in (1, 2))
    assert {r.n for r in got} == {4}
    huge = spark.createDataFrame([(1, [1e300, -1e300]), (2, [-1e300, 5.0]), (3, [1e17, 5.0])], "vec_id long, embedding array<double>")
    assert {(r.deviation is None, np.isfinite(r.whitened)) for r in whiten(huge).collect()} == {(True, True)}
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id = 1")).count() == 0
