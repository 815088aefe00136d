import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.llm import nearest as N
from folioquery.llm.nearest import hadamard, nearest, probes, signed_axes, unit_rows


def brute(ids, x, top=5, every=50):
    u = unit_rows(np.array(x, float))
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        score = u @ u[k]
        order = [j for j in np.lexsort([ids, -score]) if j != k][:top]
        out.setdefault(int(ids[k]), []).append([(int(ids[j]), float(score[j])) for j in order])
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in hits[0]}) for q, hits in want.items())
    return hit / sum(len(hits[0]) for hits in want.values())


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_rotations_keep_lengths_and_probes_are_the_best():
    rng = np.random.default_rng(1)
    x = unit_rows(rng.normal(size=(7, 13)))
    assert np.allclose(hadamard(hadamard(np.pad(x, ((0, 0), (0, 3)))))[:, :13], x)
    for polytopes, wanted in ((1, 5), (2, 37), (3, 60)):
        axes = [signed_axes(x, 2, s) for s in range(polytopes)]
        assert all(np.allclose(np.linalg.norm(a[:, :16], axis=1), 1) for a in axes)
        for row, (prefix, last) in enumerate(probes(x, 2, polytopes, wanted)):
            total = axes[0][row]
            for a in axes[1:]:
                total = np.add.outer(total, a[row]).ravel()
            assert np.allclose(np.sort(total[prefix * 32 + last])[::-1], np.sort(total)[::-1][:wanted])
            assert len(set(zip(prefix.tolist(), last.tolist(), strict=True))) == wanted


@pytest.mark.parametrize("name,group", [("sf0.01", 1024), ("sf0.1", 100)])
def test_recall_and_exact_scores(spark, monkeypatch, name, group):
    monkeypatch.setattr(N, "GROUP", group)
    table = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").select("vec_id", "embedding").withColumn("node", F.lit("clash"))
    data = table.toPandas()
    want = brute(data.vec_id.to_numpy(), np.array(data.embedding.tolist()))
    got = collected(nearest(table, F.col("vec_id") % 50 == 0))
    assert set(got) == set(want) and all(len(hits) == 5 for hits in got.values())
    assert recall(got, want) >= 0.9
    at = {int(i): k for k, i in enumerate(data.vec_id)}
    u = unit_rows(np.array(data.embedding.tolist(), float))
    for q, hits in got.items():
        assert q not in [v for v, _ in hits] and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert all(abs(s - u[at[q]] @ u[at[v]]) < 1e-12 for v, s in hits)


def test_copies_ties_repeated_ids_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=6), rng.normal(size=6)
    rows = [(i, a.tolist()) for i in range(0, 400)] + [(0, b.tolist()), (450, b.tolist()), (451, (2 * b).tolist()), (451, b.tolist())]
    odd = [(500, None), (550, [0.0] * 6), (600, [float("nan")] + [1.0] * 5), (650, [1.0, None] + [1.0] * 4), (700, []), (750, [1.0]), (None, a.tolist()), (800, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(df, F.col("vec_id") % 50 == 0).collect())
    for q in range(50, 400, 50):
        assert [v for i, _, v, _ in got if i == q] == [0, 1, 2, 3, 4]
    assert [v for i, _, v, s in got if i == 450] == [0, 451, 451, 0, 1] and [s for i, _, v, s in got if i == 450][:3] == [1.0] * 3
    zero = sorted(v for i, _, v, _ in got if i == 0)  # two rows of this id ask: one among the copies, one beside the other vector
    assert zero == sorted([1, 2, 3, 4, 5] + [450, 451, 451, 0, 1])
    assert not [g for g in got if g[0] >= 500]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(df.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
