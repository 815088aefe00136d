import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioquery.llm.graphs import components
from folioquery.llm.near_duplicates import _apart, _most_apart, near_duplicate_classes, parity_sketch, probability_jaccard, probminhash
from folioquery.llm.words import shingles

from .cases import ODD, documents, words


def weighted(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(x, y):
    common = x.keys() & y.keys()
    every = x.keys() | y.keys()
    if set(x.values()) == set(y.values()) == {1}:
        return len(common) / len(every)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in common)


def classes(texts):
    bags = [weighted(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(bags):
        for j in range(i):
            y = bags[j]
            # J is at most the ratio of common elements to all.
            if x and y and (len(x.keys() & y.keys()) >= 0.3 * len(x.keys() | y.keys())) and similarity(x, y) >= 0.8 - 1e-9:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(text, pick, share):
    w = text.split()
    for i in range(len(w)):
        if pick.random() < share:
            w[i] = f"new{pick.randint(0, 10**9)}"
    return " ".join(w)


def test_classes_match_all_pairs(spark, sf_dir):
    pick = random.Random(2)
    base = " ".join(f"w{pick.randint(0, 10**6)}" for _ in range(400))
    texts = [*ODD, *(edited(base, pick, 0.012) for _ in range(60)), *(edited(base, pick, 0.04) for _ in range(30))]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 4000]
    got = near_duplicate_classes(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.class_id for r in got] == classes(texts)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_probability_jaccard_is_exact_and_estimated():
    pick = random.Random(4)
    for _ in range(5):
        a = " ".join(pick.choice("abcdef") for _ in range(300))
        b = " ".join(w if pick.random() > 0.05 else "z" for w in a.split())
        exact = similarity(weighted(a), weighted(b))
        x, y = shingles(a.encode()), shingles(b.encode())
        assert abs(probability_jaccard(x, y) - exact) < 1e-9
        agree = np.mean(probminhash(*x, 4000) == probminhash(*y, 4000))
        assert abs(agree - exact) < 0.04


def test_weights_matter_and_few_elements_fill_all_registers():
    one = (np.array([7], np.uint64), np.array([3]))
    assert set(probminhash(*one)) == {np.uint64(7)}
    two = (np.array([7, 9], np.uint64), np.array([1, 9]))
    assert 0.85 < np.mean(probminhash(*two, 4000) == 9) < 0.95


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e. f"), (5, "a b c d e f"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.class_size) for r in near_duplicate_classes(docs).collect()))
    assert got == [(-1, -1, 4), (3, 3, 4), (5, 3, 4), (5, 3, 4), (8, 8, 1)]
    assert near_duplicate_classes(docs.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(pick.randint(0, 60), pick.randint(0, 60)) for _ in range(45)] + [(7, 7)]
    label = {v: v for e in links for v in e}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    del links[-1]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    lone = {v for v in label if v not in got}
    assert all(got[v] == label[v] for v in got) and all(label[v] == v for v in lone)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_rule_out_no_link(spark):
    pick = random.Random(6)
    base = " ".join(pick.choice("abcdefghijklmnop") for _ in range(300))
    bags = [shingles(edited(base, pick, pick.choice([0, 0.01, 0.02, 0.03, 0.1])).encode()) for _ in range(40)]
    bags += [shingles(" ".join(base.split()[:n]).encode()) for n in range(60, 300, 12)]
    heavy = "one line said over and over " * 60  # few elements, much weight
    bags += [shingles((heavy + edited(base, pick, pick.choice([0.005, 0.02, 0.05]))).encode()) for _ in range(20)]
    rows = []
    for e, w in bags:
        fine, half = parity_sketch(e, int(w.sum()))
        rows.append((int(w.sum()), int(w.sum()) - len(w), fine.tolist(), half.tolist()))
    sets = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, total long, extra long, fine array<long>, half array<long>")
    x, y = (sets.select(*(F.col(c).alias(f"{c}_{of}") for c in sets.columns)) for of in "xy")
    met = x.join(y, F.col("i_x") < F.col("i_y")).select("i_x", "i_y", _apart("x", "y").alias("d"), _most_apart("x", "y", 0.2).alias("most"))
    links = out = 0
    for r in met.collect():
        (ex, _), (ey, _) = bags[r.i_x], bags[r.i_y]
        assert r.d <= len(np.setxor1d(ex, ey))
        if probability_jaccard(bags[r.i_x], bags[r.i_y]) >= 0.8:
            links += 1
            assert r.d <= r.most + 1e-6
        else:
            out += r.d > r.most
    assert links > 50 and out > 200


def test_an_id_with_two_texts_keeps_both_links_in_any_order(spark):
    base = [" ".join(f"{p}{i}" for i in range(60)) for p in "xy"]
    rows = [(5, base[0]), (5, base[1]), (6, base[0] + " more"), (7, base[1] + " more"), (8, "something else entirely here today")]
    for order in (rows, rows[::-1]):
        got = near_duplicate_classes(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r.doc_id, r.class_id) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]
