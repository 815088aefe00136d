import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioquery.llm import resampling
from folioquery.llm.resampling import importance_resample

from .cases import ODD, documents, words


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest, buckets, least_words, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, longest)))
    for text in target:
        t.update(map(bucket, features(text, longest)))
    a, b = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[k] + 1.0) * a / ((s[k] + 1.0) * b))) for k in range(buckets)]
    out = []
    for i, text in rows:
        f = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return sorted((tuple(r) + (rank.get(id(r)),) for r in out), key=repr)


@pytest.mark.parametrize("longest,least_words,percent", [(1, 20, 10), (3, 0, 37)])
def test_matches_brute_force(spark, sf_dir, longest, least_words, percent):
    texts = [*ODD, "a b\nc\n\nd e", "\n", "a\nb\nc\nd", *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, "", "a\nb c"]
    docs = documents(spark, texts).withColumn("key", F.lit(1)).withColumn("words", F.lit("clash"))
    got = importance_resample(docs, spark.createDataFrame([(t,) for t in bench], "text string"), longest=longest, least_words=least_words, percent=percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(list(enumerate(texts)), bench, longest, 10_000, least_words, percent, 2024)


def test_null_and_repeated_ids_ties_and_empty_tables(spark, monkeypatch):
    rows = [(1, "a b"), (1, "a b"), (None, "b c"), (None, "b c"), (2, None), (3, "c")]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("b c",)], "text string")
    for hot in (resampling.HOT, 3):
        monkeypatch.setattr(resampling, "HOT", hot)
        got = importance_resample(docs, target, least_words=0, percent=100).collect()
        ranks = sorted(r["rank"] for r in got)
        assert ranks == [1, 2, 3, 4, 5, 6]
        want = brute(rows, ["b c"], 1, 10_000, 0, 100, 2024)
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted((r[:5] for r in want), key=repr)
    assert importance_resample(docs.limit(0), target).count() == 0
    assert all(r["rank"] is None and r.n_words == len(words(dict(rows).get(r.doc_id))) for r in importance_resample(docs, target.limit(0)).collect())
