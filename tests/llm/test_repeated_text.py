import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioquery.llm import repeated_text
from folioquery.llm.repeated_text import remove_repeats
from folioquery.llm.suffix_merge import repeated_starts

from .cases import ODD, documents


def brute(texts, width=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def made(pick):
    line = " ".join(pick.choice(["alpha", "beta", "gamma", "delta", "é", "ß"]) for _ in range(60))
    passage = "".join(pick.choice("abcdefgh ") for _ in range(420))
    for i in range(60):
        own = "".join(pick.choice("ijklmnop ") for _ in range(pick.randint(0, 300)))
        shared = pick.choice([line, passage, passage[: pick.randint(150, 420)], passage[pick.randint(0, 200) :], ""])
        yield own + shared + own[: pick.randint(0, 90)]
    yield "ab" * 300
    yield "x" * 199
    yield "x" * 200 + "y"
    yield "z" * 201


def result(rows):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_matches_brute_force(spark, sf_dir, monkeypatch):
    pick = random.Random(8)
    texts = [t for t in ODD if len(t or "") < 9000] + list(made(pick))
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 4000]
    want = list(brute(texts))
    assert sum(w[1] for w in want) > 5000
    docs = documents(spark, texts).withColumn("n_bytes", F.lit("clash"))
    assert result(remove_repeats(docs).collect()) == want
    # The same through the row-wise path of crowded seeds, and hashed in short stretches.
    monkeypatch.setattr(repeated_text, "MANY", 1)
    monkeypatch.setattr(repeated_text, "STRETCH", 150)
    assert result(remove_repeats(docs).collect()) == want


def test_merge_of_shards_equals_counting(monkeypatch):
    from folioquery.llm import suffix_merge

    monkeypatch.setattr(suffix_merge, "SHARD", 100)
    pick = random.Random(6)
    for _ in range(40):
        base = "".join(pick.choice("ab") for _ in range(60))
        strings = []
        for _ in range(pick.randint(1, 9)):
            cut = pick.randint(0, 20)
            strings.append((base[cut:] + "".join(pick.choice("abc") for _ in range(pick.randint(0, 30)))).encode())
        weights = [pick.choice([1, 1, 1, 2]) for _ in strings]
        seen = Counter()
        for s, w in zip(strings, weights, strict=True):
            for i in range(len(s) - 15):
                seen[s[i : i + 16]] += w
        got = repeated_starts(strings, weights, 16)
        for s, flags in zip(strings, got, strict=True):
            assert flags.tolist() == [seen[s[i : i + 16]] > 1 for i in range(len(s) - 15)]


def test_null_ids_repeated_rows_and_empty_table(spark):
    pick = random.Random(3)
    one = "".join(pick.choice("abcdefgh") for _ in range(500))
    docs = spark.createDataFrame([(1, one), (1, one), (None, one + "tail"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == [(0, 500, 1, b"tail"), (1, 500, 1, b""), (1, 500, 1, b""), (2, 0, 0, b"")]
    assert remove_repeats(docs.limit(0)).count() == 0
