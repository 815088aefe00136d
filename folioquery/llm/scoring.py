"""Scores of texts under a unigram base and a self-attention model.

Counts cover all training rows: words are counted in each partition and summed by word. A
token is one position of the attention model, which predicts the token's class (the word's
crc32 modulo ``lm.IDS - 1``; the end has a class of its own); a word's probability is that
of its class times its share of the class, (c + 0.5) / (n + 0.5 * (v + 1)) with the n tokens
and v words that training rows have in the class, so unseen words share one half. The most frequent
``FREQUENT`` words travel to the tasks; all other words of a text are looked up by a
join, so vocabulary size has no bound. The attention weights start from a fit on the
``SAMPLE`` training rows of least hash; then every partition goes once over all its
training rows from there, and its changes are averaged, weighted by the targets it saw
(an embedding row: by the uses of its id). So the fit covers every training row; its last
digits depend on how the rows are partitioned.

Defined cases: null or empty text is its end token alone; repeated rows keep a row each;
a null id hashes as empty text; without training rows all counts are zero and the model
is uniform over ids; other columns are not looked at; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention_lm as lm
from .tables import as_bytes, stored

FREQUENT, SAMPLE, FOLDS, HELD = 300_000, 400, 5, 1
SHARE = 0.85  # of a token's probability that comes from the base
_END = b""  # no word is empty
_HELD_BLOCKS = 512  # blocks scored at once
_SENT_ROWS = 256  # embedding rows that are averaged together


def tokens_of(data: bytes) -> list[bytes]:
    """Lower-cased words between white space, and the end."""
    return [*data.lower().split(), _END]


def word_ids(classes: int | None = None) -> int:
    """Classes that words are hashed into."""
    return lm.IDS - 1 if classes is None else classes


def subwords(tokens: list[bytes], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text, one for each token but the end hashed, and how many belong to each token."""
    ids = np.fromiter(map(crc32, tokens), np.int64, len(tokens)) % classes
    ids[-1] = lm.END
    return ids, np.ones(len(ids), np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for data in batch.column("data"):
            counts.update(tokens_of(data.as_py()))
            if len(counts) > 500_000:
                yield rows()
    yield rows()


def _class_counts(counts: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words that the training rows have in every class; at most one row a class is collected."""
    of = F.when(F.octet_length("word") == 0, F.lit(lm.END)).otherwise(F.pmod(F.crc32("word"), F.lit(classes)))
    tokens, words = np.zeros(lm.IDS), np.zeros(lm.IDS)
    for i, n, v in counts.groupBy(of.alias("id")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        tokens[i], words[i] = n, v
    return tokens, words


def fit_all(training: DataFrame, model: dict, classes: int | None = None) -> dict:
    """The model after one pass over the ``data`` of all rows, averaged over partitions."""
    begun = training.sparkSession.sparkContext.broadcast(model)
    others = sorted(k for k in model if k[0] != "b" and k != "E")

    def batch_of(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        data = [v.astype(np.float32).tobytes() for v in sums.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(data, pa.binary())], names=["at", "data"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, ids = begun.value, word_ids(classes)
        texts = (subwords(tokens_of(d.as_py()), ids)[0] for b in batches for d in b.column("data"))
        end, uses, n = lm.train_pass(start, texts)
        if n:
            sums = {-1: np.concatenate([*(((end[k] - start[k]) * n).ravel() for k in others), [n]])}
            for low in range(0, lm.IDS, _SENT_ROWS):
                part = slice(low, low + _SENT_ROWS)
                if uses[part].any():
                    weight = uses[part, None]
                    sums[low] = np.concatenate([(end["E"][part] - start["E"][part]) * weight, weight], axis=1).ravel()
            yield batch_of(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0.0) + np.frombuffer(data, np.float32).astype(np.float64)
        if sums:
            yield batch_of(sums)

    schema = "at long, data binary"
    sums: dict[int, np.ndarray] = {}
    # At most a row for each part of the model and task; tasks are dealt by part.
    for at, data in training.select("data").mapInArrow(fit, schema).repartition("at").mapInArrow(add, schema).collect():
        sums[at] = sums.get(at, 0.0) + np.frombuffer(data, np.float32).astype(np.float64)
    out = dict(model)
    if sums:
        out["E"] = model["E"].copy()
        *change, n = sums.pop(-1)
        change, at = np.array(change) / n, 0
        for k in others:
            out[k] = (model[k] + change[at : at + model[k].size].reshape(model[k].shape)).astype(np.float32)
            at += model[k].size
        for low, data in sums.items():
            data = data.reshape(-1, lm.DIM + 1)
            out["E"][low : low + len(data)] += (data[:, :-1] / np.maximum(data[:, -1:], 1)).astype(np.float32)
    return out


_NAMES = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"]
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _settle(pending: list[tuple], model: dict, mass: np.ndarray, frequent: dict, rest: float, out: list[list], rare: tuple[list, list, list]) -> None:
    """Score whole texts together; words that are not frequent are left to the join (words, shares, ends by text)."""
    x, y, follows, _ = lm.blocks([ids for *_, ids in pending])
    flat = np.zeros(y.shape)
    for low in range(0, len(x), _HELD_BLOCKS):
        # One block before comes along as context and is not scored again.
        start = max(0, low - 1)
        part = slice(start, low + _HELD_BLOCKS)
        flat[low : low + _HELD_BLOCKS] = lm.log_probabilities(model, x[part], y[part], follows[part])[low - start :]
    # Probability of a class a token's worth: times c + 0.5 it is that of the word.
    real = y >= 0
    share = np.exp(flat[real]) / mass[y[real]]
    at = 0
    for number, doc, held, tokens, _ in pending:
        p, at = share[at : at + len(tokens)], at + len(tokens)
        c = np.fromiter(map(frequent.get, tokens, repeat(-1)), np.int64, len(tokens))
        seen = c >= 0
        n = c[seen] + 0.5
        base = float(np.log10(n / rest).sum())
        score = float(np.log10(mixed(n / rest, n * p[seen])).sum())
        left = np.flatnonzero(~seen)
        rare[0].extend(map(tokens.__getitem__, left.tolist()))
        rare[1].append(p[left])
        rare[2].append(len(rare[0]))
        for column, value in zip(out, (number, doc, held, len(tokens), int(seen.sum()), base, score), strict=True):
            column.append(value)


def mixed(base, attended):
    """Probability of a token: a share of its base probability, the rest from attention."""
    return SHARE * base + (1 - SHARE) * attended + 1e-300


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None) -> DataFrame:
    """One row per document: token counts, base score and model score, log10."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.pmod(F.crc32(key), F.lit(FOLDS)) == HELD).alias("held_out"), as_bytes(text_col).alias("data"))
    training = rows.filter(~F.col("held_out"))
    counts = stored(training.select("data").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rest = total + 0.5 * (distinct + 1)
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    frequent = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
    sample = training.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE).select("data").toArrow()
    own = word_ids(classes)
    in_class, words_of = _class_counts(counts, own)
    model = lm.train(lm.init(in_class), [subwords(tokens_of(d.as_py()), own)[0] for d in sample.column(0)])
    model = fit_all(training, model, classes)
    shared = spark.sparkContext.broadcast((model, in_class + 0.5 * (words_of + 1), frequent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass, frequent = shared.value
        ids, number = word_ids(classes), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            rare: tuple[list, list, list] = ([], [np.zeros(0)], [0])
            pending: list[tuple] = []
            size = 0
            for doc, held, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = tokens_of(data.as_py())
                pending.append((number, doc, held, tokens, subwords(tokens, ids)[0]))
                number += 1
                size += len(tokens)
                if size > 1 << 19:
                    _settle(pending, model, mass, frequent, rest, out, rare)
                    pending, size = [], 0
            _settle(pending, model, mass, frequent, rest, out, rare)
            pairs = pa.StructArray.from_arrays([pa.array(rare[0], pa.binary()), pa.array(np.concatenate(rare[1]))], ["word", "p"])
            columns = [pa.array(c, k) for c, k in zip(out, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(rare[2], pa.int32()), pairs)], names=_NAMES)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<word:binary,p:double>>"
    scored = stored(rows.mapInArrow(score, schema), "lm-scores")
    words = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.p").alias("p"))
    looked = words.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    more = looked.groupBy("row").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.sum(F.log10((F.col("c") + 0.5) / rest)).alias("more_base"),
        F.sum(F.log10(mixed((F.col("c") + 0.5) / rest, (F.col("c") + 0.5) * F.col("p")))).alias("more_score"),
    )
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
