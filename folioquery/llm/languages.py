"""Language identification by fusing independent evidence in one posterior.

Four pieces are combined: the text's likelihood under hashed byte-trigram models,
the language its markup declares, the suffix of its address, and a prior of its host.
The priors are counted, not assumed: soft decisions from the text alone are summed by
host, by registered domain and in all; a host's counts are smoothed towards its
domain's and those towards the whole. How often a declaration or a suffix goes with a
language is counted the same way. A row's own decision is taken out of its host's and
domain's counts, so it is not evidence for itself.

A further class stands for everything else, text in no labelled language and noise: all
trigrams alike, ``BACKGROUND`` of all texts beforehand, no evidence but its likelihood. It
takes part in the posterior, so a text that fits no language is not accepted.

Each text goes to Python once for the fit and once for its likelihood, which is written;
counts are made from it without reading texts again. Where texts are kept they are written
beside it, and decided on where they are if the count tables were counted to be small; else
decisions are made from narrow rows and meet the texts last, by a row key. Likelihoods leave Python in slices of ``SLICE`` rows.

All counts cover all rows. What reaches the driver is the trigram model, whose size is
languages x ``BUCKETS`` whatever the corpus. Count tables are joined; beside
kept texts they are broadcast up to ``FEW_COUNTS``, else only below Spark's size threshold, and skewed hosts are split by adaptive execution.

Defined cases: a text without words has no likelihood and is never accepted; null
declaration, host or suffix give no evidence; a declaration is reduced to its primary
subtag; languages are those of the labelled rows (null labels ignored), and without any
the result is null and not accepted; ties go to the first language in order; repeated
rows keep a row each; other columns are carried, those named like a result are replaced;
working columns start with ``_lang_``. More than ``MAX_LANGUAGES`` labels are an error:
labels are a closed set of languages, and the model on the driver has that bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.session import small_or_none

from .tables import as_bytes, stored
from .words import fold_words

BUCKETS = 1 << 14
MAX_LANGUAGES = 256
# A text's trigrams are not independent: their summed evidence levels off at so many.
FULL_WEIGHT = 200.0
ALPHA = 10.0  # pseudo-rows that a host or domain starts with
MIN_PROBABILITY = 0.5
BACKGROUND = 0.01
SLICE = 512
FEW_COUNTS = 400_000  # counts of a table, by key and language, that are broadcast where texts are carried
RESULTS = ["lang_id", "lang_probability", "lang_by_text", "lang_accepted", "lang_declared", "lang_host", "lang_suffix"]

_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible_text(html: bytes) -> bytes:
    """Text of a page: no scripts, styles, comments or tags, entities resolved."""
    return unescape(_HIDDEN.sub(b" ", html).decode("utf-8", "replace")).encode("utf-8", "replace")


def trigram_buckets(data: bytes) -> np.ndarray:
    """Hashed trigrams of the lower-cased words, spaces included; empty without words."""
    words = fold_words(data)
    if not words:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 14)


def fit_trigrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages of the labelled rows and log P(trigram | language), from all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = trigram_buckets(data.as_py())
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                totals[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), as_bytes(text_col).alias("data"))
    summed = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    place = {lang: i for i, lang in enumerate(langs)}
    at = [place[x] for x in table.column("lang").to_pylist()]
    np.add.at(counts, (table.column("bucket").to_numpy(), at), table.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(axis=0))


def _with_likelihood(rows: DataFrame, model: np.ndarray, html: bool, text_col: str = "_lang_text") -> DataFrame:
    """``rows``, without ``_lang_text``, with the number of trigrams ``_lang_n`` of the text column,
    ``_lang_ll`` relative to the best language, and ``_lang_other``, the background's."""
    kept = [f for f in rows.schema.fields if f.name != "_lang_text"]
    schema = T.StructType([
        *kept, T.StructField("_lang_ll", T.ArrayType(T.DoubleType())), T.StructField("_lang_other", T.DoubleType()), T.StructField("_lang_n", T.LongType()),
    ])
    shared = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    names, flat = [f.name for f in kept], -np.log(BUCKETS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lls, others, sizes = [], [], []
                for data in batch.column(text_col).cast(pa.binary()):
                    data = data.as_py() or b""
                    found = trigram_buckets(visible_text(data) if html else data)
                    level = 1 + len(found) / FULL_WEIGHT
                    ll = weights[found].sum(axis=0, dtype=np.float64) / level
                    lls.append((ll - ll.max()).tolist())
                    others.append(len(found) * flat / level - ll.max())
                    sizes.append(len(found))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names), pa.array(lls, pa.list_(pa.float64())), pa.array(others, pa.float64()), pa.array(sizes, pa.int64())],
                    names=[*names, "_lang_ll", "_lang_other", "_lang_n"],
                )

    return rows.mapInArrow(score, schema)


def _softmax(logs: Column) -> Column:
    """Probabilities from log values of which the largest is near zero."""
    powers = F.transform(logs, lambda x: F.exp(x))
    return F.transform(
        F.array(F.struct(powers.alias("p"), F.aggregate(powers, F.lit(0.0), lambda a, x: a + x).alias("s"))),
        lambda x: F.transform(x["p"], lambda v: v / x["s"]),
    )[0]


def _counts(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Soft decisions summed by key: (key, array of counts by language)."""
    sums = F.array(*[F.sum(F.col("_lang_soft")[i]) for i in range(size)])
    return rows.filter((F.col("_lang_n") > 0) & F.col(key).isNotNull()).groupBy(key).agg(sums.alias(name))


def identify_languages(
    rows: DataFrame, langs: list[str], model: np.ndarray, *, text_col: str, declared: Column, host: Column, html: bool = False,
    keep_text: bool = True,
) -> DataFrame:
    """``rows`` with ``lang_id``, ``lang_probability``, ``lang_by_text``, ``lang_accepted``,
    ``lang_declared``, ``lang_host`` and ``lang_suffix``; without the text column on request."""
    labels = F.split(host, r"\.")
    carried = [c for c in rows.columns if c not in RESULTS and (keep_text or c != text_col)]
    keys = ["_lang_declared", "_lang_host", "_lang_domain", "_lang_suffix"]
    prepared = rows.select(
        *carried,
        F.nullif(F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), "^[A-Za-z]+", 0)), F.lit("")).alias("_lang_declared"),
        F.nullif(host, F.lit("")).alias("_lang_host"),
        F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).alias("_lang_domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).alias("_lang_suffix"),
        *([] if keep_text else [as_bytes(text_col).alias("_lang_text")]),
    )
    passed = carried
    size = max(1, len(langs))
    read = "_lang_text"
    if keep_text:
        # Texts are written once, beside their evidence.
        prepared, read = prepared.withColumn("_lang_row", F.monotonically_increasing_id()), text_col
    soft = stored(_with_likelihood(prepared, model, html, read), "language-evidence")
    rows = soft
    soft = soft.withColumn("_lang_soft", _softmax(F.col("_lang_ll"))).withColumn("_lang_all", F.lit(0))
    whole = _counts(soft, "_lang_all", size, "n").first()
    total = np.array(whole["n"] if whole else [0.0] * size)
    base = F.array(*[F.lit(float(x)) for x in (total + 1) / (total.sum() + size)])
    marginal = F.array(*[F.lit(float(x)) for x in total + 1.0])

    counted = {key: _counts(soft, key, size, f"{key}_n") for key in keys}
    if keep_text:
        few = {key: small_or_none(counts, FEW_COUNTS // size) for key, counts in counted.items()}
        if all(few.values()):
            counted = {key: small.df for key, small in few.items()}
        else:
            passed = ["_lang_row"]  # many keys: texts wait where they are and meet their language last
    joined = soft.select(*passed, *keys, "_lang_ll", "_lang_other", "_lang_n", "_lang_soft")
    for key, counts in counted.items():
        joined = joined.join(counts, key, "left")

    zero = F.array(*[F.lit(0.0)] * size)
    own = F.when(F.col("_lang_n") > 0, F.col("_lang_soft")).otherwise(zero)

    def smoothed(counts: Column, towards: Column) -> Column:
        others = F.zip_with(counts, own, lambda n, mine: F.greatest(n - mine, F.lit(0.0)))
        return F.transform(
            F.array(F.struct(others.alias("n"), F.aggregate(others, F.lit(ALPHA), lambda a, x: a + x).alias("s"))),
            lambda x: F.zip_with(x["n"], towards, lambda n, p: (n + ALPHA * p) / x["s"]),
        )[0]

    def evidence(counts: Column) -> Column:
        return F.when(counts.isNull(), zero).otherwise(F.zip_with(counts, marginal, lambda n, m: F.log((n + 0.5) / m)))

    joined = (
        joined.withColumn("_lang_p1", F.when(F.col("_lang_domain_n").isNull(), base).otherwise(smoothed(F.col("_lang_domain_n"), base)))
        .withColumn("_lang_p2", F.when(F.col("_lang_host_n").isNull(), F.col("_lang_p1")).otherwise(smoothed(F.col("_lang_host_n"), F.col("_lang_p1"))))
    )
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("_lang_ll"), F.transform("_lang_p2", lambda p: F.log(p))), add(evidence(F.col("_lang_declared_n")), evidence(F.col("_lang_suffix_n"))))
    # The background is the last entry.
    joined = joined.withColumn("_lang_logs", F.array_append(logs, F.col("_lang_other") + float(np.log(BACKGROUND))))
    joined = joined.withColumn("_lang_logs", F.transform("_lang_logs", lambda x: x - F.array_max("_lang_logs")))
    joined = joined.withColumn("_lang_post", F.slice(_softmax(F.col("_lang_logs")), 1, size)).withColumn("_lang_best", F.array_max("_lang_post"))
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.lit(None).cast("array<string>")
    best = names[(F.array_position("_lang_post", F.col("_lang_best")) - 1).cast("int")]
    by_text = names[(F.array_position("_lang_ll", F.lit(0.0)) - 1).cast("int")]
    worded = F.col("_lang_n") > 0
    accepted = worded & (F.col("_lang_best") >= MIN_PROBABILITY) & F.lit(bool(langs))
    decided = joined.select(
        *passed,
        best.alias("lang_id"), F.col("_lang_best").alias("lang_probability"), F.when(worded, by_text).alias("lang_by_text"), accepted.alias("lang_accepted"),
        F.col("_lang_declared").alias("lang_declared"), F.col("_lang_host").alias("lang_host"), F.col("_lang_suffix").alias("lang_suffix"),
    )
    return rows.select(*carried, "_lang_row").join(decided, "_lang_row").drop("_lang_row") if passed == ["_lang_row"] else decided


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
