"""Target-distribution importance resampling over hashed word runs.

A document's features are its runs of up to ``longest`` consecutive words, hashed into
buckets. How often each bucket occurs in the corpus and in the target gives its gain; a
document's weight is the sum over its features, and weights with Gumbel noise drawn from
the id rank the documents, which samples without replacement in proportion to the weights.

Texts repeat lines, so line feeds cut them and each distinct line is looked at once: its
features are hashed once, counted into the corpus as often as the line occurs, and summed
into one weight that all documents with this line take. Runs that cross a line feed belong
to no line; they are listed per document and added apart. A document travels as the digests
of its lines. Lines that make up more than a ``HOT``-th of all lines are fewer than ``HOT``:
their weights are broadcast, so no key of the remaining join holds more than that share.
The bucket counts are all that reaches the driver; their number is a parameter.

Ranks come from a range-sorted table: places within a part plus the sizes of parts before.

Defined cases: a null text has no words; it counts among all documents but is drawn only
with ``least_words`` 0. A null id draws its noise as the text ``<seed>:`` and comes last
among ties. Repeated rows keep a row each, with neighbouring ranks. An empty target has
equal counts everywhere; an empty table gives an empty result. Other columns are not
looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.functions.lets import let

from .tables import stored

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
HOT = 1000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def _runs(words: Column, width: int) -> Column:
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, width)))


def line_buckets(line: Column, longest: int, buckets: int) -> Column:
    """Buckets of a line's features, one for each occurrence."""

    def of(words: Column) -> Column:
        found = [F.transform(words, lambda w: bucket_of(w, buckets))]
        found += [F.transform(_runs(words, n), lambda w: bucket_of(w, buckets)) for n in range(2, longest + 1)]
        return F.concat(*found)

    return let(words_of(line), of)


def crossing_buckets(lines: Column, longest: int, buckets: int) -> Column:
    """Buckets of the runs that cross a line feed."""
    if longest < 2:
        return F.array().cast("array<int>")
    placed = F.flatten(F.transform(lines, lambda line, i: F.transform(words_of(line), lambda w: F.struct(i.alias("line"), w.alias("word")))))

    def across(words: Column, width: int) -> Column:
        starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
        crossing = F.filter(starts, lambda i: F.get(words, i - 1)["line"] != F.get(words, i + width - 2)["line"])
        return F.transform(crossing, lambda i: bucket_of(F.concat_ws(" ", F.transform(F.slice(words, i, width), lambda x: x["word"])), buckets))

    def of(words: Column) -> Column:
        return F.concat(*[across(words, n) for n in range(2, longest + 1)])

    return let(placed, of)


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _segments(texts: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the digests of their lines, distinct lines with their buckets), both written."""
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.transform(_lines(text_col), lambda line: F.unhex(F.md5(line.cast("binary")))).alias("keys"), crossing_buckets(_lines(text_col), longest, buckets).alias("crossing"),
    )
    lines = texts.select(F.explode_outer(_lines(text_col)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    lines = lines.select(
        F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), "times", line_buckets(F.col("line"), longest, buckets).alias("buckets"),
        F.size(words_of(F.col("line"))).alias("words") if longest > 1 else F.lit(0).alias("words"),
    )
    if longest == 1:
        lines = lines.withColumn("words", F.size("buckets"))
    return stored(rows, "resampling-rows"), stored(lines, "resampling-lines")


def _counts(rows: DataFrame, lines: DataFrame, buckets: int) -> list[int]:
    """Occurrences of each bucket in all rows."""
    each = lines.select(F.explode_outer("buckets").alias("bucket"), "times")
    each = each.unionByName(rows.filter(F.size("crossing") > 0).select(F.explode_outer("crossing").alias("bucket"), F.lit(1).cast("long").alias("times")))
    out = [0] * buckets
    for r in each.filter("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Scaled log ratio of smoothed shares, for each bucket."""
    b, s, t = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return [math.floor(1000.0 * math.log((float(y) + 1.0) * (s + b) / ((float(x) + 1.0) * (t + b)))) for x, y in zip(corpus, target, strict=True)]


def _ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` by falling score, then id, with ranks up to ``drawn``."""
    ordered = scored.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered, "resampling-order").withColumn("part", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r.part, r["count"]) for r in ordered.groupBy("part").count().collect())  # one for each part of the sort
    before, seen = [], 0
    for part, n in sizes:
        before.append((part, seen))
        seen += n
    offsets = F.broadcast(ordered.sparkSession.createDataFrame(before, "part long, offset long"))
    rank = F.col("offset") + F.col("at") + 1
    return ordered.join(offsets, "part").withColumn("rank", F.when(rank <= drawn, rank))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn)."""
    rows, lines = _segments(docs, id_col, text_col, longest, buckets)
    none = target.select(F.lit(None).cast("long").alias("id"), F.col(target_col).alias("text"))
    gain = gains(_counts(rows, lines, buckets), _counts(*_segments(none, "id", "text", longest, buckets), buckets))
    # One constant of the plan instead of thousands of literals.
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    weigh = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    weighed = stored(lines.select("key", "times", "words", F.size("buckets").alias("features"), weigh(F.col("buckets")).alias("gain")), "resampling-weights")
    total = weighed.agg(F.sum("times")).first()[0] or 0
    often = weighed.filter(F.col("times") * HOT > total).select("key", "words", "features", "gain")  # fewer than HOT rows
    seldom = weighed.filter(F.col("times") * HOT <= total).select("key", "words", "features", "gain")
    each = rows.select("row", "doc_id", F.explode_outer("keys").alias("key"))
    sums = ["row", "doc_id", "words", "features", "gain"]
    joined = each.join(F.broadcast(often), "key").select(*sums).unionByName(each.join(F.broadcast(often), "key", "left_anti").join(seldom, "key").select(*sums))
    if longest > 1:
        joined = joined.unionByName(rows.select("row", "doc_id", F.lit(0).alias("words"), F.size("crossing").alias("features"), weigh(F.col("crossing")).alias("gain")))
    whole = joined.groupBy("row", "doc_id").agg(*[F.sum(c).cast("long").alias(n) for c, n in (("words", "n_words"), ("features", "n_features"), ("gain", "weight"))])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)
    scored = stored(whole.withColumn("score", (F.col("weight") + noise).cast("long")), "resampling-scores")
    able = scored.filter(F.col("n_words") >= least_words)
    ranked = _ranked(able, able.count() * percent // 100)
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*out))
