"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .languages import fit_trigrams, identify_languages, markup_language
from .licenses import scan_licenses
from .near_duplicates import near_duplicate_classes
from .nearest import nearest
from .packing import pack
from .repeated_text import remove_repeats
from .resampling import importance_resample
from .scoring import score_texts
from .secrets import scan_secrets
from .tables import table
from .url_lists import host_of, judge_captures
from .vector_links import link_vectors
from .whitening import whiten

HORIZON = 360


def op1_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = fit_trigrams(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = identify_languages(
        pages.withColumn("markup", markup_language(F.col("html"))), langs, model, text_col="html", declared=F.col("markup"),
        host=host_of(F.col("url")), html=True, keep_text=False,
    )
    return found.drop("markup")


def filter_list(pages: DataFrame) -> DataFrame:
    """Dated statements about every host, its parent domain, and a path of it.

    The given tables have no filter list, so days and actions follow from a digest
    of each key.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    keys = hosts.select(
        F.explode(F.array(F.col("host"), F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2)), F.concat(F.col("host"), F.lit("/en")))).alias("key")
    ).distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", "key", F.col("k").cast("string"))), at, 4), 16, 10).cast("int")
    return keys.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select(
        "key", (number(1) % HORIZON).alias("day"),
        F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), number(5) % 3 + 1).alias("action"),
    )


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") % HORIZON).cast("int").alias("fetch_day"))
    return judge_captures(captures, filter_list(pages), HORIZON)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("hits")


def op10_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_merge, op2_decontamination, op3_minhash, op4_attention_scores, op5_packing, op6_languages, op7_url_lists, op8_secrets, op9_licenses, op10_vector_links,
        op11_whitening, op12_resampling, op13_nearest,
    )
}
