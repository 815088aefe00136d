"""Corpus invariants and the retrieval gate, as relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci


def _any_in(haystack: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: contains_ci(haystack, n))


def _judged(cases: DataFrame, hits: DataFrame, labels: str, out: str) -> DataFrame:
    """Whether any label string stands in any hit's citation and text.

    Each hit is judged on its own row and the verdicts are combined by ``max``,
    so texts are never gathered. Cases without hits count as not found.
    """
    wanted = cases.filter(F.size(F.coalesce(labels, F.array())) > 0).select("query_id", labels)
    haystack = F.concat_ws(" ", "citation", "text")
    return (
        wanted.join(hits, "query_id", "left")
        .groupBy("query_id")
        .agg(F.coalesce(F.max(_any_in(haystack, F.col(labels))), F.lit(False)).alias(out))
    )


def hit_at_k(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, hit)`` for cases that expect something in their top hits."""
    return _judged(cases, hits, "expect_any", "hit")


def forbidden_found(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, found)`` for cases that forbid something in their top hits."""
    return _judged(cases, hits, "forbid", "found")


def eval_sanity(cases: DataFrame) -> DataFrame:
    """One row: cases, distinct queries, and cases without any expectation."""
    def filled(name: str) -> Column:
        return F.size(F.coalesce(F.col(name), F.array())) > 0

    per_query = cases.groupBy("query").agg(
        F.count("*").alias("n"),
        F.sum((~(filled("expect_any") | filled("forbid"))).cast("bigint")).alias("empty"),
    )
    return per_query.agg(
        F.sum("n").alias("cases"), F.count("*").alias("distinct_queries"),
        F.sum("empty").alias("without_expectation"),
    )


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def missing_fields(chunks: DataFrame, fields: Iterable[str]) -> DataFrame:
    """One row: rows, and how many lack each field."""
    return chunks.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields],
    )


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents on one side only, with the side."""
    column = left.columns[0]
    sides = left.select(column, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(column, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        sides.groupBy(column).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .filter(F.col("_l") != F.col("_r"))
        .select(column, F.when(F.col("_l") == 1, "left").otherwise("right").alias("side"))
    )


def untitled_parts(chunks: DataFrame) -> DataFrame:
    """One row: parts of multi-part units, and how many carry no title."""
    many = chunks.filter(F.col("unit_parts") > 1)
    return many.agg(
        F.count("*").alias("parts"), F.count_if(F.col("section").isNull()).alias("untitled")
    )
