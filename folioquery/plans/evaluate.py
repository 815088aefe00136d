"""The retrieval gate: labelled questions, hits in the top k, forbidden results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citation import chunk_citation
from ..operators import quality
from ..operators.expansion import Dictionary
from ..operators.filters import FILTER_LIMITS, filter_values, unknown_filters
from ..operators.index import CorpusIndex
from ..rules import SearchParams
from ..sources.corpus import Vehicle
from . import search as S


def gate_queries(cases: DataFrame, vehicle: Vehicle) -> DataFrame:
    """Labelled questions with the limits of their own filters and of the guard.

    Documents must pass both; an engine asked for as a filter holds besides the engine the
    question names, as separate limits.
    """
    asked = S.guarded_queries(cases, vehicle)
    own = {
        column: filter_values(F.col("filters"), key, kind) for key, (column, kind) in FILTER_LIMITS.items()
    }
    wanted = own.pop("only_docs")
    docs = (
        F.when(wanted.isNull(), F.col("only_docs"))
        .when(F.col("only_docs").isNull(), wanted)
        .otherwise(F.array_intersect("only_docs", wanted))
    )
    return asked.withColumns({"only_docs": docs, **own})


def gate_hits(
    index: CorpusIndex,
    cases: DataFrame,
    vehicle: Vehicle,
    synonyms: Dictionary | None = None,
    params: SearchParams = SearchParams(),
) -> DataFrame:
    """Hits of all questions in one plan, each question cut at its own ``top_k``.

    A filter under a key that no limit belongs to is an error, never ignored.
    """
    most, bound, unknown = cases.agg(
        F.coalesce(F.max("top_k"), F.lit(1)), F.coalesce(F.sum("top_k"), F.lit(0)),
        F.max(F.get(unknown_filters(F.col("filters")), F.lit(0))),
    ).first()
    if unknown is not None:
        raise ValueError(f"unknown filter {unknown!r}; known ones: {', '.join(FILTER_LIMITS)}")
    hits = S.search(index, gate_queries(cases, vehicle), synonyms, top_k=most, params=params)
    kept = hits.join(cases.select("query_id", "top_k"), "query_id").filter(
        F.col("rank") <= F.col("top_k")
    )
    return S.with_chunks(index, kept, params, bound)


def run_gate(
    index: CorpusIndex,
    cases: DataFrame,
    vehicle: Vehicle,
    synonyms: Dictionary | None = None,
    params: SearchParams = SearchParams(),
) -> DataFrame:
    """``(query_id, query, kind, passed)``: expected strings found, forbidden ones absent.

    ``cases`` as read by ``read_eval_cases`` plus a ``query_id``.
    """
    hits = gate_hits(index, cases, vehicle, synonyms, params).select(
        "query_id", chunk_citation().alias("citation"), "text"
    )
    hit = quality.hit_at_k(cases, hits).select(
        "query_id", F.lit("expected").alias("kind"), F.col("hit").alias("passed")
    )
    clean = quality.forbidden_found(cases, hits).select(
        "query_id", F.lit("forbidden").alias("kind"), (~F.col("found")).alias("passed")
    )
    return cases.select("query_id", "query").join(hit.unionByName(clean), "query_id")
