"""Top-k without scoring every posting: blocks of chunks that cannot reach the list are left out.

The index keeps, for each term and block of chunks, the shortest chunk for every small term
count (``block_bounds``). From these follows the largest score a chunk of the block can have
for a question, whatever k1 and b are. The blocks of largest possible score are scored
first; the k-th hit among them is a threshold that the final k-th hit cannot fall below,
and a block whose bound does not reach it holds no hit. The rest are scored exactly.

Bounds of all blocks are rows of a narrow table, several postings to a row; they meet by
(query, block), so neither a frequent term nor a long question crowds a task. In an index
for known questions a block's bounds are one row, and meet the questions where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import SearchParams
from ..session import Small, lookup, new_scratch_path
from .index import BOUND_COUNTS, CorpusIndex, by_block
from .scoring import top_hits

# Hits compare scores rounded to six digits, and sums differ in their last bits by order.
SLACK = 2e-6


def largest_term_score(index: CorpusIndex, params: SearchParams) -> Column:
    """The best score one term can give in a block: the shortest chunk of each term count."""

    def score(tf: Column, length: Column) -> Column:
        norm = 1 - params.b + params.b * length / F.lit(index.avg_len or 1.0)
        return F.when(length.isNotNull(), tf * (params.k1 + 1) / (tf + params.k1 * norm))

    each = [score(F.lit(float(n)), F.col(f"len_{n}")) for n in range(1, BOUND_COUNTS)]
    many = score(F.col("most").cast("double"), F.col("len_many"))
    return F.col("idf") * F.greatest(*each, many)


def _found_bounds(index: CorpusIndex, terms: DataFrame | Small, params: SearchParams) -> DataFrame:
    """Bounds of the asked terms with the rows that ask, all of a question and block in one task."""
    if index.asked_bounds is not None and isinstance(terms, Small):
        matches = sum(row["df"] for row in terms.rows)  # at least as many as bounds
        rows = by_block(index.asked_bounds, matches, terms=terms.values("term"))
        return rows.drop("bucket").join(F.broadcast(terms.df.drop("bucket")), "term")
    asked = terms.df if isinstance(terms, Small) else terms
    return lookup(index.bounds, asked, ["bucket", "term"], params.broadcast_rows).repartition("query_id", "block")


def block_scores(index: CorpusIndex, terms: DataFrame | Small, params: SearchParams) -> DataFrame:
    """``(query_id, block, bound)``: no chunk of the block scores above ``bound``.

    Mirrors the three levels of ranking: a phrase needs all its terms in the block, the
    best phrase stands for its concept, and under strict coverage a block without some
    concept is left out at once.
    """
    found = _found_bounds(index, terms, params).withColumn("_s", largest_term_score(index, params))
    phrase = ["query_id", "block", "n_concepts", "wants_torque", "concept_id", "phrase_id", "phrase_len"]
    torque = F.max("has_torque").alias("has_torque")
    phrases = (
        found.groupBy(*phrase)
        .agg(
            (F.max("weight") * F.sum("_s")).alias("s"), F.count("*").alias("_found"),
            F.sum(F.col("has_title").cast("int")).alias("_titles"), torque,
        )
        .filter(F.col("_found") == F.col("phrase_len"))
        .withColumn("in_title", F.col("_titles") == F.col("phrase_len"))
    )
    concepts = phrases.groupBy(*phrase[:5]).agg(F.max("s").alias("s"), F.max("in_title").alias("in_title"), torque)
    best = F.col("s") * F.when(F.col("in_title"), 1 + params.title_bonus).otherwise(F.lit(1.0))
    blocks = concepts.groupBy(*phrase[:4]).agg(F.sum(best).alias("s"), F.count("*").alias("covered"), torque)
    if params.coverage == "strict":
        blocks = blocks.filter(F.col("covered") == F.col("n_concepts"))
        bound = F.col("s")
    else:
        bound = F.pow(F.col("covered") / F.col("n_concepts"), F.lit(2.0)) * F.col("s")
    bound = bound + params.proximity_bonus * (F.col("covered") - 1)
    bound = bound + F.when(F.col("wants_torque") & F.col("has_torque"), params.torque_bonus).otherwise(0.0)
    return blocks.select("query_id", "block", bound.alias("bound"))


def live_blocks(
    index: CorpusIndex, terms: DataFrame | Small, score: Callable[[DataFrame], DataFrame], params: SearchParams, top_k: int, per_doc: int | None,
) -> DataFrame:
    """``(query_id, block)`` that can hold one of the ``top_k`` hits.

    ``score(blocks)`` gives the scored chunks of the given blocks. A question with fewer
    than ``top_k`` hits in its first blocks keeps all its blocks.
    """
    spark = index.spark
    path = new_scratch_path(spark, "block-bounds")
    block_scores(index, terms, params).write.parquet(path)
    blocks = spark.read.schema("query_id long, block long, bound double").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = blocks.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= params.first_blocks)
    hits = top_hits(score(first.select("query_id", "block")), top_k, per_doc)
    reached = hits.groupBy("query_id").agg(F.count("*").alias("_hits"), F.min("score").alias("_least"))
    reached = reached.filter(F.col("_hits") >= top_k)
    return (
        blocks.join(reached, "query_id", "left")
        .filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - SLACK))
        .select("query_id", "block")
    )
