"""Where in a text a question is answered best: folds over word positions.

Both measures walk once through the places of the asked words in reading order and keep
the last place of each word, so a step costs as many comparisons as words were asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.lets import let
from ..functions.text import fold, surface_tokens
from ..session import join_small
from .index import occurrences

# Weights are whole millionths of an idf, so equal stretches weigh exactly the same.
WEIGHT_UNIT = 1_000_000


def _in_reading_order(places: Column) -> Column:
    """``array<array<int>>`` as one sorted array of ``struct<at, which>``."""
    return F.sort_array(
        F.flatten(
            F.transform(
                places,
                lambda own, i: F.transform(own, lambda p: F.struct(p.alias("at"), i.alias("which"))),
            )
        )
    )


def _seen(last: Column, place: Column) -> Column:
    """The last place of each word once ``place`` is read."""
    return F.transform(last, lambda at, i: F.when(i == place["which"], place["at"]).otherwise(at))


def _nothing_seen(places: Column) -> Column:
    return F.array_repeat(F.lit(-1), F.size(places))


def smallest_cover(places: Column) -> Column:
    """``struct<first, last>`` of the shortest stretch with a place of every word.

    The earliest of equally short ones; null fields if a word has no place.
    """
    none = F.lit(None).cast("int")

    def step(best: Column, place: Column) -> Column:
        def judged(last: Column) -> Column:
            first = F.array_min(last)
            shorter = best["last"].isNull() | (place["at"] - first < best["last"] - best["first"])
            better = (first >= 0) & shorter
            return F.struct(
                F.when(better, first).otherwise(best["first"]).alias("first"),
                F.when(better, place["at"]).otherwise(best["last"]).alias("last"),
                last.alias("seen"),
            )

        return let(_seen(best["seen"], place), judged)

    return let(
        places,
        lambda all_: F.aggregate(
            _in_reading_order(all_),
            F.struct(none.alias("first"), none.alias("last"), _nothing_seen(all_).alias("seen")),
            step,
            lambda best: F.struct(best["first"].alias("first"), best["last"].alias("last")),
        ),
    )


def best_window(places: Column, weights: Column, width: int) -> Column:
    """``struct<first, last, weight>`` of the stretch within ``width`` words whose different
    words weigh most, each counted once; the earliest of equals. Null fields and weight 0
    if no word has a place."""
    none = F.lit(None).cast("int")

    def step(best: Column, place: Column) -> Column:
        def near(at: Column) -> Column:
            return (at >= 0) & (at > place["at"] - width)

        def judged(last: Column) -> Column:
            held = F.zip_with(last, weights, lambda at, w: F.when(near(at), w).otherwise(F.lit(0)))
            def weighed(weight: Column) -> Column:
                # Two words may share a place: the second one narrows the stretch.
                better = (weight > best["weight"]) | (
                    (weight == best["weight"]) & (place["at"] == best["last"])
                )
                return F.struct(
                    F.when(better, F.array_min(F.filter(last, near))).otherwise(best["first"]).alias("first"),
                    F.when(better, place["at"]).otherwise(best["last"]).alias("last"),
                    F.greatest(weight, best["weight"]).alias("weight"),
                    last.alias("seen"),
                )

            return let(F.aggregate(held, F.lit(0).cast("bigint"), lambda total, w: total + w), weighed)

        return let(_seen(best["seen"], place), judged)

    return let(
        places,
        lambda all_: F.aggregate(
            _in_reading_order(all_),
            F.struct(
                none.alias("first"), none.alias("last"), F.lit(0).cast("bigint").alias("weight"),
                _nothing_seen(all_).alias("seen"),
            ),
            step,
            lambda best: F.struct(
                best["first"].alias("first"), best["last"].alias("last"), best["weight"].alias("weight")
            ),
        ),
    )


def cover_pairs(found: Column, window: int) -> Column:
    """How many steps from concept to concept a close stretch makes: all or none.

    ``found`` holds ``struct<concept_id, places>``. The shortest stretch with a place of
    every concept counts if it spans at most ``window`` words for each step.
    """

    def count(all_: Column) -> Column:
        steps = F.size(all_) - 1
        return let(
            smallest_cover(F.transform(all_, lambda f: f["places"])),
            lambda s: F.when(s["last"] - s["first"] <= window * steps, steps).otherwise(F.lit(0)),
        )

    return F.when(F.size(found) > 1, let(found, count)).otherwise(F.lit(0))


def _words_between(text: Column, first: Column, last: Column) -> Column:
    """The text from word ``first`` to word ``last``, as written, line breaks as blanks."""
    words = F.regexp_extract_all(text, F.lit(rules.TOKEN), F.lit(0))

    def joined(w: Column, gaps: Column) -> Column:
        pieces = F.transform(
            F.sequence(first, last),
            lambda i: F.concat(
                F.get(w, i), F.when(i < last, F.get(gaps, i + 1)).otherwise(F.lit(""))
            ),
        )
        return F.regexp_replace(F.array_join(pieces, ""), r"\s+", " ")

    return let(words, lambda w: let(F.split(text, rules.TOKEN), lambda gaps: joined(w, gaps)))


def passage(text: Column, asked: Column, width: int) -> Column:
    """``struct<first, last, weight, text>``: the best stretch of a text for a question.

    ``asked`` holds ``struct<term, weight>``. ``first`` and ``last`` are the outermost
    asked words of the stretch (from 0, null if there are none); ``text`` shows ``width``
    words around them, or the beginning of the text. A text whose lower case has other
    word borders is shown in lower case. A text without words gives null text.
    """

    def shown(body: Column, best: Column, n_words: Column) -> Column:
        spare = F.lit(width - 1) - (best["last"] - best["first"])
        wanted = F.coalesce(best["first"] - F.floor(spare / 2).cast("int"), F.lit(0))
        first = F.greatest(F.least(wanted, n_words - width), F.lit(0))
        last = F.least(first + width, n_words) - 1
        return F.struct(
            best["first"].alias("first"), best["last"].alias("last"), best["weight"].alias("weight"),
            F.when(n_words > 0, let(first, lambda a: let(last, lambda b: _words_between(body, a, b)))).alias("text"),
        )

    def found(body: Column) -> Column:
        hits = F.filter(occurrences(body, False), lambda o: F.array_contains(asked["term"], o["term"]))
        places = let(
            hits,
            lambda all_: F.transform(
                asked,
                lambda a: F.transform(F.filter(all_, lambda o: o["term"] == a["term"]), lambda o: o["pos"]),
            ),
        )
        same = F.size(surface_tokens(body)) == F.regexp_count(body, F.lit(rules.TOKEN))
        return let(
            best_window(places, asked["weight"], width),
            lambda best: shown(
                F.when(same, body).otherwise(fold(body)), best, F.size(surface_tokens(body))
            ),
        )

    return let(F.coalesce(text, F.lit("")), found)


def with_passages(hits: DataFrame, terms: DataFrame, width: int = 40) -> DataFrame:
    """Hits (``query_id``, ``text``) with their best ``passage`` of about ``width`` words.

    ``terms(query_id, term, idf)`` may name a term several times. Only the texts of hits
    are looked at: a second pass over the postings of frequent words would cost more.
    """
    asked = (
        terms.groupBy("query_id", "term")
        .agg(F.round(F.max("idf") * WEIGHT_UNIT).cast("bigint").alias("weight"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_asked"))
    )
    none = F.array().cast("array<struct<term:string,weight:bigint>>")
    return (
        join_small(hits, asked, "query_id", "left")
        .withColumn("_asked", F.coalesce("_asked", none))
        .withColumn("passage", passage(F.col("text"), F.col("_asked"), width))
        .drop("_asked")
    )
