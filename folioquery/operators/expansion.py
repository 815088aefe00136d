"""From questions to concepts: query words, repaired words, synonyms.

Queries travel as a relation ``(query_id, query)``, so one question and a batch
take the same plan. The result is one row per term of each alternative phrase::

    query_id, n_concepts, wants_torque, concept_id, phrase_id, phrase_len, plain, term, weight
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lets import explode_once, let
from ..functions.text import (
    is_compound,
    stem,
    stems,
    surface_tokens,
    trigrams,
    without_stop_words,
)
from ..rules import SearchParams
from ..session import lookup, small_or_none
from .index import CorpusIndex, term_bucket

KEY_GLUE = "\u0001"
GROUPS_TYPE = "array<struct<start:int,len:int,alternatives:array<array<string>>>>"


def query_words(queries: DataFrame, params: SearchParams) -> DataFrame:
    """``(query_id, pos, surface, stem, parts)``: words in order, stop words left out.

    ``parts`` holds the stems of a compound's parts, or the word's own stem.
    """
    kept = without_stop_words(surface_tokens(F.col("query")), params.stop_words)
    pieces = F.when(
        is_compound(F.col("surface")), F.split("surface", "-")
    ).otherwise(F.array())
    return (
        queries.select("query_id", F.posexplode_outer(kept).alias("pos", "surface"))
        .filter(F.col("surface").isNotNull())
        .withColumn("_stems", stems(F.concat(F.array("surface"), pieces)))
        .select(
            "query_id", "pos", "surface", F.get("_stems", F.lit(0)).alias("stem"),
            F.when(
                F.size("_stems") > 1, F.slice("_stems", F.lit(2), F.size("_stems") - 1)
            ).otherwise(F.col("_stems")).alias("parts"),
        )
    )


@dataclass(frozen=True)
class Dictionary:
    """Synonym groups by the stems of their key phrase, prepared once.

    ``groups(key, key_len, alternatives)``, each alternative an array of stems;
    ``longest`` is the number of words of the longest key.
    """

    groups: DataFrame
    longest: int


def dictionary_groups(synonyms: DataFrame, params: SearchParams) -> DataFrame:
    """``(key, key_len, alternatives)`` from ``(phrase, alternatives)``."""

    def phrase_stems(phrase: Column) -> Column:
        return stems(without_stop_words(surface_tokens(phrase), params.stop_words))

    return (
        synonyms.select(
            phrase_stems(F.col("phrase")).alias("_key"),
            F.filter(
                F.transform("alternatives", lambda a: F.array_distinct(phrase_stems(a))),
                lambda a: F.size(a) > 0,
            ).alias("alternatives"),
        )
        .filter(F.size("_key") > 0)
        .select(
            F.array_join("_key", KEY_GLUE).alias("key"),
            F.size("_key").alias("key_len"),
            "alternatives",
        )
        .groupBy("key", "key_len")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("alternatives"))))
             .alias("alternatives"))
    )


def prepare_dictionary(
    synonyms: DataFrame, params: SearchParams = SearchParams()
) -> Dictionary:
    """Stem a synonym table once; a small one is held ready for broadcast."""
    groups = dictionary_groups(synonyms, params)
    small = small_or_none(groups, params.broadcast_rows)
    if small is not None:
        return Dictionary(small.df, max((r["key_len"] for r in small.rows), default=1))
    return Dictionary(groups, groups.agg(F.max("key_len")).first()[0])


def known_words(
    words: DataFrame, index: CorpusIndex, dict_: Dictionary | None, params: SearchParams
) -> DataFrame:
    """Stems of query words found in the index or in the dictionary's key phrases."""
    wanted = words.select(F.col("stem").alias("term")).distinct().withColumn(
        "bucket", term_bucket(F.col("term"), index.buckets)
    )
    known = lookup(index.terms, wanted, ["bucket", "term"], params.broadcast_rows).select("term")
    if dict_ is not None:
        in_keys = dict_.groups.select(F.explode(F.split("key", KEY_GLUE)).alias("term"))
        known = known.unionByName(in_keys)
    return known.distinct()


def nearest_surfaces(unknown: DataFrame, index: CorpusIndex, params: SearchParams) -> DataFrame:
    """Best index word for each unknown word by trigram Jaccard.

    ``unknown(surface)``, distinct, gives ``(surface, correction, shared, united)``.
    A word of ``n`` trigrams must share at least ``ceil(threshold * n)`` of them
    with its correction, so one of its ``n - ceil(threshold * n) + 1`` rarest is
    among the shared: candidates meet on those only, and the commonest trigrams,
    which half the vocabulary has, are never joined. A pair that meets on several
    is judged at the rarest trigram it shares, by all trigrams of both, so candidates
    are neither gathered nor sorted. No candidate at or above the threshold is lost.
    """
    threshold = params.fuzzy_threshold
    slack = threshold - 1e-9
    asked = explode_once(
        unknown.withColumn("_grams", trigrams(F.col("surface"))),
        F.col("_grams"), "gram", "surface", F.size("_grams").alias("_asked"),
    ).withColumn("bucket", term_bucket(F.col("gram"), index.buckets))
    whole = Window.partitionBy("surface")
    # Trigrams the index lacks count as the rarest of all: they use up probes.
    rarest = Window.partitionBy("surface").orderBy("_n", "gram")
    present = F.count("*").over(whole)
    probes = (
        lookup(
            index.gram_counts.withColumnRenamed("n", "_n"), asked, ["bucket", "gram"],
            params.broadcast_rows,
        )
        .withColumn("_order", F.row_number().over(rarest))
        .withColumn("_probes", present - F.ceil(F.col("_asked") * slack) + 1)
        .withColumn("_rarest", F.transform(
            F.array_sort(F.collect_list(F.struct("_order", "gram")).over(whole)), lambda g: g["gram"]
        ))
        .filter(F.col("_order") <= F.col("_probes"))
        .drop("_n", "_order", "_probes")
    )
    possible_size = (F.col("n_grams") >= F.col("_asked") * slack) & (
        F.col("n_grams") * slack <= F.col("_asked")
    )
    least_needed = (F.col("_asked") + F.col("n_grams")) * (slack / (1 + slack))
    grams = index.grams.withColumnRenamed("surface", "correction")
    own = F.col("all_grams") if "all_grams" in grams.columns else trigrams(F.col("correction"))
    # In the order of the asked word's trigrams, rarest first.
    common = F.array_intersect("_rarest", own)
    return (
        lookup(grams, probes, ["bucket", "gram"], params.broadcast_rows)
        .filter(possible_size)
        .filter((F.size(common) >= least_needed) & (F.get(common, F.lit(0)) == F.col("gram")))
        .withColumn("shared", F.size(common))
        .withColumn("united", F.col("_asked") + F.col("n_grams") - F.col("shared"))
        .withColumn("_jaccard", F.round(F.col("shared") / F.col("united"), 6))
        .filter(F.col("_jaccard") >= threshold)
        .groupBy("surface")
        .agg(
            F.min(
                F.struct((-F.col("_jaccard")).alias("j"), "correction", "shared", "united")
            ).alias("_best")
        )
        .select("surface", "_best.correction", "_best.shared", "_best.united")
    )


def unknown_words(
    words: DataFrame, index: CorpusIndex, dict_: Dictionary | None, params: SearchParams
) -> DataFrame:
    """Query words neither the index nor the dictionary has, compounds aside:
    their parts are alternatives already."""
    known = known_words(words, index, dict_, params)
    return (
        words.filter(~is_compound(F.col("surface")))
        .join(known, words["stem"] == known["term"], "left_anti")
        .select("surface").distinct()
    )


def repair_words(words: DataFrame, index: CorpusIndex, dict_: Dictionary | None,
                 params: SearchParams) -> DataFrame:
    """Replace unknown words by their nearest index word, before synonyms apply."""
    unknown = unknown_words(words, index, dict_, params)
    small = small_or_none(unknown, params.broadcast_rows)
    if small is not None:
        if not small.rows:
            return words
        unknown = small.df
    fixes = nearest_surfaces(unknown, index, params).select(
        "surface", stem(F.col("correction")).alias("_fixed")
    )
    return words.join(fixes, "surface", "left").select(
        "query_id", "pos", "surface",
        F.coalesce("_fixed", "stem").alias("stem"),
        F.when(F.col("_fixed").isNull(), F.col("parts")).otherwise(F.array("_fixed")).alias("parts"),
    )


def _spans(words: Column, max_len: int) -> Column:
    """Every run of up to ``max_len`` consecutive words as ``struct<start, len, key>``."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda start: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(max_len), F.size(words) - start + 1)),
                lambda n: F.struct(
                    start.alias("start"),
                    n.alias("len"),
                    F.array_join(F.slice(words, start, n), KEY_GLUE).alias("key"),
                ),
            ),
        )
    )


def _greedy_spans(spans: Column) -> Column:
    """Longest dictionary match first at each word, left to right, no overlap."""

    def take(acc: Column, s: Column) -> Column:
        return F.when(
            s["start"] >= acc["next"],
            F.struct(
                (s["start"] + s["len"]).alias("next"),
                F.concat(acc["taken"], F.array(s)).alias("taken"),
            ),
        ).otherwise(acc)

    empty = F.filter(spans, lambda s: F.lit(False))
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(
            b["len"] - a["len"]
        ),
    )
    return F.aggregate(
        ordered, F.struct(F.lit(1).alias("next"), empty.alias("taken")), take,
        lambda acc: acc["taken"],
    )


def _phrase(terms: Column, weight: float) -> Column:
    return F.struct(terms.alias("terms"), F.lit(weight).alias("weight"))


def _own_phrases(stems_: Column, parts: Column) -> Column:
    """The query's own words of one concept; a compound also offers its parts."""
    return F.array_distinct(
        F.array(
            _phrase(F.array_distinct(stems_), 1.0),
            _phrase(F.array_distinct(F.flatten(parts)), 1.0),
        )
    )


def concepts(words: DataFrame, dict_: Dictionary | None, params: SearchParams) -> DataFrame:
    """``(query_id, n_concepts, wants_torque, concept_id, phrases)``.

    A concept is a run of query words that is a whole dictionary key, or a
    single word. Its phrases compete: the query's own words at weight 1 and the
    group's alternatives at the synonym weight. Everything per query is bounded
    by that query's own length.
    """
    per_query = words.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "stem", "parts"))).alias("_w")
    ).select(
        "query_id",
        F.col("_w.stem").alias("_stems"),
        F.col("_w.parts").alias("_parts"),
    )
    torque_stems = F.array(*[F.lit(w) for w in params.torque_stems])
    flagged = per_query.withColumn("wants_torque", F.arrays_overlap("_stems", torque_stems))

    no_groups = F.array().cast(GROUPS_TYPE)
    if dict_ is None:
        with_groups = flagged.withColumn("_groups", no_groups)
    else:
        matched = (
            flagged.select(
                "query_id", F.explode_outer(_spans(F.col("_stems"), dict_.longest)).alias("_s")
            )
            .select("query_id", "_s.start", "_s.len", "_s.key")
            .join(dict_.groups.select("key", "alternatives"), "key")
            .groupBy("query_id")
            .agg(F.collect_list(F.struct("start", "len", "alternatives")).alias("_matched"))
        )
        with_groups = flagged.join(matched, "query_id", "left").withColumn(
            "_groups",
            F.coalesce(_greedy_spans(F.col("_matched")), no_groups),
        )

    def inside(i: Column) -> Column:
        return F.exists(
            F.col("_groups"),
            lambda s: (i >= s["start"]) & (i < s["start"] + s["len"]),
        )

    def own(start: Column, length: Column) -> Column:
        return _own_phrases(
            F.slice(F.col("_stems"), start, length), F.slice(F.col("_parts"), start, length)
        )

    singles = F.transform(
        F.filter(F.sequence(F.lit(1), F.size("_stems")), lambda i: ~inside(i)),
        lambda i: F.struct(
            i.alias("start"), own(i, F.lit(1)).alias("phrases")
        ),
    )
    grouped = F.transform(
        "_groups",
        lambda s: F.struct(
            s["start"].alias("start"),
            F.concat(
                own(s["start"], s["len"]),
                F.transform(s["alternatives"], lambda a: _phrase(a, params.synonym_weight)),
            ).alias("phrases"),
        ),
    )
    # Two words with the same phrases are one concept, so repeating a word asks nothing
    # more. Equal ones are neighbours after sorting; the first in reading order stays.
    def distinct_concepts(all_: Column) -> Column:
        def first_of_each(rows: Column) -> Column:
            return F.filter(
                rows, lambda c, i: (i == 0) | (c["phrases"] != F.get(rows, i - 1)["phrases"])
            )

        by_phrases = F.sort_array(
            F.transform(all_, lambda c: F.struct(c["phrases"].alias("phrases"), c["start"].alias("start")))
        )
        return F.sort_array(
            F.transform(
                let(by_phrases, first_of_each),
                lambda c: F.struct(c["start"].alias("start"), c["phrases"].alias("phrases")),
            )
        )

    listed = distinct_concepts(F.concat(singles, grouped))
    return (
        with_groups.withColumn("_concepts", listed)
        .select(
            "query_id", F.size("_concepts").alias("n_concepts"), "wants_torque",
            F.posexplode_outer("_concepts").alias("concept_id", "_c"),
        )
        .filter(F.col("concept_id").isNotNull())
        .select("query_id", "n_concepts", "wants_torque", "concept_id",
                F.col("_c.phrases").alias("phrases"))
    )


def query_terms(concept_rows: DataFrame) -> DataFrame:
    """One row per term of each phrase of each concept; ``plain`` if it is the concept's only one."""
    return (
        concept_rows.select(
            "query_id", "n_concepts", "wants_torque", "concept_id",
            (F.size("phrases") == 1).alias("_sole"),
            F.posexplode("phrases").alias("phrase_id", "_p"),
        )
        .select(
            "query_id", "n_concepts", "wants_torque", "concept_id", "phrase_id",
            F.size("_p.terms").alias("phrase_len"),
            (F.col("_sole") & (F.size("_p.terms") == 1)).alias("plain"),
            F.col("_p.weight").alias("weight"),
            F.explode("_p.terms").alias("term"),
        )
    )


def single_terms(concept_rows: DataFrame) -> DataFrame:
    """``(query_id, concept_id, terms)``: words that satisfy a concept on their own."""
    one = F.filter("phrases", lambda p: F.size(p["terms"]) == 1)
    return concept_rows.select(
        "query_id", "concept_id", "phrases",
        F.array_distinct(F.transform(one, lambda p: F.get(p["terms"], F.lit(0)))).alias("terms"),
    )
