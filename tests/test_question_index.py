"""An index of known questions gives the hits of the full index from far fewer rows."""

import pytest
from pyspark.sql import functions as F

from folioquery.operators.expansion import prepare_dictionary
from folioquery.operators import index as I
from folioquery.operators import scoring
from folioquery.operators.index import build_postings, open_index, term_documents, write_index
from folioquery.plans import search as S
from folioquery.rules import SearchParams
from folioquery.sources.corpus import synonym_table

TEXTS = [
    "Clutch cable adjustment: tighten to 25 N.m. Clutch-pedal free play.",
    "The gearbox oil level is checked with the car level. Oil, oil and oil.",
    "Замена сцепления и трос сцепления. Момент затяжки 25 Н.м.",
    "clutch", "", None, "Timing belt of the K4M engine; belts and chains.",
    "level gauge of the clutch fluid", "gearbox clutches, rare wordx", "clutch clutch level oil gearbox",
]
QUESTIONS = [(1, "clutch level"), (2, "gearboks oil"), (3, "сцепление момент"), (4, "zzzz"), (5, "clutch-pedal")]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (f"d{i % 3}:u{i}", f"d{i % 3}", "ru" if i == 2 else "en", "Clutch" if i % 4 == 0 else None, text, i % 5)
        for i, text in enumerate(TEXTS * 2)
    ]
    return spark.createDataFrame(rows, "id string, doc string, lang string, section string, text string, chapter int")


@pytest.fixture(scope="module")
def full(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("full"))
    write_index(chunks, path, buckets=2)
    return open_index(spark, path)


def hits(index, queries, synonyms, params, **kw):
    rows = S.search(index, queries, synonyms, params=params, **kw).select("query_id", "rank", "chunk_id", F.round("score", 6))
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("coverage,prune_from", [("strict", 1_000_000), ("soft", 0)])
def test_same_hits_as_the_full_index(spark, chunks, full, coverage, prune_from):
    params = SearchParams(coverage=coverage, prune_from=prune_from)
    queries = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    synonyms = prepare_dictionary(synonym_table(spark, {"oil": ["fluid", "level gauge"]}))
    own = S.index_for_questions(chunks, queries, synonyms, params, bounds=True)
    kw = {"top_k": 6, "where": {"lang": "en", "doc": ["d0", "d1"]}} if prune_from else {"top_k": 4, "per_doc": 1}
    got = hits(own, queries, synonyms, params, **kw)
    assert got and got == hits(full, queries, synonyms, params, **kw)


def test_only_asked_terms_are_kept_and_totals_are_whole(spark, chunks, full):
    params = SearchParams(fuzzy=False)
    queries = spark.createDataFrame([(1, "clutch level")], "query_id long, query string")
    own = S.index_for_questions(chunks, queries, None, params)
    assert (own.n_chunks, own.n_tokens) == (full.n_chunks, full.n_tokens)
    assert {r.term for r in own.postings.select("term").distinct().collect()} == {"clutch", "level"}
    want = full.postings.filter(F.col("term").isin("clutch", "level"))
    columns = ["term", "chunk_id", "tf", "title_tf", "positions", "chunk_len"]
    assert sorted(map(tuple, own.postings.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_matches_are_not_shuffled_again(spark, chunks):
    """The only exchanges carry chunks (by block) and the few best hits (by question)."""
    params = SearchParams(fuzzy=False)
    queries = spark.createDataFrame([(1, "clutch level oil")], "query_id long, query string")
    own = S.index_for_questions(chunks, queries, None, params)
    plan = S.search(own, queries, params=params)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(block" in plan
    assert "chunk_id" not in "".join(line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(" in line)


def test_term_documents_are_the_counts_of_the_postings(chunks):
    want = build_postings(chunks).groupBy("term").agg(F.count("*").alias("df"))
    assert sorted(map(tuple, term_documents(chunks).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("few", [100, 0])
def test_counts_without_places_are_those_of_the_postings(spark, chunks, monkeypatch, few):
    """Titles, compounds, endings of both languages, decimals; asked by few letters or by all stems."""
    monkeypatch.setattr(I, "FEW_TERMS", few)
    terms = sorted(r.term for r in build_postings(chunks).select("term").distinct().collect())
    odd = chunks.limit(1).withColumn("id", F.lit("odd")).withColumn("section", F.lit("Oils-Level oil"))
    rows = chunks.unionByName(odd.withColumn("text", F.lit("oiling a-b x2-y 1.5.2 ё-oils сцеплениями eyes")))
    columns = ["chunk_id", "chunk_len", "has_torque", "e.term", "e.tf", "e.title_tf"]
    for asked in (["oil", "a", "сцеплен", "x2-y", "1.5.2", "clutch"], terms):
        own = I.asked_chunks(rows, asked, positions=False).select("*", F.explode("entries").alias("e")).select(*columns)
        want = I.asked_chunks(rows, asked).select("*", F.explode("entries").alias("e")).select(*columns)
        got = sorted(map(tuple, own.collect()))
        assert got and got == sorted(map(tuple, want.collect()))
        lengths = [{r.chunk_id: r.chunk_len for r in I.asked_chunks(rows, asked, p).collect()} for p in (True, False)]
        assert lengths[0] == lengths[1]


@pytest.mark.parametrize("coverage", ["strict", "soft"])
def test_pair_scores_are_the_scores_of_all_levels_in_fewer_rows(spark, chunks, full, coverage):
    params = SearchParams(coverage=coverage, proximity_bonus=0.0, fuzzy=False)
    queries = spark.createDataFrame([*QUESTIONS, (6, "clutch-pedal oil level")], "query_id long, query string")
    synonyms = prepare_dictionary(synonym_table(spark, {"oil": ["fluid", "level gauge"]}))
    own = S.index_for_questions(chunks, queries, synonyms, params)
    assert "positions" not in own.postings.columns
    for index in (own, full):
        matches = S.match_postings(index, S.question_terms(index, queries, synonyms, params), params)
        levels = scoring.concept_scores(scoring.phrase_matches(matches, index, params), params)
        columns = ["query_id", "chunk_id", "doc", "covered", "n_concepts", F.round("score", 9)]
        want = sorted(map(tuple, scoring.chunk_scores(levels, params).select(*columns).collect()))
        assert want and want == sorted(map(tuple, scoring.pair_scores(matches, index, params).select(*columns).collect()))


def test_block_bounds_meet_their_questions_without_being_shuffled(spark, chunks, full):
    from folioquery.operators.pruning import block_scores
    from folioquery.session import small_or_none

    params = SearchParams(fuzzy=False, proximity_bonus=0.0, coverage="soft")
    queries = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    own = S.index_for_questions(chunks, queries, None, params, bounds=True)

    def scores(index):
        terms = small_or_none(S.question_terms(index, queries, None, params), 100)
        return block_scores(index, terms, params)

    got = {(r.query_id, r.block): round(r.bound, 6) for r in scores(own).collect()}
    assert got and got == {(r.query_id, r.block): round(r.bound, 6) for r in scores(full).collect()}
    plan = scores(own)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "hashpartitioning(block" in dealt[0], plan


def test_repairs_gather_no_candidates(spark, chunks, full, tmp_path):
    from folioquery.functions.text import trigrams
    from folioquery.operators.expansion import nearest_surfaces

    params = SearchParams()
    unknown = spark.createDataFrame([("gearboks",), ("clutchh",), ("leveel",), ("zzzz",), ("cabl",)], "surface string")
    own = I.write_vocabulary(chunks, str(tmp_path / "words"), buckets=2)
    near = nearest_surfaces(unknown, own, params)
    got = sorted(map(tuple, near.collect()))
    assert got == sorted(map(tuple, nearest_surfaces(unknown, full, params).collect()))
    grams = {r.s: set(r.g) for r in I.surface_forms(chunks).unionByName(unknown).select(F.col("surface").alias("s"), trigrams(F.col("surface")).alias("g")).collect()}
    known = [r.surface for r in I.surface_forms(chunks).collect()]
    best = []
    for (word,) in unknown.collect():
        pairs = [(-round(len(grams[word] & grams[k]) / len(grams[word] | grams[k]), 6), k, len(grams[word] & grams[k]), len(grams[word] | grams[k])) for k in known]
        if -min(pairs)[0] >= params.fuzzy_threshold:
            best.append((word, *min(pairs)[1:]))
    assert got == sorted(best) and len(got) >= 3
    plan = near._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "Aggregate(key=[" in line.replace("keys=", "key=")]
    assert keys and not any("correction" in line.split("functions=")[0] for line in keys), plan
