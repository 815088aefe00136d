"""Passages and covers on hand-made places, and against all combinations."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from folioquery.operators import passages as P
from folioquery.operators.corpus import CHUNK_SCHEMA
from folioquery.operators.index import open_index, write_index
from folioquery.plans import search as S
from folioquery.rules import SearchParams

PLACES = "places array<array<int>>, weights array<bigint>"


def chunk(id_, section, text):
    return (id_, "book", "Book", "ru", section, text, 1, None, None, None, None, None, None, None)


def brute_cover(places):
    found = [(max(c) - min(c), max(c), min(c)) for c in product(*places)]
    return (None, None) if not places or not found else (min(found)[2], min(found)[1])


def brute_window(places, weights, width):
    best = (None, None, 0)
    for end in sorted({p for own in places for p in own}):
        last = [max((p for p in own if end - width < p <= end), default=None) for own in places]
        weight = sum(w for at, w in zip(last, weights) if at is not None)
        if weight > best[2]:
            best = (min(at for at in last if at is not None), end, weight)
    return best


def test_folds_equal_all_combinations(spark):
    draw = random.Random(11)
    groups = [
        [sorted(draw.sample(range(26), draw.randint(0, 5))) for _ in range(draw.randint(1, 4))]
        for _ in range(300)
    ]
    rows = [(g, [draw.randint(1, 9) for _ in g]) for g in groups]
    got = spark.createDataFrame(rows, PLACES).coalesce(1).select(
        "*", P.smallest_cover(F.col("places")).alias("c"),
        P.best_window(F.col("places"), F.col("weights"), 6).alias("w"),
    ).collect()
    assert len(got) == 300
    for r in got:
        assert tuple(r["c"]) == brute_cover(r["places"])
        assert tuple(r["w"]) == brute_window(r["places"], r["weights"], 6)


def test_cover_pairs_needs_every_concept_near(spark):
    rows = [
        ([(0, [1]), (1, [9]), (2, [17])],),   # 16 words for two steps of 8
        ([(0, [1]), (1, [9]), (2, [18])],),   # one too far
        ([(0, [5]), (2, [1]), (1, [])],),     # a concept with no place in the body
        ([(0, [5])],),                        # nothing to be near to
        ([(0, [30, 2]), (1, [31])],),         # any order of places
    ]
    df = spark.createDataFrame(rows, "found array<struct<concept_id:int,places:array<int>>>").coalesce(1)
    got = [r[0] for r in df.select(P.cover_pairs(F.col("found"), 8)).collect()]
    assert got == [2, 0, 0, 0, 1]


@pytest.fixture(scope="module")
def shown(spark):
    texts = [
        "Вступление. " + "слово " * 30 + "Щётка   стартёра\nснята тут. " + "конец " * 30 + "щётка",
        "ABC нет такого", "", None, "İx щётка лежит", "щётка " * 3000,
    ]
    asked = [(("щетк"), 2.0), ("стартер", 3.0), ("щетк", 1.0)]
    hits = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 9, "щётка")],
                                 "query_id long, i int, text string").coalesce(1)
    terms = spark.createDataFrame([(1, t, w) for t, w in asked], "query_id long, term string, idf double")
    got = P.with_passages(hits, terms.coalesce(1), width=5).collect()
    return {r["i"]: r["passage"] for r in got}


def test_passage_keeps_the_spelling_and_centres_the_words(shown):
    assert shown[0]["text"] == "слово Щётка стартёра снята тут"
    assert (shown[0]["first"], shown[0]["last"], shown[0]["weight"]) == (31, 32, 5_000_000)


def test_passage_without_asked_words_is_the_beginning(shown):
    assert shown[1]["text"] == "ABC нет такого" and shown[1]["first"] is None
    assert shown[9]["text"] == "щётка" and shown[9]["weight"] == 0  # a question without terms


def test_passage_of_odd_texts(shown):
    assert shown[2]["text"] is None and shown[3]["text"] is None
    assert shown[4]["text"].endswith("щетка лежит") and shown[4]["weight"] == 2_000_000
    assert shown[5]["first"] == 0 and shown[5]["text"].count("щётка") == 5  # ties: the earliest


def test_cover_ranks_the_close_text_first(spark, tmp_path):
    far = "насос " + "слово " * 20 + "фильтр " + "слово " * 20 + "клапан"
    near = "клапан насос фильтр " + "слово " * 40
    rows = [chunk("a:u1:0", None, far), chunk("b:u1:0", None, near)]
    write_index(spark.createDataFrame(rows, CHUNK_SCHEMA).coalesce(1), str(tmp_path / "i"), buckets=2)
    index = open_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "насос фильтр клапан")], "query_id long, query string")
    params = SearchParams(proximity="cover", fuzzy=False)
    hits = S.search(index, asked, params=params)
    scores = {r["chunk_id"]: r["score"] for r in hits.collect()}
    assert scores["b:u1:0"] == pytest.approx(scores["a:u1:0"] + 2 * params.proximity_bonus, abs=1e-6)
    full = S.with_passages(index, S.with_chunks(index, hits, params), asked, params=params, width=3)
    got = {r["id"]: r["passage"]["text"] for r in full.collect()}
    assert got["b:u1:0"] == "клапан насос фильтр"
