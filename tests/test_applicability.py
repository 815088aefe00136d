"""Which documents may answer for which engine."""

import pytest
from pyspark.sql import functions as F

from folioquery.operators import applicability as app
from folioquery.plans.search import guarded_queries
from folioquery.sources.corpus import Vehicle

VEHICLE = Vehicle(
    engines={
        "H4M": {"aliases": ["HR16DE"], "timing_drive": "chain"},
        "K4M": {"aliases": [], "timing_drive": "belt"},
        "K7M": {"aliases": [], "timing_drive": "belt"},
    },
    document_engines={
        "workshop": ["D4F", "K4M", "K7M", "K9K"], "diagrams": ["K4M", "K7M"], "owner": [],
    },
    profile={"platform": "X", "market": "RU", "engine": "K7M"},
)


def test_codes_in_text():
    assert app.engines_in_text("снятие цепи h4m 1.6") == ["H4M"]
    assert app.engines_in_text("HR16DE") == ["H4M"]
    assert app.engines_in_text("k4m и K7M, k4m") == ["K4M", "K7M"]
    assert app.engines_in_text("момент затяжки, xk4m") == []


def test_codes_as_a_column_agree(spark):
    texts = ["снятие цепи h4m 1.6", "HR16DE", "k4m и K7M, k4m", "K9K D4F", "момент xk4m", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(app.engines_in(F.col("t"), app.code_names())).collect()]
    assert got == [app.engines_in_text(t) for t in texts]


def test_uncovered_engine_blocks_documents():
    r = app.check("замена цепи ГРМ H4M", VEHICLE)
    assert (r.engine, r.allowed, r.blocked) == ("H4M", ["owner"], ["diagrams", "workshop"])
    assert any("H4M" in w for w in r.warnings)
    assert not any("ВНИМАНИЕ" in w for w in r.warnings)


def test_covered_engine_blocks_nothing():
    r = app.check("замена ремня ГРМ K4M", VEHICLE)
    assert r.blocked == [] and "workshop" in r.allowed and r.warnings == []


def test_wrong_timing_drive_is_called_out():
    assert any("неприменим" in w for w in app.check("замена ремня ГРМ H4M", VEHICLE).warnings)
    assert any("ВНИМАНИЕ" in w for w in app.check("timing chain K4M", VEHICLE).warnings)
    assert not any("ВНИМАНИЕ" in w for w in app.check("ремень генератора H4M", VEHICLE).warnings)


def test_no_engine_restricts_nothing():
    r = app.check("прокачка тормозов", VEHICLE)
    assert r.allowed is None and app.restrict({"lang": "ru"}, r) == {"lang": "ru"}


def test_profile_is_a_default_and_the_query_overrides_it():
    assert app.check("распиновка", VEHICLE, profile_engine="K7M").engine == "K7M"
    assert app.check("распиновка K4M", VEHICLE, profile_engine="K7M").engine == "K4M"


def test_restrict_intersects():
    r = app.check("цепь ГРМ H4M", VEHICLE)
    assert app.restrict({"doc": "workshop"}, r)["doc"] == []
    assert app.restrict({"doc": ["workshop", "owner"]}, r)["doc"] == ["owner"]
    assert app.restrict(None, r)["doc"] == ["owner"]


@pytest.mark.parametrize("profile", [None, "K7M"])
def test_batch_guard_agrees_with_check(spark, profile):
    texts = ["цепь ГРМ H4M", "ремень K4M", "тормоза"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    for r in guarded_queries(df, VEHICLE, profile).collect():
        want = app.check(texts[r["query_id"]], VEHICLE, profile)
        assert (r["only_engine"], r["only_docs"]) == (want.engine, want.allowed)


def test_codes_are_not_searched_as_words(spark):
    df = spark.createDataFrame([("цепь ГРМ h4m",), ("K4M",), ("жк4м",)], "q string").coalesce(1)
    got = [r[0].strip() for r in df.select(app.without_codes(F.col("q"), app.code_names())).collect()]
    assert got == ["цепь ГРМ", "K4M", "жк4м"]


def test_relational_coverage(spark):
    docs = spark.createDataFrame([("workshop",), ("diagrams",), ("owner",)], "doc string")
    cover = spark.createDataFrame(
        [("workshop", "K4M"), ("workshop", "K4M"), ("workshop", "K7M"), ("diagrams", "K4M")],
        "doc string, engine string")
    covered = app.document_coverage(docs, cover)
    allowed = {tuple(r) for r in app.allowed_documents(covered, ["K7M", "H4M"]).collect()}
    blocked = {tuple(r) for r in app.blocked_documents(covered, ["K7M", "H4M"]).collect()}
    assert allowed == {("K7M", "workshop"), ("K7M", "owner"), ("H4M", "owner")}
    assert blocked == {("K7M", "diagrams"), ("H4M", "workshop"), ("H4M", "diagrams")}
