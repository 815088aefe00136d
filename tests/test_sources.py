"""Files in and out, evaluation gate, command line."""

import json

import pytest
from pyspark.sql import functions as F

from folioquery import cli
from folioquery.functions.citation import chunk_citation
from folioquery.operators import quality
from folioquery.operators.corpus import CHUNK_SCHEMA
from folioquery.operators.expansion import prepare_dictionary
from folioquery.operators.index import open_index
from folioquery.plans.build import build_corpus
from folioquery.plans.evaluate import run_gate
from folioquery.sources import corpus as src

from test_applicability import VEHICLE
from test_search import SYNONYMS


def row(id_, doc, lang, section, text, parts=1, chapter=None, page=None, end=None, image=None, engines=None):
    return (id_, doc, {"owner": "Owner's book", "workshop": "Workshop manual"}.get(doc, "Diagrams"),
            lang, section, text, parts, chapter, page, end, image, engines, None, None)


ROWS = [
    row("owner:u1:0", "owner", "ru", "УРОВЕНЬ МАСЛА", "Проверьте уровень масла щупом на ровной площадке.", 2, 4, 3, 5),
    row("owner:u1:1", "owner", "ru", "УРОВЕНЬ МАСЛА", "Долейте масло через воронку до верхней отметки щупа.", 2, 4, 3, 5),
    row("workshop:u7:0", "workshop", "en", "TIMING BELT REMOVAL", "Remove the timing belt and the idler; fit a new belt every time.", 1, None, 3100, 3104),
    row("workshop:u8:0", "workshop", "en", "CLUTCH REPLACEMENT", "Take off the clutch plate. Tighten the cover bolts to 20 N.m in order.", 1, None, 3200, 3200),
    row("diagrams:u1:0", "diagrams", "ru", "Схема 8V", "Распиновка блока управления двигателем восьмиклапанным.", image="13.jpg", engines=["K7M"]),
    row("diagrams:u2:0", "diagrams", "ru", "Схема 16V", "Распиновка блока управления двигателем шестнадцатиклапанным.", image="21.jpg", engines=["K4M"]),
]
CASES = [
    {"query": "уровень масла", "expect_any": ["УРОВЕНЬ МАСЛА"]},
    {"query": "проверьте уровень", "filters": {"lang": "ru"}, "expect_any": ["щупом"], "top_k": 1},
    {"query": "долейте масло", "filters": {"doc": "owner", "chapter": "4"}, "expect_any": ["воронку"]},
    {"query": "clutch replacement", "expect_any": ["CLUTCH"], "forbid": ["TIMING BELT"]},
    {"query": "timing belt K4M", "expect_any": ["nowhere", "TIMING BELT"]},
    {"query": "timing belt H4M", "forbid": ["TIMING BELT"], "note": "not covered"},
    {"query": "распиновка блока K7M", "expect_any": ["Схема 8V"], "forbid": ["иллюстрация 21.jpg"]},
    {"query": "распиновка блока K4M", "expect_any": ["16V"], "forbid": ["иллюстрация 13.jpg"]},
    {"query": "распиновка H4M", "forbid": ["иллюстрация"]},
    {"query": "замена сцепления", "expect_any": ["CLUTCH REPLACEMENT"]},
]


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("data")
    dump = lambda name, value: (root / name).write_text(json.dumps(value, ensure_ascii=False))
    dump("synonyms.json", SYNONYMS)
    dump("vehicle.json", {"engines": VEHICLE.engines, "document_engines": VEHICLE.document_engines,
                          "profile": VEHICLE.profile})
    dump("sources.json", [
        {"doc": "owner", "title": "Owner's book", "indexed": True, "drive_file_id": "f1"},
        {"doc": "scan", "title": "Scanned book", "indexed": False},
        {"doc": "workshop", "title": "Workshop manual", "indexed": True}])
    lines = [json.dumps(c, ensure_ascii=False) for c in CASES]
    (root / "eval.jsonl").write_text("\n\n".join(lines) + "\n  \n")
    (root / "assets").mkdir()
    (root / "assets" / "13.jpg").write_bytes(b"x")
    chunks = spark.createDataFrame(ROWS, CHUNK_SCHEMA).coalesce(1)
    build_corpus(chunks, str(root / "built"), buckets=4)
    return root


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNK_SCHEMA).coalesce(1)


def test_corpus_round_trip(spark, chunks, tmp_path):
    want = sorted(map(str, chunks.collect()))
    src.write_chunks(chunks, str(tmp_path / "j"))
    assert sorted(map(str, src.read_chunks(spark, str(tmp_path / "j")).collect())) == want
    src.write_chunks(chunks, str(tmp_path / "p"), "parquet")
    stored = src.read_chunks(spark, str(tmp_path / "p"), "parquet")
    assert sorted(map(str, stored.collect())) == want


def test_small_files(spark, files):
    assert src.read_vehicle(spark, str(files / "vehicle.json")).profile["engine"] == "K7M"
    read = {r["phrase"]: r["alternatives"] for r in src.read_synonyms(spark, str(files / "synonyms.json")).collect()}
    assert read == SYNONYMS
    sources = src.read_sources(spark, str(files / "sources.json"))
    assert [r["doc"] for r in sources.filter("indexed").orderBy("doc").collect()] == ["owner", "workshop"]


def test_scans_without_text_are_not_indexed(spark, files):
    sources = src.read_sources(spark, str(files / "sources.json"))
    pages = spark.createDataFrame([("owner", "t"), ("owner", "  "), ("scan", "t")], "doc string, text string")
    assert [tuple(r) for r in src.indexable(pages, sources).collect()] == [("owner", "t")]


def test_listing_and_stats(spark, chunks, files):
    got = {(r["doc"], r["lang"]): (r["units"], r["chunks"]) for r in src.list_sources(chunks).collect()}
    assert got == {("owner", "ru"): (1, 2), ("workshop", "en"): (2, 2), ("diagrams", "ru"): (2, 2)}
    listed = src.list_sources(chunks, src.read_sources(spark, str(files / "sources.json")))
    assert {r["doc"]: r["chunks"] for r in listed.collect()} == {"owner": 2, "scan": None, "workshop": 2}
    stats = {r["doc"]: r for r in src.corpus_stats(chunks).collect()}
    assert stats["workshop"]["max_page"] == 3200 and stats["owner"]["units"] == 1


def test_pictures(spark, chunks, files):
    listing = src.list_files(spark, str(files / "assets"))
    found = {r["id"]: r["path"] for r in src.image_paths(
        chunks.filter("image is not null"), listing).collect()}
    assert found["diagrams:u1:0"].endswith("13.jpg") and found["diagrams:u2:0"] is None
    pictures = spark.createDataFrame(
        [("owner", p, f"p{p}.jpg") for p in (2, 3, 5, 6)], "doc string, page int, path string")
    got = {r["id"]: r["pictures"] for r in src.page_pictures(chunks, pictures, width=2).collect()}
    assert got == {"owner:u1:0": ["p3.jpg", "p5.jpg"], "owner:u1:1": ["p3.jpg", "p5.jpg"]}


def test_every_chunk_can_be_cited(chunks):
    got = {r["id"]: r["c"] for r in chunks.select("id", chunk_citation().alias("c")).collect()}
    assert got["owner:u1:1"] == "Owner's book — УРОВЕНЬ МАСЛА — PDF-стр. 3-5 — фрагмент 2 из 2"
    assert got["diagrams:u1:0"] == "Diagrams — Схема 8V — иллюстрация 13.jpg"
    assert got["workshop:u8:0"].endswith("PDF-стр. 3200")


def test_quality_of_the_corpus(chunks):
    assert quality.duplicate_ids(chunks).count() == 0
    assert quality.duplicate_ids(chunks.union(chunks)).count() == len(ROWS)
    m = quality.missing_fields(chunks, ("id", "chapter")).first()
    assert (m["n_rows"], m["missing_id"], m["missing_chapter"]) == (6, 0, 4)
    t = quality.untitled_parts(chunks.withColumn("section", F.lit(None).cast("string"))).first()
    assert (t["parts"], t["untitled"]) == (2, 2)


def test_eval_set_and_gate(spark, files):
    cases = src.read_eval_cases(spark, str(files / "eval.jsonl")).coalesce(1)
    s = quality.eval_sanity(cases).first()
    assert (s["cases"], s["distinct_queries"], s["without_expectation"]) == (10, 10, 0)
    cases = cases.withColumn("query_id", F.monotonically_increasing_id())
    index = open_index(spark, str(files / "built" / "index"))
    synonyms = prepare_dictionary(src.read_synonyms(spark, str(files / "synonyms.json")))
    results = run_gate(index, cases, VEHICLE, synonyms).collect()
    assert [r for r in results if not r["passed"]] == []
    assert len(results) == sum("expect_any" in c for c in CASES) + sum("forbid" in c for c in CASES)
    # The gate notices a failure: without the guard the forbidden page is found.
    open_vehicle = type(VEHICLE)(VEHICLE.engines, {}, {})
    unguarded = cases.filter(F.col("query").contains("belt H4M"))
    loose = run_gate(index, unguarded.withColumn("query", F.lit("timing belt")), open_vehicle).collect()
    assert [r["passed"] for r in loose] == [False]


def test_filters_of_any_shape(spark, files):
    from folioquery.operators.filters import filter_values, unknown_filters

    shapes = ['{"lang": "ru", "chapter": 4}', '{"lang": ["ru", "en"], "chapter": [4, "5", "x", 6.5]}', '{"doc": [], "lang": null}', '{"year": 1, "doc": "a"}', "{}", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, s string").withColumn("f", F.parse_json("s"))
    got = df.select(filter_values(F.col("f"), "lang"), filter_values(F.col("f"), "chapter", "int"), filter_values(F.col("f"), "doc"), unknown_filters(F.col("f")), "i").orderBy("i").collect()
    assert [tuple(r)[:3] for r in got] == [
        (["ru"], [4], None), (["ru", "en"], [4, 5, None, 6], None), (None, None, []), (None, None, ["a"]), (None, None, None), (None, None, None)]
    assert [r[3] or [] for r in got] == [[], [], [], ["year"], [], []]


def test_gate_takes_lists_and_engines_and_refuses_unknown_keys(spark, files):
    index = open_index(spark, str(files / "built" / "index"))
    rows = [(1, "распиновка", '{"engine": "K7M"}'), (2, "распиновка", '{"engine": ["K4M", "K7M"]}'), (3, "распиновка", '{"doc": []}'), (4, "распиновка", '{"doc": ["owner", "diagrams"], "lang": ["ru"]}')]

    def cases(rows):
        df = spark.createDataFrame(rows, "query_id long, query string, f string").coalesce(1)
        return df.select("query_id", "query", F.parse_json("f").alias("filters"), F.lit(5).alias("top_k"), F.array(F.lit("8V")).alias("expect_any"), F.array(F.lit("16V")).alias("forbid"))

    open_vehicle = type(VEHICLE)(VEHICLE.engines, {}, {})
    got = {(r.query_id, r.kind): r.passed for r in run_gate(index, cases(rows), open_vehicle).collect()}
    assert [got[i, "expected"] for i in (1, 2, 3, 4)] == [True, True, False, True]
    assert [got[i, "forbidden"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    with pytest.raises(ValueError, match="year"):
        run_gate(index, cases([(1, "a", '{"year": 2001}')]), open_vehicle)


def test_command_line(spark, files):
    ix = str(files / "built" / "index")
    listed = cli.run(spark, [ix, "--list-sources"])
    assert "owner [ru]: 1 units, 2 chunks" in listed
    out = cli.run(spark, [ix, "замена сцепления", "--synonyms", str(files / "synonyms.json"), "--top", "1"])
    assert out[1].startswith("[1] Workshop manual — CLUTCH REPLACEMENT") and "id=workshop:u8:0  score=" in out[2]
    assert any("clutch" in line.lower() for line in out[4:] or out[3:])
    out = cli.run(spark, [ix, "timing belt H4M", "--vehicle", str(files / "vehicle.json")])
    assert "найдено фрагментов: 0" in out[0] and any("H4M" in line for line in out[1:])
    out = cli.run(spark, [ix, "распиновка блока", "--vehicle", str(files / "vehicle.json"), "--lang", "ru"])
    assert any("13.jpg" in line for line in out) and not any("21.jpg" in line for line in out)
    with pytest.raises(SystemExit):
        cli.run(spark, [ix])
