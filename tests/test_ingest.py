"""Page texts to a stored corpus that answers questions."""

import json

from folioquery import cli, ingest
from folioquery.sources.corpus import read_chunks

BODY = "Undo the bolts of the cover and lift it off the housing before going on."


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    return str(path)


def test_manual_in_split_files(spark, tmp_path):
    pages = [{"doc": "manual", "lang": "en", "part": part, "page": page,
              "text": f"- {page} -\n{BODY}\nPart {part} page {page} tighten 9 N.m .\nXSL version : 1"}
             for part in (1, 2) for page in (1, 2, 3)]
    pages.append({"doc": "scan", "lang": "en", "part": 1, "page": 1, "text": "not indexed at all"})
    marks = [{"doc": "manual", "level": 1, "title": "GEARBOX REMOVAL", "page": 2},
             {"doc": "manual", "level": 1, "title": "GEARBOX REFITTING", "page": 5}]
    images = [{"doc": "diagrams", "unit_id": "i1", "lang": "en", "section": "Loom 16V", "image": "2.jpg",
               "text": "Connector list of the engine loom with all of its pins."}]
    (tmp_path / "s.json").write_text(json.dumps([
        {"doc": "manual", "title": "Workshop", "indexed": True}, {"doc": "scan", "indexed": False},
        {"doc": "diagrams", "title": "Diagrams", "indexed": True}]))
    out = str(tmp_path / "out")
    said = ingest.run(spark, [
        lines(tmp_path / "p.jsonl", pages), out, "--layout", "manual",
        "--bookmarks", lines(tmp_path / "b.jsonl", marks), "--sources", str(tmp_path / "s.json"),
        "--images", lines(tmp_path / "i.jsonl", images), "--buckets", "4", "--stats"])
    assert any(s.startswith("manual: 3 units") for s in said) and not any("scan" in s for s in said)
    rows = {r["id"]: r for r in read_chunks(spark, f"{out}/corpus", "parquet").collect()}
    middle = rows["manual:u2:0"]
    assert (middle["section"], middle["pdf_page"], middle["pdf_page_end"]) == ("GEARBOX REMOVAL", 2, 4)
    assert "Part 1 page 2" in middle["text"] and "Part 2 page 1" in middle["text"]
    assert rows["diagrams:ui1:0"]["engines"] == ["K4M"] and middle["engines"] is None
    answer = cli.run(spark, [f"{out}/index", "gearbox refitting", "--top", "1"])
    assert answer[1] == "[1] Workshop — GEARBOX REFITTING — PDF-стр. 5-6"


def test_pictures_of_the_part_only(spark, tmp_path):
    long = "\n".join([BODY] * 18)
    pages = [{"doc": "manual", "lang": "en", "part": 1, "page": n, "text": f"{long}\n{word} comes off last."}
             for n, word in ((1, "Bracket"), (2, "Manifold"), (3, "Gasket"))]
    marks = [{"doc": "manual", "level": 1, "title": "INTAKE", "page": 1},
             {"doc": "manual", "level": 2, "title": "REMOVAL", "page": 1}, {"doc": "manual", "level": 3, "title": "BOLTS", "page": 2}]
    images = [{"doc": "diagrams", "unit_id": "i1", "lang": "en", "section": "Loom", "image": "2.jpg",
               "text": "Connector list of the engine loom with all of its pins."}]
    out, shots, assets = str(tmp_path / "out"), tmp_path / "shots", tmp_path / "assets"
    ingest.run(spark, [
        lines(tmp_path / "p.jsonl", pages), out, "--layout", "manual", "--depth", "2",
        "--bookmarks", lines(tmp_path / "b.jsonl", marks), "--images", lines(tmp_path / "i.jsonl", images), "--buckets", "4"])
    for folder, names in ((shots / "manual", (1, 2, 3, 9)), (shots / "other", (2,)), (assets, (2,))):
        folder.mkdir(parents=True)
        for name in names:
            (folder / f"{name}.jpg").write_bytes(b"x")
    ask = lambda question: cli.run(spark, [
        f"{out}/index", question, "--top", "1", "--pages", str(shots), "--images", str(assets)])
    answer = ask("manifold")
    assert answer[1].startswith("[1] manual — INTAKE > REMOVAL — PDF-стр. 1-3")
    shown = {line.rsplit("shots/", 1)[1] for line in answer if "shots/" in line}
    assert "manual/2.jpg" in shown and shown < {"manual/1.jpg", "manual/2.jpg", "manual/3.jpg"}
    assert [line.rsplit("/", 1)[1] for line in ask("loom pins") if "/assets/" in line] == ["2.jpg"]


def test_handbook_by_headings(spark, tmp_path):
    pages = [{"doc": "book", "lang": "ru", "part": 1, "page": n, "text": f"3.{n}\n{head}\n{BODY}"}
             for n, head in ((1, "ШИНЫ (1/2)"), (2, "ШИНЫ (2/2)"), (3, "ЛАМПЫ"))]
    out = str(tmp_path / "out")
    ingest.run(spark, [lines(tmp_path / "p.jsonl", pages), out, "--layout", "headings", "--buckets", "4"])
    rows = read_chunks(spark, f"{out}/corpus", "parquet").collect()
    got = {(r["section"], r["pdf_page"], r["pdf_page_end"], r["chapter"]) for r in rows}
    assert got == {("ШИНЫ", 1, 2, 3), ("ЛАМПЫ", 3, 3, 3)}


def test_short_units_join_their_neighbours(spark, tmp_path):
    texts = [f"{BODY} First.", "Oil: 4 l.", f"{BODY} Third.", "See page 1."]
    pages = [{"doc": "manual", "lang": "en", "part": 1, "page": i + 1, "text": t} for i, t in enumerate(texts)]
    marks = [{"doc": "manual", "level": 1, "title": f"TOPIC {i + 1}", "page": i + 1} for i in range(4)]
    out = str(tmp_path / "out")
    given = [lines(tmp_path / "p.jsonl", pages), out, "--layout", "manual",
             "--bookmarks", lines(tmp_path / "b.jsonl", marks), "--buckets", "2", "--join-short"]
    ingest.run(spark, given)
    rows = {r["id"]: r for r in read_chunks(spark, f"{out}/corpus", "parquet").collect()}
    assert set(rows) == {"manual:u1:0", "manual:u3:0"}
    third = rows["manual:u3:0"]
    assert third["text"] == f"TOPIC 2\nOil: 4 l.\n{BODY} Third.\nTOPIC 4\nSee page 1."
    assert (third["pdf_page"], third["pdf_page_end"]) == (2, 4)
    shown = cli.run(spark, [f"{out}/index", "oil", "--passage", "6"])
    assert shown[-1].split() == "TOPIC 2 Oil: 4 l. Undo".split()
