"""Short units against a plain walk through each document."""

import random

import pytest

from folioquery.operators.short_units import absorb_short
from folioquery.operators.units import gather_units

SCHEMA = "doc string, unit_id string, first_page int, last_page int, section string, text string, lang string"
MIN, TARGET = 10, 25


def walk(units):
    """``{(doc, unit_id): (first_page, last_page, section, text)}`` by the stated rule."""
    out = {}
    for doc in {u[0] for u in units}:
        own = sorted((u for u in units if u[0] == doc), key=lambda u: (u[2], u[1]))
        filled = [u for u in own if u[5] and u[5].strip(" ")]
        for u in own:
            if u not in filled:
                out[u[0], u[1]] = (u[2], u[3], u[4], u[5])
        size = lambda u: len(u[5].strip(" "))
        runs, longs = [[]], []
        for u in filled:
            if size(u) >= MIN:
                longs.append([u])
                runs.append([])
            else:
                runs[-1].append(u)
        line = lambda u: "\n".join(x for x in (u[4], u[5]) if x is not None)
        taken = [([], []) for _ in longs]
        for i, run in enumerate(runs):
            total = sum(size(u) for u in run)
            if run and (total >= MIN or not longs):
                n, before, parts = max(1, total // TARGET), 0, {}
                for u in run:
                    parts.setdefault(before * n // total, []).append(u)
                    before += size(u)
                for members in parts.values():
                    text = "\n".join([members[0][5]] + [line(u) for u in members[1:]])
                    out[doc, members[0][1]] = (
                        min(u[2] for u in members), max(u[3] for u in members), members[0][4], text)
            elif run and i < len(longs):
                taken[i][0].extend(run)
            elif run:
                taken[-1][1].extend(run)
        for (u,), (lead, tail) in zip(longs, taken):
            out[doc, u[1]] = (
                min([u[2]] + [x[2] for x in lead]), max([u[3]] + [x[3] for x in tail]), u[4],
                "\n".join([line(x) for x in lead] + [u[5]] + [line(x) for x in tail]))
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_against_a_walk(spark, block):
    draw = random.Random(5)
    units = []
    for d in range(12):
        share = draw.choice([0.0, 0.2, 0.6, 1.0])
        for i in range(draw.randint(1, 30)):
            n = draw.randint(MIN, 40) if draw.random() < share else draw.choice([0, 1, 2, 3, 9])
            title = draw.choice([None, f"T{i}"])
            text = draw.choice([None, ""]) if n == 0 else "x" * n
            units.append((f"d{d}", f"{i:03d}", i // 2, i // 2 + 1, title, text, "en"))
    # 'hot' is one long run; 'few' has less than the minimum in all.
    units += [("hot", f"{i:03d}", i, i, None, "word", "en") for i in range(60)]
    units += [("few", "1", 1, 1, None, "ab", "en"), ("few", "2", 2, 2, "T", "cd", "en")]
    got = absorb_short(spark.createDataFrame(units, SCHEMA).coalesce(2), MIN, TARGET, block).collect()
    rows = {(r["doc"], r["unit_id"]): (r["first_page"], r["last_page"], r["section"], r["text"]) for r in got}
    assert len(got) == len(rows) and rows == walk(units)
    assert {k[1]: v[3] for k, v in rows.items() if k[0] == "few"} == {"1": "ab\nT\ncd"}
    short = {k[0] for k, v in rows.items() if v[3] and len(v[3]) < MIN}
    assert all(sum(len(u[5] or "") for u in units if u[0] == d) < MIN for d in short)


def test_page_starts_blocks_pictures_and_strays(spark):
    pages = [("b", "1", 1, "Intro"), ("b", "2", 2, "line one is long\nand two"), ("b", "2", 3, "third page text"),
             ("b", "2", 4, "fourth page text"), ("b", "3", 5, "end")]
    df = spark.createDataFrame(pages, "doc string, unit_id string, pdf_page int, text string").coalesce(1)
    units = gather_units(df, ["doc", "unit_id"], "pdf_page", "text", block_pages=2).selectExpr("*", "'S' section")
    got = sorted(absorb_short(units, MIN, TARGET).collect(), key=lambda r: r["block"])
    assert [r["text"] for r in got] == [
        "S\nIntro\nline one is long\nand two\nthird page text", "fourth page text\nS\nend"]
    assert [[tuple(s) for s in r["page_starts"]] for r in got] == [[(1, 1), (2, 2), (4, 3)], [(0, 4), (2, 5)]]
    assert all((r["first_page"], r["last_page"]) == (1, 5) for r in got)

    odd = [(None, "1", 1, 1, None, "ab", "en", None), ("p", "1", 1, 1, None, "cap", "en", "1.jpg"),
           ("p", "2", 2, 2, None, "a longer text here", "en", None), ("p", "3", None, None, None, "cd", "en", None)]
    units = spark.createDataFrame(odd, SCHEMA + ", image string").coalesce(1)
    got = {(r["doc"], r["unit_id"]): r["text"] for r in absorb_short(units, MIN, TARGET).collect()}
    assert got == {(None, "1"): "ab", ("p", "1"): "cap", ("p", "2"): "cd\na longer text here"}
    assert absorb_short(units.limit(0), MIN, TARGET).count() == 0
