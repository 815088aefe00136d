"""Command line: ask a question of a stored corpus.

    python -m folioquery.cli INDEX "question" [--top N] [--doc D] [--lang L] [--chapter C]
        [--images FOLDER] [--pages FOLDER] [--passage WORDS]
    python -m folioquery.cli INDEX --list-sources
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.citation import chunk_citation, snippet
from .operators.applicability import code_names, without_codes
from .operators.expansion import prepare_dictionary
from .operators.index import open_index
from .plans.search import SearchRequest, ask_guarded, expand, with_passages
from .sources.corpus import (
    Vehicle, image_paths, list_files, list_sources, page_files, page_pictures, read_synonyms, read_vehicle,
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioquery", description=__doc__)
    p.add_argument("index", help="folder of a stored index")
    p.add_argument("query", nargs="?", help="the question")
    p.add_argument("--top", type=int, default=5)
    p.add_argument("--doc")
    p.add_argument("--lang")
    p.add_argument("--chapter", type=int)
    p.add_argument("--per-doc", type=int)
    p.add_argument("--synonyms", help="JSON file: phrase -> alternatives")
    p.add_argument("--vehicle", help="JSON file: engines, document_engines, profile")
    p.add_argument("--images", help="folder of the illustrations that chunks name")
    p.add_argument("--pages", help="folder of rendered pages: <document>/<page>.jpg")
    p.add_argument("--passage", type=int, help="show so many words where most of the question stands")
    p.add_argument("--list-sources", action="store_true")
    return p


# What places a hit among the pictures.
_PLACE = ["id", "doc", "image", "pdf_page", "pdf_page_end", "part_page", "part_page_end"]
_PLACE_SCHEMA = "id string, doc string, image string, pdf_page int, pdf_page_end int, part_page int, part_page_end int"


def request_of(args: argparse.Namespace) -> SearchRequest:
    given = {"doc": args.doc, "lang": args.lang, "chapter": args.chapter}
    return SearchRequest(
        args.query, args.top, {k: v for k, v in given.items() if v is not None}, args.per_doc
    )


def pictures_of(spark: SparkSession, shown: list, images: str | None, pages: str | None) -> dict[str, list[str]]:
    """Paths of the illustration and of the rendered pages of each shown hit, by id."""
    if not shown or not (images or pages):
        return {}
    hits = spark.createDataFrame([tuple(r[c] for c in _PLACE) for r in shown], _PLACE_SCHEMA)
    found: dict[str, list[str]] = {}
    if images:
        for r in image_paths(hits, list_files(spark, images)).filter("path is not null").collect():
            found.setdefault(r["id"], []).append(r["path"])
    if pages:
        for r in page_pictures(hits, page_files(list_files(spark, pages))).collect():
            found.setdefault(r["id"], []).extend(r["pictures"])
    return found


def run(spark: SparkSession, argv: Sequence[str]) -> list[str]:
    """The printed lines of one invocation."""
    args = parser().parse_args(argv)
    index = open_index(spark, args.index)
    if args.list_sources:
        rows = list_sources(index.chunks).orderBy("doc", "lang").collect()
        return [f"{r['doc']} [{r['lang']}]: {r['units']} units, {r['chunks']} chunks" for r in rows]
    if not args.query:
        parser().error("a question or --list-sources is required")

    synonyms = prepare_dictionary(read_synonyms(spark, args.synonyms)) if args.synonyms else None
    vehicle = read_vehicle(spark, args.vehicle) if args.vehicle else Vehicle()
    hits, verdict = ask_guarded(
        index, request_of(args), vehicle, synonyms,
        profile_engine=vehicle.profile.get("engine"),
    )
    terms = sorted(
        {t for c in expand(index, args.query, synonyms) for phrase, _ in c["phrases"] for t in phrase}
    )
    window = snippet(F.col("text"), F.array(*[F.lit(t) for t in terms]).cast("array<string>"))
    if args.passage:
        asked = spark.createDataFrame([(0, args.query)], "query_id long, query string")
        asked = asked.withColumn("query", without_codes(F.col("query"), code_names(vehicle)))
        hits = with_passages(index, hits, asked, synonyms, width=args.passage)
        window = F.col("passage.text")
    shown = hits.select(
        "rank", "score", *_PLACE, chunk_citation().alias("citation"), window.alias("snippet"),
    ).orderBy("rank").collect()
    pictures = pictures_of(spark, shown, args.images, args.pages)
    lines = [f"Запрос: {args.query}   найдено фрагментов: {len(shown)}"]
    lines += verdict.warnings
    if not shown:
        lines.append("В корпусе ответа нет.")
    for r in shown:
        lines.append(f"[{r['rank']}] {r['citation']}")
        lines.append(f"    id={r['id']}  score={r['score']:.2f}")
        paths = pictures.get(r["id"], [])
        if r["image"] and not any(p.endswith("/" + r["image"]) for p in paths):
            lines.append(f"    {r['image']}")
        lines += [f"    {p}" for p in paths]
        lines.append(f"   {r['snippet']}")
    return lines


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("folioquery").getOrCreate()
    print("\n".join(run(spark, sys.argv[1:])))


if __name__ == "__main__":
    main()
