"""Build a corpus and its index from page texts.

    python -m folioquery.ingest PAGES OUT --layout handbook|headings|manual
        [--bookmarks F] [--toc F] [--depth N] [--sources F] [--images F] [--buckets N] [--stats]
        [--join-short]

All inputs are JSON lines. PAGES: doc, lang, part, page, text, where ``page``
counts inside each ``part`` of a split file. Bookmarks and contents entries: doc,
level, title, page and maybe position (the place in the outline, for entries that share a
page), with page numbers running through the whole document. ``--depth`` is the level down
to which bookmarks open units and titles are paths; without it all do, under plain titles.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import units as U
from .operators.index import TERM_BUCKETS
from .operators.short_units import absorb_short
from .plans import build
from .sources.corpus import corpus_stats, read_chunks, read_sources

PAGES = "doc string, lang string, part int, page long, text string"
MARKS = "doc string, level int, title string, page long, position long"
IMAGES = "doc string, unit_id string, lang string, section string, image string, text string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioquery-ingest", description=__doc__)
    p.add_argument("pages")
    p.add_argument("out")
    p.add_argument("--layout", choices=("handbook", "headings", "manual"), required=True)
    p.add_argument("--bookmarks")
    p.add_argument("--toc")
    p.add_argument("--depth", type=int)
    p.add_argument("--sources")
    p.add_argument("--images")
    p.add_argument("--buckets", type=int, default=TERM_BUCKETS)
    p.add_argument("--join-short", action="store_true", help="no chunk below the minimum length where a document has more")
    p.add_argument("--stats", action="store_true")
    return p


def numbered_pages(pages: DataFrame) -> DataFrame:
    """Pages of split files with numbers running through the document."""
    files = pages.groupBy("doc", "part").agg(F.max("page").alias("n_pages"))
    return U.global_pages(pages, files)


def run(spark: SparkSession, argv: Sequence[str]) -> list[str]:
    args = parser().parse_args(argv)
    pages = numbered_pages(spark.read.schema(PAGES).json(args.pages))
    titles = pages.select("doc", F.col("doc").alias("doc_title")).distinct()
    if args.sources:
        sources = read_sources(spark, args.sources)
        pages = build.indexable(pages, sources)
        titles = sources.select("doc", F.coalesce("title", "doc").alias("doc_title"))

    if args.layout == "manual":
        if not args.bookmarks:
            parser().error("the manual layout needs --bookmarks")
        marks = spark.read.schema(MARKS).json(args.bookmarks)
        units = build.units_by_bookmarks(build.parse_manual(pages), marks, depth=args.depth)
    else:
        parsed = build.parse_handbook(pages)
        by = build.units_by_layout_id if args.layout == "handbook" else build.units_by_heading
        units = by(parsed)
    if args.toc:
        units = U.fill_titles(units, spark.read.schema(MARKS).json(args.toc), depth=args.depth)
    if args.join_short:
        units = absorb_short(units)
    if args.images:
        units = U.union_units(units, spark.read.schema(IMAGES).json(args.images)).fillna(
            0, ["block"]
        )
    tagged = F.col("image").isNotNull() if args.images else None
    build.build_corpus(build.chunk_units(units, titles, tag_diagrams=tagged), args.out,
                       buckets=args.buckets)
    lines = [f"corpus and index written to {args.out}"]
    if args.stats:
        stats = corpus_stats(read_chunks(spark, f"{args.out}/corpus", "parquet")).orderBy("doc")
        lines += [
            f"{r['doc']}: {r['units']} units, {r['chunks']} chunks, {r['chars']} characters, "
            f"{r['min_chars']}-{r['max_chars']} per chunk"
            for r in stats.collect()
        ]
    return lines


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("folioquery-ingest").getOrCreate()
    print("\n".join(run(spark, sys.argv[1:])))


if __name__ == "__main__":
    main()
