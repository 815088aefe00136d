"""From page texts to a stored, indexed corpus.

Pages arrive as text (one row per page of a file); extraction from PDF happens
outside. Each publisher layout has its own way to bound units; all of them end
in the same chunk schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import lines as L
from ..operators import units as U
from ..operators.chunking import units_to_chunks
from ..operators.corpus import as_chunks
from ..operators.index import TERM_BUCKETS, write_index
from ..session import join_small
from ..sources.corpus import indexable, write_chunks


def parse_handbook(pages: DataFrame) -> DataFrame:
    """Handbook pages with label, chapter, section, clean text and layout id.

    The id of the section is printed on each page by the publisher's layout.
    """
    layout = L.first_matching(L.page_lines(F.col("text")), rules.LAYOUT_ID_LINE)
    kept = [c for c in pages.columns if c != "text"]
    return (
        pages.withColumn("_p", L.parse_page(F.col("text")))
        .withColumn("layout_id", F.regexp_replace(layout, r"_\d+$", ""))
        .select(*kept, "layout_id", "_p.*")
    )


def parse_manual(pages: DataFrame) -> DataFrame:
    """Manual pages with step, section, system code, torque mark and clean text."""
    kept = [c for c in pages.columns if c != "text"]
    return pages.withColumn("_p", L.parse_manual_page(F.col("text"))).select(*kept, "_p.*")


def _first_heading() -> Column:
    """The first heading of a unit without its counter; pages without one are passed over."""
    page = F.when(F.col("section").isNotNull(), F.col("pdf_page"))
    return F.min_by(L.section_key(F.col("section")), page)


def units_by_layout_id(pages: DataFrame) -> DataFrame:
    """Pages with the same printed section id form a unit, its first heading the title.

    A page without an id is a unit of its own.
    """
    own = F.concat(F.lit("p"), F.col("pdf_page"))
    keyed = pages.withColumn("layout_id", F.coalesce("layout_id", own))
    heads = keyed.groupBy("doc", "layout_id").agg(
        _first_heading().alias("section"),
        F.min("chapter").alias("chapter"),
        F.min("lang").alias("lang"),
    )
    gathered = U.gather_units(keyed, ["doc", "layout_id"], "pdf_page", "text")
    return gathered.join(heads, ["doc", "layout_id"]).withColumnRenamed("layout_id", "unit_id")


def units_by_heading(pages: DataFrame, block: int = 4096) -> DataFrame:
    """A page with a new heading opens a unit that runs to the next heading.

    A heading that only continues the one before (``(2/4)``) opens nothing.
    """
    continues = F.col("section").rlike(r"\((?:[2-9]|[1-9]\d+)/\d+\) *$")
    first = F.col("section").isNotNull() & ~continues
    marked = U.heading_islands(pages, "doc", "pdf_page", first, block)
    heads = marked.groupBy("doc", "island").agg(
        _first_heading().alias("section"),
        F.min("chapter").alias("chapter"),
        F.min("lang").alias("lang"),
    )
    gathered = U.gather_units(marked, ["doc", "island"], "pdf_page", "text")
    return gathered.join(heads, ["doc", "island"]).withColumn(
        "unit_id", F.col("island").cast("string")
    ).drop("island")


def units_by_bookmarks(
    pages: DataFrame, bookmarks: DataFrame, width: int = 256, depth: int | None = None
) -> DataFrame:
    """A bookmark's page range is a unit; the bookmark's title is its title.

    With a ``depth`` deeper bookmarks open no units and titles are paths. Pages before
    a document's first bookmark form an untitled unit.
    """
    ranges = U.bookmark_ranges(bookmarks, depth).withColumnsRenamed(
        {"title": "section", "first_page": "unit_start"}
    )
    begins = pages.groupBy("doc").agg(F.min("pdf_page").alias("unit_start"))
    firsts = ranges.groupBy("doc").agg(F.min("unit_start").alias("next_page"))
    front = (
        begins.join(firsts, "doc", "left")
        .filter(F.col("next_page").isNull() | (F.col("unit_start") < F.col("next_page")))
        .withColumn("section", F.lit(None).cast("string"))
    )
    placed = U.interval_join(
        pages.select("doc", "lang", "pdf_page", "text"), ranges.unionByName(front), "doc",
        "pdf_page", "unit_start", "next_page", width,
    )
    keys = ["doc", "unit_start"]
    titles = placed.groupBy(*keys).agg(
        F.max("section").alias("section"), F.min("lang").alias("lang")
    )
    return (
        U.gather_units(placed, keys, "pdf_page", "text").join(titles, keys)
        .withColumn("unit_id", F.col("unit_start").cast("string")).drop("unit_start")
    )


def chunk_units(
    units: DataFrame, titles: DataFrame, target: int = rules.CHUNK_TARGET,
    tag_diagrams: Column | None = None,
) -> DataFrame:
    """Units of any kind as chunks. ``titles(doc, doc_title)`` names the documents.

    A chunk below the minimum length is led in by its title instead of being dropped.
    """
    chunks = join_small(units_to_chunks(units, target), titles, "doc", "left")
    short = (F.length("text") < rules.MIN_CHUNK_CHARS) & F.col("section").isNotNull()
    chunks = chunks.withColumn(
        "text", F.when(short, F.concat_ws("\n", "section", "text")).otherwise(F.col("text"))
    )
    renamed = chunks.withColumnsRenamed({"first_page": "pdf_page", "last_page": "pdf_page_end"})
    if tag_diagrams is not None:
        renamed = renamed.withColumn(
            "engines", F.when(tag_diagrams, U.engine_tags(F.col("section")))
        )
    return as_chunks(renamed)


def build_corpus(
    chunks: DataFrame, path: str, fmt: str = "parquet", buckets: int = TERM_BUCKETS
) -> None:
    """Store the corpus, then index what was stored, so texts are cut only once."""
    write_chunks(chunks, f"{path}/corpus", fmt)
    stored = chunks.sparkSession.read.format(fmt).load(f"{path}/corpus")
    write_index(as_chunks(stored), f"{path}/index", buckets)


__all__ = [
    "build_corpus", "chunk_units", "indexable", "parse_handbook", "parse_manual",
    "units_by_bookmarks", "units_by_heading", "units_by_layout_id",
]
