"""Citations and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .lets import let
from .text import fold


def page_range(first: Column, last: Column) -> Column:
    """``12`` or ``12-15``; null when the first page is unknown."""
    return F.when(
        first.isNotNull() & last.isNotNull() & (last > first),
        F.concat_ws("-", first.cast("string"), last.cast("string")),
    ).otherwise(first.cast("string"))


def part_number(chunk_id: Column) -> Column:
    """1-based part number from an id of the form ``doc:unit:part``."""
    return F.substring_index(chunk_id, ":", -1).try_cast("int") + F.lit(1)


def citation(
    chunk_id: Column,
    doc: Column,
    doc_title: Column,
    section: Column,
    unit_parts: Column,
    first_page: Column,
    last_page: Column,
    image: Column,
) -> Column:
    """Document title, section, pages, part and illustration; absent pieces are left out."""
    pages = F.concat(F.lit(rules.PAGE_LABEL + " "), page_range(first_page, last_page))
    part = F.when(
        unit_parts > 1,
        F.concat(
            F.lit(rules.PART_LABEL + " "),
            part_number(chunk_id).cast("string"),
            F.lit(f" {rules.PART_OF_LABEL} "),
            unit_parts.cast("string"),
        ),
    )
    picture = F.concat(F.lit(rules.IMAGE_LABEL + " "), image)
    return F.concat_ws(
        rules.CITATION_SEPARATOR, F.coalesce(doc_title, doc), section, pages, part, picture
    )


def chunk_citation() -> Column:
    """The citation of a row in the chunk schema."""
    c = F.col
    return citation(
        c("id"), c("doc"), c("doc_title"), c("section"), c("unit_parts"),
        c("pdf_page"), c("pdf_page_end"), c("image"),
    )


def snippet(text: Column, terms: Column, width: int = 240) -> Column:
    """A window of text around the first of ``terms`` found, with ellipses.

    ``terms`` is an array of lower-case stems. This is a display window; the
    chunk keeps its whole text.
    """

    def window(first: Column) -> Column:
        start = F.greatest(first - F.lit(width // 2), F.lit(1))
        return F.concat(
            F.when(start > 1, F.lit("… ")).otherwise(F.lit("")),
            F.regexp_replace(F.substring(text, start, F.lit(width)), r"\s+", " "),
            F.when(start + F.lit(width) <= F.length(text), F.lit(" …")).otherwise(F.lit("")),
        )

    hits = let(
        fold(text),
        lambda low: F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0),
    )
    return let(F.coalesce(F.array_min(hits), F.lit(1)), window)
