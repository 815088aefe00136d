"""Page text to page records: line classes, headings, layout noise, hyphens.

A page is one row; its lines live in an array, so parsing a page is one
projection and never shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .lets import let

HANDBOOK_NOISE = (rules.PRINTER_COLOUR_LINE, rules.LAYOUT_ID_LINE, rules.FOREIGN_HEADING_LINE)
MANUAL_NOISE = (rules.STYLESHEET_LINE, rules.XML_NAME_LINE)


def page_lines(text: Column) -> Column:
    """Trimmed lines of a page."""
    return F.transform(F.split(text, "\n"), lambda l: F.trim(l))


def any_match(line: Column, patterns: Iterable[str]) -> Column:
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | line.rlike(pattern)
    return matched


def is_heading(line: Column) -> Column:
    """An upper-case line; lower case may follow a colon or stand in parentheses."""
    return line.rlike(rules.HEADING_LINE)


def is_callout(line: Column) -> Column:
    """Illustration callouts: several short numbers, or one lone digit.

    A lone number of two or more digits is a table value and is kept.
    """
    return line.rlike(rules.CALLOUT_LINE)


def is_handbook_noise(line: Column) -> Column:
    return any_match(line, HANDBOOK_NOISE)


def is_manual_noise(line: Column) -> Column:
    return any_match(line, MANUAL_NOISE)


def line_class(line: Column) -> Column:
    """Name of the class a handbook line falls into."""
    return (
        F.when(F.length(line) == 0, "blank")
        .when(line.rlike(rules.PAGE_LABEL_LINE), "label")
        .when(is_handbook_noise(line) | is_manual_noise(line), "noise")
        .when(is_callout(line), "callout")
        .when(is_heading(line), "heading")
        .otherwise("text")
    )


def join_hyphens(text: Column) -> Column:
    """Join a word broken by a hyphen at a line end."""
    return F.regexp_replace(text, r"(\p{L}) ?-\n(\p{Ll})", "$1$2")


def first_matching(lines: Column, pattern: str) -> Column:
    return F.get(F.filter(lines, lambda l: l.rlike(pattern)), F.lit(0))


def section_key(title: Column) -> Column:
    """A heading without its trailing ``(i/n)`` continuation counter."""
    return F.regexp_replace(title, rules.CONTINUATION_COUNTER, "")


def system_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rules.SYSTEM_CODE, 1), F.lit(""))


def has_torque(text: Column) -> Column:
    """Whether the text states a torque: a number with its unit."""
    return text.rlike(rules.TORQUE_VALUE)


def without_lines(lines: Column, *chosen: Column) -> Column:
    """Lines without the first occurrence of each chosen one; equal later lines stay."""
    places = F.array(*[F.coalesce(F.array_position(lines, line), F.lit(0)) for line in chosen])
    return let(places, lambda at: F.filter(lines, lambda l, i: ~F.array_contains(at, (i + 1).cast("long"))))


def parse_page(text: Column) -> Column:
    """Handbook page: ``struct<page_label, chapter, section, text>``."""

    def record(lines: Column) -> Column:
        label = first_matching(lines, rules.PAGE_LABEL_LINE)
        heading = first_matching(lines, rules.HEADING_LINE)
        body = F.filter(without_lines(lines, label, heading), lambda l: ~is_callout(l))
        return F.struct(
            label.alias("page_label"),
            F.split_part(label, F.lit("."), F.lit(1)).try_cast("int").alias("chapter"),
            heading.alias("section"),
            join_hyphens(F.array_join(body, "\n")).alias("text"),
        )

    kept = F.filter(page_lines(text), lambda l: ~is_handbook_noise(l))
    return let(kept, record)


def parse_manual_page(text: Column) -> Column:
    """Manual page: ``struct<step, section, section_src, has_torque, text>``.

    A numbered sub-step starts with a digit and therefore never matches a
    heading.
    """

    def record(lines: Column) -> Column:
        heading = first_matching(lines, rules.HEADING_LINE)
        body = F.filter(without_lines(lines, heading), lambda l: ~l.rlike(rules.STEP_LINE))
        whole = join_hyphens(F.array_join(lines, "\n"))
        step = F.regexp_extract(first_matching(lines, rules.STEP_LINE), rules.STEP_LINE, 1)
        return F.struct(
            step.try_cast("int").alias("step"),
            heading.alias("section"),
            system_code(whole).alias("section_src"),
            has_torque(whole).alias("has_torque"),
            join_hyphens(F.array_join(body, "\n")).alias("text"),
        )

    kept = F.filter(page_lines(text), lambda l: ~is_manual_noise(l))
    return let(kept, record)


def html_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?s)<h1>(.*?)</h1>", 1), F.lit(""))


def html_paragraphs(html: Column) -> Column:
    """Paragraph texts of a page, inner tags removed, one line each."""
    inner = F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return F.array_join(
        F.transform(inner, lambda p: F.trim(F.regexp_replace(p, r"<[^>]*>", " "))), "\n"
    )
