"""Assembling units from pages, and the marks units carry.

Texts are gathered per unit only: a unit is one procedure or section. Page
numbering and heading islands order by document, and one document may be very
large, so running sums are computed in two levels (per block, then over block
totals) instead of one window over a whole document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.lets import explode_once


def running_total(
    df: DataFrame, group: str, order: str, value: str, out: str, block: int = 4096
) -> DataFrame:
    """Inclusive running sum of ``value`` by ``order`` (integer) within ``group``.

    A hot group is split into blocks of ``block`` consecutive order values. Each
    block sums on its own task; block totals, one row per block, are summed
    again and added back by key.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    across = Window.partitionBy(group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = (
        blocked.groupBy(group, "_block")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(across), F.lit(0)))
        .drop("_total")
    )
    return (
        blocked.withColumn("_inside", F.sum(value).over(inside))
        .join(totals, [group, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before", "_block")
    )


def next_value(df: DataFrame, group: str, order: str, out: str, block: int = 4096) -> DataFrame:
    """The next larger ``order`` value within ``group`` (unique integers), or null.

    Looks inside blocks of ``block`` consecutive values; only the last row of a
    block takes its answer from the first value of the next filled block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(group, "_block").orderBy(order)
    across = Window.partitionBy(group).orderBy("_block")
    firsts = (
        blocked.groupBy(group, "_block")
        .agg(F.min(order).alias("_first"))
        .select(group, "_block", F.lead("_first").over(across).alias("_next_first"))
    )
    return (
        blocked.withColumn("_inside", F.lead(order).over(inside))
        .join(firsts, [group, "_block"])
        .withColumn(out, F.coalesce("_inside", "_next_first"))
        .drop("_inside", "_next_first", "_block")
    )


def global_pages(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """Number the pages of split files through.

    ``parts(doc, part, n_pages)`` lists the files of each document in order;
    ``pages(doc, part, page, ...)`` counts pages from 1 inside each file.
    """
    offsets = running_total(parts, "doc", "part", "n_pages", "_through").select(
        "doc", "part", (F.col("_through") - F.col("n_pages")).alias("_offset")
    )
    return (
        pages.join(offsets, ["doc", "part"])
        .withColumn("pdf_page", F.col("page") + F.col("_offset"))
        .drop("_offset")
    )


def _numbered(bookmarks: DataFrame, block: int) -> DataFrame:
    """Bookmarks in reading order, ``ordinal`` counting from 0 within the document.

    The order is page, ``position`` (where the outline states one), level, title. Rows
    are numbered inside blocks of ``block`` pages; block totals are added by key.
    """
    stated = F.col("position") if "position" in bookmarks.columns else F.lit(None)
    inside = Window.partitionBy("doc", "_block").orderBy("first_page", "_position", "level", "title")
    across = Window.partitionBy("doc").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocked = bookmarks.filter(F.col("page").isNotNull()).select(
        "doc", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).cast("int").alias("level"),
        F.nullif(F.trim("title"), F.lit("")).alias("title"), F.col("page").alias("first_page"),
        stated.cast("bigint").alias("_position"), F.floor(F.col("page") / block).alias("_block"),
    )
    before = blocked.groupBy("doc", "_block").agg(F.count("*").alias("_rows")).select(
        "doc", "_block", F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_before")
    )
    return (
        blocked.withColumn("_row", F.row_number().over(inside))
        .join(before, ["doc", "_block"])
        .select("doc", "level", "title", "first_page", (F.col("_before") + F.col("_row") - 1).alias("ordinal"))
    )


def bookmark_tree(bookmarks: DataFrame, block: int = 4096) -> DataFrame:
    """Nested sections of an outline: ``(doc, ordinal, level, title, path, parent, first_page, end_page)``.

    A section ends where the next bookmark of its own level or above begins (null: with
    the document). ``path`` holds the titles from the outermost section down to its own,
    ``parent`` the ordinal of the one around it; levels may be skipped. Bookmarks without
    a page open nothing.

    Each bookmark asks every level down to its own for the last mark before it and the
    first after it. The answers are as-of values inside blocks of ``block`` bookmarks,
    completed from the blocks' first and last marks, so no task works through a whole
    document; a bookmark's answers, as many as it has levels, meet in one row.
    """
    mark = F.when(F.col("at") == F.col("level"), F.struct("ordinal", "first_page", "title"))
    asked = _numbered(bookmarks, block).select(
        "*", F.floor(F.col("ordinal") / block).alias("_block"),
        F.explode(F.sequence(F.lit(1), F.col("level"))).alias("at"),
    ).withColumn("_mark", mark)
    inside, across = Window.partitionBy("doc", "at", "_block"), Window.partitionBy("doc", "at")

    def latest(value: str, window: Window) -> Column:
        # Looking ahead is looking back in the other order, which needs one pass only.
        return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))

    around = (
        asked.groupBy("doc", "at", "_block")
        .agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
        .select(
            "doc", "at", "_block",
            latest("_last", across.orderBy("_block")).alias("_block_before"),
            latest("_first", across.orderBy(F.desc("_block"))).alias("_block_after"),
        )
    )
    placed = (
        asked.withColumn("_before", latest("_mark", inside.orderBy("ordinal")))
        .withColumn("_after", latest("_mark", inside.orderBy(F.desc("ordinal"))))
        .join(around, ["doc", "at", "_block"])
        .withColumn("_before", F.coalesce("_before", "_block_before"))
        .withColumn("_after", F.coalesce("_after", "_block_after"))
    )
    outer = F.when(
        (F.col("at") < F.col("level")) & F.col("_before").isNotNull(),
        F.struct("at", F.col("_before.ordinal").alias("ordinal"), F.col("_before.title").alias("title")),
    )
    # A mark of an inner level counts only if it came after all marks of the levels above.
    none = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<string>").alias("titles"))
    chain = F.aggregate(
        F.sort_array(F.collect_list(outer)), none,
        lambda acc, o: F.when(
            o["ordinal"] > acc["last"],
            F.struct(o["ordinal"].alias("last"), F.concat(acc["titles"], F.array(o["title"])).alias("titles")),
        ).otherwise(acc),
    )
    return (
        placed.groupBy("doc", "ordinal", "level", "title", "first_page")
        .agg(chain.alias("_chain"), F.min("_after").alias("_next"))
        .select(
            "doc", "ordinal", "level", "title",
            F.array_compact(F.concat("_chain.titles", F.array("title"))).alias("path"),
            F.when(F.col("_chain.last") >= 0, F.col("_chain.last")).alias("parent"),
            "first_page", F.col("_next.first_page").alias("end_page"),
        )
    )


def bookmark_ranges(bookmarks: DataFrame, depth: int | None = None) -> DataFrame:
    """``[page, next page)`` for each bookmark of a document.

    Several bookmarks on one page open one unit that carries all their titles,
    outer levels first, so each of them can be found. With a ``depth`` only
    bookmarks down to that level open units, and a title is the whole path.
    """
    if depth is None:
        titles = F.transform(
            F.array_sort(F.collect_set(F.struct("level", "title"))), lambda t: t["title"]
        )
        opened = bookmarks.groupBy("doc", "page").agg(titles.alias("_titles"))
    else:
        tree = bookmark_tree(bookmarks.filter(F.coalesce("level", F.lit(1)) <= depth))
        marks = F.sort_array(F.collect_list(F.struct("ordinal", "level", "path")))
        # A mark followed by a deeper one on its page is part of that one's path.
        innermost = F.filter(
            "_marks", lambda m, i: F.coalesce(F.get("_marks", i + 1)["level"] <= m["level"], F.lit(True))
        )
        paths = F.transform(innermost, lambda m: F.array_join(m["path"], rules.PATH_SEPARATOR))
        opened = (
            tree.withColumnRenamed("first_page", "page")
            .groupBy("doc", "page").agg(marks.alias("_marks"))
            .select("doc", "page", F.array_distinct(paths).alias("_titles"))
        )
    one_per_page = opened.select(
        "doc", "page",
        F.nullif(F.array_join("_titles", rules.TITLE_SEPARATOR), F.lit("")).alias("title"),
    )
    return next_value(one_per_page, "doc", "page", "next_page").select(
        "doc", "title", F.col("page").alias("first_page"), "next_page"
    )


def _mean_distance(points: DataFrame, group: str, point: str) -> int:
    """Distance between neighbouring points of a group, on the average over all groups."""
    ranges = points.groupBy(group).agg(
        (F.max(point) - F.min(point)).cast("double").alias("_range"), F.count(point).alias("_points")
    )
    whole, n = ranges.agg(F.sum("_range"), F.sum("_points")).first()
    return int((whole or 0) // n) + 1 if n else 1


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    group: str,
    point: str,
    start: str,
    end: str,
    width: int,
) -> DataFrame:
    """Points inside half-open intervals ``[start, end)``, null end meaning open.

    Both sides meet on ``(group, bucket)`` with buckets of ``width`` points, so
    the match is an equi-join that also splits a very large group; an interval is
    listed once per bucket it covers. Buckets are wider where points lie far apart,
    so that a group's range holds about as many buckets as it has points at most.
    Open intervals, few per group, are closed at their group's last point first.
    """
    width = max(width, _mean_distance(points, group, point))
    closed = intervals.filter(F.col(end).isNotNull()).withColumn("_end", F.col(end))
    open_ = intervals.filter(F.col(end).isNull())
    last = points.groupBy(group).agg((F.max(point) + 1).alias("_end"))
    bounded = closed.unionByName(open_.join(last, group).select(*closed.columns))
    listed = bounded.filter(F.col("_end") > F.col(start)).withColumn(
        "_bucket",
        F.explode(
            F.sequence(F.floor(F.col(start) / width), F.floor((F.col("_end") - 1) / width))
        ),
    )
    placed = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return (
        placed.join(listed, [group, "_bucket"])
        .filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col("_end")))
        .drop("_bucket", "_end")
    )


def gather_units(
    pages: DataFrame, keys: list[str], page: str, text: str, block_pages: int = 1024
) -> DataFrame:
    """A unit's text in page order with the page range of the whole unit.

    A unit is one row (``block`` 0) unless it spans more than ``block_pages``
    pages; then it is a row per block of pages, so no task ever gathers an
    unbounded unit's text. Nothing is left out, and ``units_to_chunks`` cuts the
    same parts whatever ``block_pages`` is. ``page_starts`` lists the line of
    ``text``, counted from 0, that each page with a text begins on.
    """
    starts = F.aggregate(
        "_pages",
        F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<line:int,page:bigint>>").alias("starts")),
        lambda acc, p: F.struct(
            (acc["line"] + F.size(F.split(p[text], "\n"))).alias("line"),
            F.concat(
                acc["starts"],
                F.array(F.struct(acc["line"].alias("line"), p[page].cast("bigint").alias("page"))),
            ).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    extent = pages.groupBy(*keys).agg(
        F.min(page).alias("first_page"), F.max(page).alias("last_page")
    )
    return (
        pages.select(*keys, page, text)
        .join(extent, keys)
        .withColumn("block", F.floor((F.col(page) - F.col("first_page")) / block_pages))
        .repartition(*keys, "block")
        .groupBy(*keys, "block", "first_page", "last_page")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(page), F.col(text)))).alias("_pages"))
        .withColumn("_pages", F.filter("_pages", lambda p: p[text].isNotNull()))
        .withColumn("text", F.array_join(F.transform("_pages", lambda p: p[text]), "\n"))
        .withColumn("page_starts", starts)
        .drop("_pages")
    )


def heading_islands(
    lines: DataFrame, doc: str, line_no: str, is_heading: Column, block: int = 4096
) -> DataFrame:
    """Number the stretch of lines each heading opens (0 before the first)."""
    flagged = lines.withColumn("_opens", is_heading.cast("bigint"))
    return running_total(flagged, doc, line_no, "_opens", "island", block).drop("_opens")


def fill_titles(
    units: DataFrame, toc: DataFrame, width: int = 64, depth: int | None = None
) -> DataFrame:
    """Give an untitled unit the contents entry at or before its first page.

    The contents entries become page ranges, so only untitled units join, each
    with exactly one entry; with a ``depth`` it is the entry's path down to there.
    """
    ranges = bookmark_ranges(toc, depth).select(
        "doc", F.col("title").alias("_toc_title"),
        F.col("first_page").alias("_from"), F.col("next_page").alias("_to"),
    )
    untitled = units.filter(F.col("section").isNull()).select("doc", "unit_id", "first_page")
    found = interval_join(untitled, ranges, "doc", "first_page", "_from", "_to", width).select(
        "doc", "unit_id", "_toc_title"
    )
    return (
        units.join(found, ["doc", "unit_id"], "left")
        .withColumn("section", F.coalesce("section", "_toc_title"))
        .drop("_toc_title")
    )


def union_units(text_units: DataFrame, image_units: DataFrame) -> DataFrame:
    """Units from text and units transcribed from illustrations."""
    return text_units.unionByName(image_units, allowMissingColumns=True)


def engine_tags(
    title: Column, rules_by_mark: Mapping[str, str] = rules.VALVE_COUNT_ENGINES
) -> Column:
    """Engines a diagram title is tied to; null when the title names none."""
    found = F.array(
        *[
            F.when(title.rlike(rf"(?:^|[^\p{{N}}]){mark}(?:[^\p{{L}}\p{{N}}]|$)"), F.lit(engine))
            for mark, engine in rules_by_mark.items()
        ]
    )
    present = F.filter(found, lambda e: e.isNotNull())
    return F.when(F.size(present) > 0, present)


def derive_coverage(chunks: DataFrame, codes: Column) -> DataFrame:
    """``(doc, engine, mentions)`` from the codes found in a document's own text.

    ``codes`` is an array expression over a chunk. Counts combine map-side, so
    a document with very many chunks costs one small row per task.
    """
    return (
        explode_once(chunks, codes, "engine", "doc")
        .groupBy("doc", "engine")
        .agg(F.count("*").alias("mentions"))
    )
