"""Short units join a neighbour of their document instead of becoming short chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.lets import let
from ..session import join_small, new_scratch_path
from .units import running_total


def in_order(df: DataFrame, group: str, page: str, tie: str, out: str, block: int = 4096) -> DataFrame:
    """Rows of each group numbered from 0 by ``page``, then ``tie``.

    Numbers are given inside blocks of pages; totals of the blocks before are added by key.
    """
    blocked = df.withColumn("_block", F.floor(F.col(page) / block))
    inside = Window.partitionBy(group, "_block").orderBy(page, tie)
    across = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy(group, "_block").agg(F.count("*").alias("_rows")).select(
        group, "_block", F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_before")
    )
    return (
        blocked.withColumn("_row", F.row_number().over(inside))
        .join(before, [group, "_block"])
        .withColumn(out, F.col("_before") + F.col("_row") - 1)
        .drop("_row", "_before", "_block")
    )


def _lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def _shifted(starts: Column, by: Column) -> Column:
    return F.transform(starts, lambda s: F.struct((s["line"] + by).alias("line"), s["page"].alias("page")))


def _joined(members: Column, own_title: Column, paged: bool) -> Column:
    """``struct<text, starts>`` of units in order, titles as lines before their texts.

    ``own_title`` says that the first title names the joined unit, so it is no line.
    """

    def piece(m: Column, i: Column) -> Column:
        as_line = m["section"].isNotNull() & ~((i == 0) & own_title)
        text = F.when(as_line, F.concat_ws("\n", m["section"], m["text"])).otherwise(m["text"])
        led = F.when(as_line, _lines(m["section"])).otherwise(F.lit(0))
        return F.struct(text.alias("text"), *([_shifted(m["page_starts"], led).alias("starts")] if paged else []))

    def merged(pieces: Column) -> Column:
        text = F.array_join(pieces["text"], "\n")
        if not paged:
            return F.struct(text.alias("text"))
        empty = F.array().cast("array<struct<line:int,page:bigint>>")
        starts = F.aggregate(
            pieces, F.struct(F.lit(0).alias("line"), empty.alias("all")),
            lambda acc, p: F.struct(
                (acc["line"] + _lines(p["text"])).alias("line"),
                F.concat(acc["all"], _shifted(F.coalesce(p["starts"], empty), acc["line"])).alias("all"),
            ),
            lambda acc: acc["all"],
        )
        return F.struct(text.alias("text"), starts.alias("starts"))

    return let(F.transform(members, piece), merged)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A narrow table that is read several times, written once."""
    path = new_scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def absorb_short(
    units: DataFrame,
    min_chars: int = rules.MIN_CHUNK_CHARS,
    target: int = rules.CHUNK_TARGET,
    block: int = 4096,
) -> DataFrame:
    """Units in the same schema, none below ``min_chars`` where its document holds more.

    ``units`` has ``doc``, ``unit_id``, ``first_page``, ``last_page``, ``section``, ``text``
    and may have ``block`` and ``page_starts`` (see ``gather_units``); ids are unique in a
    document. A run of short units is what stands between two long ones.

    * A run with ``min_chars`` or more in all becomes units of its own, about ``target``
      characters each, under the id and title of their first member.
    * A smaller run leads in the long unit after it, or ends the last one.
    * A document of nothing but a smaller run becomes one unit.

    No text is lost; the titles of joined units become lines before their texts. Units
    without text, without document or with an ``image`` stay as they are. Runs are found
    from running totals over blocks, so neither a large document nor a long run meets in
    one task; what is gathered is bounded by ``target``. Sizes and members, a few numbers a
    unit, are written to the scratch folder when this is called.
    """
    if target < 2 * min_chars:
        raise ValueError("target must be at least twice min_chars")
    key = ["doc", "unit_id"]
    paged, blocked = "page_starts" in units.columns, "block" in units.columns
    pictured = F.col("image").isNotNull() if "image" in units.columns else F.lit(False)
    chars = F.length(F.trim("text"))
    number = F.col("block") if blocked else F.lit(0)
    sizes = (
        units.filter(F.col("doc").isNotNull() & ~pictured)
        .groupBy(*key)
        .agg(
            F.coalesce(F.min("first_page"), F.lit(0)).alias("_page"), F.sum(chars).alias("_chars"),
            F.min(number).alias("_head"), F.max(number).alias("_foot"),
        )
        .filter(F.col("_chars") > 0)
        .withColumn("_long", (F.col("_chars") >= min_chars).cast("bigint"))
    )
    placed = running_total(
        in_order(sizes, "doc", "_page", "unit_id", "_at", block), "doc", "_at", "_long", "_island", block
    )
    placed = _stored(placed, "unit-sizes")
    long_ = placed.filter(F.col("_long") == 1)
    short = running_total(placed.filter(F.col("_long") == 0), "doc", "_at", "_chars", "_through", block)

    islands = long_.groupBy("doc").agg(F.max("_island").alias("_islands"))
    runs = short.groupBy("doc", "_island").agg(
        F.min(F.col("_through") - F.col("_chars")).alias("_base"), F.sum("_chars").alias("_total"),
        F.min("_at").alias("_from"), F.max("_at").alias("_to"),
    )
    alone = (F.col("_total") >= min_chars) | F.col("_islands").isNull()
    runs = join_small(runs, islands, "doc", "left").select(
        "doc", "_island", "_base", "_total", alone.alias("_alone"),
        F.greatest(F.floor(F.col("_total") / target), F.lit(1)).alias("_units"),
        # The long unit that takes the run in, and on which side.
        F.least(F.col("_island") + 1, F.col("_islands")).alias("_host"),
        (F.col("_island") < F.col("_islands")).alias("_leads"),
        F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))).alias("_span"),
    )
    members = (
        short.withColumn("_span", F.floor(F.col("_at") / block))
        .join(runs, ["doc", "_island", "_span"])
        .withColumn(
            "_part",
            F.when(F.col("_alone"), F.expr("(_through - _chars - _base) * _units div _total")).otherwise(F.lit(0)),
        )
        .select(*key, "_at", "_island", "_part", "_alone", "_host", "_leads")
    )
    members = _stored(members, "short-units")
    texts = units.filter((chars < min_chars) & (chars > 0))
    rest = [c for c in units.columns if c not in ("doc", "text", "first_page", "last_page", "page_starts")]
    gathered = (
        texts.join(members, key)
        .groupBy("doc", "_island", "_part", "_alone", "_host", "_leads")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("_at", "section", "text", *(["page_starts"] if paged else []))
                )
            ).alias("_members"),
            F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"),
            F.min_by(F.struct(*rest), "_at").alias("_first"),
        )
        .withColumn("_joined", _joined(F.col("_members"), F.col("_alone"), paged))
    )
    starts = [F.col("_joined.starts").alias("page_starts")] if paged else []
    own = gathered.filter("_alone").select(
        "doc", *[F.col(f"_first.{c}").alias(c) for c in rest], "first_page", "last_page",
        F.col("_joined.text").alias("text"), *starts,
    ).select(*units.columns)

    taken = {
        "text": F.col("_joined.text"), "first": F.col("first_page"), "last": F.col("last_page"),
        **({"starts": F.col("_joined.starts")} if paged else {}),
    }
    sides = {"_lead": F.col("_leads"), "_tail": ~F.col("_leads")}
    extras = (
        gathered.filter(~F.col("_alone"))
        .groupBy("doc", F.col("_host").alias("_island"))
        .agg(
            *[
                F.first(F.when(here, value), ignorenulls=True).alias(f"{side}_{name}")
                for side, here in sides.items() for name, value in taken.items()
            ]
        )
        .join(long_, ["doc", "_island"])
        .select(
            *key, F.lit(False).alias("_gone"), "_head", "_foot",
            *[f"{side}_{name}" for side in sides for name in taken],
        )
    )
    gone = members.select(*key, F.lit(True).alias("_gone"))
    changes = extras.unionByName(gone, allowMissingColumns=True)
    kept = join_small(units, changes, key, "left").filter(
        F.col("_gone").isNull() | ~F.col("_gone") | pictured
    )
    # Only the first row of a long unit takes a lead, only the last one a tail.
    def lead(name: str) -> Column:
        return F.when(number == F.col("_head"), F.col(f"_lead_{name}"))

    def tail(name: str) -> Column:
        return F.when(number == F.col("_foot"), F.col(f"_tail_{name}"))

    changed = F.col("_gone").isNotNull() & ~pictured
    columns = {
        "first_page": F.least("first_page", "_lead_first"),
        "last_page": F.greatest("last_page", "_tail_last"),
        "text": F.concat_ws("\n", lead("text"), F.col("text"), tail("text")),
    }
    if paged:
        led = F.when(number == F.col("_head"), F.coalesce(_lines(F.col("_lead_text")), F.lit(0))).otherwise(F.lit(0))
        empty = F.array().cast("array<struct<line:int,page:bigint>>")
        # Before the new text stands beside it: the shift counts the lines of the old one.
        shifted = F.concat(
            F.coalesce(lead("starts"), empty), F.coalesce(_shifted(F.col("page_starts"), led), empty),
            F.coalesce(_shifted(tail("starts"), led + F.col("_text_lines")), empty),
        )
        kept = kept.withColumn("_text_lines", F.coalesce(_lines(F.col("text")), F.lit(0))).withColumn(
            "page_starts", F.when(changed, shifted).otherwise(F.col("page_starts"))
        )
    return kept.select(
        *[
            F.when(changed, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in units.columns
        ]
    ).unionByName(own)
