"""Splitting long units into parts.

Packing is sequential within one text, so it is a fold over that row's own
array: no shuffle, no Python. Atoms are paragraphs; a paragraph above the
target breaks into sentences, a sentence above it into words, and a word above
it into slices, so no part exceeds the target by more than a merged short tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.lets import let


def _slices(word: Column, target: int) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.length(word) - 1) / target).cast("int"))
    return F.transform(
        starts,
        lambda i: F.struct(
            F.when(i == 0, F.lit(" ")).otherwise(F.lit("")).alias("sep"),
            F.substring(word, i * target + 1, F.lit(target)).alias("text"),
        ),
    )


def _spaced(piece: Column) -> Column:
    return F.array(F.struct(F.lit(" ").alias("sep"), piece.alias("text")))


def _word_atoms(sentence: Column, target: int) -> Column:
    words = F.filter(F.split(sentence, r"\s+"), lambda w: F.length(w) > 0)
    return F.flatten(
        F.transform(
            words,
            lambda w: F.when(F.length(w) <= target, _spaced(w)).otherwise(_slices(w, target)),
        )
    )


def _sentence_atoms(paragraph: Column, target: int) -> Column:
    sentences = F.filter(
        F.transform(
            F.regexp_extract_all(paragraph, F.lit(rules.SENTENCE), F.lit(0)),
            lambda s: F.trim(s),
        ),
        lambda s: F.length(s) > 0,
    )
    return F.flatten(
        F.transform(
            sentences,
            lambda s: F.when(F.length(s) <= target, _spaced(s)).otherwise(_word_atoms(s, target)),
        )
    )


def _atoms(text: Column, target: int) -> Column:
    """Pieces in order: separator before it, text, and the line of the text it stands on."""
    paragraphs = F.filter(
        F.transform(
            F.split(text, "\n"), lambda l, i: F.struct(F.trim(l).alias("text"), i.alias("line"))
        ),
        lambda p: F.length(p["text"]) > 0,
    )

    def pieces(p: Column) -> Column:
        return F.when(F.length(p) <= target, _spaced(p)).otherwise(_sentence_atoms(p, target))

    def spread(p: Column) -> Column:
        return F.transform(
            pieces(p["text"]),
            lambda atom, i: F.struct(
                F.when(i == 0, F.lit("\n")).otherwise(atom["sep"]).alias("sep"),
                atom["text"].alias("text"), p["line"].alias("line"),
            ),
        )

    return F.flatten(F.transform(paragraphs, spread))


_NO_PARTS = "array<struct<text:string,first:int,last:int>>"


def _part(text: Column, first: Column, last: Column) -> Column:
    """A part and the lines it runs over."""
    return F.struct(text.alias("text"), first.alias("first"), last.alias("last"))


def _packed(text: Column, target: int, min_chars: int) -> Column:
    """The parts of a unit with the lines of ``text`` each runs over."""
    start = F.struct(
        F.array().cast(_NO_PARTS).alias("parts"),
        _part(F.lit(""), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("open"),
    )

    def pack(acc: Column, atom: Column) -> Column:
        parts, open_ = acc["parts"], acc["open"]
        fits = (
            F.length(open_["text"]) + F.length(atom["sep"]) + F.length(atom["text"]) <= target
        )
        alone = _part(atom["text"], atom["line"], atom["line"])
        longer = _part(
            F.concat(open_["text"], atom["sep"], atom["text"]), open_["first"], atom["line"]
        )
        return (
            F.when(open_["text"] == "", F.struct(parts.alias("parts"), alone.alias("open")))
            .when(fits, F.struct(parts.alias("parts"), longer.alias("open")))
            .otherwise(
                F.struct(F.concat(parts, F.array(open_)).alias("parts"), alone.alias("open"))
            )
        )

    def close(acc: Column) -> Column:
        parts, tail = acc["parts"], acc["open"]
        count = F.size(parts)
        before = F.get(parts, count - 1)
        merged = F.concat(
            F.slice(parts, F.lit(1), count - 1),
            F.array(
                _part(
                    F.concat(before["text"], F.lit("\n"), tail["text"]), before["first"], tail["last"]
                )
            ),
        )
        return (
            F.when(tail["text"] == "", parts)
            .when((F.length(tail["text"]) < min_chars) & (count > 0), merged)
            .otherwise(F.concat(parts, F.array(tail)))
        )

    return F.aggregate(_atoms(text, target), start, pack, close)


def chunk_unit(
    text: Column,
    target: int = rules.CHUNK_TARGET,
    min_chars: int = rules.MIN_CHUNK_CHARS,
) -> Column:
    """The parts of a unit: greedy packing up to ``target`` characters.

    A last part shorter than ``min_chars`` joins the part before it.
    """
    return F.transform(_packed(text, target, min_chars), lambda p: p["text"])


def _page_at(starts: Column, line: Column) -> Column:
    """The page that line is on: the last one that starts at it or before; null without starts."""
    return F.array_max(F.transform(F.filter(starts, lambda s: s["line"] <= line), lambda s: s["page"]))


def chunk_page(
    section: Column,
    text: Column,
    target: int = rules.CHUNK_TARGET,
) -> Column:
    """Parts of one parsed page; a page without body text is carried by its heading."""
    return let(
        chunk_unit(text, target),
        lambda parts: F.when(F.size(parts) > 0, parts).when(
            F.length(section) > 0, F.array(section)
        ).otherwise(F.array().cast("array<string>")),
    )


def _pack_states(lengths: Column, target: int, state: Column) -> Column:
    """``(closed, open)``: parts closed and length of the open part, after atoms of these lengths."""

    def step(acc: Column, atom: Column) -> Column:
        fits = acc["open"] + atom["sep"] + atom["text"] <= target
        return (
            F.when(acc["open"] == 0, F.struct(acc["closed"].alias("closed"), atom["text"].alias("open")))
            .when(fits, F.struct(acc["closed"].alias("closed"), (acc["open"] + atom["sep"] + atom["text"]).alias("open")))
            .otherwise(F.struct((acc["closed"] + 1).alias("closed"), atom["text"].alias("open")))
        )

    return F.aggregate(lengths, state, step)


def _pieces(atoms: Column, carried: Column, target: int) -> Column:
    """What a block adds to the part left open before it (first, maybe empty) and to each new part,
    with the lines of the block that it runs over."""
    nothing = _part(F.lit(""), F.lit(None).cast("int"), F.lit(None).cast("int"))
    start = F.struct(
        F.array().cast(_NO_PARTS).alias("parts"), nothing.alias("open"), carried.alias("size")
    )

    def step(acc: Column, atom: Column) -> Column:
        parts, open_ = acc["parts"], acc["open"]
        more = F.length(atom["sep"]) + F.length(atom["text"])
        alone = _part(atom["text"], atom["line"], atom["line"])
        longer = _part(
            F.concat(open_["text"], atom["sep"], atom["text"]),
            F.coalesce(open_["first"], atom["line"]), atom["line"],
        )
        return (
            F.when(
                acc["size"] == 0,
                F.struct(parts.alias("parts"), alone.alias("open"), F.length(atom["text"]).alias("size")),
            )
            .when(
                acc["size"] + more <= target,
                F.struct(parts.alias("parts"), longer.alias("open"), (acc["size"] + more).alias("size")),
            )
            .otherwise(
                F.struct(
                    F.concat(parts, F.array(open_)).alias("parts"),
                    alone.alias("open"), F.length(atom["text"]).alias("size"),
                )
            )
        )

    return F.aggregate(atoms, start, step, lambda acc: F.concat(acc["parts"], F.array(acc["open"])))


def _blocks_to_parts(units: DataFrame, kept: list[str], target: int, min_chars: int) -> DataFrame:
    """Parts of units that come in several rows, cut as if the text were in one.

    The lengths of a unit's atoms, not their texts, meet in one row; folding them
    gives each block the part and length it starts from. A part that spans blocks
    is put together from what each adds, and so are its pages.
    """
    key = ["doc", "unit_id"]
    paged = [c for c in units.columns if c == "page_starts"]
    pages = [
        _page_at(F.col("page_starts"), F.col(f"_piece.{line}")).alias(name)
        for line, name in (("first", "part_page"), ("last", "part_page_end")) if paged
    ]
    atoms = units.select(*kept, *paged, "unit_id", "block", _atoms(F.col("text"), target).alias("_atoms"))
    sizes = F.transform(
        "_atoms", lambda a: F.struct(F.length(a["sep"]).alias("sep"), F.length(a["text"]).alias("text"))
    )
    begin = F.struct(F.lit(0).alias("closed"), F.lit(0).alias("open"))
    states = F.aggregate(
        "_blocks",
        F.struct(
            F.array().cast("array<struct<block:bigint,closed:int,open:int>>").alias("before"), begin.alias("at")
        ),
        lambda acc, b: F.struct(
            F.concat(
                acc["before"],
                F.array(F.struct(
                    b["block"].alias("block"), acc["at"]["closed"].alias("closed"), acc["at"]["open"].alias("open")
                )),
            ).alias("before"),
            _pack_states(b["sizes"], target, acc["at"]).alias("at"),
        ),
    )
    ends = F.col("_end")
    starts = (
        atoms.select(*key, F.struct(F.col("block").cast("bigint").alias("block"), sizes.alias("sizes")).alias("_b"))
        .groupBy(*key).agg(F.sort_array(F.collect_list("_b")).alias("_blocks"))
        .select(*key, states.alias("_s"))
        .select(*key, F.col("_s.at").alias("_end"), F.explode("_s.before").alias("_at"))
        .select(
            *key, F.col("_at.block").alias("block"), F.col("_at.closed").alias("_closed"), F.col("_at.open").alias("_open"),
            (ends["closed"] + (ends["open"] > 0).cast("int")).alias("_total"),
            ((ends["open"] > 0) & (ends["open"] < min_chars) & (ends["closed"] > 0)).alias("_short"),
        )
    )
    tail = F.col("_short") & (F.col("part") == F.col("_total") - 1)
    opens = (F.col("_i") > 0) | (F.col("_open") == 0)
    pieces = (
        atoms.join(starts, [*key, "block"])
        .select(
            *kept, *paged, "unit_id", "block", "_closed", "_open", "_total", "_short",
            F.posexplode_outer(_pieces(F.col("_atoms"), F.col("_open"), target)).alias("_i", "_piece"),
        )
        .filter(F.col("_piece.text") != "")
        .select(
            *kept, "unit_id", "block", "_closed", "_open", "_total", "_short", "_i",
            F.col("_piece.text").alias("text"), *pages,
        )
        .withColumn("part", F.col("_closed") + F.col("_i"))
        # A last part that is too short joins the one before.
        .withColumn("text", F.when(tail & opens, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")))
        .withColumn("part", F.when(tail, F.col("part") - 1).otherwise(F.col("part")))
    )
    return (
        pieces.groupBy(*key, "part")
        .agg(
            *[F.first(c).alias(c) for c in kept if c not in key],
            F.first(F.col("_total") - F.col("_short").cast("int")).alias("unit_parts"),
            *([F.min("part_page").alias("part_page"), F.max("part_page_end").alias("part_page_end")] if paged else []),
            F.sort_array(F.collect_list(F.struct("block", "_i", "text"))).alias("_all"),
        )
        .withColumn("text", F.array_join(F.transform("_all", lambda p: p["text"]), ""))
        .drop("_all")
    )


def units_to_chunks(units: DataFrame, target: int = rules.CHUNK_TARGET) -> DataFrame:
    """One row per part; every part keeps all unit columns, the title included.

    ``units`` needs ``doc``, ``unit_id`` and ``text``. Map-only, unless a
    ``block`` column says that long units come in several rows; the parts are the
    same however a unit is divided into blocks. With ``page_starts`` (see
    ``gather_units``) a part also states its own pages, ``part_page`` to ``part_page_end``.
    """
    kept = [c for c in units.columns if c not in ("text", "unit_id", "block", "page_starts")]
    if "block" in units.columns:
        parts = _blocks_to_parts(units, kept, target, rules.MIN_CHUNK_CHARS)
    else:
        paged = [c for c in units.columns if c == "page_starts"]
        packed = _packed(F.col("text"), target, rules.MIN_CHUNK_CHARS)
        parts = (
            units.select(*kept, *paged, "unit_id", packed.alias("_parts"))
            .withColumn("unit_parts", F.size("_parts"))
            .select(*kept, *paged, "unit_id", "unit_parts", F.posexplode_outer("_parts").alias("part", "_part"))
            .filter(F.col("_part").isNotNull())
            .select(
                *kept, "unit_id", "unit_parts", "part", F.col("_part.text").alias("text"),
                *(
                    [
                        _page_at(F.col("page_starts"), F.col("_part.first")).alias("part_page"),
                        _page_at(F.col("page_starts"), F.col("_part.last")).alias("part_page_end"),
                    ]
                    if paged else []
                ),
            )
        )
    return parts.withColumn(
        "id", F.concat_ws(":", "doc", F.concat(F.lit("u"), F.col("unit_id")), F.col("part"))
    )
