"""Tokenising, stemming and trigrams as Column expressions (no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .lets import let
from .russian import stem_russian


def fold(text: Column) -> Column:
    """Lower case with ё read as е."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def surface_tokens(text: Column) -> Column:
    """Words in reading order, hyphen compounds kept whole."""
    return F.regexp_extract_all(fold(text), F.lit(rules.TOKEN), F.lit(0))


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{N}")


def is_compound(token: Column) -> Column:
    return F.contains(token, F.lit("-")) & ~has_digit(token)


def token_forms(token: Column) -> Column:
    """A compound gives itself and each part; any other token gives itself."""
    return F.when(
        is_compound(token), F.concat(F.array(token), F.split(token, "-"))
    ).otherwise(F.array(token))


def tokenize(text: Column) -> Column:
    """All index forms of a text: words, plus the parts of hyphen compounds."""
    return F.flatten(F.transform(surface_tokens(text), token_forms))


def _cut(token: Column, chars: int) -> Column:
    return F.left(token, F.length(token) - F.lit(chars))


def strip_plural(token: Column) -> Column:
    return F.when(
        F.endswith(token, F.lit("s"))
        & ~F.endswith(token, F.lit("ss"))
        & (F.length(token) >= 4),
        _cut(token, 1),
    ).otherwise(token)


def strip_verb_ending(token: Column) -> Column:
    size = F.length(token)
    return (
        F.when(F.endswith(token, F.lit("ing")) & (size >= 7), _cut(token, 3))
        .when(F.endswith(token, F.lit("ed")) & (size >= 6), _cut(token, 2))
        .when(F.endswith(token, F.lit("e")) & (size >= 4), _cut(token, 1))
        .otherwise(token)
    )


def stem_english(token: Column) -> Column:
    """Light stemmer with a minimum stem length per ending."""
    return let(strip_plural(token), strip_verb_ending)


def is_cyrillic(token: Column) -> Column:
    """Whether a lower-case token starts in the Russian alphabet (by code point)."""
    return (token >= "а") & (token < "ѐ")


def _may_inflect(token: Column) -> Column:
    """Cheap test: only these last letters can be an English ending."""
    return F.right(token, F.lit(1)).isin("s", "e", "d", "g")


def stem_word(token: Column) -> Column:
    """Stem of a token that is a plain column or lambda variable (it is read often).

    Dispatch per token: digits untouched, Cyrillic and Latin by their own rules.
    """
    return (
        F.when(is_cyrillic(token), F.when(has_digit(token), token).otherwise(stem_russian(token)))
        .when(~_may_inflect(token) | has_digit(token), token)
        .otherwise(stem_english(token))
    )


def stem(token: Column) -> Column:
    """Stem of any token expression."""
    return let(token, stem_word)


def stems(tokens: Column) -> Column:
    return F.transform(tokens, stem_word)


def trigrams(word: Column) -> Column:
    """Distinct character trigrams, anchored by two leading and one trailing blank."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return let(
        padded,
        lambda p: F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(p) - F.lit(2)),
                lambda i: F.substring(p, i, F.lit(3)),
            )
        ),
    )


def contains_ci(haystack: Column, needle: Column) -> Column:
    return F.contains(F.lower(haystack), F.lower(needle))


def without_stop_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    stop = F.array(*[F.lit(word) for word in stop_words])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))
