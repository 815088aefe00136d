"""Russian stemming as Column expressions, after the published Snowball rules.

Each suffix class is one anchored pattern. The prefix ``[^V]*V`` skips to the
end of the first vowel, so endings are only taken from the region after it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

# Vowels and the ending classes of the published algorithm.
VOWELS = "аеиоуыэюя"
GERUND_AFTER_A = "вшись|вши|в"
GERUND = "ившись|ывшись|ивши|ывши|ив|ыв"
REFLEXIVE = "ся|сь"
ADJECTIVE = (
    "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
)
PARTICIPLE_AFTER_A = "ем|нн|вш|ющ|щ"
PARTICIPLE = "ивш|ывш|ующ"
VERB_AFTER_A = "ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н"
VERB = (
    "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь"
    "|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю"
)
NOUN = (
    "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья"
    "|а|е|и|й|о|у|ы|ь|ю|я"
)

_HEAD = f"[^{VOWELS}]*[{VOWELS}]"


def _ending(plain: str, after_a: str | None = None) -> str:
    pattern = f"({_HEAD}.*?)(?:{plain})"
    if after_a:
        pattern = f"{pattern}|({_HEAD}.*?[ая])(?:{after_a})"
    return f"^(?:{pattern})$"


GERUND_RE = _ending(GERUND, GERUND_AFTER_A)
REFLEXIVE_RE = _ending(REFLEXIVE)
ADJECTIVE_RE = _ending(ADJECTIVE)
PARTICIPLE_RE = _ending(PARTICIPLE, PARTICIPLE_AFTER_A)
VERB_RE = _ending(VERB, VERB_AFTER_A)
NOUN_RE = _ending(NOUN)
FINAL_I_RE = _ending("и")
# The derivational ending must lie after the second vowel-consonant pair.
DERIVATIONAL_RE = (
    f"^([^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}].*?)ость?$"
)
SUPERLATIVE_RE = _ending("ейше|ейш")
DOUBLE_N_RE = f"^({_HEAD}.*?н)н$"
SOFT_SIGN_RE = _ending("ь")


def _two(pattern_has_both: bool) -> str:
    return "$1$2" if pattern_has_both else "$1"


def _inflection(word: Column) -> Column:
    def adjectival(w: Column, or_else: Column) -> Column:
        return let(
            F.regexp_replace(w, ADJECTIVE_RE, _two(False)),
            lambda a: F.when(a != w, F.regexp_replace(a, PARTICIPLE_RE, _two(True))).otherwise(
                or_else
            ),
        )

    def verb_or_noun(w: Column) -> Column:
        return let(
            F.regexp_replace(w, VERB_RE, _two(True)),
            lambda v: F.when(v != w, v).otherwise(F.regexp_replace(w, NOUN_RE, _two(False))),
        )

    return let(
        F.regexp_replace(word, GERUND_RE, _two(True)),
        lambda g: F.when(g != word, g).otherwise(
            let(
                F.regexp_replace(word, REFLEXIVE_RE, _two(False)),
                lambda r: adjectival(r, verb_or_noun(r)),
            )
        ),
    )


def _tidy(word: Column) -> Column:
    def close(w: Column) -> Column:
        return let(
            F.regexp_replace(w, SUPERLATIVE_RE, _two(False)),
            lambda s: let(
                F.regexp_replace(s, DOUBLE_N_RE, _two(False)),
                lambda n: F.when((s != w) | (n != s), n).otherwise(
                    F.regexp_replace(w, SOFT_SIGN_RE, _two(False))
                ),
            ),
        )

    return let(
        F.regexp_replace(
            F.regexp_replace(word, FINAL_I_RE, _two(False)), DERIVATIONAL_RE, _two(False)
        ),
        close,
    )


def stem_russian(word: Column) -> Column:
    """Stem of one lower-case Cyrillic word (ё already folded to е)."""
    return let(word, lambda w: _tidy(_inflection(w)))
