"""Which documents may answer for which engine.

The relational forms work on any number of queries; ``check`` and ``restrict``
decide for one query from the applicability map, which has a handful of entries.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..session import join_small
from ..sources.corpus import Vehicle
from .filters import engine_condition


@dataclass(frozen=True)
class Applicability:
    engine: str | None = None
    allowed: list[str] | None = None
    blocked: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def code_names(vehicle: Vehicle | None = None) -> dict[str, str]:
    """Every written form of an engine code (upper case) with its canonical code."""
    names = {code: code for code in rules.ENGINE_CODES}
    names.update(rules.ENGINE_ALIASES)
    for code, facts in (vehicle.engines if vehicle else {}).items():
        names[code.upper()] = code
        for alias in (facts or {}).get("aliases") or []:
            names[alias.upper()] = code
    return names


def _alternatives(names: Mapping[str, str]) -> str:
    return "|".join(sorted(re.escape(n.lower()) for n in names))


def engines_in(text: Column, names: Mapping[str, str]) -> Column:
    """Canonical engine codes named in a text, in reading order, each once."""
    if not names:
        return F.array().cast("array<string>")
    canonical = F.create_map(
        *[F.lit(x) for pair in sorted(names.items()) for x in (pair[0].lower(), pair[1])]
    )
    known = F.array(*[F.lit(name.lower()) for name in sorted(names)])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    codes = F.filter(words, lambda w: F.array_contains(known, w))
    return F.array_distinct(F.transform(codes, lambda w: F.element_at(canonical, w)))


def engines_in_text(text: str, vehicle: Vehicle | None = None) -> list[str]:
    """Codes in one short text such as a query."""
    names = code_names(vehicle)
    found = re.findall(rf"(?<!\w)(?:{_alternatives(names)})(?!\w)", text.lower())
    return list(dict.fromkeys(names[f.upper()] for f in found))


def without_codes(query: Column, names: Mapping[str, str]) -> Column:
    """The question without engine codes, unless it is nothing else.

    A code chooses documents and diagrams; their texts need not repeat it.
    """
    rest = F.regexp_replace(query, rf"(?i)\b(?:{_alternatives(names)})\b", " ")
    return F.when(F.trim(rest) != "", rest).otherwise(query)


def asked_drive(query: str) -> str | None:
    """``belt`` or ``chain`` when the query is about that kind of timing drive."""
    text = query.lower()
    if not re.search(rules.TIMING_WORD, text):
        return None
    if re.search(rules.BELT_WORD, text):
        return "belt"
    return "chain" if re.search(rules.CHAIN_WORD, text) else None


def check(query: str, vehicle: Vehicle, profile_engine: str | None = None) -> Applicability:
    """Engine of the query (else the profile's), admitted documents, and warnings."""
    named = engines_in_text(query, vehicle)
    engine = named[0] if named else profile_engine
    if engine is None:
        return Applicability()
    coverage = vehicle.document_engines
    allowed = sorted(d for d, covers in coverage.items() if not covers or engine in covers)
    blocked = sorted(set(coverage) - set(allowed))
    if not coverage:
        allowed = None  # no map at all: nothing is known against any document
    warnings = []
    if blocked:
        warnings.append(
            f"Двигатель {engine} не покрыт документами: {', '.join(blocked)} — они исключены."
        )
    drive = (vehicle.engines.get(engine) or {}).get("timing_drive")
    asked = asked_drive(query)
    if drive and asked and drive != asked:
        warnings.append(
            f"{rules.ALARM_WORD}: привод ГРМ двигателя {engine} — "
            f"{'цепь' if drive == 'chain' else 'ремень'}; "
            f"вопрос о другом приводе {rules.NOT_APPLICABLE_WORD}."
        )
    return Applicability(engine, allowed, blocked, warnings)


def restrict(where: Mapping | None, result: Applicability) -> dict:
    """``where`` with its documents cut down to the admitted ones."""
    merged = dict(where or {})
    if result.allowed is None:
        return merged
    wanted = merged.get("doc")
    if wanted is None:
        merged["doc"] = list(result.allowed)
    else:
        asked = wanted if isinstance(wanted, (list, tuple, set)) else [wanted]
        merged["doc"] = [d for d in asked if d in result.allowed]
    return merged


def resolve_engine(named: Column, profile: Column) -> Column:
    """Code named in the query, else the profile's, else null."""
    return F.coalesce(F.get(named, F.lit(0)), profile)


def admitted(engine: Column, vehicle: Vehicle) -> Column:
    """Documents of the applicability map that may answer for an engine; null when
    no engine is known, which restricts nothing."""
    if not vehicle.document_engines:
        return F.lit(None).cast("array<string>")
    documents = F.array(
        *[
            F.struct(
                F.lit(doc).alias("doc"),
                F.array(*[F.lit(e) for e in covers]).cast("array<string>").alias("covers"),
            )
            for doc, covers in sorted(vehicle.document_engines.items())
        ]
    )
    fitting = F.filter(
        documents, lambda d: (F.size(d["covers"]) == 0) | F.array_contains(d["covers"], engine)
    )
    return F.when(engine.isNotNull(), fitting["doc"])


def document_coverage(documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(doc, covers)``: the engines of each document, null when it states none.

    ``coverage(doc, engine)`` may repeat pairs; there are only a few engine codes,
    so the set of one document stays small and combines map-side.
    """
    stated = coverage.groupBy("doc").agg(F.sort_array(F.collect_set("engine")).alias("covers"))
    return documents.select("doc").distinct().join(stated, "doc", "left")


def allowed_documents(covered: DataFrame, engines: Sequence[str]) -> DataFrame:
    """``(engine, doc)``: documents that cover the engine or state no coverage."""
    return covered.withColumn(
        "engine", F.explode(F.array(*[F.lit(e) for e in engines]))
    ).filter(engine_applies(F.col("covers"), F.col("engine"))).select("engine", "doc")


def blocked_documents(covered: DataFrame, engines: Sequence[str]) -> DataFrame:
    """``(engine, doc)``: documents whose stated coverage leaves the engine out."""
    return covered.withColumn(
        "engine", F.explode(F.array(*[F.lit(e) for e in engines]))
    ).filter(~engine_applies(F.col("covers"), F.col("engine"))).select("engine", "doc")


def gate(chunks: DataFrame, covered: DataFrame, engine: str) -> DataFrame:
    """Chunks that may answer for an engine: their document covers it, and their own
    tag, if they have one, names it."""
    allowed = allowed_documents(covered, [engine]).select("doc")
    return join_small(chunks, allowed, "doc", "left_semi").filter(engine_condition(engine))


def engine_applies(covers: Column, engine: Column) -> Column:
    return covers.isNull() | F.array_contains(covers, engine)
