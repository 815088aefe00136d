"""Result filters: equality, membership, engine tags, and their intersection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Where = Mapping[str, object]


def where_condition(where: Where | None) -> Column:
    """All conditions of a ``where`` mapping, ANDed.

    A list means membership; the empty list admits nothing, it is not "no filter".
    """
    condition = F.lit(True)
    for name, wanted in (where or {}).items():
        if isinstance(wanted, (list, tuple, set, frozenset)):
            clause = F.col(name).isin(list(wanted)) if wanted else F.lit(False)
        else:
            clause = F.col(name) == F.lit(wanted)
        condition = condition & clause
    return condition


def engine_condition(engine: str | None, tags: str = "engines") -> Column:
    """Rows tagged with other engines are dropped; untagged rows apply to all."""
    if engine is None:
        return F.lit(True)
    return F.col(tags).isNull() | F.array_contains(tags, engine)


# Optional per-query columns of a batch; null means the query sets no such limit.
LIMITS = ("only_docs", "only_engine", "only_engines", "only_langs", "only_chapters")

# Filter keys of a labelled question, the limit column each one sets, and its type.
FILTER_LIMITS = {
    "doc": ("only_docs", "string"), "lang": ("only_langs", "string"),
    "chapter": ("only_chapters", "int"), "engine": ("only_engines", "string"),
}


def limits_condition(present: Iterable[str]) -> Column:
    """Per-query limits carried by the query side, on rows already joined with it."""
    tests = {
        "only_docs": lambda c: F.array_contains(c, F.col("doc")),
        "only_engine": lambda c: F.col("engines").isNull() | F.array_contains("engines", c),
        "only_engines": lambda c: F.col("engines").isNull() | F.arrays_overlap(F.col("engines"), c),
        "only_langs": lambda c: F.array_contains(c, F.col("lang")),
        "only_chapters": lambda c: F.array_contains(c, F.col("chapter")),
    }
    condition = F.lit(True)
    for name in present:
        condition = condition & (F.col(name).isNull() | F.coalesce(tests[name](F.col(name)), F.lit(False)))
    return condition


def filter_values(filters: Column, key: str, kind: str = "string") -> Column:
    """The values a variant of filters allows under a key, as an array.

    A scalar is a list of one, the empty list stays empty (it admits nothing), and an
    absent key or a JSON null sets no limit. A value that is not of the ``kind`` becomes
    null inside the array, which no row equals; a fraction counts as its whole part.
    """
    path = f"$.{key}"
    value = F.try_variant_get(filters, path, "variant")
    shape = F.schema_of_variant(value)
    several = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", kind))
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast(f"array<{kind}>"))
        .when(shape.startswith("ARRAY"), several)
        .otherwise(F.array(F.try_variant_get(value, "$", kind)))
    )


def unknown_filters(filters: Column) -> Column:
    """Keys no limit belongs to; null or empty if all are known."""
    return F.array_except(F.json_object_keys(F.to_json(filters)), F.array(*[F.lit(k) for k in FILTER_LIMITS]))
