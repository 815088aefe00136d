"""Secret scans with column expressions only.

Base patterns give spans of three kinds. Besides these, candidate strings (long runs
of key characters with letters and digits) are judged by the Shannon entropy of a
sliding window: the sum of c*log2(c) over character counts is updated by the entering
and the leaving character alone, so no window is counted anew. The threshold depends
on the character class. Candidates on the allow-list, and those inside a base span,
are suppressed; base spans always stay.

Match positions come from the pieces between matches: ``split`` and
``regexp_extract_all`` walk the same leftmost matches, so lengths add up to offsets.

Defined cases: null or empty text has no spans; rows are independent, so ties and
repeated rows keep their own results; empty tables stay empty; columns named like
the results are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
# A run shorter than the least length fails whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

_KEY = r"[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_KEY})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){_KEY}{{20,}}+"
WINDOW = 20
# Least bits per character of a window, by character class.
THRESHOLDS = {"hex": 3.0, "lower": 3.6, "upper": 3.6, "mixed": 3.7}
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """Every match as (start, kind, end, value); code points, end exclusive."""
    empty = F.expr(f"cast(array() as {_SPAN})")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def peak_entropy(value: Column, width: int = WINDOW) -> Column:
    """Largest entropy in bits of any ``width`` consecutive characters; 0 if shorter.

    The state holds the window and the sum of c*log2(c); a character's count is the
    number of characters that removing it from the window takes away.
    """

    def weight(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count)).otherwise(0.0)

    def count(window: Column, char: Column) -> Column:
        return (F.length(window) - F.length(F.replace(window, char, F.lit("")))).cast("double")

    def leave(state: Column) -> Column:
        full = F.length(state["w"]) == width
        gone = count(state["w"], F.substring(state["w"], 1, 1))
        return F.struct(
            F.when(full, F.substring(state["w"], 2, width)).otherwise(state["w"]).alias("w"),
            F.when(full, state["s"] - weight(gone) + weight(gone - 1)).otherwise(state["s"]).alias("s"),
            state["h"].alias("h"),
        )

    def enter(state: Column, char: Column) -> Column:
        had = count(state["w"], char)
        total = state["s"] + weight(had + 1) - weight(had)
        whole = F.length(state["w"]) == width - 1
        bits = F.when(whole, F.log2(F.lit(float(width))) - total / width).otherwise(0.0)
        return F.struct(F.concat(state["w"], char).alias("w"), total.alias("s"), F.greatest(state["h"], bits).alias("h"))

    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("h"))
    # A one-element transform names the intermediate state, so it is computed once.
    return F.aggregate(
        F.split(value, ""), start, lambda s, c: F.transform(F.array(leave(s)), lambda x: enter(x, c))[0], lambda s: s["h"]
    )


def threshold(value: Column) -> Column:
    return (
        F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"])
        .when(~value.rlike("[A-Z]"), THRESHOLDS["lower"])
        .when(~value.rlike("[a-z]"), THRESHOLDS["upper"])
        .otherwise(THRESHOLDS["mixed"])
    )


def with_secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans`` (base and entropy), both ordered."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = (
        docs.withColumn("_assign", F.filter(spans_of(text, ASSIGN, 0), lambda s: s["value"].rlike(ASSIGN_VALUE)))
        .withColumn("_access", spans_of(text, ACCESS, 1))
        .withColumn("_hex", spans_of(text, HEX, 2))
        .withColumn("_long", spans_of(text, CANDIDATE, 3))
        .withColumn("base_spans", F.array_sort(F.concat("_assign", "_access", "_hex")))
    )
    # Base spans reach into each other at most through their starts, so one comparison each suffices.
    strong = F.filter(
        F.col("_long"),
        lambda c: ~F.exists("base_spans", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
        & ~c["value"].rlike(ALLOWED)
        & (peak_entropy(c["value"]) >= threshold(c["value"])),
    )
    return found.withColumn("secret_spans", F.array_sort(F.concat(F.col("base_spans"), strong))).drop(
        "_assign", "_access", "_hex", "_long"
    )


def listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with every span replaced by a mark; overlapping spans share one."""
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(
            x["start"] >= s["at"],
            F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)),
        ).otherwise(s["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans."""
    found = with_secret_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"),
    )
