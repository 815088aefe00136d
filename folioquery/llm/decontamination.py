"""Benchmark decontamination with one Aho-Corasick automaton.

Items (questions, answers) are normalised to words and cut into windows of
consecutive words; all windows of all items form one automaton, and each text is
scanned once. Matches are word ranges; offsets map back to the original bytes.

The automaton is sized before it is broadcast: items of more text than
``block_bytes`` in all are split by a hash of their id into several automata,
each scanned over the texts, and the matches are united by a row key that is stored
first. So repeated rows and rows without an id keep a row each, in one block or many.

Defined cases: null or empty text has no words and is clean; an item without words
matches nothing; repeated items all count; other columns are not looked at; a null
id is kept as null; empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import as_bytes, stored
from .words import fold_words, folded, worker_cache

SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<first_word:long,last_word:long,start_byte:long,end_byte:long>>"
)


def item_windows(data: bytes, width: int) -> set[bytes]:
    """Windows of ``width`` words; an item of fewer words, but not none, is one window."""
    words = fold_words(data)
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def build_automaton(items: list[tuple[str, bytes]], width: int):
    """Automaton over space-delimited windows; a value is (words, ids of the items)."""
    owners: dict[bytes, set[str]] = {}
    for item, data in items:
        for window in item_windows(data, width):
            owners.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        key = f" {window.decode('utf-8', 'surrogateescape')} "
        automaton.add_word(key, (window.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        automaton.make_automaton()
    return automaton if owners else None


def matches(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges (first, last) inside any window, and the items they are from."""
    if automaton is None or not words:
        return [], set()
    text = f" {b' '.join(words).decode('utf-8', 'surrogateescape')} "
    found = list(automaton.iter(text))
    if not found:
        return [], set()
    # A match ends on the space behind its last word; that space's rank is the word's.
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    ranges = sorted((int(at) - size + 1, int(at)) for at, (_, (size, _)) in zip(last, found, strict=True))
    return merge(ranges), {item for _, (_, ids) in found for item in ids}


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def word_offsets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word in the original text."""
    inside = np.concatenate([[False], np.frombuffer(folded(data), np.uint8) != 32, [False]]).astype(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _row(doc, words_n: int, ranges, items) -> dict:
    ids = sorted(items)
    return {
        "doc_id": doc, "n_words": words_n, "n_hit": sum(b - a + 1 for a, b, *_ in ranges), "n_items": len(ids),
        "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "contaminated": bool(ranges), "items": ids,
        "spans": [{"first_word": a, "last_word": b, "start_byte": s, "end_byte": e} for a, b, s, e in ranges],
    }


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start_byte", "end_byte")]))),
])


def _wanted(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), as_bytes(item_text_col).alias("data"))


def _blocks(wanted: DataFrame, block_bytes: int) -> int:
    """Parts of the items, each for an automaton of its own."""
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    return max(1, -(-total // block_bytes))


def _pairs(wanted: DataFrame, block: int, blocks: int) -> list[tuple[str, bytes]]:
    part = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else wanted
    rows = part.toArrow()
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def _automaton(shared, key: str, width: int):
    """The automaton of the items shared under ``key``; a worker keeps the last one."""
    cache = worker_cache()
    if cache.get("automaton_key") != key:
        cache["automaton"], cache["automaton_key"] = build_automaton(shared.value, width), key
    return cache["automaton"]


def without_contaminated(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 10, block_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows of ``docs`` that ``find_contamination`` finds clean, as they came. A row is judged
    where it is read, so none needs an id and none is moved or written."""
    wanted = _wanted(items, item_col, item_text_col)
    blocks = _blocks(wanted, block_bytes)
    kept, at = docs, docs.columns.index(text_col)

    def clean(shared, key: str):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared, key, width)
            for batch in batches:
                texts = (t.as_py() or b"" for t in batch.column(at).cast(pa.binary()))
                yield batch.filter(pa.array([not matches(automaton, fold_words(t))[0] for t in texts], pa.bool_()))

        return scan

    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(_pairs(wanted, block, blocks))
        kept = kept.mapInArrow(clean(shared, uuid.uuid4().hex), docs.schema)
    return kept


def _scan(docs: DataFrame, shared, key: str, width: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, key, width)
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                words = fold_words(data)
                ranges, items = matches(automaton, words)
                if ranges:
                    starts, ends = word_offsets(data)
                    ranges = [(a, b, int(starts[a]), int(ends[b])) for a, b in ranges]
                rows.append(_row(doc, len(words), ranges, items))
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.mapInArrow(scan, SCHEMA)


def _united(parts: DataFrame) -> DataFrame:
    """Matches of several automata, one row per row key, which stands in ``doc_id``."""
    gathered = parts.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items"),
    )

    def unite(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                first = {s["first_word"]: s["start_byte"] for s in r["spans"]}
                last = {s["last_word"]: s["end_byte"] for s in r["spans"]}
                ranges = merge([(s["first_word"], s["last_word"]) for s in r["spans"]])
                rows.append(_row(r["doc_id"], r["n_words"], [(a, b, first[a], last[b]) for a, b in ranges], set(r["items"])))
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return gathered.mapInArrow(unite, SCHEMA)


def find_contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = 10, block_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: counts, contaminated items and the matched ranges."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"))
    wanted = _wanted(items, item_col, item_text_col)
    blocks = _blocks(wanted, block_bytes)
    parts, scanned = [], texts
    if blocks > 1:
        keyed = stored(texts.withColumn("row_key", F.monotonically_increasing_id()), "contamination-rows")
        scanned = keyed.select(F.col("row_key").alias("doc_id"), "data")
    for block in range(blocks):
        parts.append(_scan(scanned, spark.sparkContext.broadcast(_pairs(wanted, block, blocks)), uuid.uuid4().hex, width))
    if blocks == 1:
        return parts[0]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    united = _united(union).withColumnRenamed("doc_id", "row_key")
    return united.join(keyed.select("row_key", "doc_id"), "row_key").select(*parts[0].columns)
