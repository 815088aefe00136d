"""Documents to training sequences: five stages, each on all rows the one before kept.

Defined cases: a null, empty or wordless text has no language and goes in the first stage;
null and repeated ids are no hindrance, every row is decided on by itself; a null label is
evidence for no language; equal rows are one class of near duplicates, of which one stays;
columns beyond those of documents are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.decontamination import without_contaminated
from folioquery.llm.languages import fit_trigrams, identify_languages
from folioquery.llm.near_duplicates import near_duplicate_classes
from folioquery.llm.packing import pack
from folioquery.llm.secrets import redacted, with_secret_spans
from folioquery.llm.tables import discard, marked_rows, scope, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The rows, written, with a key of their own: ids can be null or repeated."""
    return stored(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), name)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without an identifiable language go; the rest carry the identified one."""
    plain = docs.select(*COLUMNS)
    langs, model = fit_trigrams(plain)
    found = identify_languages(plain, langs, model, text_col="text", declared=F.col("lang"), host=F.col("source"))
    return found.filter("lang_accepted").select("doc_id", "text", F.col("lang_id").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one row of each class stays, that of smallest id; a row without an id
    only where no row of its class has one. Rows without words are classes of their own."""
    rows = _keyed(docs, "near-duplicate-rows")
    with scope() as spent:
        found = near_duplicate_classes(rows, id_col="row_key").select(F.col("doc_id").alias("row_key"), "class_id")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
        least = rows.select("row_key", "doc_id").join(found, "row_key").groupBy("class_id").agg(first.alias("first"))
        kept = stored(least.select("first.row_key"), "near-duplicate-kept")
    # What is kept is written: nothing reads the tables of the search any more.
    for written in spent:
        if written is not kept:
            discard(written)
    return marked_rows(rows, kept, "row_key").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark window go, with an id or without."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every secret is replaced by a mark; all documents stay."""
    found = with_secret_spans(docs.select(*COLUMNS))
    clean = found.withColumn("text", redacted(F.col("text"), F.col("secret_spans")))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: pieces of documents in sequences of the corpus mixture."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("languages", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

# Trained models, similarity classes and token ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
