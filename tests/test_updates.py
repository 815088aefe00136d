"""A corpus changed in layers gives what a full rebuild gives."""

import pytest
from pyspark.sql import functions as F

from folioquery.operators.corpus import CHUNK_SCHEMA
from folioquery.operators.index import index_in_memory
from folioquery.plans.search import search
from folioquery.plans.updates import compact, corpus_documents, ingest_documents, open_corpus
from folioquery.rules import SearchParams
from test_search import chunk

PARAMS = SearchParams(coverage="soft", fuzzy=False)


def rows(spark, *chunks):
    return spark.createDataFrame(list(chunks), CHUNK_SCHEMA).coalesce(1)


def state(spark, index):
    asked = spark.createDataFrame([(1, "pump valve"), (2, "filter")], "query_id long, query string").coalesce(1)
    hits = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in search(index, asked, top_k=9, params=PARAMS).collect())
    terms = sorted((r.term, r.df) for r in index.terms.collect())
    return hits, terms, index.n_chunks, index.n_tokens


def test_layers_and_compaction_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path)
    old = [chunk("a:u1:0", "a", "en", "PUMP", "The pump has a valve."), chunk("a:u2:0", "a", "en", None, "Old filter, old pump."), chunk("b:u1:0", "b", "en", None, "A valve alone.")]
    other = [chunk("z:u1:0", "z", "en", None, "Filter and pump of a second publisher.")]
    new = [chunk("a:u1:0", "a", "en", "PUMP", "The pump has a new valve."), chunk("c:u1:0", "c", "en", None, "Another filter valve.")]
    assert ingest_documents(spark, path, rows(spark, *old), "one", buckets=2) == {"new": 2}
    assert ingest_documents(spark, path, rows(spark, *other), "two") == {"new": 1}
    assert ingest_documents(spark, path, rows(spark, *old), "one") == {"same": 2}
    assert ingest_documents(spark, path, rows(spark, *new), "one") == {"changed": 1, "new": 1, "gone": 1}
    want = state(spark, index_in_memory(rows(spark, *new, *other)))
    assert state(spark, open_corpus(spark, path)) == want and want[0]
    assert sorted((r.doc, r.publisher) for r in corpus_documents(spark, path).collect()) == [("a", "one"), ("c", "one"), ("z", "two")]
    with pytest.raises(ValueError, match="'z'"):
        ingest_documents(spark, path, rows(spark, *other), "one")
    compact(spark, path)
    assert state(spark, open_corpus(spark, path)) == want
    # A layer that was never committed is not read.
    spark.range(1).select(F.lit("a").alias("doc"), F.lit("one").alias("publisher"), F.lit(None).cast("string").alias("digest")).write.parquet(f"{path}/manifest/layer=99")
    assert state(spark, open_corpus(spark, path)) == want
