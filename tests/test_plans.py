"""What the plans look like: pruned scans, bounded broadcasts, no nested loops, no Python."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioquery.operators.index import open_index, write_index
from folioquery.plans import search as S
from folioquery.rules import SearchParams
from folioquery.session import small_or_none
from workload import adapter as A
from workload import queries as Q
from workload.oracle import ORACLE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def plan(df, mode="simple"):
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ix"))
    write_index(A.documents_as_chunks(spark, SF), path, buckets=8)
    return open_index(spark, path)


def asked(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, query string")


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(ORACLE)


def test_no_nested_loops_and_no_python(spark):
    bad = {}
    for name, run in Q.QUERIES.items():
        text = plan(run(spark, SF))
        found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|\w*EvalPython|MapInPandas", text)
        if found:
            bad[name] = found
    assert bad == {}


def test_search_reads_only_its_terms(spark, index):
    terms = S.question_terms(index, asked(spark, "erst thing"), None, Q.PLAIN)
    text = plan(S.match_postings(index, terms, Q.PLAIN, where={"lang": "en"}))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "postings" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", scan)
    assert "In(term, [erst,thing])" in scan and "EqualTo(lang,en)" in scan
    assert "positions" not in scan.split("ReadSchema")[1]
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_three_aggregations_share_one_shuffle(spark, index):
    hits = S.score_queries(index, asked(spark, "erst thing"), params=SearchParams(fuzzy=False))
    assert plan(hits).count("Exchange hashpartitioning") == 1


def test_caps_and_top_k_prune_before_the_shuffle(spark, index):
    text = plan(S.search(index, asked(spark, "erst thing"), per_doc=1, params=Q.PLAIN))
    assert text.count("WindowGroupLimit") == 4  # partial and final, cap and top-k


def test_wide_texts_are_not_read_for_scores(spark, index):
    text = plan(S.search(index, asked(spark, "erst thing"), params=Q.PLAIN))
    assert not any("text:string" in line for line in text.splitlines() if "FileScan" in line)


def test_candidate_join_changes_no_result(spark, index):
    question = asked(spark, "ananble er re thing")
    lean = S.search(index, question, top_k=500, params=Q.PLAIN)
    assert "LeftSemi" in plan(lean)
    wide = S.search(index, question, top_k=500, params=SearchParams(**{**Q.PLAIN.__dict__, "broadcast_rows": 0}))
    rows = lambda df: sorted((r["chunk_id"], round(r["score"], 6)) for r in df.collect())
    assert rows(lean) == rows(wide) and rows(lean)


def test_postings_are_built_without_a_shuffle(spark):
    from folioquery.operators.index import build_postings

    chunks = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc"), "lang", "text")
    text = plan(build_postings(chunks))
    assert "Exchange" not in text
    assert text.count("regexp_extract_all") <= 2  # title and text, each once


def test_small_or_none_is_a_check_not_a_cut(spark):
    df = spark.range(100).toDF("x")
    assert small_or_none(df, 99) is None
    assert len(small_or_none(df, 100).rows) == 100


def test_scratch_folder_is_required_on_a_cluster(spark):
    from folioquery import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        @staticmethod
        def get(name, default):
            return None

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError):
        session.scratch_dir(Session)
    assert session.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
