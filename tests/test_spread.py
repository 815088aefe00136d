"""Words are counted where their document lies."""

from folioquery.operators import units
from workload.queries import QUERIES


def test_tokens_are_not_shuffled(spark, tmp_path):
    rows = [(i, "a-b a b a" if i % 2 else None, "en", "src1") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("tokenize", "compound_split"):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(") == 1 and "token" not in plan.split("hashpartitioning(")[1].split(")")[0]
        assert {(r.token, r.n) for r in df.collect() if r.doc_id == 1} >= {("a" if name == "tokenize" else "en-stop-en", 2 if name == "tokenize" else 1)}


def test_intervals_over_points_far_apart_are_listed_about_once_a_point(spark):
    # Listed by 4096 points each, the first interval had 2.4e9 rows.
    far = 10**13
    points = spark.createDataFrame([("a", 0), ("a", 5), ("a", far), ("b", 7)], "doc string, page long")
    marks = spark.createDataFrame([("a", 0, far), ("a", far, None), ("b", 7, None)], "doc string, first long, next long")
    got = units.interval_join(points, marks, "doc", "page", "first", "next", width=4096).collect()
    assert sorted((r.doc, r.page, r.first) for r in got) == [("a", 0, 0), ("a", 5, 0), ("a", far, far), ("b", 7, 7)]
