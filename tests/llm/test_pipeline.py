import re
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from folioquery.llm.tables import marked_rows, stored
from folioquery.session import scratch_dir

from .cases import ODD, words
from .test_decontamination import brute as leaks
from .test_near_duplicates import classes

def test_pipeline_stage_removes_contaminated_rows_without_an_id(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item}", "en", "a", 9), (None, "clean text", "en", "a", 9), (5, item, "en", "a", 9), (5, "fine", "en", "a", 9), (6, "fine", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "clean text"), (5, "fine"), (6, "fine")]


def _odd_table(spark, sf_dir):
    """Documents with odd texts, copies, null and repeated ids, labels and sources, and clashing columns."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(900 + i, t, None, None, None) for i, t in enumerate(ODD)]
    rows += [(None, rows[3][1], "en", "src1", 1), (rows[5][0], rows[5][1], "en", "src1", 1), (rows[5][0], rows[6][1] + " password: hunter2secret", None, "src2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"row_key": F.lit(1), "lang_id": F.lit("x"), "class_id": F.lit(2), "secret_spans": F.lit("y"), "sequence_id": F.lit(3)})


def test_all_stages_on_odd_rows(spark, sf_dir):
    docs, seen = _odd_table(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    stages = [name for name, _ in corpus_pipeline.STAGES]
    texts = {a: [r.text for r in seen[a]] for a in stages}

    # Language: what has no words goes; what is labelled and longer than a line stays.
    kept = sorted(texts["near_duplicates"])
    assert not [t for t in kept if not words(t)]
    assert all(r.text in kept for r in seen["languages"] if r.lang and len(r.text) > 60)

    # Near duplicates: one of each class of a plain comparison of all pairs.
    by_class = {}
    for row, c in zip(seen["near_duplicates"], classes(texts["near_duplicates"]), strict=True):
        by_class.setdefault(c, []).append(row)
    left = seen["decontamination"]
    assert len(left) == len(by_class)
    first = [min((r.doc_id is None, r.doc_id or 0) for r in rows) for rows in by_class.values()]
    assert sorted(first) == sorted((r.doc_id is None, r.doc_id or 0) for r in left)

    # Decontamination: rows without a hit of a plain search.
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [r.text for r, found in zip(left, leaks([r.text for r in left], items), strict=True) if not found[1]]
    assert sorted(clean) == sorted(texts["secrets"])

    # Secrets: all rows stay, no assigned secret is left, texts without one are as before.
    assert len(seen["packing"]) == len(seen["secrets"]) and not any("hunter2secret" in r.text for r in seen["packing"])
    plain = [t for t in texts["secrets"] if not re.search("(?i)(password|secret|token|key|passwd)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}", t)]
    assert plain and not [t for t in plain if t not in texts["packing"]]

    # Packing: every id of every row once, in sequences without gaps.
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens): p.doc_tokens for p in pieces}.values())
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert ends.get(p.sequence_id, 0) == p.offset
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048


def test_empty_table_gives_an_empty_result(spark, sf_dir):
    docs = _odd_table(spark, sf_dir).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
    assert docs.count() == 0


def test_only_rows_and_what_is_kept_are_left_on_disk_behind_near_duplicates(spark, sf_dir):
    folder = Path(scratch_dir(spark))
    before = set(folder.iterdir())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    made = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p not in before}
    assert made == {"near-duplicate-rows", "near-duplicate-kept"}
    assert 0 < rows.count() < docs.count()


def test_rows_are_picked_by_bitmap_without_a_shuffle_of_their_own(spark):
    rows = spark.range(0, 100_000, 1, 3).select(F.monotonically_increasing_id().alias("row_key"), F.col("id").alias("n"))
    rows = stored(rows, "bitmap-rows")
    for wanted in (F.col("n") % 7 < 3, F.col("n") == 99_999, F.lit(False)):
        marked = rows.filter(wanted).select("row_key")
        found = marked_rows(rows, marked, "row_key")
        assert [r.n for r in found.orderBy("n").collect()] == [r.n for r in rows.filter(wanted).orderBy("n").collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(row_key" not in plan and "SortMergeJoin" not in plan
