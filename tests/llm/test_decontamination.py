import hashlib

from pyspark.sql import functions as F

from folioquery.llm import decontamination
from folioquery.llm.decontamination import find_contamination, merge

from .cases import ODD, documents, words


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w:
            for k in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= own
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_matches_brute_force_in_one_or_many_automata(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bench += [(900, "one"), (901, None), (902, "..."), (903, "same text HERE"), (904, "here now"), (905, "zwölf boxkämpfer"), (906, "ab ab ab ab ab ab ab ab ab ab ab")]
    texts = [*ODD, *(r.text for r in base.collect())]
    texts += ["x " + bench[0][1].upper() + " y", " ".join(words(bench[1][1])[:12]), " ".join(words(bench[1][1])[:9])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = list(brute(texts, bench))
    for block_bytes in (64 << 20, 1500):
        got = find_contamination(documents(spark, texts), items, block_bytes=block_bytes).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got] == want
        for r in got:
            data = (texts[r.doc_id] or "").encode()
            for s in r.spans:
                inside = words(data[s.start_byte : s.end_byte].decode())
                assert inside == words(texts[r.doc_id])[s.first_word : s.last_word + 1]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "b c d", 7), (1, "b c d", 7), (None, "b", 7)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(1, "c d"), (None, "b c")], "item_id long, text string").withColumn("data", F.lit(0))
    got = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in find_contamination(docs, items).collect())
    assert got == [(0, 0, 0), (1, 3, 2), (1, 3, 2)]
    assert find_contamination(docs.limit(0), items).count() == 0
    assert [r.contaminated for r in find_contamination(docs, items.limit(0)).collect()] == [False] * 3
    assert merge([(5, 6), (0, 2), (3, 4), (9, 9)]) == [(0, 6), (9, 9)]


def test_rows_without_an_id_or_with_one_id_stay_apart_in_many_blocks(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("i1", item), ("i2", "a b c d e f g h i j k")], "item_id string, text string")
    texts = [(None, f"x {item}"), (None, "clean text"), (None, "a b c d e f g h i j k"), (7, item), (7, item), (7, "other")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda **kw: sorted(map(repr, find_contamination(docs, items, **kw).collect()))
    assert len(rows()) == len(texts) and rows(block_bytes=20) == rows()


def test_clean_rows_stay_as_they_came_and_are_not_moved_or_written(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = {r.doc_id for r in find_contamination(docs, items).filter("not contaminated").collect()}
    assert 0 < len(want) < docs.count()
    for bytes_ in (64 << 20, 4000):  # one automaton, several
        kept = decontamination.without_contaminated(docs, items, block_bytes=bytes_)
        assert kept.schema == docs.schema and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in docs.collect() if r.doc_id in want)
