import numpy as np
from pyspark.sql import functions as F

from folioquery.llm import languages
from folioquery.llm.languages import RESULTS, fit_trigrams, identify_languages, markup_language, visible_text

from .cases import ODD, documents


def test_held_out_accuracy_by_text_and_by_all_evidence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    langs, model = fit_trigrams(docs.filter(~fold))
    held = docs.filter(fold & (F.length("text") > 60))
    rows = identify_languages(held, langs, model, text_col="text", declared=F.lit(None), host=F.col("source")).collect()
    assert len(rows) > 20 and np.mean([r.lang_by_text == r.lang for r in rows]) > 0.9
    rows = identify_languages(held, langs, model, text_col="text", declared=F.col("lang"), host=F.col("source")).collect()
    assert np.mean([r.lang_id == r.lang for r in rows]) > 0.95 and all(r.lang_accepted for r in rows)


def test_posterior_equals_a_plain_computation(spark):
    texts = ["aaa bbb", "aaa aaa bbb", "ccc ddd", "ccc ccc", "aaa ccc", ""]
    docs = documents(spark, texts, langs=("x", "x", "y", "y", "x", "y"), sources=("h.d.com", "h.d.com", "g.d.com", "k.e.org"))
    langs, model = fit_trigrams(docs)
    got = identify_languages(docs, langs, model, text_col="text", declared=F.col("lang"), host=F.col("source")).orderBy("doc_id").collect()
    assert langs == ["x", "y"]
    from folioquery.llm.languages import ALPHA, BACKGROUND, BUCKETS, FULL_WEIGHT, trigram_buckets

    base = docs.orderBy("doc_id").collect()
    m = model.astype(np.float32)
    lls, others = [], []
    for r in base:
        t = trigram_buckets(r.text.encode())
        ll = m[t].sum(axis=0, dtype=np.float64) / (1 + len(t) / FULL_WEIGHT)
        lls.append(ll - ll.max())
        others.append(-len(t) * np.log(BUCKETS) / (1 + len(t) / FULL_WEIGHT) - ll.max() + np.log(BACKGROUND))
    soft = [np.exp(ll) / np.exp(ll).sum() * (r.text != "") for ll, r in zip(lls, base)]
    total = sum(soft)
    prior = (total + 1) / (total.sum() + 2)
    tld = lambda r: r.source.split(".")[-1]
    domain = lambda r: r.source.split(".", 1)[1]
    for i, r in enumerate(base):
        counts = lambda f: sum((s for s, o in zip(soft, base) if f(o) == f(r)), np.zeros(2))  # noqa: E731, B023
        level = lambda c, p: (np.maximum(c - soft[i], 0) + ALPHA * p) / (np.maximum(c - soft[i], 0).sum() + ALPHA)  # noqa: E731, B023
        p = level(counts(lambda o: o.source), level(counts(domain), prior))
        logs = lls[i] + np.log(p) + np.log((counts(lambda o: o.lang) + 0.5) / (total + 1)) + np.log((counts(tld) + 0.5) / (total + 1))
        logs = np.append(logs, others[i])
        post = (np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum())[:2]
        assert abs(got[i].lang_probability - post.max()) < 1e-6 and got[i].lang_id == langs[int(post.argmax())]
        assert got[i].lang_accepted == (r.text != "" and post.max() >= 0.5)


def test_text_of_no_labelled_language_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang in ('en', 'fr')")
    langs, model = fit_trigrams(docs)
    odd = [
        "Настоящее руководство предназначено для владельцев и работников мастерских", "zzzz qqqq xkxk wvwv jjqz zxqj", "0193 8821 7713 5501 9982 1234 8871",
        "これは別の言語で書かれた文章です。次の文もそうです。",
    ]
    rows = documents(spark, odd, langs=(None,)).unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = identify_languages(rows, langs, model, text_col="text", declared=F.col("lang"), host=F.col("source")).collect()
    assert sorted(r.text for r in got if not r.lang_accepted and r.text in odd) == sorted(odd)
    clean = [r for r in got if r.lang]
    assert all(r.lang_accepted and r.lang_id == r.lang for r in clean if len(r.text) > 60) and np.mean([r.lang_accepted for r in clean]) > 0.99


def test_odd_rows_markup_and_empty_tables(spark):
    docs = documents(spark, ODD, langs=("de", None, "EN-us"), sources=(None, "", "x"))
    langs, model = fit_trigrams(docs)
    clash = docs.withColumn("lang_id", F.lit(1)).withColumn("lang_host", F.lit("x")).withColumn("n", F.lit(2))
    found = identify_languages(clash, langs, model, text_col="text", declared=F.col("lang"), host=F.col("source"))
    assert sorted(found.columns) == sorted({*docs.columns, "n", *RESULTS})
    rows = found.collect()
    assert len(rows) == len(ODD) and not any(r.lang_accepted for r in rows if not (r.text or "").strip(" \n\t!-?\x00\x1f\x7f"))
    assert {r.lang_declared for r in rows} == {"de", "en", None}
    none, empty = fit_trigrams(docs.limit(0))
    rows = identify_languages(docs, none, empty, text_col="text", declared=F.lit("de"), host=F.col("source")).collect()
    assert none == [] and not any(r.lang_accepted for r in rows)
    assert identify_languages(docs.limit(0), langs, model, text_col="text", declared=F.lit("de"), host=F.col("source")).count() == 0
    html = "<!DOCTYPE html><HTML class=a lang='fr-CA'><script>var a='</p>';</script><!-- x --><p>d&eacute;j&agrave;</p></html>"
    assert spark.range(1).select(markup_language(F.lit(html)).alias("m")).first().m == "fr-CA"
    assert visible_text(html.encode()).split() == ["déjà".encode()]


def test_texts_stay_where_they_are_for_any_number_of_hosts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    langs, model = languages.fit_trigrams(docs)

    def found():
        return languages.identify_languages(docs, langs, model, text_col="text", declared=F.col("lang"), host=F.col("source"))

    few = found()
    assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(languages, "FEW_COUNTS", 0)
    many = found()
    assert many.columns == few.columns and "_lang_row" in many._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.doc_id, r.text, r.lang_id, r.lang_accepted, round(r.lang_probability, 9)) for r in df.collect())
    assert rows(few) == rows(many) and len(rows(few)) == docs.count()
