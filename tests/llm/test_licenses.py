import random

from pyspark.sql import functions as F

from folioquery.llm.licenses import BASE_PHRASES, MIN_SCORE, TEMPLATES, Index, scan_licenses

from .cases import ODD, documents, words


def brute(text):
    w = words(text)
    out = []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


def test_base_places_match_brute_force(spark, sf_dir):
    texts = [*ODD, "CC-BY-NC cc by nc by nc", "x under the MIT license under the mit license.", "Apache License, Version 2.0 and apache license version 20"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want, row = brute(text), got[i]
        labels = sorted({label for _, label in want})
        assert (row.n_words, row.n_base, row.base_labels) == (len(words(text)), len(want), ",".join(labels))
        assert (row.first_word, row.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert set(labels) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_every_template_is_found_anywhere_and_nowhere_else(spark):
    filler = " ".join(f"word{i} the of software" for i in range(300))
    texts = [f"{filler} {text} {filler}" for _, text, _ in TEMPLATES] + [filler, "free license of the software foundation", *ODD]
    rows = {r.doc_id: r for r in scan_licenses(documents(spark, texts)).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        hit = [h for h in rows[i].hits if h.label == label]
        assert hit and max(h.score for h in hit) > 0.9 and any(abs(h.start_word - 1200) <= 3 for h in hit)
    assert all(rows[i].labels == "" and rows[i].score == 0 for i in range(len(TEMPLATES), len(texts)))


def test_edited_notice_is_found_and_key_phrase_is_needed():
    index = Index({}, 10)
    notice = "redistribution and use in source and binary forms with or without any modification are permitted if the following conditions are met"
    assert [label for label, _, _ in index.lookup([w.encode() for w in notice.split()])] == ["bsd"]
    assert index.lookup([w.encode() for w in notice.replace("source and binary", "binary or source").split()]) == []


def test_file_with_all_templates_has_all_labels():
    # Frequencies as in a corpus where the words of short notices are common and the others unseen.
    common = {w.encode(): 80 for w in "licensed under the license version of this work gnu general public mit apache cc by nc 2 3 4 0 released".split()}
    index = Index(common, 10_000)
    both = f"{TEMPLATES[10][1]} {TEMPLATES[12][1]} {TEMPLATES[7][1]}"
    assert {label for label, _, _ in index.lookup([w.encode() for w in words(both)])} == {"bsd", "isc", "gpl-3"}
    every = "\n".join(text for _, text, _ in TEMPLATES)
    found = index.lookup([w.encode() for w in words(every)])
    assert [label for label, _, _ in found] == [label for label, _, _ in TEMPLATES]
    assert all(score == 1.0 for _, _, score in found)


def test_lookup_finds_what_every_start_would():
    rng = random.Random(5)
    index = Index({w: rng.randrange(50) for w in Index({}, 1).postings}, 60)
    vocabulary = sorted(index.postings)
    for _ in range(60):
        text = []
        for t in rng.sample(range(len(TEMPLATES)), 3):
            for word in index.templates[t][1]:
                text += rng.choices(vocabulary, k=rng.choice([0, 0, 0, 0, 1, 2]))
                text += [word] if rng.random() < 0.85 else []
        hits = index.lookup(text)
        for t, (label, wanted, _) in enumerate(index.templates):
            best = max(index._verify(text, t, start) for start in range(-len(wanted), len(text) + 1))
            assert best < MIN_SCORE or label in {a for a, _, _ in hits}, (label, best)


def test_empty_table_and_clashing_columns(spark):
    df = documents(spark, ["Released under the MIT License."]).withColumn("labels", F.lit("x")).withColumn("score", F.lit(9))
    row = scan_licenses(df).first()
    assert row.labels == "mit" and row.score == 1.0
    assert scan_licenses(df.limit(0)).count() == 0
