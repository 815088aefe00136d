"""A small documents fixture with nulls, empty, short, repeated and very long rows."""

import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, texts, langs=("en",), sources=("a", "b")):
    rows = [
        (i, t, langs[i % len(langs)], sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, COLUMNS)


ODD = [None, "", " \n\t", "!!! --- ???", "one", "Zwölf Boxkämpfer jagen", "\x00\x1f x\x7f", "a" * 5000, "ab " * 40000, "same text here now", "same text here now"]
