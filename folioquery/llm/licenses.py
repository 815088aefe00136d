"""License scans with a positional index of rare words.

Fixed license texts form an index: word -> (template, position). Corpus-wide
document frequencies of the index words are counted first. For each file and each template whose
mandatory phrases all stand in it, that template's words of highest IDF are looked up, as
many as leave too few others to reach the least score without them, so no start that
would verify goes without votes. Every pair of a file position and a
posting votes for a relative position (file start of the template), and a start with
votes of several different rare words is verified: the template's mandatory phrases
must stand in the aligned stretch, and the share of template words found near their
place is the score. If no voted start verifies, the starts within the slack of one are
tried too. Base phrases are searched exactly and their labels stay.

The index holds a few hundred words, whatever the corpus; that is its size bound.

Defined cases: null or empty text has no words, no labels and score 0; repeated rows
keep a row each; ties go to the smallest start; other columns are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import as_bytes
from .words import fold_words

# Exact phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Fixed values: (label, wording, mandatory phrases) of widespread licence notices.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the software", ["permission is hereby granted free of charge"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache license version 2"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at", ["apache license version 2", "in compliance with the license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ["creative commons attribution noncommercial"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license version 3"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation", ["terms of the gnu general public license"]),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
     "the Free Software Foundation", ["gnu lesser general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license v 2"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
]
RARE_WORDS = 12  # words of a template looked up at least, if the file has as many
MIN_VOTES = 2  # different rare words that must agree on a start
SLACK = 3  # words that a place may be off
MIN_SCORE = 0.6

_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("hits", pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("score", pa.float64())]))),
])
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "hits array<struct<label:string,start_word:long,score:double>>"
)


class Index:
    """Postings of all templates, with each word's IDF in the corpus."""

    def __init__(self, frequencies: dict[bytes, int], documents: int, templates=TEMPLATES):
        self.templates = [
            (label, fold_words(text.encode()), [fold_words(p.encode()) for p in phrases]) for label, text, phrases in templates
        ]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            for at, word in enumerate(words):
                self.postings[word].append((t, at))
        self.idf = {w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) for w in self.postings}

    def lookup(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """Verified (label, start word, score), one for each template that is found."""
        joined = b" " + b" ".join(words) + b" "
        wanted = [t for t, (_, _, phrases) in enumerate(self.templates) if all(b" " + b" ".join(p) + b" " in joined for p in phrases)]
        if not wanted:
            return []
        present = set(words) & self.postings.keys()
        places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t in wanted:
            for word in self.rare_words(t, present):
                places[word] += [(t, place) for of, place in self.postings[word] if of == t]
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for at, word in enumerate(words):
            for t, place in places.get(word, ()):
                votes[t, at - place].add(word)
        best = self._best(words, votes, votes)
        missed = set(wanted) - best.keys()
        if missed:
            around = {(t, start + d) for t, start in votes if t in missed for d in range(-SLACK, SLACK + 1)}
            best |= self._best(words, votes, around - votes.keys())
        return [(self.templates[t][0], max(0, start), score) for t, (score, start) in sorted(best.items())]

    def rare_words(self, t: int, present: set[bytes]) -> list[bytes]:
        """A template's present words of highest IDF; a start that scores ``MIN_SCORE`` has ``MIN_VOTES`` of them."""
        counts = Counter(w for w in self.templates[t][1] if w in present)
        order = sorted(counts, key=lambda w: (-self.idf[w], w))
        needed, rest = MIN_SCORE * len(self.templates[t][1]), sum(counts.values())
        for n, word in enumerate(order, 1):
            rest -= counts[word]
            # Places that can be found with fewer than MIN_VOTES of the first n words.
            most = rest + sum(sorted((counts[w] for w in order[:n]), reverse=True)[: MIN_VOTES - 1])
            # Ties at the last place all stay.
            if n >= RARE_WORDS and most < needed and (n == len(order) or self.idf[order[n]] < self.idf[word]):
                return order[:n]
        return order

    def _best(self, words: list[bytes], votes: dict[tuple[int, int], set[bytes]], starts) -> dict[int, tuple[float, int]]:
        """For each template the best (score, start) that verifies."""
        best: dict[int, tuple[float, int]] = {}
        for t, start in starts:
            near = set().union(*(votes.get((t, start + d), ()) for d in range(-SLACK, SLACK + 1)))
            if len(near) >= MIN_VOTES:
                score = self._verify(words, t, start)
                if score >= MIN_SCORE and (t not in best or (-score, start) < (-best[t][0], best[t][1])):
                    best[t] = (score, start)
        return best

    def _verify(self, words: list[bytes], t: int, start: int) -> float:
        _, wanted, phrases = self.templates[t]
        low, high = max(0, start - SLACK), start + len(wanted) + SLACK
        stretch = words[low:high]
        for phrase in phrases:
            if not any(stretch[i : i + len(phrase)] == phrase for i in range(len(stretch) - len(phrase) + 1)):
                return 0.0
        found = 0
        for place, word in enumerate(wanted):
            at = start + place
            found += word in words[max(0, at - SLACK) : max(0, at + SLACK + 1)]
        return found / len(wanted)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) wherever a base phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in BASE_PHRASES.items():
        key = f" {phrase} ".encode()
        at = joined.find(key)
        while at >= 0:
            places.append((joined.count(b" ", 0, at), label))
            at = joined.find(key, at + 1)
    return sorted(places)


def _frequencies(texts: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many texts each index word occurs, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for data in batch.column(1):
                seen.update(vocabulary.intersection(fold_words(data.as_py())))
                n += 1
        words = [*seen, b""]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([*seen.values(), n], pa.int64())], names=["word", "n"]
        )

    rows = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()
    found = {bytes(w): n for w, n in rows}
    return found, found.pop(b"", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base phrase places, labels and score (see the module)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"))
    vocabulary = {w for _, text, _ in TEMPLATES for w in fold_words(text.encode())}
    frequencies, documents = _frequencies(texts, vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequencies, documents)
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = fold_words(data.as_py())
                places = base_places(words)
                hits = index.lookup(words)
                base = sorted({label for _, label in places})
                score = max([0.5 * bool(base), *(s for _, _, s in hits)])
                rows.append({
                    "doc_id": doc, "n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None,
                    "last_word": places[-1][0] if places else None, "base_labels": ",".join(base),
                    "labels": ",".join(sorted({*base, *(label for label, _, _ in hits)})), "score": float(score),
                    "hits": [{"label": a, "start_word": b, "score": float(np.float64(c))} for a, b, c in hits],
                })
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return texts.mapInArrow(scan, SCHEMA)
