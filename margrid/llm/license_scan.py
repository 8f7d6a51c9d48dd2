"""Licence scan by a positional index of rare words.

Licence notices and phrases are templates; the index lists, for the words of each template that are rarest
in the scanned corpus, at which place of which template they stand. A document's rare licence words are
looked up; postings that agree on where a template would begin are intersected by relative position, and
what remains is verified: phrases word by word, notices by their mandatory key phrases.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margrid.llm.common import in_tasks

# Phrases and labels of the base rule.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Key phrases that name a licence on their own, with the method's labels.
PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "bsd 3 clause license": "bsd-3",
    "bsd 2 clause license": "bsd-2",
    "the unlicense": "unlicense",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
# Opening sentences of licence notices, each with its label and mandatory key phrases.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license", ["may not use this file except in compliance"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license", ["you can redistribute it and or modify it", "gnu general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("public-domain", "this is free and unencumbered software released into the public domain",
     ["unencumbered software released into the public domain"]),
]
# Rarest words of a template that are posted, and by how many places a key phrase may be off in a notice.
ANCHORS = 3
SLACK = 4

# ASCII but digits and letters part words; A-Z become a-z.
_TO_WORDS = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def _words(phrase: str) -> tuple[bytes, ...]:
    return tuple(phrase.encode().split())


def vocabulary() -> set[bytes]:
    """All words of all templates; its size hangs on the templates alone."""
    texts = [*BASE, *PHRASES, *(n[1] for n in NOTICES)]
    return {w for t in texts for w in _words(t)}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = vocabulary()
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(known.intersection(words_of(text)))
        counts[b""] = len(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )


class Index:
    """Postings of the rarest words of phrases and notices, under given document frequencies."""

    def __init__(self, frequency: dict[str, int]):
        documents = frequency.get("", 0)
        self.idf = {w: math.log((documents + 1) / (frequency.get(w.decode(), 0) + 1)) for w in vocabulary()}
        notices = [_words(text) for _, text, _ in NOTICES]
        keys = [_words(k) for _, _, ks in NOTICES for k in ks]
        self.phrases = sorted({*map(_words, BASE), *map(_words, PHRASES), *keys})
        self.templates = [*self.phrases, *notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, words in enumerate(self.templates):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[:ANCHORS]
            self.needed.append(len(rare))
            for place, w in enumerate(words):
                # of a word that stands in a template twice, the first place is posted
                if w in rare and words.index(w) == place:
                    self.postings[w].append((t, place))
        self.base = {self.phrases.index(_words(p)): label for p, label in BASE.items()}
        self.named = {self.phrases.index(_words(p)): label for p, label in PHRASES.items()}
        self.notices = [
            (len(self.phrases) + i, label, [self.phrases.index(_words(k)) for k in ks])
            for i, (label, _, ks) in enumerate(NOTICES)
        ]
        self.rare = set(self.postings)

    def _coverage(self, words: list[bytes], template: tuple[bytes, ...], begin: int) -> float:
        total = sum(self.idf[w] + 1e-9 for w in template)
        met = sum(
            self.idf[w] + 1e-9 for i, w in enumerate(template) if 0 <= begin + i < len(words) and words[begin + i] == w
        )
        return met / total

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        if self.rare.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for at, w in enumerate(words):
            if w in self.rare:
                for t, place in self.postings[w]:
                    votes[t, at - place] += 1
        found: dict[int, list[int]] = defaultdict(list)  # places of whole phrases
        agreed: dict[int, list[int]] = defaultdict(list)  # likely places of notices
        for (t, begin), n in votes.items():
            template = self.templates[t]
            if t < len(self.phrases):
                if n == self.needed[t] and begin >= 0 and tuple(words[begin:begin + len(template)]) == template:
                    found[t].append(begin)
            elif n >= 2:
                agreed[t].append(begin)
        base = {label for t, label in self.base.items() if t in found}
        labels = base | {label for t, label in self.named.items() if t in found}
        best = 0.0
        for t, label, keys in self.notices:
            template = self.templates[t]
            for begin in agreed.get(t, ()):
                lo, hi = begin - SLACK, begin + len(template) + SLACK
                if all(any(lo <= p < hi for p in found.get(k, ())) for k in keys):
                    labels.add(label)
                    best = max(best, self._coverage(words, template, begin))
        starts = [p for t in self.base if t in found for p in found[t]]
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), (0.5 + 0.5 * best) if labels else 0.0,
        )


def _scan(frequency: dict[str, int]):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency)
        for batch in batches:
            found = [index.scan(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=schema)

    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Whole texts are read; words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. The only
    table that leaves the corpus is the document frequency of each template word. Null and empty texts have
    no words, no labels (empty strings), score 0 and null places; repeated rows are scanned each. The score
    is 0 without a label, else a half, and up to 1 by how much of a notice stands in place.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = in_tasks(rows.select("text"), _frequencies, "word string, n long")
    frequency = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return in_tasks(rows, _scan(frequency), OUT)
