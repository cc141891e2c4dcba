"""License scans by a positional rare-token index.

Templates are short licence notices.  Of each template, the rarest words of its
mandatory key phrase (highest inverse document frequency over the whole corpus)
are indexed with positions.  All of them are looked up in every file; each
posting votes for a template laid at the relative position, and where all rare
words of a template agree it is verified: its key phrase must stand there word
for word, and enough of its words must stand around it in their order, so that
inserted and missing words lose no notice.  The key phrase must stand
anyway, so the index loses no place, however many notices a file holds.  Beside
that, every place of the base phrases is counted exactly.

Defined cases: a null text is an empty one (no words, no labels, score 0);
null identifiers pass through; very long texts are scanned whole; repeated
rows give repeated results; an empty corpus gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import mapped, table

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, notice, key phrase that must stand in it.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "except in compliance with the license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under the creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("reserved", "all rights reserved", "all rights reserved"),
]

#: Bytes of no word become spaces, A-Z become a-z; digits, letters and all bytes of other characters stay.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def room(part: list[bytes]) -> int:
    """In how many words of a file a part of a template may stand: a quarter more than it has, two at least."""
    return len(part) + max(2, len(part) // 4) if part else 0


def in_order(wanted: list[bytes], words: list[bytes]) -> int:
    """How many of the wanted words stand in words in their order: the longest common subsequence."""
    row = [0] * (len(words) + 1)
    for a in wanted:
        corner = 0
        for j, b in enumerate(words):
            above = row[j + 1]
            row[j + 1] = corner + 1 if a == b else max(above, row[j])
            corner = above
    return row[-1]


class Index:
    """Positions of the rarest words of each template's key phrase; rare is how many a template has."""

    def __init__(self, templates, frequency: dict[bytes, int], documents: int, rare: int = 2, least: float = 0.8):
        self.templates = [(label, text.encode().split(), key.encode().split()) for label, text, key in templates]
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) for _, words, _ in self.templates for w in words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.key_at, self.needed, self.least = [], [], least
        for t, (_, words, key) in enumerate(self.templates):
            k = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            chosen = sorted(set(key), key=lambda w: (-self.idf[w], w))[:rare]
            places = [k + p for p, w in enumerate(key) if w in chosen]
            for p in places:
                self.postings.setdefault(words[p], []).append((t, p))
            self.key_at.append(k)
            self.needed.append(len(places))

    def scan(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that stand in the words, and the best agreement."""
        if self.postings.keys().isdisjoint(words):
            return set(), 0.0
        votes: Counter = Counter()
        for i, w in enumerate(words):
            if w in self.postings:
                votes.update((t, i - p) for t, p in self.postings[w])
        labels, best = set(), 0.0
        for (t, at), n in votes.items():
            label, wanted, key = self.templates[t]
            if label in labels and best == 1.0:  # nothing can be added
                continue
            k = at + self.key_at[t]
            if n < self.needed[t] or k < 0 or words[k : k + len(key)] != key:
                continue
            end, left, right = k + len(key), wanted[: self.key_at[t]], wanted[self.key_at[t] + len(key) :]
            agree = (len(key) + in_order(left, words[max(0, k - room(left)) : k]) + in_order(right, words[end : end + room(right)])) / len(wanted)
            if agree >= self.least:
                labels.add(label)
                best = max(best, agree)
        return labels, best


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE.items():
        wanted = b" " + phrase.encode() + b" "
        at, seen, word = joined.find(wanted), 0, 0  # word: how many words start before seen
        while at >= 0:
            word, seen = word + joined.count(b" ", seen, at), at
            out.append((word, label))
            at = joined.find(wanted, at + 1)
    return out


def document_frequency(docs: DataFrame, vocabulary: frozenset) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all of them; as many rows as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = 0, Counter()
        for b in batches:
            for x in b.column(0):
                c.update(vocabulary.intersection(words_of(x.as_py())))
                n += 1
        c[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("binary")).transform(mapped, run, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = {bytes(w): n for w, n in rows}
    return counts, counts.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, rare: int = 2, least: float = 0.8) -> DataFrame:
    """One row of RESULT for every document (doc_id, text)."""
    vocabulary = frozenset(w for _, text, _ in templates for w in text.encode().split())
    index = Index(templates, *document_frequency(docs, vocabulary), rare, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(x.as_py())
                places = base_places(words)
                labels, score = index.scan(words)
                base = {label for _, label in places}
                starts = [p for p, _ in places]
                rows.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).transform(mapped, run, RESULT)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
