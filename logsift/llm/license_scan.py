"""Licence notices found through a positional index of the templates' words.

Each word of a template has postings: the template, and the word's place in it. For every file and every template whose
mandatory words it holds, the file's words of the highest inverse document frequency are looked up first;
their postings meet by relative position, rarest first, until only the places are left where all words
of a phrase stand as they do in the template. Windows around them that hold all mandatory phrases are
compared with the whole template, words put in or left out being allowed for by a share of its length.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.common import PIECE_BYTES, SPACE, small_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and labels of the contract.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Customary notices and the phrases without which they are not that licence.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license you may obtain a copy of the license at",
        ("apache license",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions"),
    ),
    "cc-by-4.0": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license", "version 3"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or "
        "without fee is hereby granted",
        ("with or without fee",),
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
        ("free of charge", "without restriction"),
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
}
# The share of a template's words that must stand in their order, in a window that is longer than the
# template by the same share at most.
SHARE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]

    @property
    def window(self) -> int:
        """How many words of a file a notice may be spread over."""
        return math.ceil(len(self.words) / SHARE)

    @property
    def least(self) -> int:
        """How many of its words must stand in order."""
        return math.ceil(SHARE * len(self.words) - 1e-9)


def _split(text: str) -> tuple[bytes, ...]:
    return tuple(WORD.findall(text.encode().lower()))


def templates() -> list[Template]:
    return [
        Template(label, _split(text), tuple(_split(p) for p in phrases))
        for label, (text, phrases) in TEMPLATES.items()
    ]


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and for each word of the templates how many hold it.

    The words are those of the templates, some two hundred, whatever the corpus.
    """
    small_batches(docs.sparkSession)
    wanted = {w for t in templates() for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = defaultdict(int)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                data = (text.as_py() or "").encode().lower()
                for word in wanted.intersection(WORD.findall(data)):
                    found[word] += 1
        words = [None, *(w.decode() for w in found)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([n, *found.values()], pa.int64())], ["word", "docs"]
        )

    parts = docs.select(text_column).mapInArrow(run, "word string, docs bigint")
    rows = parts.groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    by_word = {r["word"]: r["docs"] for r in rows}
    total = by_word.pop(None, 0)
    return total, {w.encode(): n for w, n in by_word.items()}


class Index:
    """Postings (template, places) of the templates' words, with their rarity, and the base phrases."""

    def __init__(self, docs: int, frequency: dict[bytes, int]):
        self.templates = templates()
        self.base = [(_split(phrase), label) for phrase, label in BASE.items()]
        # by word and template: its places in the template
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, template in enumerate(self.templates):
            for place, word in enumerate(template.words):
                self.postings[word][t].append(place)
        self.idf = {w: math.log((docs + 1) / (frequency.get(w, 0) + 1)) for w in self.postings}
        self.mandatory = [frozenset(w for p in t.phrases for w in p) for t in self.templates]
        # a bit for each place of a word, for comparing windows
        self.bits = [
            {w: sum(1 << i for i in self.postings[w][t]) for w in template.words}
            for t, template in enumerate(self.templates)
        ]
        self.starts = {words[0] for words, _ in self.base}
        self.words = self.starts.union(*self.mandatory)
        self.reach = max(t.window for t in self.templates)

    def scan(self, words: list[bytes], final: bool, seen: int) -> tuple[list, list]:
        """Base phrases (start, label) and templates (label, share) of a piece of a document.

        Of a piece that is not the last, starts in its last reach words are left for the next one;
        seen is how many words at its beginning have been looked at as starts before.
        """
        if self.words.isdisjoint(words):
            return [], []
        last = len(words) if final else len(words) - self.reach
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in self.words:
                places[word].append(at)
        base = []
        for phrase, label in self.base:
            for at in places.get(phrase[0], ()):
                if seen <= at < last and tuple(words[at : at + len(phrase)]) == phrase:
                    base.append((at, label))
        matches = []
        for t, template in enumerate(self.templates):
            if self.mandatory[t] <= places.keys():
                share = self._best(t, words, places, seen, last)
                if share:
                    matches.append((template.label, share))
        return base, matches

    def _phrase_places(self, t: int, phrase: tuple[bytes, ...], places: dict[bytes, list[int]]) -> list[int]:
        """Where the phrase stands in the file: the postings of its words, rarest first, by relative position."""
        starts: set[int] | None = None
        for word in sorted(set(phrase), key=lambda w: (-self.idf[w], len(places[w]), w)):
            inner = [i for i, w in enumerate(phrase) if w == word]
            for i in inner:
                here = {at - i for at in places[word]}
                starts = here if starts is None else starts & here
            if not starts:
                return []
        return sorted(at for at in starts if at >= 0)

    def _best(self, t: int, words: list[bytes], places: dict[bytes, list[int]], seen: int, last: int) -> float:
        """The largest share of a template in a window that holds its phrases; 0 below SHARE."""
        template = self.templates[t]
        found = []
        for phrase in sorted(template.phrases, key=lambda p: -max(self.idf[w] for w in p)):
            at = self._phrase_places(t, phrase, places)
            if not at:
                return 0.0
            found.append((at, len(phrase)))
        size, best = template.window, 0
        done = seen
        for at in found[0][0]:
            # windows with this occurrence in them that have not been looked at
            for start in range(max(done, at + found[0][1] - size), min(at, last - 1) + 1):
                inside = all(
                    i < len(where) and where[i] + length <= start + size
                    for where, length in found
                    for i in [bisect.bisect_left(where, start)]
                )
                if inside:
                    best = max(best, _in_order(self.bits[t], len(template.words), words[start : start + size]))
                    if best == len(template.words):
                        return 1.0
            done = max(done, min(at, last - 1) + 1)
        return best / len(template.words) if best >= template.least else 0.0


def _in_order(bits: dict[bytes, int], size: int, window: list[bytes]) -> int:
    """How many of a template's words stand in a window in their order, at most: the longest common
    subsequence, a row of its table being the bits of one number."""
    row = every = (1 << size) - 1
    for word in window:
        own = row & bits.get(word, 0)
        row = (row + own | row - own) & every
    return size - row.bit_count()


def _pieces(data: bytes) -> Iterator[tuple[list[bytes], bool]]:
    at = 0
    while True:
        cut = SPACE.search(data, at + PIECE_BYTES) if len(data) - at > PIECE_BYTES else None
        end = cut.end() if cut else len(data)
        yield WORD.findall(data, at, end), end == len(data)
        if end == len(data):
            return
        at = end


def scan_text(index: Index, text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score) of a whole text."""
    total, base, matches = 0, [], []
    buffer: list[bytes] = []
    looked = 0  # words of the buffer that were starts before
    for words, final in _pieces((text or "").encode().lower()):
        offset = total - len(buffer)
        total += len(words)
        buffer = buffer + words if buffer else words
        found, labels = index.scan(buffer, final, looked)
        base += [(offset + at, label) for at, label in found]
        matches += labels
        if not final:
            last = max(looked, len(buffer) - index.reach)
            buffer, looked = buffer[last:], 0
    base_labels = {label for _, label in base}
    return (
        total,
        len(base),
        min((at for at, _ in base), default=None),
        max((at for at, _ in base), default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {label for label, _ in matches})),
        max((share for _, share in matches), default=0.0),
    )


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Labels are strings joined by commas, empty if there are none; the places are null then. The
    score is the share of the best verified template's words that stand in place, 0 without one.
    A null text counts as empty. Rows repeat as they do in docs, other columns don't matter.
    """
    index = Index(*document_frequencies(docs, text_column))
    slim = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    schema = T.StructType(
        [slim.schema["doc"]]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
        + [T.StructField("score", T.DoubleType())]
    )
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(index, text.as_py()) for text in batch.column("text")]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc")] + [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                schema.names,
            )

    return slim.mapInArrow(run, schema)
