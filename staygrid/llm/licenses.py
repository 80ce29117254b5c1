"""License notices by an exact set-similarity join of text blocks and templates.

A block is a window of words; windows are twice as long as the longest template and start
every half window, so a notice lies whole in one of them. A template matches a block if
the block contains at least the threshold's share of its different words. Words are put
in one global order, rarest first by the number of documents that have them. The join
then needs to look only at the first words of a template (prefix filter), only at blocks
with enough words of the templates (length filter), and only goes on while the words left
after the match can still reach the overlap (positional filter). Nothing is missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.frames import batch_of, id_and_text, map_batches

# Fixed values of the contract: base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(65, 91)}

# Sentences of public license notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)
CONTAINMENT = 0.8
# Words that tell templates apart which are otherwise nearly alike: a template with such a
# word matches only blocks that have it, and a template without it not those that do.
TELLING = {
    "mit": frozenset({"mit"}), "gpl": frozenset(), "agpl": frozenset({"affero"}), "lgpl": frozenset({"lesser"}),
    "cc-by": frozenset(), "cc-by-sa": frozenset({"sharealike"}), "apache": frozenset({"apache"}),
}
ALIKE = (frozenset({"gpl", "agpl", "lgpl"}), frozenset({"cc-by", "cc-by-sa"}))
# Templates travel to every task, so their number and length are bounded.
MOST_TEMPLATES, MOST_WORDS = 1000, 256

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, blocks array<struct<label:string,start:long,stop:long,containment:double>>"
)


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    # A phrase counts only where its words stand one after another.
    phrase: bool


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(UPPER_TO_LOWER) if not text.isascii() else text.lower())


def templates_from(notices: Sequence[tuple[str, str]], phrases: dict[str, str]) -> list[Template]:
    found = [Template(label, tuple(words_of(text)), False) for label, text in notices]
    found += [Template(label, tuple(words_of(text)), True) for text, label in phrases.items()]
    found = [t for t in found if t.words]
    if len(found) > MOST_TEMPLATES or any(len(t.words) > MOST_WORDS for t in found):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of at most {MOST_WORDS} words")
    return found


def document_counts(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """In how many documents each word of the templates occurs: one row per word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in batch["text"].to_pylist():
                for word in vocabulary.intersection(words_of(text)):
                    total[word] = total.get(word, 0) + 1
        yield batch_of(word=pa.array(list(total), pa.string()), n=pa.array(list(total.values()), pa.int64()))

    counts = map_batches(docs.select("text"), counted, "word string, n long")
    return {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def told_apart(template: Template) -> tuple[frozenset, frozenset]:
    """Words a block must have, and must not have, for the template's label."""
    own = TELLING.get(template.label, frozenset())
    others = [TELLING[x] for kin in ALIKE if template.label in kin for x in kin - {template.label}]
    return own.intersection(template.words), frozenset().union(*others) - own


class Index:
    """Templates by the words of their prefixes, in the global order."""

    def __init__(self, templates: Sequence[Template], counts: dict[str, int], containment: float):
        vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.templates = templates
        self.sets = [sorted({self.rank[w] for w in t.words}) for t in templates]
        self.need = [
            len(s) if t.phrase else max(1, math.ceil(containment * len(s) - 1e-9))
            for t, s in zip(templates, self.sets, strict=True)
        ]
        self.told = [told_apart(t) for t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for k, (ranks, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.postings.setdefault(rank, []).append((k, place))
        self.prefix_words = {vocabulary[r] for r in self.postings}
        longest = max((len(t.words) for t in templates), default=1)
        self.step, self.window = longest, 2 * longest

    def matches(self, ranks: list[int]) -> list[tuple[int, float]]:
        """(template, containment) for a block with these ranks (distinct, ascending)."""
        seen: set[int] = set()
        out = []
        own = set(ranks)
        for place, rank in enumerate(ranks):
            for k, at in self.postings.get(rank, ()):
                if k in seen:
                    continue
                need, size = self.need[k], len(self.sets[k])
                if len(ranks) < need:  # length filter
                    continue
                # What may still match: the shorter rest behind this first shared word.
                if 1 + min(size - at - 1, len(ranks) - place - 1) < need:
                    continue
                seen.add(k)
                shared = sum(r in own for r in self.sets[k])
                if shared >= need:
                    out.append((k, shared / size))
        return out


def places_of(phrase: tuple[str, ...], words: list[str], start: int, stop: int) -> list[int]:
    """Starts of the phrase in ``words[start:stop]``, words one after another."""
    found, n, at = [], len(phrase), start
    while True:
        try:
            at = words.index(phrase[0], at, stop)
        except ValueError:
            return found
        if at + n <= stop and tuple(words[at : at + n]) == phrase:
            found.append(at)
        at += 1


def scan_text(text: str, index: Index) -> dict:
    words = words_of(text)
    places: set[tuple[int, int]] = set()
    blocks: list[dict] = []
    best = 0.0
    # Only blocks with a word of some prefix can match.
    if not index.prefix_words.isdisjoint(words):
        hits = [k for k, w in enumerate(words) if w in index.prefix_words]
        starts = sorted({b for k in hits for b in (k // index.step - 1, k // index.step) if b >= 0})
        for start in (b * index.step for b in starts):
            stop = min(start + index.window, len(words))
            ranks = sorted({index.rank[w] for w in words[start:stop] if w in index.rank})
            for k, containment in index.matches(ranks):
                template = index.templates[k]
                if template.phrase:
                    found = places_of(template.words, words, start, stop)
                    places.update((k, p) for p in found)
                    containment = 1.0 if found else 0.0
                else:
                    having, lacking = index.told[k]
                    own = words[start:stop]
                    if not having.issubset(own) or not lacking.isdisjoint(own):
                        continue
                    blocks.append({"label": template.label, "start": start, "stop": stop, "containment": containment})
                best = max(best, containment)
    base = {index.templates[k].label for k, _ in places}
    at = [p for _, p in places]
    return {
        "n_words": len(words), "n_base": len(places),
        "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {b["label"] for b in blocks})),
        "score": best, "blocks": blocks,
    }


def scan(
    docs: DataFrame,
    notices: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = BASE,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Per row: base phrases with their places, labels, score, and all matching blocks.

    ``labels`` has the base labels and those of every template of which some block
    contains at least ``containment`` of the different words, and that its telling words
    do not rule out; ``score`` is the largest containment among the matches (1 for a
    phrase), 0 without one. Every match counts, also of equal containment; a very long
    text is searched in blocks. No labels is the
    empty string. Null and empty texts have no words; repeated rows are kept, a null
    doc_id stays null, no rows give no rows, other columns of ``docs`` are not read.
    Two passes over the text: word counts over all documents (one row per template word
    comes to the driver), then the join, for which the bounded template index goes to
    the tasks and nothing is shuffled.
    """
    templates = templates_from(notices, phrases)
    rows = id_and_text(docs)
    counts = document_counts(rows, {w for t in templates for w in t.words})
    index = Index(templates, counts, containment)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
            "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
            "blocks": pa.list_(pa.struct([
                ("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64()),
            ])),
        }
        for batch in batches:
            found = [scan_text(t, index) for t in batch["text"].to_pylist()]
            yield batch_of(
                doc_id=batch["doc_id"],
                **{name: pa.array([f[name] for f in found], kind) for name, kind in kinds.items()},
            )

    return map_batches(rows, scanned, RESULT)
