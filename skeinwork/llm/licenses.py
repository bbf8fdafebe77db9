"""License scan with a positional rare-token index.

Every template has mandatory key phrases. The index holds, for the word of each key phrase with the highest inverse
document frequency over the templates, its postings: template, phrase and position. A file looks up those of its words
that are in the index; each posting tells where the template would start. The starts that the phrases of a template tell
are intersected: a candidate is a start that every phrase has a posting for, ``SLACK`` words off at most. It counts if the
key phrases do stand at those places and enough of the template's words stand near theirs.

A phrase that must stand as it is is a template of one key phrase, so its places come from the same index.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skeinwork.llm.common import add_by_text, alnum_words

# Phrases whose every place counts, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Fixed values: (label, template, key phrases).
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        ("licensed under the apache license version 2 0", "except in compliance with the license"),
    ),
    ("apache", "Licensed under the Apache License, Version 2.0", ("licensed under the apache license version 2 0",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
        ("this program is free software", "under the terms of the gnu general public license"),
    ),
    ("gpl", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "lgpl",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ("gnu lesser general public license",),
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("subject to the terms of the mozilla public license",),
    ),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("mit", "Released under the MIT License", ("released under the mit license",)),
    ("all-rights-reserved", "All rights reserved.", ("all rights reserved",)),
)

#: Words by which a phrase may stand off its place in the template: names and years come between.
SLACK = 8
LEAST_SCORE = 0.6


@dataclass(frozen=True)
class Phrase:
    words: tuple[bytes, ...]
    start: int
    anchor: int


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[Phrase, ...]
    base: bool


class Index:
    """Postings of the rarest word of every key phrase."""

    def __init__(self, base=BASE, templates=TEMPLATES) -> None:
        texts = [(label, phrase, (phrase,), True) for phrase, label in base] + [(a, b, c, False) for a, b, c in templates]
        words = [tuple(alnum_words(t.encode())) for _, t, _, _ in texts]
        n_docs = Counter(w for ws in words for w in set(ws))
        idf = {w: math.log(len(texts) / n) for w, n in n_docs.items()}
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.templates: list[Template] = []
        for k, ((label, _, phrases, is_base), ws) in enumerate(zip(texts, words, strict=True)):
            placed = []
            for j, text in enumerate(phrases):
                parts = tuple(alnum_words(text.encode()))
                at = [i for i in range(len(ws) - len(parts) + 1) if ws[i : i + len(parts)] == parts]
                if not at:
                    raise ValueError(f"{label}: the key phrase {text!r} is not in its template")
                anchor = max(range(len(parts)), key=lambda i, parts=parts: (idf[parts[i]], -i))
                placed.append(Phrase(parts, at[0], anchor))
                self.postings[parts[anchor]].append((k, j, at[0] + anchor))
            self.templates.append(Template(label, ws, tuple(placed), is_base))
        self.postings = dict(self.postings)
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places (first word, label) of the base phrases, and the best score of each label found."""
        if self.rare.isdisjoint(words):
            return [], {}
        rare, votes = self.rare, defaultdict(list)
        for i, w in enumerate(words):
            if w in rare:
                for k, j, at in self.postings[w]:
                    votes[k, j].append(i - at)
        places: list[tuple[int, str]] = []
        best: dict[str, float] = {}
        for k, t in enumerate(self.templates):
            told = [votes.get((k, j), []) for j in range(len(t.phrases))]
            starts = self._candidates(told)
            if not starts:
                continue
            firm = [[x for x in own if _stands(words, p, x)] for own, p in zip(told, t.phrases, strict=True)]
            if t.base:
                places += [(x, t.label) for x in firm[0]]
                best |= {t.label: 1.0} if firm[0] else {}
            elif all(firm):
                scores = [self._score(t, words, x) for x in starts if all(_near(own, x) for own in firm)]
                if scores and max(scores) >= LEAST_SCORE:
                    best[t.label] = max(best.get(t.label, 0.0), *scores)
        return places, best

    def _candidates(self, starts: list[list[int]]) -> list[int]:
        """The starts that a phrase tells and every other phrase has a posting near; each list is in order."""
        if len(starts) == 1:
            return starts[0]
        if not all(starts):
            return []
        found = [x for own in starts for x in own if all(_near(other, x) for other in starts if other is not own)]
        return sorted(set(found))

    def _score(self, t: Template, words: list[bytes], start: int) -> float:
        """Share of the template's words found near their places."""
        near: dict[bytes, list[int]] = defaultdict(list)
        for i in range(max(0, start - SLACK), min(len(words), start + len(t.words) + SLACK)):
            near[words[i]].append(i - start)
        hit = sum(any(abs(at - i) <= SLACK for at in near.get(w, ())) for i, w in enumerate(t.words))
        return hit / len(t.words)


def _near(starts: list[int], x: int) -> list[int]:
    """Those of the sorted starts that are ``SLACK`` words from ``x`` at most."""
    return starts[bisect_left(starts, x - SLACK) : bisect_right(starts, x + SLACK)]


def _stands(words: list[bytes], p: Phrase, start: int) -> bool:
    """Whether the phrase stands where a template that starts at ``start`` has it."""
    at = start + p.start
    return at >= 0 and tuple(words[at : at + len(p.words)]) == p.words


_FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_base", T.LongType(), False),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType(), False),
    T.StructField("labels", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
]


@lru_cache(maxsize=4)
def _index(base: tuple, templates: tuple) -> Index:
    return Index(base, templates)


def _factory(base: tuple, templates: tuple) -> Callable:
    index = _index(base, templates)

    def compute(texts: list[bytes | None]) -> list[list]:
        rows = []
        for raw in texts:
            words = alnum_words(raw or b"")
            places, best = index.scan(words)
            at = [p for p, _ in places]
            plain = sorted({label for _, label in places})
            score = max(best.values(), default=0.0)
            rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(plain), ",".join(sorted({*plain, *best})), score))
        return list(map(list, zip(*rows, strict=True)))

    return compute


def scan_licenses(df: DataFrame, text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their smallest and largest
    start, null without one), ``base_labels``, ``labels`` (with those of templates; distinct, sorted, comma-joined) and
    ``score`` (1 for a base phrase, else the best template's share of words in place, 0 without one); no shuffle.

    A null or empty text has no words and no labels. Texts are scanned whole. Repeated rows get equal results; input
    columns with the name of a new one are replaced. ``keep``: the input columns to return besides (all by default).
    """
    return add_by_text(df, text_col, partial(_factory, base, templates), _FIELDS, keep=keep)
