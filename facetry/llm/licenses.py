"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment confirms them.

Words are compared lower-cased and without punctuation.  For each template length m, windows of m words begin every
``max(1, m // 8)`` words of the whole text; a text of fewer words is one window.  Windows and templates are sets of five-word shingles (a shorter
template is one shingle of all its words).  A window and a template of its length meet in one of ``bands`` bands of
``rows`` MinHash values.  An occurrence with containment c >= 0.75 has a window at most half a step off, so their
similarity is at least (c - 1/16) / (2 - c + 1/16) = 0.52 and, with 16 bands of one row, they meet with
probability 1 - 0.48 ** 16 > 0.99999.  A candidate is confirmed on the shingles themselves, word by word, in the
window widened by one step on both sides: the share of the template's shingles found there.

Windows of all lengths share their MinHash values: the smallest of 2, 4, 8, ... neighbouring shingles are made once
for each hash, and a window is covered by two of these runs.  Templates with whole licence texts (some 43,000 words)
so cost one doubling more each time the longest one doubles, not one scan for each.

A map over the texts, no shuffle.  Templates are a parameter, sent with the function and prepared once in each worker.
The given ones are the whole texts and notices in ``license_texts`` and some short sentences.

A cut notice that is a whole text of n < m words and holds the share c of the template's shingles has similarity
c / (2 - c) = 0.6 at least.

Defined cases: null text, no words: no match.  Overlapping windows with one template are one occurrence with the
largest share.  Rows that repeat a ``doc_id`` are scanned each.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as W
from .frames import by_batch

# Sentences by which texts name a licence, and beginnings of notices.
SHORT_NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "bsd-disclaimer": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"),
}
# whole licence texts (-text) and the notices they ask for (-notice), as their publishers word them
LICENSE_TEXTS = {x.name.removesuffix(".txt"): x.read_text("utf-8") for x in files(__package__).joinpath("license_texts").iterdir() if x.name.endswith(".txt")}
TEMPLATES = SHORT_NOTICES | dict(sorted(LICENSE_TEXTS.items()))


@dataclass(frozen=True)
class LicenseParams:
    width: int = 5
    percent: int = 75
    bands: int = 16
    rows: int = 1
    steps: int = 8  # a window moves by an eighth of its length
    seed: int = 3


def separators(points: np.ndarray) -> np.ndarray:
    """All ASCII characters but letters and digits, of lower-cased text."""
    return (points < 128) & ~(((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)))


def plain_words(text: str) -> list[str]:
    points = W.lower_ascii(W.code_points([text])[0])
    start, end = W.word_spans(separators(points))
    return [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(start, end)]


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on, whatever text they are in."""
    long = max(0, len(words) - width + 1)
    total = np.zeros(long, np.uint64)
    for k, factor in enumerate(W.odd_numbers(width, 11)):
        total += words[k:k + long] * factor
    return W.spread(total)


def _minima(x: np.ndarray, asked: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """For each (begin, span), the smallest of ``span`` neighbours from each place of ``begin`` on, by doubling."""
    out, have = [x[:0]] * len(asked), 1
    for j in sorted((j for j, (begin, _) in enumerate(asked) if len(begin)), key=lambda j: asked[j][1]):
        begin, span = asked[j]
        while 2 * have <= span:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        out[j] = np.minimum(x[begin], x[begin + (span - have)])
    return out


def _row_minima(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest value from each ``begin`` to its ``end`` (exclusive, beyond it)."""
    if not len(begin):
        return x[:0]
    beyond = np.append(x, x[-1])  # an end may be the end of all
    return np.minimum.reduceat(beyond, np.column_stack((begin, end)).ravel())[::2]


def _band_values(shingle: np.ndarray, asked: list[tuple[np.ndarray, int]], band: int, p: LicenseParams, rows: tuple | None = None) -> list[np.ndarray]:
    """For each (begin, span), the band value of the windows of ``span`` shingles that begin there; then of ``rows``, if given."""
    factor, values = W.odd_numbers(p.bands * p.rows, p.seed), None
    for k in range(band * p.rows, (band + 1) * p.rows):
        hashed = shingle * factor[k]
        least = _minima(hashed, asked) + ([_row_minima(hashed, *rows)] if rows else [])
        values = least if values is None else [W.spread(v) + x for v, x in zip(values, least)]
    return values


class _Templates:
    """Templates of one length with their band values."""

    def __init__(self, length: int, named: dict[str, list[str]], p: LicenseParams):
        self.length, self.width, self.step = length, min(p.width, length), max(1, length // p.steps)
        self.span = length - self.width + 1
        self.names = sorted(named)
        self.sets = [{tuple(named[n][i:i + self.width]) for i in range(self.span)} for n in self.names]
        hashed = []
        for name in self.names:
            points, first = W.code_points([" ".join(named[name])])
            hashed.append(_shingles(W.word_hashes(points, *W.word_spans(W.is_space(points))), self.width))
        self.hashes = [np.unique(h) for h in hashed]
        # the fewest words that hold the share of some template
        self.least = min(max(1, -(-p.percent * len(x) // 100)) for x in self.sets) + self.width - 1
        whole = [(np.zeros(1, np.int64), self.span)]
        # by band, a value for each template
        self.marks = [np.array([_band_values(h, whole, band, p)[0][0] for h in hashed]) for band in range(p.bands)]

    def windows(self, offset: np.ndarray) -> np.ndarray:
        """First words of the windows: every step of each text, and at its last place."""
        size = np.diff(offset)
        held = np.flatnonzero(size >= self.length)
        count = (size[held] - self.length) // self.step + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(np.concatenate((np.repeat(offset[held], count) + self.step * nth, offset[held + 1] - self.length)))

    def short(self, size: np.ndarray) -> np.ndarray:
        """Texts of fewer words, whose only window is the whole text."""
        return np.flatnonzero((size < self.length) & (size >= self.least))


def candidates(sets: list[_Templates], words: np.ndarray, offset: np.ndarray, p: LicenseParams) -> list[set[tuple[int, int]]]:
    """For each length, (first word, template) of windows that share a band with a template."""
    found: list[set[tuple[int, int]]] = [set() for _ in sets]
    for width in sorted({g.width for g in sets}):
        groups = [k for k, g in enumerate(sets) if g.width == width]
        asked = [(sets[k].windows(offset), sets[k].span) for k in groups]
        shingle = _shingles(words, width)
        # whole texts that are a window of some length
        size = np.diff(offset)
        texts = np.flatnonzero((size >= min(sets[k].least for k in groups)) & (size < max(sets[k].length for k in groups)))
        short = [np.searchsorted(texts, sets[k].short(size)) for k in groups]
        rows = offset[texts], offset[texts + 1] - (width - 1)
        for band in range(p.bands):
            *values, whole = _band_values(shingle, asked, band, p, rows)
            for k, (begin, _), value, few in zip(groups, asked, values, short):
                marks = sets[k].marks[band]
                for places, held in ((begin, value), (rows[0][few], whole[few])):
                    for at in np.flatnonzero(np.isin(held, marks)):
                        found[k].update((int(places[at]), int(t)) for t in np.flatnonzero(marks == held[at]))
    return found


def template_sets(templates: dict[str, str], p: LicenseParams) -> list[_Templates]:
    by_length: dict[int, dict[str, list[str]]] = {}
    for name, text in templates.items():
        words = plain_words(text)
        if words:
            by_length.setdefault(len(words), {})[name] = words
    return [_Templates(length, named, p) for length, named in sorted(by_length.items())]


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...], p: LicenseParams) -> list[_Templates]:
    return template_sets(dict(templates), p)


def find(texts: list, sets: list[_Templates], p: LicenseParams) -> tuple[np.ndarray, list[list[dict]]]:
    """(words, occurrences) of each text."""
    points, first = W.code_points(texts)
    points = W.lower_ascii(points)
    start, end = W.word_spans(separators(points))
    row = np.searchsorted(first, start, side="right") - 1
    hashed = W.word_hashes(points, start, end)
    offset = np.searchsorted(row, np.arange(len(texts) + 1))
    out: list[list[dict]] = [[] for _ in texts]
    shingles = {width: _shingles(hashed, width) for width in {g.width for g in sets}}
    for group, near in zip(sets, candidates(sets, hashed, offset, p)):
        held: dict[tuple[int, int], list[list[int]]] = {}
        shingle_hashes = shingles[group.width]
        for at, t in sorted(near):
            doc = int(row[at])
            lo, hi = max(offset[doc], at - group.step), min(offset[doc + 1], at + group.length + group.step)
            # equal shingles have equal hashes: too few equal hashes need no look at the words
            if 100 * np.isin(group.hashes[t], shingle_hashes[lo:max(lo, hi - group.width + 1)]).sum() < p.percent * len(group.sets[t]):
                continue
            words = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[lo:hi], end[lo:hi])]
            where = {}
            for i in range(len(words) - group.width + 1):
                shingle = tuple(words[i:i + group.width])
                if shingle in group.sets[t]:
                    where.setdefault(shingle, []).append(i)
            share = 100 * len(where) // len(group.sets[t])
            if 100 * len(where) >= p.percent * len(group.sets[t]):
                spots = [i for x in where.values() for i in x]
                held.setdefault((doc, t), []).append([int(lo - offset[doc]) + min(spots), int(lo - offset[doc]) + max(spots) + group.width, share])
        for (doc, t), spans in held.items():
            spans.sort()
            merged = [spans[0]]
            for s in spans[1:]:
                if s[0] < merged[-1][1]:
                    merged[-1] = [merged[-1][0], max(merged[-1][1], s[1]), max(merged[-1][2], s[2])]
                else:
                    merged.append(s)
            out[doc] += [{"name": group.names[t], "start": a, "end": b, "percent": c} for a, b, c in merged]
    for found in out:
        found.sort(key=lambda x: (x["start"], x["name"]))
    return np.diff(offset), out


FOUND = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("percent", pa.int64())]))


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, p: LicenseParams = LicenseParams()) -> DataFrame:
    """(doc_id, n_words, found) with the occurrences of each text: name, first word, end, percent of shingles."""
    named = tuple(templates.items())

    def kernel(batch):
        words, found = find(batch.column("text").to_pylist(), _prepared(named, p), p)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(found, FOUND)], ["doc_id", "n_words", "found"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(by_batch(kernel), "doc_id bigint, n_words bigint, found array<struct<name:string,start:bigint,end:bigint,percent:bigint>>")
