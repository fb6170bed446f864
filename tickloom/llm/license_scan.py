"""License scan: wordings placed word by word, ranked by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of common licenses and notices, by SPDX-style identifier. A name may
# have several wordings.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

CUE = re.compile(
    r"licen[sc]|copyright|\(c\)|©|permission is hereby|permission to use|redistribution|rights reserved|public domain"
    r"|creative commons|\bcc0?[ -](by|1\.0)|free software|\bspdx\b",
    re.IGNORECASE,
)
MARKS = re.compile(r"[^\w\s]*")
WORDS = re.compile(r"[^\W_]+(?:[.][0-9]+)*(?:-[^\W_]+)*")

MATCH_SCHEMA = (
    "doc_id long, begin long, end long, license string, template int, gain double, missing array<string>, "
    "added array<string>, exact boolean"
)
_MATCHES = pa.schema(
    [
        ("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("license", pa.string()),
        ("template", pa.int32()), ("gain", pa.float64()), ("missing", pa.list_(pa.string())),
        ("added", pa.list_(pa.string())), ("exact", pa.bool_()),
    ]
)


def wording(text: str) -> list[str]:
    """Words of a text in lower case; version numbers and joined names are one word."""
    return [w.lower() for w in WORDS.findall(text)]


def _edits(template: np.ndarray, found: np.ndarray) -> Iterator[np.ndarray]:
    """Least edits to turn the first 0, 1, 2, ... words of ``template`` into a run of ``found`` that
    ends before each position; an edit is a word missing or a word added.
    """
    at = np.arange(len(found) + 1)
    row = np.zeros(len(found) + 1, np.int64)
    yield row
    for word in template:
        last, row = row, row + 1
        row[1:] = np.where(found == word, np.minimum(row[1:], last[:-1]), row[1:])
        row = np.minimum.accumulate(row - at) + at
        yield row


def _trace(template: np.ndarray, found: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Where the run that ends with ``found`` begins, the places missing and the places added. Of
    equally many edits those count that keep most words.
    """
    rows = list(_edits(template, found))
    i, j, missing, added = len(template), len(found), [], []
    while i:
        if j and found[j - 1] == template[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            added.append(j)
        else:
            i -= 1
            missing.append(i)
    return j, missing[::-1], added[::-1]


def differences(template: list[str], found: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that are missing, and words added, within where it lies in ``found``."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in (template, found))
    *_, last = _edits(a, b)
    _, missing, added = _trace(a, b[: np.flatnonzero(last == last.min())[-1]])
    return [template[i] for i in missing], [found[j] for j in added]


class Scanner:
    """Finds where templates are worded in a block, whatever stands around them.

    A place is confirmed if it differs in at most ``max_edits`` of the template's words, and the
    template, as a raw dictionary, shortens the place's compression by at least ``min_gain`` of the
    template's own compressed size. ``tries`` bounds how many templates are placed, those that share
    most words first; without it all are.
    """

    def __init__(self, templates, min_gain: float, max_edits: float, tries: int | None = None):
        self._templates = [(name, wording(text)) for name, text in templates]
        self._min_gain, self._max_edits, self._tries = min_gain, max_edits, tries
        self.longest = max((len(words) for _, words in self._templates), default=0)
        self.reach = int(self.longest * (1 + max_edits)) + 1
        self._alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self._primed, self._own = [], []
        for _, words in self._templates:
            data = " ".join(words).encode()
            self._own.append(len(self._alone.compress(data)))
            data = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._primed.append(
                zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            )
        self._ids: dict[str, int] = {}
        self._coded = [np.array([self._ids.setdefault(w, len(self._ids)) for w in words], np.int64) for _, words in self._templates]
        self._needs = np.zeros((len(self._templates), len(self._ids)), np.int64)
        for row, coded in zip(self._needs, self._coded):
            for word, count in Counter(coded.tolist()).items():
                row[word] = count
        self._least = np.array([len(c) - int(max_edits * len(c)) for c in self._coded], np.int64)
        self._known: dict[tuple[str, ...], list[tuple]] = {}

    def match(self, block: str) -> tuple | None:
        """(license, template, gain, missing, added) of the best confirmed template."""
        found = self.find(wording(block))
        return min(found)[-1] if found else None

    def find(self, words: list[str]) -> list[tuple]:
        """(rank, begin, end, match) of the confirmed places, in positions of words. Of places that
        overlap the one with the fewest differences counts, then the one with the most bytes saved.
        """
        key = tuple(words)
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= 10_000:
                self._known.clear()
            known = self._known[key] = self._find(words)
        return known

    def _find(self, words: list[str]) -> list[tuple]:
        ids = np.fromiter((self._ids.get(w, -1) for w in words), np.int64, len(words))
        counts = np.bincount(ids[ids >= 0], minlength=len(self._ids))
        shared = np.minimum(self._needs, counts).sum(axis=1)
        asked = np.flatnonzero(shared >= self._least)
        if self._tries is not None:
            asked = sorted(asked, key=lambda i: -shared[i] / len(self._coded[i]))[: self._tries]
        confirmed = []
        for i in asked:
            confirmed += self._places(int(i), words, ids)
        taken, out = np.zeros(len(words), bool), []
        for place in sorted(confirmed):
            _, begin, end, _ = place
            if not taken[begin:end].any():
                taken[begin:end] = True
                out.append(place)
        return out

    def _places(self, i: int, words: list[str], ids: np.ndarray) -> Iterator[tuple]:
        (name, template), coded = self._templates[i], self._coded[i]
        *_, last = _edits(coded, ids)
        ends = np.flatnonzero(last <= self._max_edits * len(template))
        taken = np.zeros(len(words), bool)
        for end in ends[np.lexsort((-ends, last[ends]))].tolist():
            if end == 0 or taken[end - 1]:
                continue
            low = max(0, end - len(template) - int(last[end]))
            begin, missing, added = _trace(coded, ids[low:end])
            begin += low
            if taken[begin:end].any():
                continue
            taken[begin:end] = True
            data = " ".join(words[begin:end]).encode()
            saved = len(self._alone.compress(data)) - len(self._primed[i].compress(data))
            gain = saved / self._own[i]
            if gain >= self._min_gain:
                rank = ((len(missing) + len(added)) / len(template), -saved, -len(template), name, i)
                lost = [template[k] for k in missing]
                yield rank, begin, end, (name, i, gain, lost, [words[low + k] for k in added])


def candidate_blocks(text: str, reach: int) -> Iterator[list[re.Match]]:
    """Runs of words within ``reach`` words of a cue of a license. Runs that meet are one; none
    leaves its paragraph, which ends at a blank line.
    """
    for paragraph in re.finditer(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", text):
        cues = [c.start() for c in CUE.finditer(text, *paragraph.span())]
        if not cues:
            continue
        words = list(WORDS.finditer(text, *paragraph.span()))
        starts = [w.start() for w in words]
        runs: list[list[int]] = []
        for cue in cues:
            at = max(0, bisect_right(starts, cue) - 1)
            if runs and at - reach <= runs[-1][1]:
                runs[-1][1] = at + reach + 1
            else:
                runs.append([max(0, at - reach), at + reach + 1])
        for begin, end in runs:
            if run := words[begin:end]:
                yield run


def _scan(batches: Iterator[pa.RecordBatch], templates, min_gain: float, max_edits: float, tries: int | None) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, min_gain, max_edits, tries)
    for batch in batches:
        columns: list[list] = [[] for _ in _MATCHES]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None or not CUE.search(text):
                continue
            for run in candidate_blocks(text, scanner.reach):
                found = scanner.find([w[0].lower() for w in run])
                for _, first, last, match in sorted(found, key=lambda place: place[1]):
                    begin, end = run[first].start(), MARKS.match(text, run[last - 1].end()).end()
                    missing, added = match[3:]
                    for column, value in zip(columns, (doc_id, begin, end, *match, not missing and not added)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCHES)], schema=_MATCHES)


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    min_gain: float = 0.4,
    max_edits: float = 0.25,
    tries: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per place of a document that words a license, within a line or over several.

    Each template is placed among the words around every cue (see :func:`candidate_blocks`), where
    the fewest words are missing or added: at most ``max_edits`` of the template's words. As a raw
    zstandard dictionary it must save at least ``min_gain`` of its own compressed size on the place,
    the reported ``gain``. Of places that overlap, the one with the fewest differences wins, then
    the one with the most bytes saved, then the longer template. ``begin`` and ``end`` are character
    positions, with the marks that follow the last word; ``missing`` and ``added`` are the differing
    words. ``tries`` bounds the templates placed around a cue; by default all are.

    Null and empty texts have no places. Null ids and repeated rows are kept. Other columns are
    dropped. An empty table gives no rows. There is no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = partial(_scan, templates=templates, min_gain=min_gain, max_edits=max_edits, tries=tries)
    return rows.mapInArrow(scan, MATCH_SCHEMA)
