"""License scans by conditional compression.

Candidate blocks are the stretches around words that license notices use, as long to either side as a template is.
Each is compressed alone and with the template as a zstandard raw dictionary; what the template saves, as a share of
its own compressed size, ranks the templates. Those that save enough are held against the block word by word, the
block longer at both ends by as many words as may differ: of all ways to lay the template into it, the one with the
fewest words missing and added counts, and those words are reported. Words before and behind it are no differences; those
that stand in place of the template's first or last words are. Few differences confirm it.
Of confirmed templates that overlap in the text, the one that agrees in most words stays.

Defined results. Words are lower-cased and stripped of punctuation at their ends. Null or empty texts and texts
without such words hold no license. Null ``doc_id``: reported under null. Rows that repeat a ``doc_id`` are scanned
one by one and reported one by one. Of several places of a license in a text the one with the fewest differences is
reported, the first of those that tie, with how many places hold it. Other columns are ignored. An empty table gives
an empty result. Very long texts are read whole; blocks stay short.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_batches

#: The usual wording of public license notices, by short identifier.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Beginnings of words, one of which stands in each template. A stretch is looked at if it holds one.
CUES = (b"licen", b"copyright", b"permission", b"redistribut", b"unencumbered")

#: Share of a template's compressed size that it must save, and of its words that may differ.
SAVED = 0.1
DIFFERENT = 0.1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def has_cue(lower: bytes) -> bool:
    return any(c in lower for c in CUES)


def normal(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?()[]{}\"'`*#/-")


def words_of(raw: bytes) -> list[bytes]:
    return [n for w in _WORD.findall(raw) if (n := normal(w))]


class Scanner:
    """Compressors and words of all templates, made once in each Python process."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {k: words_of(t.encode()) for k, t in templates.items()}
        self.longest = max(n + int(n * DIFFERENT) for n in map(len, self.words.values()))
        self.places: dict[str, dict[bytes, list[int]]] = {k: {} for k in self.words}
        for k, own in self.words.items():
            for j, w in enumerate(own):
                self.places[k].setdefault(w, []).append(j)
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given, self.size = {}, {}
        for k, w in self.words.items():
            raw = b" ".join(w)
            self.size[k] = len(self.plain.compress(raw))
            self.given[k] = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def ranked(self, words: list[bytes], cue: int) -> list[tuple[float, str]]:
        """(share saved, template) of the blocks around a cue, best first."""
        out, alone = [], {}
        for name, own in self.words.items():
            n = len(own)
            lo = max(0, cue - n)
            raw = b" ".join(words[lo : cue + n + 1])
            if n not in alone:
                alone[n] = len(self.plain.compress(raw))
            out.append(((alone[n] - len(self.given[name].compress(raw))) / self.size[name], name))
        return sorted(out, reverse=True)

    def differences(self, name: str, block: list[bytes], cue: int) -> list[tuple[int, int, list[str], bool]]:
        """(place, number of words that differ, those words: '-' missing, '+' added; whether it holds the cue) where the
        template fits best: around the cue, wholly before it, and wholly behind it, if it fits well enough there."""
        own, places = self.words[name], self.places[name]
        n, limit = len(own), int(len(self.words[name]) * DIFFERENT)
        # chains of equal words, by the pair (place in the block, place in the template) that they end with
        reached: dict[tuple[int, int], tuple[int, int, tuple[int, int] | None]] = {}  # (differences, start, pair before)
        best: dict[int, tuple[int, int, tuple[int, int]]] = {}
        for i, word in enumerate(block):
            for j in places.get(word, ()):
                found = []
                if j + min(i, j) <= limit:  # words in place of the template's first ones are added
                    found.append((j + min(i, j), i - min(i, j), None))
                for x in range(min(limit, i - 1) + 1):
                    for y in range(min(limit - x, j - 1) + 1):
                        had = reached.get((i - 1 - x, j - 1 - y))
                        if had and had[0] + x + y <= limit:
                            found.append((had[0] + x + y, had[1], (i - 1 - x, j - 1 - y)))
                if not found:
                    continue
                reached[i, j] = now = min(found, key=lambda f: f[:2])
                behind = min(n - 1 - j, len(block) - 1 - i)
                differ = now[0] + n - 1 - j + behind
                side = (now[1] > cue) - (i + behind < cue)
                if differ <= limit and (side not in best or (differ, now[1]) < best[side][:2]):
                    best[side] = (differ, now[1], (i, j))
        out = []
        for side, (differ, start, pair) in best.items():
            kept, last = [], pair
            while pair:
                kept.append(pair)
                pair = reached[pair][2]
            same, agree = {i for i, _ in kept}, {j for _, j in kept}
            end = last[0] + 1 + min(n - 1 - last[1], len(block) - 1 - last[0])
            changed = [f"-{w.decode()}" for j, w in enumerate(own) if j not in agree] + [f"+{block[i].decode()}" for i in range(start, end) if i not in same]
            out.append((start, differ, changed, side == 0))
        return out

    def scan(self, raw: bytes) -> dict[str, tuple]:
        """license -> (differences, word place, share saved, changed words, places)."""
        if not has_cue(raw.lower()):
            return {}
        words = words_of(raw)
        found: dict[tuple[int, str], tuple] = {}
        known: dict[tuple[int, bytes], list[tuple]] = {}
        for cue in (i for i, w in enumerate(words) if has_cue(w)):
            before = min(cue, self.longest)
            around = before, b" ".join(words[cue - before : cue + self.longest + 1])
            if around not in known:
                known[around] = []
                for saved, name in self.ranked(words, cue):
                    if saved < SAVED:
                        break
                    n = len(self.words[name]) + int(len(self.words[name]) * DIFFERENT)
                    lo = max(0, cue - n)
                    for place, differ, changed, holds in self.differences(name, words[lo : cue + n + 1], cue - lo):
                        known[around].append((lo + place - cue, name, differ, saved, changed, holds))
            for place, name, differ, saved, changed, holds in known[around]:
                if holds or (cue + place, name) not in found:
                    found[cue + place, name] = (differ, saved, changed)
        taken, out = [], {}
        for (place, name), (differ, saved, changed) in sorted(found.items(), key=lambda x: (x[1][0] - len(self.words[x[0][1]]), x[1][0], x[0])):
            end = place + len(self.words[name])
            i = bisect.bisect(taken, (place,))
            if (i and taken[i - 1][1] > place) or (i < len(taken) and taken[i][0] < end):
                continue
            taken.insert(i, (place, end))
            had = out.get(name)
            best = min(((differ, place, saved, changed), *([had[:4]] if had else [])), key=lambda x: x[:2])
            out[name] = (*best, (had[4] if had else 0) + 1)
        return out


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(templates))


SCHEMA = "doc_id long, license string, word_start long, differences int, changed array<string>, saved double, places int"


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each document and license it holds."""
    key = tuple(templates.items())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(key)
        for batch in it:
            rows = [
                (doc, name, place, n, changed, saved, places)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True)
                for name, (n, place, saved, changed, places) in sorted(find.scan(text.as_py() or b"").items())
            ]
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "license", "word_start", "differences", "changed", "saved", "places"])

    return map_batches(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), batches, SCHEMA)
