"""License scans: patience alignment of texts with license templates.

Words are lower-cased with marks stripped from both ends. Alignment anchors on words that are
unique to both sides, keeps the longest increasing subsequence of anchors, and aligns the gaps
between them in the same way; words next to an anchor that agree are taken along, so that
repeated words count too. Coverage is the share of the template's words that are aligned.

A text may state a license anywhere and more than once, so each alignment is over a window of
the text: around every place of the template's words that are rarest in this text, so many of
them that any match of the wanted coverage has one. Windows that overlap are aligned as one if no
longer than two templates. The best window counts, the first of equals. Where such a window holds
a word more often than the template and is not aligned whole, as of statements close together, in
which no word is unique, windows of one template's length and of a quarter more are aligned, too,
from every place where a statement can start by a rare word's place; if none of them matches,
windows of four lengths from each of the template's words on. A template of LONG words or more that
is aligned as wanted is not looked for more closely: whole license texts have words of their own
in any part, and repeat many others.

Templates are a parameter: TEMPLATES has notices and short licenses, ``full_texts`` reads a folder of
whole ones.

Licenses share wording. A template matches only with one of the words, if it has any, that no
other license of the pack has; and of licenses whose matches overlap those with most words
aligned stand, of these those with most coverage. Equal ones all stand.

Null and empty texts match nothing, and an empty table gives no rows. Every row is scanned,
repeats too; a null doc_id is carried along. Rows keep no other columns, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

COVERAGE = 0.8
#: Words of a template from which a window that matches is not narrowed.
LONG = 400
MARKS = ".,;:!?\"'()[]{}<>*"

#: Customary wordings of license statements and of the terms of short licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "All-Rights-Reserved": ["All rights reserved."],
}


def full_texts(folder: str) -> dict[str, list[str]]:
    """Whole licenses as templates: one of each file, named as the file without an ending .txt. They are
    read by the driver and go to the tasks with the scan."""
    from pathlib import Path

    return {f.name.removesuffix(".txt"): [f.read_text("utf-8", "replace")] for f in sorted(Path(folder).iterdir()) if f.is_file()}


def words(text: str) -> list[str]:
    return [w.strip(MARKS) for w in text.lower().split()]


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first part, whose second parts rise."""
    ends: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(ends, y)
        if at:
            back[k] = piles[at - 1]
        if at == len(ends):
            ends.append(y)
            piles.append(k)
        else:
            ends[at], piles[at] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a and b, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # beside an anchor, or at an end
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one, two = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if two[w] == 1}
        anchors = rising([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if one[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if x1 - x0 > 1 and y1 - y0 > 1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def narrow(at: list[int], lo: int, hi: int, template: list[str], rare: list[str]) -> list[tuple[int, int]]:
    """Windows of one template's length and of 1.25, each with a rare word at a place it has in the template."""
    size = len(template)
    starts = sorted({k - j for k in at for j, w in enumerate(template) if w in rare})
    return sorted({(max(lo, a), min(hi, a + n)) for a in starts for n in (size, size + size // 4) if a + size > lo and a < hi})


@dataclass(frozen=True)
class Template:
    license: str
    words: list[str]
    counts: Counter
    need: int  # words to be aligned
    own: frozenset[str]  # words that no other license has


@dataclass(frozen=True)
class Pack:
    templates: list[Template]
    known: frozenset[str]


def prepared(templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> Pack:
    every = {k: [words(t) for t in ts] for k, ts in (templates or TEMPLATES).items()}
    holders = Counter(w for ts in every.values() for w in set().union(*ts))
    found = [Template(k, t, Counter(t), max(1, ceil(len(t) * coverage - 1e-9)), frozenset(w for w in t if holders[w] == 1)) for k, ts in every.items() for t in ts if t]
    return Pack(found, frozenset(holders))


def every(text: list[str], lo: int, hi: int, t: Template) -> list[tuple[int, int]]:
    """Windows of 0.8 to 1.5 templates' lengths from each of the template's words on that hold enough of them.

    Words that count are kept as a window of each length slides on."""
    n, found = len(t.words), []
    for size in sorted({t.need, n, n + n // 4, n + n // 2}):
        inside: Counter = Counter()
        held, end = 0, lo
        for a in range(lo, hi):
            while end < min(hi, a + size):
                w = text[end]
                if w in t.counts:
                    inside[w] += 1
                    held += inside[w] <= t.counts[w]
                end += 1
            w = text[a]
            if w in t.counts:
                if held >= t.need:
                    found.append((a, size, end))
                held -= inside[w] <= t.counts[w]
                inside[w] -= 1
    return [(a, end) for a, _, end in sorted(found)]


def _most(text: list[str], windows: list[tuple[int, int]], t: Template) -> tuple[int, int, int] | None:
    """(words aligned, first word, last word) of the first of the windows with most, if enough."""
    found = None
    for a, b in windows:
        got = align(text[a:b], t.words)
        if len(got) >= t.need and (found is None or len(got) > found[0]) and (not t.own or any(t.words[y] in t.own for _, y in got)):
            found = len(got), a + got[0][0], a + got[-1][0]
    return found


def best(text: list[str], places: dict[str, list[int]], t: Template) -> tuple[int, int, int] | None:
    """(words aligned, first word, last word) of the best window, if it covers enough."""
    if sum(min(n, len(places.get(w, ()))) for w, n in t.counts.items()) < t.need or t.own and not any(w in places for w in t.own):
        return None
    spare = len(t.words) - t.need
    rare, dropped = [], 0
    for w, n in sorted(t.counts.items(), key=lambda x: (len(places.get(x[0], ())), x[0])):
        rare.append(w)
        dropped += n
        if dropped > spare:
            break
    reach = 2 * len(t.words)
    found = None
    spans: list[list[int]] = []
    places_of = sorted({k for w in rare for k in places.get(w, ())})
    for at in places_of:
        lo, hi = max(0, at - reach), min(len(text), at + reach + 1)
        if spans and hi - spans[-1][0] <= 2 * reach + 2 * len(t.words):
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        inside = Counter(w for w in text[lo:hi] if w in t.counts)
        repeats = any(inside[w] > n for w, n in t.counts.items())
        here = _most(text, [(lo, hi)], t)
        if repeats and (here is None or here[0] < len(t.words) < LONG):
            here = max(filter(None, (here, _most(text, narrow(places_of[bisect_left(places_of, lo) : bisect_left(places_of, hi)], lo, hi, t.words, rare), t))), key=lambda x: x[0], default=None)
            here = here or _most(text, every(text, lo, hi, t), t)
        if here and (found is None or here[0] > found[0]):
            found = here
    return found


def scan(text: str | None, pack: Pack):
    """(license, coverage, first word, last word) for each license that text states."""
    own = words(text or "")
    places: dict[str, list[int]] = defaultdict(list)
    for k, w in enumerate(own):
        if w in pack.known:
            places[w].append(k)
    if not places:
        return
    hits = [((x[0], x[0] / len(t.words)), t.license, x[1], x[2]) for t in pack.templates if (x := best(own, places, t))]
    stand: dict[str, tuple] = {}
    for score, name, first, last in sorted(hits, key=lambda x: (-x[0][0], -x[0][1], *x[1:])):
        if name not in stand and not any(first <= b and a <= last and other > score for other, a, b in stand.values()):
            stand[name] = (score, first, last)
    for name, (score, first, last) in sorted(stand.items()):
        yield name, score[1], first, last


def _scan(pack: Pack):
    def run(batches):
        for b in batches:
            doc, name, cover, first, last = [], [], [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                for x in scan(t.as_py(), pack):
                    for out, v in zip((doc, name, cover, first, last), (d, *x)):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(name, pa.string()), pa.array(cover, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "license", "coverage", "first_word", "last_word"])

    return run


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word: a row for each license a text states."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan(prepared(templates, coverage)), "doc_id long, license string, coverage double, first_word long, last_word long")
