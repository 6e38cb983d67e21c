"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are few and fixed, so their inverted index travels with the code. A document's words become template
vocabulary numbers; its grams are looked up in the index, hits are gathered by template and diagonal, and where a band holds as
many as any match must keep, the template is aligned within it, which gives the matched share and the span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from terrane.llm.decontaminate import _FOLD, tokens
from terrane.llm.textmap import map_texts

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."

# Wording of common licenses, of the openings of long ones, and of the notices that refer to them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "MIT-disclaimer": (
        f"{_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
        "permit third-parties to whom the Software is furnished to do so"
    ),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-2.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "GPL-3.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "LGPL-2.1-text": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "LGPL-3.0-text": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "AGPL-3.0-text": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-only": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
        "published by the Free Software Foundation."
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EUPL-1.2-notice": "Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-grant": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-ND-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "All-rights-reserved": "All rights reserved. No part of this work may be reproduced without written permission",
}

#: The widest band, and the matched share of a template that makes a match.
BAND, MIN_COVERAGE = 6, 0.8
#: Templates of more words are indexed by pairs of words: there single words would be found too often.
LONG = 400
#: Alignments worked out at once.
BATCH = 4096


@dataclass(frozen=True)
class Print:
    """How a template is indexed: length of its grams, their winnowed places, and how many of them every match keeps."""

    k: int
    at: tuple[int, ...]
    need: int


def fingerprint(words: list[int], min_coverage: float, band: int) -> Print:
    """Winnowed grams of a template such that an alignment of ``min_coverage`` within the band cannot miss ``need`` of them.

    Of n words at most ``lost`` are unmatched, so at most as many single words are. A pair of words is lost with either of its
    words, or where words are inserted between them; as all diagonals lie within the band, ``2 * band + lost`` are at most inserted.
    Whatever is changed, left out or inserted, the grams that are left are hits whose diagonals lie within one band.
    """
    n = len(words)
    lost = int(n - min_coverage * n + 1e-9)
    for k, window, broken in ((2, 1, 3 * lost + 2 * band),) if n > LONG else ((1, 3, lost), (1, 2, lost)):
        at = winnow([xxhash.xxh64_intdigest(str(words[i : i + k])) for i in range(n - k + 1)], window)
        if len(at) - broken >= 3:
            return Print(k, tuple(at), len(at) - broken)
    return Print(1, tuple(range(n)), max(1, n - lost))


def winnow(hashes: list[int], window: int) -> list[int]:
    """Positions of each window's smallest hash, the rightmost on ties; all of fewer hashes than a window have one."""
    chosen: list[int] = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = range(i, min(len(hashes), i + window))
        at = min(part, key=lambda j: (hashes[j], -j), default=None)
        if at is not None and (not chosen or chosen[-1] != at):
            chosen.append(at)
    return chosen


def align(template: np.ndarray, words: np.ndarray, starts: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignments of all of ``template`` with ``words``, one for each of ``starts``, where template word 0 is on the middle diagonal.

    The words' ends are free: match 2, mismatch -1, gap -1. Score, matched template words, first and last matched word
    of each start's best; ties prefer the earlier end.
    """
    width = 2 * band + 1
    place = np.arange(width)
    score, matched = (np.zeros((len(starts), width), np.int64) for _ in range(2))
    first, last = (np.full((len(starts), width), -1, np.int64) for _ in range(2))
    for i, t in enumerate(template):
        j = starts[:, None] + (i - band) + place
        hit = (j >= 0) & (j < len(words))
        hit &= words[np.clip(j, 0, len(words) - 1)] == t
        now = [np.where(hit, score + 2, score - 1), matched + hit, np.where(hit & (first < 0), j, first), np.where(hit, j, last)]
        skipped = score[:, 1:] - 1 > now[0][:, :-1]  # the template's word is missing
        for new, old in zip(now, (score - 1, matched, first, last)):
            new[:, :-1][skipped] = old[:, 1:][skipped]
        value = now[0] + place  # a word in between costs one a diagonal, so the best source is a running maximum
        source = np.maximum.accumulate(np.where(value == np.maximum.accumulate(value, axis=1), place, 0), axis=1)
        score, matched, first, last = (np.take_along_axis(x, source, 1) for x in now)
        score = score - (place - source)
    best = score.argmax(axis=1)
    return tuple(x[np.arange(len(starts)), best] for x in (score, matched, first, last))


class Index:
    """The inverted index of winnowed template fingerprints: by gram, the templates and the places in them."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> None:
        texts = {n: tokens(t.encode()) for n, t in templates.items()}
        self.names = sorted(n for n, words in texts.items() if words)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for n in self.names for w in texts[n]}))}
        self.templates = [np.array([self.vocabulary[w] for w in texts[n]], np.int64) for n in self.names]
        self.least = [min_coverage * len(t) - 1e-9 for t in self.templates]
        self.bands = [min(BAND, max(1, (len(t) - 1) // 2)) for t in self.templates]
        self.prints = [fingerprint(t.tolist(), min_coverage, b) for t, b in zip(self.templates, self.bands)]
        self.needs = np.array([p.need for p in self.prints], np.int64)
        entries: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for t, (words, p) in enumerate(zip(self.templates, self.prints)):
            entries[p.k] += [(int(self._grams(words, p.k)[at]), t, at) for at in p.at]
        self.entries = {}
        for k, found in entries.items():
            gram, t, at = (np.array(c, np.int64) for c in zip(*sorted(found)))
            known, begin, n = np.unique(gram, return_index=True, return_counts=True)
            self.entries[k] = (known, begin, n, t, at)
        # Words of each template with their counts, one template after the other, for a look at whole texts.
        bags = [np.unique(t, return_counts=True) for t in self.templates]
        self.bag_words, self.bag_counts = (np.concatenate(x) if bags else np.zeros(0, np.int64) for x in (zip(*bags) if bags else ((), ())))
        self.bag_starts = np.cumsum([0] + [len(w) for w, _ in bags])[:-1]

    def _grams(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the k-grams, 0 where one has a word of no template."""
        n = max(0, len(ids) - k + 1)
        grams, whole = ids[:n].copy(), ids[:n] > 0
        for j in range(1, k):
            part = ids[j : n + j]
            grams, whole = grams * (len(self.vocabulary) + 1) + part, whole & (part > 0)
        return np.where(whole, grams, 0)

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """By template, whether the text has enough of its words at all, in any order."""
        there = np.bincount(ids, minlength=len(self.vocabulary) + 1)
        return np.add.reduceat(np.minimum(there[self.bag_words], self.bag_counts), self.bag_starts) >= self.least

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Templates, and ranges of starts (from, to) at which enough of their fingerprints lie within a band."""
        alive = self.possible(ids)
        if not alive.any():
            return
        for k, (known, begin, n, template, place) in self.entries.items():
            if len(ids) < k:
                continue
            grams = self._grams(ids, k)
            slot = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            at = np.flatnonzero(known[slot] == grams)
            slot, times = slot[at], n[slot[at]]
            entry = np.repeat(begin[slot] - np.cumsum(times) + times, times) + np.arange(times.sum())
            wanted = alive[template[entry]]
            entry, diagonal = entry[wanted], np.repeat(at, times)[wanted]
            diagonal = diagonal - place[entry]
            order = np.lexsort((diagonal, template[entry]))
            of, diagonal = template[entry][order], diagonal[order]
            for t in np.unique(of).tolist():
                mine = diagonal[np.searchsorted(of, t) : np.searchsorted(of, t, "right")]
                need, band = self.prints[t].need, self.bands[t]
                low, high = mine[need - 1 :] - band, mine[: len(mine) - need + 1] + band
                fits = low <= high
                low, high = low[fits], high[fits]
                if len(low):
                    new = np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]]
                    firsts = np.flatnonzero(new)
                    yield t, np.stack([low[firsts], np.maximum.reduceat(high, firsts)], axis=1)


def alignments(index: Index, t: int, ranges: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(-score, template, first, last, coverage) of the matches of a template that begin in these ranges.

    Short templates are aligned at every start. Of others, as many starts as a band has diagonals share an alignment of twice the
    band, which holds all of theirs: two copies of a template so long are never that near.
    """
    template, band = index.templates[t], index.bands[t]
    starts = np.concatenate([np.arange(a, b + 1) for a, b in ranges])
    wide = band
    if index.least[t] > 4 * band + 1:
        starts, wide = np.concatenate([np.arange(a, b + 1, 2 * band + 1) for a, b in ranges]) + band, 2 * band
    for at in range(0, len(starts), BATCH):
        score, matched, first, last = align(template, ids, starts[at : at + BATCH], wide)
        for i in np.flatnonzero(matched >= index.least[t]).tolist():
            yield -int(score[i]), t, int(first[i]), int(last[i]), int(matched[i]) / len(template)


def scanner(templates: dict[str, str], min_coverage: float) -> Callable[[bytes | None], tuple[int, str, list[dict]]]:
    index = Index(templates, min_coverage)
    get = index.vocabulary.get

    def scan(raw: bytes | None) -> tuple[int, str, list[dict]]:
        words = tokens(raw)
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return 0, "", []
        found = {x for t, ranges in index.candidates(ids) for x in alignments(index, t, ranges, ids)}
        told: list[tuple[int, int, int, float]] = []
        for _, t, first, last, share in sorted(found):  # the best of those that overlap
            k = bisect_left(told, (first,))
            if (k == len(told) or told[k][0] > last) and (k == 0 or told[k - 1][1] < first):
                insort(told, (first, last, t, share))
        if not told:
            return 0, "", []
        spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        out = [
            {"license": index.names[t], "coverage": share, "start": int(chars[spans[f][0]]), "end": int(chars[spans[l][1]])}
            for f, l, t, share in told
        ]
        return len(out), ",".join(sorted({x["license"] for x in out})), out

    return scan


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_matches``, ``licenses``, ``matches`` (license, coverage, start, end in code points) for every row.

    A match aligns at least ``min_coverage`` of a template's words, whatever their case and punctuation; of matches
    that overlap, the one that aligns best is told (ties: the template whose name sorts first, then the earlier). An alignment of that
    many words within the band is found whatever words are changed, left out or inserted: its fingerprints cannot all be lost. Null and empty texts
    have no match; very long texts are read whole, in time in proportion to their length and matches; null ids and repeated rows
    come back as they are; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    chosen = TEMPLATES if templates is None else templates
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    return map_texts(
        docs,
        id_col,
        text_col,
        lambda: scanner(chosen, min_coverage),
        "n_matches long, licenses string, matches array<struct<license:string,coverage:double,start:bigint,end:bigint>>",
        [pa.int64(), pa.string(), kind],
    )
