"""The license scan against alignments without an index, and copies with words changed, left out and inserted."""

import random

import numpy as np
import pytest

from terrane.llm import licensescan
from terrane.llm.decontaminate import tokens

SMALL = {
    "five": "one two three four five",
    "six": "licensed under cc by four zero",
    "twins": "a b a b a b a",
    "twelve": "the words of this notice are the words of that other notice",
    "forty": " ".join(f"w{k % 23}" for k in range(40)),
}


def plain_align(template, words, start, band):
    """Cell by cell: score, matched, first, last."""
    width = 2 * band + 1
    before = [(0, 0, -1, -1)] * width
    for i, t in enumerate(template):
        row = []
        for d in range(width):
            j = start + i + d - band
            s, m, f, e = before[d]
            same = 0 <= j < len(words) and words[j] == t
            cell = (s + 2, m + 1, j if f < 0 else f, j) if same else (s - 1, m, f, e)
            if d + 1 < width and before[d + 1][0] - 1 > cell[0]:
                cell = (before[d + 1][0] - 1, *before[d + 1][1:])
            if d and row[d - 1][0] - 1 > cell[0]:
                cell = (row[d - 1][0] - 1, *row[d - 1][1:])
            row.append(cell)
        before = row
    return max(before, key=lambda cell: cell[0])


def everywhere(index, words):
    """All matches at all starts, without the index: (template, first, last, score)."""
    out = set()
    for t, (template, band) in enumerate(zip(index.templates, index.bands)):
        for start in range(-band, len(words)):
            score, matched, first, last = plain_align(template.tolist(), words, start, band)
            if matched >= index.least[t]:
                out.add((t, first, last, score))
    return out


def edited(draw, words, others):
    """Up to a fifth of the words changed or left out, and up to a fifth inserted."""
    words = list(words)
    for at in draw.sample(range(len(words)), int(len(words) * draw.choice((0, 0.1, 0.2)) + 1e-9)):
        words[at] = draw.choice((None, draw.choice(others)))
    for _ in range(int(len(words) * draw.choice((0, 0.1, 0.2)) + 1e-9)):
        words.insert(draw.randint(1, len(words) - 1), draw.choice(others))
    return [w for w in words if w is not None]


@pytest.mark.parametrize("seed", range(60))
def test_small_texts_against_alignment_without_index(seed):
    draw = random.Random(seed)
    index, scan = licensescan.Index(SMALL, 0.8), licensescan.scanner(SMALL, 0.8)
    vocabulary = sorted({w for t in SMALL.values() for w in t.split()}) + ["x", "y", "z"]
    text = draw.choices(vocabulary, k=draw.randint(0, 15))
    for _ in range(draw.randint(1, 3)):
        text += edited(draw, draw.choice(list(SMALL.values())).split(), vocabulary) + draw.choices(vocabulary, k=draw.randint(0, 6))
    ids = [index.vocabulary.get(w.encode(), 0) for w in text]
    every = everywhere(index, ids)
    found = {x for t, r in index.candidates(np.array(ids, np.int64)) for x in licensescan.alignments(index, t, r, np.array(ids, np.int64))}
    short = {x for x in every if index.least[x[0]] <= 4 * index.bands[x[0]] + 1}
    assert {(t, f, e, -s) for s, t, f, e, _ in found if index.least[t] <= 4 * index.bands[t] + 1} == short
    # What is told: each match without the index meets one that aligns at least as well.
    raw = " ".join(text)
    told = [(raw[: m["start"]].count(" "), raw[: m["end"]].count(" "), m) for m in scan(raw.encode())[2]]
    scores = {}
    for s, t, f, e, _ in found:
        scores[index.names[t], f, e] = max(-s, scores.get((index.names[t], f, e), -99))
    for _, first, last, score in every:
        assert any(f <= last and first <= e and scores[m["license"], f, e] >= score for f, e, m in told), (text, first, last)
    assert bool(every) == bool(told)


@pytest.mark.parametrize("name", sorted(licensescan.TEMPLATES))
def test_edited_copies_are_found(name):
    draw = random.Random(name)
    scan = licensescan.scanner({name: licensescan.TEMPLATES[name]}, 0.8)
    index = licensescan.Index({name: licensescan.TEMPLATES[name]}, 0.8)
    words = [w.decode() for w in tokens(licensescan.TEMPLATES[name].encode())]
    found = 0
    for _ in range(12):
        copy = ["Before", "it", *edited(draw, words, ["other", "wording", "here", *words[:3]]), "and", "after"]
        ids = [index.vocabulary.get(w.lower().encode(), 0) for w in copy]
        n = scan(" ".join(copy).encode())[0]
        if not n or index.least[0] <= 4 * index.bands[0] + 1:  # longer ones are aligned in twice the band
            assert bool(everywhere(index, ids)) == bool(n), copy
        found += n
    assert found > 0


def test_a_template_of_thousands_of_words_is_indexed_by_pairs():
    draw = random.Random(9)
    text = draw.choices([f"word{k}" for k in range(300)] + ["the"] * 60, k=2500)
    templates = {"long": " ".join(text)}
    index = licensescan.Index(templates, 0.8)
    assert index.prints[0].k == 2 and index.prints[0].need > 900
    scan = licensescan.scanner(templates, 0.8)
    copy = [w for k, w in enumerate(text) if k % 9 != 4]  # one in nine is left out, and as many inserted elsewhere
    drift = 0
    for k in range(len(copy) - 5, 0, -8):
        copy.insert(k, "new")
        drift += 1
    n, names, found = scan(" ".join(copy).encode())
    assert drift > 250 and names == "long" and found[0]["coverage"] >= 0.8


def test_notices_with_words_in_between():
    scan = licensescan.scanner(licensescan.TEMPLATES, 0.8)
    for text, name in {
        "Licensed under the CC BY license 4.0": "CC-BY-4.0",
        "Released under an MIT License": "MIT-notice",
        "It is licensed, it is said, under the CC BY-NC-SA license, version 4.0.": "CC-BY-NC-SA-4.0",
        "Apache License\n  Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.": "Apache-2.0-text",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Boston\n"
        "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.": "GPL-2.0-text",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-long",
    }.items():
        assert scan(text.encode())[1] == name, text
    assert scan(b"The license of this work is not known to us, and all of it is rights and words.")[0] == 0


def test_hostile_texts_take_seconds():
    import time

    scan = licensescan.scanner(licensescan.TEMPLATES, 0.8)
    for text in (licensescan.TEMPLATES["MIT"] * 1200, "the software license of and to any " * 30_000, "licensed under cc by 4 0 " * 40_000, "a " * 500_000):
        began = time.process_time()
        scan(text.encode())
        assert time.process_time() - began < 10
