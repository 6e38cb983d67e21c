"""Near copies against exact Jaccard similarities, which share no code with the library."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.exact import groups, similar_pairs
from terrane.llm import nearcopies, simhash


def family(n, edits, hidden):
    """``n`` moderately similar texts, and pairs of further ones at some .85; the smallest ids are the family's."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    base = [word() for _ in range(220)]

    def edited(text, n):
        out = list(text)
        for at in draw.sample(range(220), n):
            out[at] = word()
        return out

    texts = [edited(base, edits) for _ in range(n)]
    for _ in range(hidden):
        one = edited(base, edits)
        texts += [one, edited(one, 3)]
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [1 << 11, 16])
def test_a_family_hides_no_near_copies(spark, monkeypatch, block):
    texts = family(1200, 10, 150)
    pairs = similar_pairs(texts, 0.8)
    want = groups(texts, [(a, b) for a, b, _ in pairs])
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sure = [(a, b) for a, b, share in pairs if share >= 0.8]
    assert len(sure) >= 100
    assert sum(got[a] == got[b] for a, b in sure) >= 0.97 * len(sure)
    assert not any(got[i] == got[j] and want[i] != want[j] for i, j in ((i, got[i]) for i in texts))


def test_recall_on_ten_thousand_documents(spark, sf):
    path = f"{sf}/../sf0.1/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()}
    pairs = similar_pairs(texts, 0.8)
    want = groups(texts, [(a, b) for a, b, _ in pairs])
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.read.parquet(path)).collect()}
    near = [(a, b) for a, b, share in pairs if share < 1]
    assert len(near) >= 40
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * len(near)
    assert all(got[a] == got[b] for a, b, share in pairs if share == 1)
    assert all(want[i] == want[got[i]] for i in texts)  # nothing below the threshold is linked


def test_unrelated_texts_that_meet_hide_nothing():
    """Texts that share a variant with two near copies but have smaller ids."""
    key = np.zeros(4, np.uint64)
    check = np.array([0x5555555555555555, 0x3333333333333333, 0xFFFF, 0xFFFE], np.uint64)
    rows = nearcopies.collisions(key, check, np.array([1, 2, 10, 11]), 0, 2, 24, 18)
    assert [10, 11] in rows[:, 1:3].tolist() and (rows[:, 0] == 0).all()
    many = nearcopies.collisions(np.zeros(9, np.uint64), np.arange(9, dtype=np.uint64), np.arange(9), 0, 2, 24, 18)
    assert [r[1:3] for r in many.tolist() if r[0] == 0] == [[0, k] for k in range(1, 9)]
    assert sorted(r[1] for r in many.tolist() if r[0]) == list(range(9)) and len({r[0] for r in many.tolist()}) == 2


def test_a_pair_is_told_in_one_place():
    """Of all crowds in which two keys share a variant, just one is the first."""
    draw, width, bits = np.random.default_rng(8), 24, 3
    keys = draw.integers(0, 1 << 30, (60, 5)).astype(np.uint64) & np.uint64(0x70000F)
    balls = [[{int(k)} | {int(k) ^ 1 << i for i in range(width)} for k in row] for row in keys]
    for x in range(20):
        told = np.zeros(60, int)
        for t in range(5):
            for pattern in range(1 << bits):
                shares = np.array([any(v >> (width - bits) == pattern for v in balls[x][t] & balls[y][t]) for y in range(60)])
                first = nearcopies.first_meeting(keys, x, int(keys[x, t]), bits, pattern, width)
                same = np.array([t != u and keys[x, u] == keys[x, t] for u in range(5)]).any()
                assert same or not (first & ~shares).any()
                told += first & shares
        meets = np.array([any(balls[x][t] & balls[y][t] for t in range(5)) for y in range(60)])
        assert (told[meets] >= 1).all() and not told[~meets].any()


def test_expanding_by_parts_loses_nothing(monkeypatch):
    draw = np.random.default_rng(3)
    key = (draw.integers(0, 1 << 8, 400) << 12).astype(np.uint64) ^ draw.integers(0, 8, 400).astype(np.uint64)
    check, reps = np.zeros(400, np.uint64), np.arange(400)
    whole = [nearcopies.collisions(key, check, reps, p, 2, 24, 18) for p in range(4)]
    monkeypatch.setattr(nearcopies, "EXPANDED", 100)
    parts = [nearcopies.collisions(key, check, reps, p, 2, 24, 18) for p in range(4)]
    def met(rows):
        """All pairs that are told, or that a crowd compares."""
        found, crowds = set(), {}
        for crowd, a, b, _ in np.concatenate(rows).tolist():
            if crowd:
                crowds.setdefault(crowd, []).append((b, a))
            else:
                found.add((a, b))
        return found | {(min(a, b), max(a, b)) for c in crowds.values() for k, a in c for m, b in c if a != b and (k ^ m).bit_count() <= 2}

    every = {(i, j) for i in range(400) for j in range(i + 1, 400) if (int(key[i]) ^ int(key[j])).bit_count() <= 2}
    assert met(whole) == every and met(parts) == every

    fps = np.unique((draw.integers(0, 1 << 6, 300).astype(np.uint64) << np.uint64(40)) ^ draw.integers(0, 1 << 10, 300).astype(np.uint64))
    a, b = simhash._meet(0, fps, 4, 2, 4)
    monkeypatch.setattr(simhash, "EXPANDED", 1000)
    x, y = simhash._meet(0, fps, 4, 2, 4)
    assert groups(range(len(fps)), zip(a.tolist(), b.tolist())) == groups(range(len(fps)), zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("n", [10, 10_000, 10**6, 10**9])
def test_a_pair_at_the_threshold_meets_at_any_size(n):
    width, tables = nearcopies.tables_for(n, 0.8)
    keys, checks = nearcopies.chosen_bits(width, tables)
    assert keys.shape == (tables, width) and all(len(set(k)) == width and not set(k) & set(c) for k, c in zip(keys.tolist(), checks.tolist()))
    draw = np.random.default_rng(n)
    far = draw.random((4000, 1024)) < nearcopies.differing(0.8)
    assert (far[:, keys].sum(axis=2) <= nearcopies.NEAR).any(axis=1).mean() >= 0.95
    assert n * (width + 1) / 2**width <= 1 / 4
