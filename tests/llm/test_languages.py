"""Language identification against plain loops over dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from terrane.llm import langid, queries


def grams(text):
    folded = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text)
    raw = (" " + " ".join(folded.split(" ")).strip() + " ").encode() if folded.strip(" ") else b"  "
    raw = b" ".join(x for x in raw.split(b" ") if x)
    raw = b" " + raw + b" "
    out = Counter()
    if len(raw) >= 3:
        for i in range(len(raw) - 1):
            out[(int.from_bytes(raw[i : i + 2], "big") * 0x85EBCA6B & 0xFFFFFFFF) >> 18] += 1
        for i in range(len(raw) - 2):
            out[(int.from_bytes(raw[i : i + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 18] += 1
    return out


def test_against_plain_loops(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in docs}
    counts = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and d["text"] is not None and not held[d["doc_id"]]:
            counts[d["lang"]].update(grams(d["text"]))
    names, bins = sorted(counts), 1 << 14
    total = {x: sum(counts[x].values()) + 0.01 * bins for x in names}
    share = {x: [(counts[x][b] + 0.01) / total[x] for b in range(bins)] for x in names}
    code = langid.codewords(len(names)).tolist()
    bits = []
    for k in range(len(code[0])):
        sides = {s: [share[x] for x, row in zip(names, code) if row[k] == s] for s in (1, -1)}
        mean = {s: [sum(v) / len(v) for v in zip(*rows)] for s, rows in sides.items()}
        weight = [math.log(a) - math.log(b) for a, b in zip(mean[1], mean[-1])]
        margin = [sum(p * w for p, w in zip(share[x], weight)) for x in names]
        scale = sum(map(abs, margin)) / len(names)
        trust = min(1.0, max(0.0, min(row[k] * m / scale for row, m in zip(code, margin))))
        bits.append((weight, scale, trust))
    whole = sum(t for *_, t in bits)
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    assert {i: r.held_out for i, r in got.items()} == held
    for d in docs:
        text = d["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (got[d["doc_id"]].lang_pred, got[d["doc_id"]].score) == ("und", 0.0)
            continue
        found = grams(text)
        n = sum(found.values())
        margins = [sum(c * w[b] for b, c in found.items()) / n / s for w, s, _ in bits]
        loss = {x: sum(math.log1p(math.exp(-4.0 * c * m)) * t * len(bits) / whole for c, m, (_, _, t) in zip(row, margins, bits)) for x, row in zip(names, code)}
        best = min(names, key=lambda x: (loss[x], x))
        assert got[d["doc_id"]].lang_pred == best
        assert got[d["doc_id"]].score == pytest.approx(1 / sum(math.exp(loss[best] - v) for v in loss.values()), abs=1e-4)
