"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match. Weak candidates (account names, random-looking tokens, endpoints) are
reported only when complementary parts co-occur: an interval join links identifiers, secrets and endpoints that lie
within a window of each other in one scope, a paragraph.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.textmap import map_texts

# Patterns over UTF-8 bytes, where letters are ASCII letters and "either case" means just those.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
NAMED = re.compile(rb"(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@+-]{3,})")
OPAQUE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(rb"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}")
CLOUD, LABEL, MOST_LABELS = b".amazonaws.com", frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789-"), 8
BLANK = re.compile(rb"\n[ \t\r]*\n")
#: In this order where spans start alike; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
NAMES = (b"user", b"login", b"account", b"client", b"access")
#: Code points between linked parts, and bits per character of a weak secret.
WINDOW, MIN_ENTROPY = 300, 3.5
_RUNS = bytes(49 if chr(b).isalnum() and b < 128 or b in b"+/_=-" else 48 for b in range(256))

Span = tuple[int, int, int]  # start, kind, end


def base_spans(raw: bytes, low: bytes, long_run: bool) -> list[Span]:
    """Strong matches in bytes: leftmost and non-overlapping within a kind; those that are too short are dropped afterwards."""
    found: list[Span] = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    if long_run:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= 32]
    return found


def entropy(token: bytes) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def weak_spans(raw: bytes, low: bytes, long_run: bool) -> list[Span]:
    """Candidates that say little alone."""
    found: list[Span] = []
    if any(k in low for k in NAMES):
        found += [(m.start(), 3, m.end()) for m in NAMED.finditer(raw)]
    if long_run:
        for m in OPAQUE.finditer(raw):
            token = m[0]
            if any(48 <= b <= 57 for b in token) and any(b > 64 for b in token) and entropy(token) >= MIN_ENTROPY:
                found.append((m.start(), 4, m.end()))
    found += endpoints(raw)
    return found


def endpoints(raw: bytes) -> list[Span]:
    """Addresses with a scheme, and host names of a cloud: from each such suffix, up to ``MOST_LABELS`` labels to its left."""
    found = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(raw)] if b"://" in raw else []
    taken, k, floor, at = found.copy(), 0, 0, raw.find(CLOUD)
    while at >= 0:
        while k < len(taken) and taken[k][2] <= at:
            floor, k = max(floor, taken[k][2]), k + 1
        end = at + len(CLOUD)
        if k == len(taken) or taken[k][0] >= end:
            start, labels, left = at, 0, at
            while left > floor and labels < MOST_LABELS and raw[left - 1] in LABEL:
                while left > floor and raw[left - 1] in LABEL:
                    left -= 1
                start, labels = left, labels + 1
                if left > floor and raw[left - 1] == 46:
                    left -= 1
            if labels:
                found.append((start, 5, end))
            floor = end
        at = raw.find(CLOUD, end)
    return found


def link(strong: list[Span], weak: list[Span], breaks: list[int], window: int = WINDOW) -> tuple[list[Span], int]:
    """The weak spans that have complementary parts, and the number of linked credentials.

    Parts are joined if they lie in one scope (no break between them) and at most ``window`` apart. A weak identifier
    needs a secret, a weak secret an identifier, and an endpoint a secret that has an identifier or that is strong.
    Each looks only for the part that starts next and the one that reaches farthest of those before it, so the work is
    one sweep however many parts there are.
    """
    starts = sorted(s for s, *_ in strong)
    reach = list(accumulate((e for *_, e in sorted(strong)), max))

    def free(x: Span) -> bool:
        k = bisect_left(starts, x[2])
        return k == 0 or reach[k - 1] <= x[0]

    weak = [x for x in weak if free(x)]
    names = sorted([x for x in strong if x[1] == 1] + [x for x in weak if x[1] == 3])
    secrets = sorted([x for x in strong if x[1] in (0, 2)] + [x for x in weak if x[1] == 4])

    def farthest(spans: list[Span]) -> list[Span]:
        return list(accumulate(spans, lambda y, z: max(y, z, key=lambda w: (w[2], w[0]))))

    def near(x: Span, others: list[Span], reaching: list[Span]) -> list[Span]:
        at = bisect_left(others, x)
        out = []
        for y in {*others[max(0, at - 1) : at + 1], *reaching[max(0, at - 1) : at]}:
            gap = max(x[0], y[0]) - min(x[2], y[2])
            first, second = min(x, y), max(x, y)
            if y != x and gap <= window and bisect_right(breaks, first[0]) == bisect_right(breaks, second[0]):
                out.append(y)
        return out

    told, pairs = set(), 0
    far_names, far_secrets = farthest(names), farthest(secrets)
    for x in secrets:
        partners = near(x, names, far_names)
        pairs += bool(partners)
        if partners:
            told |= {x, *partners}
    for x in names:
        partners = near(x, secrets, far_secrets)
        if partners:
            told |= {x, *partners}
    good = sorted(x for x in secrets if x in told or x[1] != 4)
    far_good = farthest(good)
    told |= {x for x in weak if x[1] == 5 and near(x, good, far_good)}
    return [x for x in weak if x in told], pairs


def scan(raw: bytes | None) -> tuple[int, int, int, str, str, int, int]:
    """Counts of strong spans, their digest, all spans, the number of weak spans told, and of linked credentials."""
    raw = raw or b""
    low = raw.lower()
    long_run = b"1" * 20 in raw.translate(_RUNS)
    strong = base_spans(raw, low, long_run)
    weak = weak_spans(raw, low, long_run)
    if not strong and not weak:
        return 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0
    breaks = [m.start() for m in BLANK.finditer(raw)]
    if not raw.isascii():
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        at = lambda spans: [(int(chars[s]), k, int(chars[e])) for s, k, e in spans]
        strong, weak, breaks = at(strong), at(weak), [int(chars[b]) for b in breaks]
    strong.sort()
    more, pairs = link(strong, weak, breaks)
    say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    count = Counter(k for _, k, _ in strong)
    digest = hashlib.sha256(say(strong).encode()).hexdigest()
    return count[0], count[1], count[2], digest, say(sorted(strong + more)), len(more), pairs


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``, ``n_weak``, ``n_linked`` for every row.

    Spans are kind:start:end in code points, end exclusive, ordered by start, then kind. A null text counts as empty
    and has no spans; very long texts are read whole, in time in proportion to their length; null ids and repeated rows come back as
    they are; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    i, s = pa.int64(), pa.string()
    return map_texts(
        docs,
        id_col,
        text_col,
        lambda: scan,
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long, n_linked long",
        [i, i, i, s, s, i, i],
    )
