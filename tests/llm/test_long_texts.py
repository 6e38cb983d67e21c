"""Notices in a row, edited notices, and texts made to be slow."""

import random
import time

import pytest

from terrane.llm import licensescan, secretscan
from terrane.llm.decontaminate import tokens


@pytest.fixture(scope="module")
def scan():
    return licensescan.scanner(licensescan.TEMPLATES, 0.8)


@pytest.mark.parametrize("name", ["CC-BY-4.0", "MIT-notice", "MIT", "Apache-2.0-notice"])
@pytest.mark.parametrize("n", [1, 2, 50])
def test_notices_in_a_row_are_all_told(scan, name, n):
    got = scan(" ".join([licensescan.TEMPLATES[name] + "."] * n).encode())
    assert (got[0], got[1]) == (n, name)
    assert all(a["end"] <= b["start"] for a, b in zip(got[2], got[2][1:]))


@pytest.mark.parametrize("name", sorted(licensescan.TEMPLATES))
def test_every_copy_with_a_fifth_of_its_words_changed_is_told(scan, name):
    draw, words = random.Random(name), [w.decode() for w in tokens(licensescan.TEMPLATES[name].encode())]
    for _ in range(30):
        copy = list(words)
        for at in draw.sample(range(len(words)), int(0.2 * len(words) + 1e-9)):
            copy[at] = "qqq"
        assert scan(("begin " * 9 + " ".join(copy) + " end" * 9).encode())[0], copy


def test_one_word_of_five(scan):
    assert scan(b"Released under an MIT License")[1] == "MIT-notice"


def test_endpoints():
    told = lambda t: [t[s:e] for s, _, e in secretscan.endpoints(t)]
    assert told(b"at s3.eu-1.amazonaws.com, https://x.amazonaws.com/y and a.b.c.d.e.f.g.h.i.j.amazonaws.com") == [
        b"https://x.amazonaws.com/y", b"s3.eu-1.amazonaws.com", b"c.d.e.f.g.h.i.j.amazonaws.com"]
    assert told(b".amazonaws.com a.amazonaws.com.amazonaws.com") == [b"a.amazonaws.com"]


SLOW = {
    "letters": b"://" + b"a" * 1_000_000,
    "dots": b"://" + b"a." * 500_000 + b"amazonaws.com",
    "hosts": b"a.amazonaws.com" * 60_000,
    "keys": b"secret " * 140_000,
    "spaces": b"token" + b" " * 1_000_000,
    "parts": b"user=abc secret=0123456789abcdef0123 " * 25_000,
}


@pytest.mark.parametrize("name", SLOW)
def test_a_megabyte_for_secrets(name):
    began = time.process_time()
    secretscan.scan(SLOW[name])
    assert time.process_time() - began < 4


def test_a_megabyte_of_notices(scan):
    began = time.process_time()
    assert scan(b"Licensed under CC BY 4.0. " * 40_000)[0] == 40_000
    assert time.process_time() - began < 15
