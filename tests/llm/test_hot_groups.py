"""One document that holds thousands of items, and families of fingerprints that meet in one pattern."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute_force import components
from terrane.llm import decontaminate, simhash
from terrane.llm.components import connected_components


def test_a_document_that_holds_two_thousand_items(spark):
    draw = random.Random(2)
    items = [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(draw.randint(1, 40)))) for i in range(2000)]
    whole = " . ".join(t for _, t in items)
    docs = spark.createDataFrame([(1, whole), (2, items[7][1] + " and more"), (3, "none of it"), (1, whole), (None, items[5][1])], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.item_id)
    assert sorted(by[1]) == sorted(2 * list(range(2000))) and by[2] == [7] and by[None] == [5] and set(by) == {1, 2, None}
    assert {r.containment for r in got} == {1.0}


def test_a_text_is_copied_once_for_many_items(spark, monkeypatch):
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(900)]
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items))], "doc_id long, text string")
    rows = []
    real = spark.createDataFrame

    def count(df, *args):
        rows.append(df.count())
        return real([], "doc_id long, item_id long, containment double")

    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, __old=type(docs).mapInArrow: count(self) if "containment" in schema else __old(self, f, schema, *a))
    decontaminate.contaminated(docs, real(items, "item_id long, text string"))
    assert rows == [4]  # 900 items, 256 at once


def family(draw, n, base, spread):
    return {base ^ sum(1 << b for b in draw.sample(range(spread), draw.randint(0, 3))) for _ in range(n)}


@pytest.mark.parametrize("radius", [2, 3, 4])
def test_hot_patterns_are_dealt_further(spark, monkeypatch, radius):
    """With small bounds, so that a family of hundreds is a hot one, dealt three times over."""
    monkeypatch.setattr(simhash, "HOT", 40)
    monkeypatch.setattr(simhash, "HOT_TIMES", 0)
    draw = random.Random(radius)
    prints = sorted(family(draw, 500, draw.getrandbits(64), 64) | family(draw, 200, draw.getrandbits(64), 20) | {draw.getrandbits(64) for _ in range(100)})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)]
    df = spark.createDataFrame(rows, "fp long, rep long")
    half = (radius + 1) // 2
    dealt = simhash._dealt(df, 4, half, 40)
    assert {12, 20} <= {r.bits for r in dealt.select("bits").distinct().collect()}
    # Whatever its depth, a row stands for a pattern that its fingerprint's ball reaches.
    for r in dealt.limit(3000).collect():
        assert ((r.fp % (1 << 64) >> (64 - r.bits)) ^ r.pattern).bit_count() <= half
    found = {r.node: r.component for r in connected_components(simhash.links(df, len(prints), radius)).collect()}
    want = components(dict(enumerate(prints)), radius)
    assert {i: found.get(i, i) for i in want} == want


def test_a_family_of_a_hundred_thousand(spark):
    """The largest task's share of the rows, where one family is nearly all of the fingerprints."""
    draw = np.random.default_rng(8)
    base = int(draw.integers(0, 2**63))
    prints = np.unique(np.array([base ^ int(m) for m in np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (100_000, 5)).astype(np.uint64), axis=1)], np.uint64))
    df = spark.createDataFrame([(int(x.astype(np.int64)), i) for i, x in enumerate(prints)], "fp long, rep long").repartition(8)
    n = len(prints)
    bits = simhash.leading_bits(n, 2)
    plain = simhash._dealt(df, bits, 2, 1 << 60).groupBy("bits", "pattern").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    dealt = simhash._dealt(df, bits, 2, 20_000).groupBy("bits", "pattern").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert n > 95_000 and plain.most > 0.9 * n and dealt.most <= 20_000 and dealt.most / dealt.all < 0.01
