"""Operator 12 against its SQL and against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import queries, topk
from tests.test_oracle import compare

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sound:
        if q is not None and q % every == 0:
            all_of = [(-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in sound if i != q]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(all_of)[:k])]
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_sql(spark, sf):
    compare(spark, sf, queries.op12_top_k, queries.oracle_sql()["op12_top_k"])


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 500)]  # one vector many times
    rows += [(500, None), (550, [0.1, None]), (600, [float("nan")] * 8), (650, [float("inf"), 0.0]), (700, []), (750, [0.3] * 3), (None, [0.5] * 8), (None, [2.0] * 8)]
    rows += [(-50, [-0.5] * 8), (800, [0.0] * 8), (850, [1e6] * 8), (851, [1e-9] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(k).alias(c) for k, c in enumerate("id row shard kind v raw asked score rank".split())])
    assert told(topk.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(df, F.lit(False)).collect() == []


def test_repeated_ids_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, -1.0])]
    got = told(topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    assert got == brute(rows) and len(got) == 6  # a list for each of the two rows, of the three others
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).collect() == []


def test_huge_components_stay_within_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [2.0, 7.0])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 2] and max(r.score for r in got) < 2**63


@pytest.mark.parametrize("kind", ["normal", "sparse", "ties", "positive", "large"])
def test_a_shard_against_all_its_rows(kind):
    draw = np.random.default_rng(7)
    for size in (1, 3, 5, 6, 40, 700):
        v = {
            "normal": lambda n: draw.normal(0, 40, (n, 24)),
            "sparse": lambda n: draw.normal(0, 40, (n, 24)) * (draw.random((n, 24)) < 0.1),
            "ties": lambda n: draw.integers(-1, 2, (n, 24)),
            "positive": lambda n: draw.integers(0, 9, (n, 24)),
            "large": lambda n: draw.integers(-(2**28), 2**28, (n, 24)),
        }[kind]
        ids = draw.permutation(size * 3)[:size].astype(np.int64)
        matrix = np.floor(v(size)).astype(np.int64)
        ids, weights, low, high = topk._index([(ids, matrix)])
        for query in np.floor(v(20)).astype(np.int64):
            own = int(ids[0])
            w = weights if topk._exact(query, low, high) else weights.astype(np.int64)
            got = topk.max_score(w, ids, query.astype(w.dtype), own, 5, low.astype(w.dtype), high.astype(w.dtype))
            every = [(-int(s), int(i)) for s, i in zip(query @ weights.astype(np.int64), ids) if i != own]
            assert [(-s, int(ids[r])) for r, s in got] == sorted(every)[:5]


def test_few_rows_are_scored_in_full():
    """The point of the method: most rows leave before their last dimensions."""
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 60, (8, 64))
    matrix = np.floor(centres[draw.integers(0, 8, 4000)] + draw.normal(0, 12, (4000, 64))).astype(np.int64)
    ids, weights, low, high = topk._index([(np.arange(4000), matrix)])

    class Counting(np.ndarray):
        probed = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, tuple) and len(key) == 2 and not isinstance(key[0], slice):
                Counting.probed += out.size
            return out

    for q in range(20):
        topk.max_score(weights.view(Counting), ids, weights[:, q].copy(), q, 5, low.astype(float), high.astype(float))
    assert Counting.probed < 20 * 4000 * 64 / 4
