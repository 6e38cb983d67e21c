"""Running totals of buckets in two levels."""

import random

from pyspark.sql import functions as F

from terrane.llm import mixing


def test_starts_over_many_shelves(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(r, b, b // 7, draw.randrange(100)) for r in range(3) for b in range(100) if draw.random() < 0.8]
    want = {(r, b): sum(w for x, y, _, w in rows if x == r and y < b) for r, b, _, _ in rows}
    got = mixing._starts(spark.createDataFrame(rows, "rank long, bucket long, shelf long, words long")).collect()
    assert {(x["rank"], x["bucket"]): x["start"] for x in got} == want


def test_rows_without_id_are_spread(spark):
    rows = [(None, f"text number {k} of a row without id", "s") for k in range(500)]
    got = spark.createDataFrame(rows, "doc_id long, text string, source string").select(mixing._order(F.col("doc_id"), F.col("text")).alias("u")).distinct()
    assert got.count() == 500
