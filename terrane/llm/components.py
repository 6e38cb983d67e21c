"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrane.functions.scratch import drop, materialize_at


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (``a``, ``b``: long).

    Each round is two minimum aggregations, combined map-side, and two equi-joins, whose hot keys adaptive execution
    splits; nothing is gathered into one task or the driver but a count and a checksum. Null ends and loops are
    ignored; repeated edges do no harm; no edges give no rows. Rounds go on until one changes nothing.
    """
    spark = edges.sparkSession
    flat = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, path = materialize_at(flat.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = _sign(now)
    was = None
    while seen[0] and seen != was:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        )
        later, there = materialize_at(small.select("u", "v").distinct(), "cc")
        drop(spark, path)
        now, path, was, seen = later, there, seen, _sign(later)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def _sign(df: DataFrame) -> tuple[int, int | None]:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x
