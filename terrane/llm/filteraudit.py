"""What each filter removes in every order of a set of filters: a trie of permutations, walked depth first.

A node of the trie is the set of filters applied so far; orders that reach one set share its survivors, which are counted
once. The survivors of a node are its parent's without what one more filter removes, persisted while its branch is walked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.columns import UPPER, let, words
from terrane.functions.scratch import drop, materialize, materialize_at

def _text_flags(text: Column) -> Column:
    """A to D of the five filters, the words of a text being split once."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    counted = let(words(body), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.array_distinct(ws)).alias("distinct")))
    upper = F.char_length(body) - F.char_length(F.translate(body, UPPER, ""))
    return let(
        counted,
        lambda c: F.struct(
            (c["n"] < 50).alias("A"),
            (100 * c["distinct"] < 65 * c["n"]).alias("B"),
            (100 * upper > 5 * F.char_length(body)).alias("C"),
            body.rlike("[#$%&*|]").alias("D"),
        ),
    )


def flag_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``A`` to ``E`` (the row fails that filter), ``good`` and ``toxic`` for every row of ``docs``.

    A: under 50 words; B: distinct words under 65 %; C: capitals A-Z over 5 % of the code points; D: any of ``#$%&*|``;
    E: the text is that of a smaller id anywhere in the table. A null text is empty, so it equals an empty one; it fails A
    only, and E after the first. Rows that repeat an id with its text do not make each other fail E; rows without id never
    fail it, nor make others fail. A null source is the part of the empty one. Any label row of an id with quality 1 makes
    its rows good, with toxic 1 toxic; labels of no document say nothing. Whole texts are read, however long; they are
    compared by SHA-256, and only repeated digests are joined back, so that one text of a third of all rows is counted
    map-side and split by adaptive execution. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        _text_flags(F.col("text")).alias("f"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    flags = materialize(narrow.select("id", "part", "f.*", "digest"), "audit_flags")
    least = flags.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    marks = marks.where("id IS NOT NULL").groupBy("id").agg(F.coalesce(F.max("g"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    # Written first: a join whose two sides come straight from an exchange is one that adaptive execution can split.
    least = materialize(least, "audit_least")
    marks = materialize(marks.where("good OR toxic"), "audit_marks")
    joined = flags.join(least, "digest", "left").join(marks, "id", "left")
    return joined.select(
        "part",
        *"ABCD",
        F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")],
    )


def count_edges(rows: DataFrame, filters: Mapping[str, Column], losses: Mapping[str, Column]) -> DataFrame:
    """A row for every part, set of filters applied so far (``state``) and filter not yet applied (``nth``): what it removes there.

    ``rows`` has a ``part``; ``filters`` says by letter when a row fails, ``losses`` which removed rows are counted once more
    under that name; none of them may be null. ``state`` has bit k for the k-th filter. Of n filters the 2^n - 1 sets that leave one to
    apply are visited once each, depth first; at most n sets of survivors are persisted at a time, in memory or on disk, and what an
    executor loses is filtered again from the rows. Counts go to a table, never to the driver. Parts without survivors have no row.
    """
    spark, letters = rows.sparkSession, list(filters)
    counted = {"removed": F.lit(True), **losses}
    schema = f"part string, state int, nth int, survivors long, {', '.join(f'{c} long' for c in counted)}"
    _, folder = materialize_at(spark.createDataFrame([], schema), "audit_edges")
    seen: set[int] = set()

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [k for k in range(len(letters)) if not state >> k & 1]
        sums = [F.count_if(filters[letters[k]] & also).alias(f"{c}_{k}") for k in left for c, also in counted.items()]
        edges = [F.struct(F.lit(state).alias("state"), F.lit(k).alias("nth"), F.col("survivors"), *[F.col(f"{c}_{k}").alias(c) for c in counted]) for k in left]
        counts = held.groupBy("part").agg(F.count("*").alias("survivors"), *sums)
        counts.select("part", F.inline(F.array(*edges))).write.mode("append").parquet(folder)
        for k in left:
            if state | 1 << k not in seen and len(left) > 1:
                visit(held.where(~filters[letters[k]]), state | 1 << k)
        held.unpersist()

    visit(rows, 0)
    return spark.read.schema(schema).parquet(folder)


def audit(rows: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """For every part, order of the filters and step: counts of what the filter there keeps, removes and repeats.

    ``rows`` has a ``part``, a boolean column for each letter, ``good`` and ``toxic``, as :func:`flag_documents` makes them.
    ``redundant`` are rows that fail the step's filter and were removed before; ``unique_fails`` fail it only; ``shapley``
    is the sum of what it removes over all orders. All parts of the input have all orders and steps, zeros included;
    an empty table has no parts. All past the edges works on at most n * 2^(n-1) rows a part.
    """
    n = len(letters)
    edges = count_edges(rows, {x: F.col(x) for x in letters}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
    names = ("survivors", "removed", "good_lost", "toxic_lost")
    # A map by edge for every part: sets that none of its rows survives are absent and count zero.
    keyed = edges.select("part", F.struct((F.col("state") * n + F.col("nth")).alias("edge"), F.struct(*names).alias("v")).alias("e"))
    parts = keyed.groupBy("part").agg(F.map_from_entries(F.collect_list("e")).alias("at"))

    def value(state: int | Column, nth: int | Column, name: str) -> Column:
        return F.coalesce(F.col("at")[state * n + nth][name], F.lit(0).cast("long"))

    totals = []
    for k in range(n):
        before = [s for s in range(1 << n) if not s >> k & 1]
        orders = {s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) for s in before}
        shapley = sum((value(F.lit(s), k, "removed") * orders[s] for s in before), F.lit(0).cast("long"))
        fails, alone = value(F.lit(0), k, "removed"), value(F.lit(before[-1]), k, "removed")
        totals.append(F.struct(fails.alias("fails"), alone.alias("unique_fails"), shapley.alias("shapley")))
    steps = F.array(
        *[
            F.struct(F.lit("".join(letters[x] for x in p)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(x).alias("nth"), F.lit(sum(1 << y for y in p[:i])).alias("state"))
            for p in permutations(range(n))
            for i, x in enumerate(p)
        ]
    )
    wide = parts.select("part", "at", F.array(*totals).alias("total")).select("part", "at", "total", F.inline(steps))
    state, nth, total = F.col("state"), F.col("nth"), F.get("total", F.col("nth"))
    removed = value(state, nth, "removed")
    return wide.select(
        "part",
        "filter_order",
        "step",
        (value(state, nth, "survivors") - removed).alias("kept"),
        removed.alias("removed"),
        (total["fails"] - removed).alias("redundant"),
        total["unique_fails"].alias("unique_fails"),
        value(state, nth, "good_lost").alias("good_lost"),
        value(state, nth, "toxic_lost").alias("toxic_lost"),
        total["shapley"].alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit` of the five filters over ``docs``; the flags' table goes once the edges are counted."""
    rows, path = materialize_at(flag_documents(docs, labels), "audit_rows")
    out = audit(rows)
    drop(docs.sparkSession, path)
    return out
