"""The plan of line dedup, and the order that it reads."""

import random
import re

from pyspark.sql import functions as F

from terrane.llm import linededup


def lines(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(9), draw.randrange(400) * 7, draw.randrange(30)) for _ in range(6000)]
    return spark.createDataFrame([(k, -k, d // 700, d, p) for k, d, p in rows], "h1 long, h2 long, span int, doc_id long, pos int"), rows


def test_first_occurrences(spark):
    df, rows = lines(spark)
    want = {}
    for k, d, p in rows:
        want[k, d] = min(p, want.get((k, d), p))
    got = linededup.first_occurrences(df).collect()
    assert len(got) == len(want) and {(r.h1, r.doc_id): r.pos for r in got} == want


def test_the_sorted_ranges_are_read_as_they_are(spark):
    df, _ = lines(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = linededup.first_occurrences(df).groupBy("h1", "h2", "span").agg(F.count("*"), F.max("doc_id"))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and "rangepartitioning(h1" in plan
    assert plan.count("Sort [") == 1 and re.search(r"Sort \[h1#\d+L? ASC NULLS FIRST, h2#\d+L? ASC NULLS FIRST, span#\d+ ASC NULLS FIRST, doc_id#\d+L? DESC NULLS LAST, pos#\d+ ASC", plan)
    assert plan.index("Window") < plan.index("Sort [") < plan.index("rangepartitioning")
