"""Operator 11 against its SQL and against plain loops over all orders."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from terrane.llm import filteraudit, queries
from tests.test_oracle import compare

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "long text here " * 40_000
PLAIN = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, PLAIN, "s"),
    (2, PLAIN, "s"),
    (2, PLAIN, "s"),
    (3, None, None),
    (4, "", ""),
    (5, LONG, "s"),
    (6, PLAIN.upper(), "t"),
    (7, PLAIN + " #", "t"),
    (None, PLAIN, "t"),
    (None, None, None),
    (8, "a " * 80, "u"),
    (9, "Ä é " * 30 + "|", "u"),
    (10, "three words only", "v"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (5, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1)]


def failing(text, ident, rows):
    text, words = text or "", WORDS.findall(text or "")
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if ident is not None and any(i is not None and i < ident and (t or "") == text for i, t, _ in rows) else "")


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out, docs = {}, [(s or "", failing(t, i, rows), i in good, i in toxic) for i, t, s in rows]
    shapley = Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            here = [d for d in docs if d[0] == part]
            gone = []
            for k, x in enumerate(order):
                now = [d for d in here if x in d[1]]
                here = [d for d in here if x not in d[1]]
                shapley[part, x] += len(now)
                alone = sum(d[0] == part and d[1] == x for d in docs)
                out[part, "".join(order), k + 1] = [len(here), len(now), sum(x in d[1] for d in gone), alone, sum(d[2] for d in now), sum(d[3] for d in now)]
                gone += now
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_against_sql(spark, sf):
    compare(spark, sf, queries.op11_filter_audit, queries.oracle_sql()["op11_filter_audit"])


def test_odd_rows_against_all_orders(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    # Clashing names play no part.
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate("A B part digest good least id f state nth at".split())])
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1))
    got = told(filteraudit.audit_documents(docs, labels))
    assert len(got) == 600 * 5 and got == brute(ROWS, LABELS)
    assert filteraudit.audit_documents(docs.limit(0), labels).count() == 0
    bare = told(filteraudit.audit_documents(docs, labels.limit(0)))
    assert all(v[4:6] == (0, 0) and v[:4] == got[k][:4] for k, v in bare.items())


@pytest.mark.parametrize("letters", ["A", "ABC"])
def test_each_set_of_filters_is_counted_once(spark, letters):
    rows = spark.range(40).select(F.lit("p").alias("part"), *[(F.col("id") % (k + 2) == 0).alias(x) for k, x in enumerate(letters)], F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    edges = filteraudit.count_edges(rows, {x: F.col(x) for x in letters}, {"good_lost": F.col("good")})
    n = len(letters)
    assert edges.count() == edges.select("state", "nth").distinct().count() == n * 2 ** (n - 1)
    out = told(filteraudit.audit(rows, letters))
    first = {order: v for (_, order, step), v in out.items() if step == 1}
    assert all(v[1] == rows.where(order[0]).count() == v[4] for order, v in first.items())


def test_no_survivors_are_kept_behind(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    filteraudit.audit_documents(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
