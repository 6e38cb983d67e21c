"""Hand-made cases of search, layers, decisions, changes, web and Cypher."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from terrane.operators import change, decision, layers, search, web
from terrane.plans.cypher import CypherError, Graph, parse


def docs(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")


def test_bm25(spark):
    d = docs(spark, "Alpha beta", "alpha alpha gamma", "delta", None, "")
    got = {r.id: r.score for r in search.bm25(d, "ALPHA gamma").collect()}
    assert set(got) == {"0", "1"} and got["1"] > got["0"]
    assert search.bm25(d, "").count() == 0
    assert search.bm25(d, "nothing").count() == 0
    assert search.top(search.bm25(d, "alpha"), 1).count() == 1


def test_tokens_and_identifiers(spark):
    r = spark.range(1).select(search.tokenize(F.lit("Ab c-D 数据 x1")).alias("t"), search.split_identifier(F.lit("HTTPClientFactory_v2Id")).alias("i")).first()
    assert r.t == ["ab", "数据", "x1"]
    assert r.i == ["http", "client", "factory", "v2", "id"]


def test_cosine(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("b", [1.0, 1.0])], "id string, vector array<float>")
    got = {r.id: r.score for r in search.vector_search(df, [2.0, 0.0]).collect()}
    assert got["a"] == pytest.approx(1) and got["z"] == 0 and got["b"] == pytest.approx(0.7071, abs=1e-4)


def test_contracts_and_dependencies(spark):
    rows = [("a", "b", "m1", "m2", "f"), ("a", "b", "m1", "m2", "e"), ("a", "c", "m1", "m1", "g")]
    calls = spark.createDataFrame(rows, "src string, dst string, src_module string, dst_module string, name string")
    got = layers.contracts(calls).first()
    assert (got.id, got.interface, got.n_calls) == ("m1--m2", "e,f", 2)
    deps = {r.module: (r.depends_on, r.depended_by) for r in layers.module_dependencies(calls).collect()}
    assert deps == {"m1": ("m2", ""), "m2": ("", "m1")}


def test_module_of(spark):
    got = spark.createDataFrame([("src/a.py",), ("setup.py",)], "p string").select(layers.module_of(F.col("p")).alias("m")).collect()
    assert [r.m for r in got] == ["src", "_root"]


def test_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "id string, hash string")
    b = spark.createDataFrame([("y", None), ("z", "4"), ("w", "5")], "id string, hash string")
    assert {r.id: r.status for r in change.diff(a, b).collect()} == {"x": "removed", "y": "unchanged", "z": "changed", "w": "added"}
    assert {r.status for r in change.diff(a, a.limit(0)).collect()} == {"removed"}


def test_churn(spark):
    rows = [("1", "m", "a"), ("2", "m", "b"), ("3", "m", "c"), ("1", "n", "a"), ("2", "n", "a"), ("3", "n", "a")]
    got = {r.id: r for r in change.churn(spark.createDataFrame(rows, "tag string, id string, hash string")).collect()}
    assert (got["m"].n_changes, got["m"].stability, got["n"].n_changes, got["n"].last_change) == (2, "volatile", 0, None)


def test_cochange_skips_large_commits(spark):
    rows = [(c, f) for c in (1, 2) for f in "ab"] + [(3, f) for f in "abcd"]
    got = change.cochange(spark.createDataFrame(rows, "commit int, file string"), most_files=3).collect()
    assert [(r.a, r.b, r.together) for r in got] == [("a", "b", 2)]


RANGES = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 9)), min_size=1, max_size=25)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(RANGES, RANGES)
def test_intervals_against_brute_force(spark, a, b):
    x = [(k, i, s, s + n) for i, (k, s, n) in enumerate(a)]
    y = [(k, i, s, s + n) for i, (k, s, n) in enumerate(b)]
    schema = "key int, {0} int, start int, end int"
    got = change.overlaps(spark.createDataFrame(x, schema.format("a_id")), spark.createDataFrame(y, schema.format("b_id")), 5)
    want = {(k, i, j) for k, i, s, e in x for q, j, t, f in y if k == q and s <= f and e >= t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    merged = change.merge_ranges(spark.createDataFrame(x, schema.format("a_id"))).collect()
    covered = lambda rs: {(k, p) for k, s, e in rs for p in range(s, e + 1)}
    assert covered([(r.key, r.start, r.end) for r in merged]) == covered([(k, s, e) for k, _, s, e in x])


def test_longest_prefix(spark):
    p = spark.createDataFrame([("a/b/c",), ("ab/c",), ("z",)], "path string")
    got = {r.path: r.prefix for r in change.longest_prefix(p, spark.createDataFrame([("a",), ("a/b",), ("z",)], "prefix string")).collect()}
    assert got == {"a/b/c": "a/b", "ab/c": None, "z": "z"}


def test_resolution_takes_the_best_tier(spark):
    refs = spark.createDataFrame([("r1", "f1", "x"), ("r2", "f2", "x"), ("r3", "f3", "x")], "ref string, file string, name string")
    syms = spark.createDataFrame([("s1", "f1", "x"), ("s2", "f9", "x")], "symbol string, file string, name string")
    imports = spark.createDataFrame([("f2", "f9")], "file string, target string")
    got = sorted((r.ref, r.symbol, r.confidence) for r in change.resolve(refs, syms, imports).collect())
    assert got == [("r1", "s1", 0.95), ("r2", "s2", 0.9), ("r3", "s1", 0.5), ("r3", "s2", 0.5)]


def test_latest_and_stale(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, None)], "key string, v int, x string")
    assert {r.key: r.x for r in change.latest(rows, "key", [F.col("v")]).collect()} == {"k": "b", "l": None}
    nodes = spark.createDataFrame([("a", "1", "1"), ("b", "1", None), ("c", "1", "2")], "id string, struct_hash string, source_hash string")
    assert {r.id: r.reason for r in change.stale(nodes).collect()} == {"b": "missing", "c": "outdated"}


def test_shape_check(spark):
    a = spark.createDataFrame([("/x", "id"), ("/x", "name"), ("/y", "k")], "route string, key string")
    b = spark.createDataFrame([("/x", "id"), ("/x", "age"), ("/y", "k")], "route string, key string")
    got = {r.route: (r.missing, r.status) for r in decision.shape_check(a, b).collect()}
    assert got == {"/x": ("age", "MISMATCH"), "/y": ("", "OK")}


def test_routes(spark):
    urls = spark.createDataFrame([(1, "/a/7"), (2, "/a/b/c"), (3, "/q"), (4, "/s/x/y"), (5, "/")], "url_id int, path string")
    routes = spark.createDataFrame([("/a/:id", 1), ("/:x", 2), ("/s/*", 3)], "route string, seq int")
    got = {r.url_id: r.route for r in web.match_routes(urls, routes).collect()}
    assert got == {1: "/a/:id", 3: "/:x", 4: "/s/*"}


def test_sections(spark):
    rows = [("d", 1, 1, 20), ("d", 3, 2, 20), ("d", 6, 3, 20), ("d", 9, 2, 20), ("d", 12, 1, 20)]
    got = {r.line: (r.end_line, r.parent) for r in web.sections(spark.createDataFrame(rows, "doc string, line long, level int, last long")).collect()}
    assert got == {1: (11, None), 3: (8, 1), 6: (8, 3), 9: (11, 1), 12: (20, None)}


def graph_of(spark):
    n = spark.createDataFrame([("a", "Function", "save", 1), ("b", "Function", "load", 9), ("f", "File", "x.py", 0)], "id string, label string, name string, line int")
    e = spark.createDataFrame([("a", "b", "CALLS", 0.9), ("f", "a", "DEFINES", 1.0), ("f", "b", "DEFINES", 1.0)], "src string, dst string, type string, confidence double")
    return Graph(n, e)


def test_cypher(spark):
    g = graph_of(spark)
    rows = lambda q: [tuple(r) for r in g.query(q).collect()]
    assert rows("MATCH (a:Function {name: 'save'})-[r:CALLS]->(b) RETURN b.name, r.confidence AS c") == [("load", 0.9)]
    assert rows("MATCH (f:File)-[:DEFINES]->(x)-[:CALLS]->(y), (f)-[:DEFINES]->(y) RETURN f.id AS f, y.id AS y") == [("f", "b")]
    assert rows("MATCH (f:File)-[*1..2]->(x) RETURN DISTINCT x.id AS id ORDER BY id") == [("a",), ("b",)]
    assert rows("MATCH (n:Function) WHERE n.line > 3 OR n.name STARTS WITH 'sa' RETURN count(n) AS n") == [(2,)]
    assert rows("MATCH (n:Function) WHERE NOT EXISTS { MATCH (n)-[:CALLS]->(m) } RETURN n.id AS id") == [("b",)]
    assert rows("MATCH (n) WHERE n.name = 'delete me' RETURN n.id") == []
    assert rows("MATCH (f:File)-[:DEFINES]->(x) RETURN f.id AS f, collect(x.name) AS xs, sum(x.line) AS s, min(x.line) AS lo, max(x.line) AS hi, avg(x.line) AS m") == [("f", ["load", "save"], 10, 1, 9, 5.0)]
    assert rows("MATCH (n) RETURN n.id AS id ORDER BY id SKIP 1 LIMIT 1") == [("b",)]
    assert rows("MATCH (a)-[r]->(b) RETURN b.id AS id, collect(DISTINCT r.type) AS t ORDER BY id DESC") == [("b", ["CALLS", "DEFINES"]), ("a", ["DEFINES"])]


@pytest.mark.parametrize("text", ["CREATE (n:X)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n.id", "MATCH (n) RETURN n.id; DROP TABLE x", "RETURN 1", "MATCH (n RETURN n.id"])
def test_cypher_reads_only(text):
    with pytest.raises((CypherError, IndexError)):
        parse(text)


def test_ranges_without_a_start_come_last_as_in_sql(spark, tmp_path):
    import duckdb

    from terrane.plans import registry

    rows = "(1, 1, '1995-01-05'), (2, 1, NULL), (3, 1, '1995-03-20'), (4, 2, NULL), (5, 2, NULL), (6, NULL, '1995-01-05'), (7, NULL, NULL), (8, 3, '1995-01-05'), (9, 3, '1995-02-01')"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, d::TIMESTAMP AS o_orderdate FROM (VALUES {rows}) t(k, c, d)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    want = con.execute(registry.oracle_sql()["range_merge"]).fetchall()
    got = [tuple(r) for r in registry.queries()["range_merge"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 6
