"""Sources, the store, names and the tools."""

import pytest
from pyspark.sql import functions as F

from terrane.functions import names
from terrane.plans import api
from terrane.sources import code, store


def test_files_and_languages(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("def f():\n    return g()\n\nclass C(B):\n    def m(self):\n        if 1:\n            f()\n")
    (tmp_path / "big.bin").write_bytes(b"0" * 100)
    found = {r.path.rsplit("/", 1)[-1] for r in code.scan_files(spark, str(tmp_path), 99 + 0).collect()}
    assert found == {"x.py"}
    facts = code.python_facts(code.read_files(spark, f"{tmp_path}/a")).collect()
    nodes = {r.name: (r.label, r.exported) for r in facts if r.kind == "node"}
    assert nodes["f"] == ("Function", True) and nodes["m"] == ("Method", True) and nodes["C"] == ("Class", True)
    assert {(r.dst, r.type) for r in facts if r.kind == "edge"} >= {("g", "CALLS"), ("f", "CALLS"), ("B", "EXTENDS")}
    df = spark.createDataFrame([("src/a.ts",), ("Makefile",), ("x/node_modules/y.js",), ("z.unknown",)], "p string")
    got = df.select(code.language(F.col("p")).alias("l"), code.ignored(F.col("p")).alias("i")).collect()
    assert [r.l for r in got] == ["typescript", "make", "javascript", None] and [r.i for r in got] == [False, False, True, False]


def test_json_both_ways(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 1}\n{bad\n{"x": 3}\n')
    assert [r.x for r in code.json_rows(spark, f"{tmp_path}/a.json", "x long").collect()] == [1, 2]
    assert [(r.x, r.status) for r in code.json_rows(spark, f"{tmp_path}/b.json", "x long").collect()] == [(1, "complete"), (None, "partial"), (3, "complete")]


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "seq int, value string")


def test_git_text(spark):
    log = lines(spark, "commit aaa\n\nx.py\ny.py\ncommit bbb\nx.py")
    assert {(r.commit, r.file) for r in code.git_log(log).collect()} == {("aaa", "x.py"), ("aaa", "y.py"), ("bbb", "x.py")}
    diff = lines(spark, "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+new\n@@ -9 +12 @@\n@@ -20,2 +22,0 @@\n--- a/y\n+++ b/y\n@@ -1 +1,2 @@")
    assert {(r.file, r.start, r.end) for r in code.diff_hunks(diff).collect()} == {("x.py", 3, 6), ("x.py", 12, 12), ("y", 1, 2)}
    assert [r.line for r in code.added_lines(diff).collect()] == ["new"]


def test_headings_skip_fences(spark):
    df = spark.createDataFrame([("a.md", "# One\n```\n# no\n```\n## Two ##\n#none")], "path string, text string")
    assert [(r.line, r.level, r.title) for r in code.headings(df).orderBy("line").collect()] == [(1, 1, "One"), (5, 2, "Two")]


def facts(spark):
    n = spark.createDataFrame([("a", "Function", "save", "x.py", 1, 5), ("b", "Function", None, "y.py", 1, 9), ("r", "Route", "/x", "", 0, 0)], "id string, label string, name string, filePath string, startLine long, endLine long")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("a", "gone", "CALLS"), ("b", "r", "HANDLES_ROUTE")], "`from` string, `to` string, type string")
    return n, e


def test_store(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.nodes().count() == 0
    n, e = facts(spark)
    assert s.write_facts(n, e) and not s.write_facts(n.orderBy(F.desc("id")), e)
    assert {r.name for r in s.nodes("Function").collect()} == {"save", "b"}
    assert s.edges().count() == 2
    s.delete_files(spark.createDataFrame([("x.py",)], "filePath string"))
    assert {r.id for r in s.nodes().collect()} == {"b", "r"} and s.edges().count() == 1
    art = lambda *rows: spark.createDataFrame(rows, "id string, layer string, structHash string, payload string")
    s.upsert(art(("m 1", "module", "h1", "{}"), ("c", "concept", "h", "{}")))
    s.upsert(art(("m 1", "module", "h2", "{}")))
    assert [(r.key, r.structHash) for r in s.artifacts("module").collect()] == [("module:m+1", "h2")]
    s.snapshot("v1", "2024-01-01")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        s.snapshot("v1", "2024-01-02")
    s.delete(spark.createDataFrame([("module:m+1",)], "key string"))
    assert [r.layer for r in s.artifacts().collect()] == ["concept"]
    assert s.snapshots().count() == 2
    s.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 2


def test_projection_first_wins(spark):
    df = spark.createDataFrame([("a", "F", "one", 1), ("a", "F", "two", 0)], "id string, label string, name string, seq long")
    assert [r.name for r in store.project_nodes(df).collect()] == ["two"]


def test_cache_and_supplement(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    hit, miss = store.cache_hits(files, spark.createDataFrame([("a", "1"), ("b", "9")], "path string, content_hash string"))
    assert [r.path for r in hit.collect()] == ["a"] and [r.path for r in miss.collect()] == ["b"]
    n, _ = facts(spark)
    assert {r.id for r in store.supplement(n, files).where("label = 'File'").collect()} == {"File:a", "File:b"}


def test_names(spark):
    r = spark.range(1).select(
        names.kebab(F.lit("HTTPClient v2")).alias("k"), names.page_route(F.lit("src/pages/api/[id]/index.ts")).alias("p"), names.page_route(F.lit("app/x/[...all]/page.tsx")).alias("q"),
        names.fetch_url(F.lit("https://h/api/${id}/?x=1")).alias("u"), names.is_test_file(F.lit("tests/b.py")).alias("t"), names.is_test_path(F.lit("a/b_test.go")).alias("t2"),
        names.reason_keys(F.lit("fetch|keys:b,a")).alias("r"), names.accessed_keys(F.lit("data.name; res.json(); result.id")).alias("a"), names.json_strings(F.lit('{"k": ["x", "y"], "z": "w"}')).alias("j"),
        names.starts_with_path(F.lit("./a/b"), F.lit("a/")).alias("s"), names.estimate_tokens(F.lit("abcde")).alias("e"),
    ).first()
    assert (r.k, r.p, r.q, r.u) == ("http-client-v2", "/api/:id", "/x/*", "/api/:param")
    assert r.t and r.t2 and r.s and (r.r, r.a, r.j, r.e) == (["a", "b"], ["id", "name"], ["x", "y", "w"], 2)


def test_tools(spark):
    n, e = facts(spark)
    e = e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "type", F.lit(1.0).alias("confidence"))
    hunks = spark.createDataFrame([("y.py", 4, 6)], "file string, start long, end long")
    assert {(r.id, r.how) for r in api.detect_changes(hunks, n, e).collect()} == {("b", "changed"), ("a", "affected")}
    assert [(r.route, r.handlers) for r in api.route_map(n, e).collect()] == [("r", ["b"])]
    assert {(r.id, r.risk) for r in api.impact(e, n.where("id = 'a'").select("id")).collect()} == {("b", "MEDIUM"), ("gone", "MEDIUM"), ("r", "MEDIUM")}
    old = spark.createDataFrame([("m", "1"), ("m", "2"), ("m", "3")], "module string, file string")
    new = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "module string, file string")
    assert [tuple(r) for r in api.migrate_annotations(old, new).collect()] == [("m", "x")]
    contracts = spark.createDataFrame([("a--b", ["a", "c"])], "id string, mods array<string>")
    assert [tuple(r) for r in api.rename_module(contracts, "a", "z", ["id", "mods"]).collect()] == [("z--b", ["z", "c"])]
    assert api.markdown(old.limit(1)) == "| module | file |\n| --- | --- |\n| m | 1 |"
    g = spark.createDataFrame([("a", "b", 2)], "source string, target string, weight int")
    assert api.mermaid(g) == 'graph LR\n  n0["a"]\n  n1["b"]\n  n0 -->|2| n1'


def test_a_value_is_carried_along_any_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(code, "ALONG", 4)
    rows = [(k, v) for k, v in enumerate([None, None, "a", None, None, None, None, None, None, None, "b", None, "c", None])] + [(40, None), (41, "d")]
    lines = spark.createDataFrame(rows, "seq long, v string").repartition(3)
    got = [r.x for r in code.carried(lines, F.col("v"), "x").orderBy("seq").collect()]
    assert got == [None, None, *["a"] * 8, "b", "b", "c", "c", "c", "d"]


def test_a_change_with_all_that_it_reaches(spark):
    t = spark.createDataFrame
    hunks = t([("a.py", 1, 4), ("a.py", 3, 6), ("b.py", 90, 99)], "file string, start long, end long")
    nodes = t([("f", "Function", "a.py", 5, 9), ("g", "Function", "a.py", 7, 9), ("File:a", "File", "a.py", 1, 99), ("x", "Method", "b.py", 1, 89)], "id string, label string, filePath string, startLine long, endLine long")
    edges = t([("c1", "f", "CALLS", 1.0, 0), ("c2", "c1", "CALLS", 1.0, 0), ("c3", "c2", "QUERIES", 1.0, 0), ("f", "p", "STEP_IN_PROCESS", 1.0, 2)], "src string, dst string, type string, confidence double, step int")
    row = api.change_summary(hunks, nodes, edges).first()
    assert (row.changed, row.affected, row.processes, row.risk) == (1, 2, 1, "MEDIUM")
    told = [r.r for r in t([(0, 0), (9, 0), (10, 0), (0, 9), (49, 9), (50, 0), (0, 10)], "a int, p int").select(api.diff_risk(F.col("a"), F.col("p")).alias("r")).collect()]
    assert told == ["LOW", "LOW", "MEDIUM", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
