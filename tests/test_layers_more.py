"""Lint, processes, labels, extraction, index and changes on literal cases."""

from pyspark.sql import functions as F

from terrane.functions import extract, names
from terrane.operators import index, lint, processes


def test_lint(spark):
    d = spark.createDataFrame
    nodes = d([("module", "a", "1", "1"), ("module", "b", "1", "0"), ("module", "_root", "1", None), ("concept", "c", "1", "2")], "layer string, id string, struct_hash string, source_hash string")
    notes = d([("module", "a", 0, True, None), ("module", "a", 1, False, "x")], "layer string, id string, nth int, stale boolean, reason string")
    mf = d([("a", "x.py"), ("b", "y.py"), ("_root", "z.py")], "module string, file string")
    deps = d([("_root", "_root")], "module string, on string")
    files = d([("x.py",), ("z.py",), *[(f"u{k:02}.py",) for k in range(23)]], "file string")
    contracts = d([("k", "a", "nowhere")], "id string, provider string, consumer string")
    steps = d([("f", "a"), ("f", "q"), ("f", "p"), ("g", None), ("g", "")], "flow string, module string")
    out = lint.lint(nodes, notes, mf, deps, files, d([("c", "gone.py")], "concept string, file string"), contracts, steps).collect()
    got = sorted((r.type, r.node_id) for r in out if r.type != "UNCOVERED_FILE")
    assert got == [
        ("CONTRACT_MODULE_MISSING", "k"), ("FLOW_MODULE_MISSING", "f"), ("HIGH_STALENESS", "_map"), ("MISSING_CONCEPT_REF", "c"), ("MISSING_FILE", "b"),
        ("ORPHAN_MODULE", "a"), ("ORPHAN_MODULE", "b"), ("STALE_ANNOTATION", "a"), ("STALE_ENRICHMENT", "b"), ("STALE_ENRICHMENT", "c"),
    ]
    loose = [r for r in out if r.type == "UNCOVERED_FILE"]
    assert len(loose) == 21 and [r.message for r in loose if r.node_id == "_summary"] == ["3 more uncovered source files (only first 20 shown)"]
    assert [r.message for r in out if r.type == "HIGH_STALENESS"][0].startswith("Map staleness: HIGH (33%")


def test_processes(spark):
    assert [processes.most_processes(n) for n in (0, 204, 205, 9999)] == [20, 20, 21, 300]
    edges = spark.createDataFrame([("a", "b", "CALLS", 0.9), ("b", "c", "CALLS", None), ("b", "d", "CALLS", 0.4), ("a", "c", "CALLS", 1.0), ("b", "e", "IMPORTS", 1.0)], "src string, dst string, type string, confidence double")
    sure = processes.calls(edges)
    assert {tuple(r) for r in sure.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    found = processes.traces(sure, spark.createDataFrame([("a",)], "id string"), depth=5)
    assert [r.path for r in found.collect()] == [["a", "b", "c"]]
    nodes = spark.createDataFrame([("a", "handleAll now"), ("c", "save")], "id string, name string")
    one = processes.processes(found, nodes, spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, community string"), 20)
    r = one.first()
    assert (r.process, r.label, r.kind, r.step_count, r.communities) == ("proc_0_handleall_now", "HandleAll now → Save", "cross_community", 3, "x,y")
    assert [tuple(x) for x in processes.steps(one).orderBy("step").collect()] == [(r.process, 1, "a"), (r.process, 2, "b"), (r.process, 3, "c")]


def test_a_dense_graph_keeps_the_first_traces(spark):
    edges = spark.createDataFrame([("s", f"m{i}") for i in range(5)] + [(f"m{i}", f"t{j}") for i in range(5) for j in range(5)], "src string, dst string")
    got = sorted(r.path for r in processes.traces(edges, spark.createDataFrame([("s",)], "id string")).collect())
    assert got == [["s", f"m{i}", f"t{j}"] for i in range(3) for j in range(4)]


def test_labels(spark):
    rows = [(1, "a", "app/web/x.py"), (1, "b", "app/web/y.py"), (1, "c", "app/src/z.py"), (2, "loadUser", "src/x.py"), (2, "loadItem", "src/y.py"), (2, "loadAll", None), (3, "q", "x.py"), (3, None, "y.py")]
    got = processes.community_labels(spark.createDataFrame(rows, "community int, name string, path string")).collect()
    assert {r.community: r.label for r in got} == {1: "Web", 2: "Load", 3: "Cluster_3"}
    rows = [("m", "getUser"), ("m", "user_list"), ("m", "orderList"), ("n", "getData"), ("n", None)]
    got = processes.module_labels(spark.createDataFrame(rows, "module string, name string")).collect()
    assert {r.module: r.label for r in got} == {"m": "user", "n": "misc"}


def test_extraction(spark):
    code = "a\nprisma.user.findMany (x); prisma.post\n.create()\nprisma.order.count(\n)\nsupabase.from('t').select('*')"
    files = spark.createDataFrame([("f", code), ("g", None), ("h", "nothing")], "path string, content string")
    assert [tuple(r) for r in extract.orm_queries(files).orderBy("orm", "line").collect()] == [("f", "prisma", "user", "findMany", 1), ("f", "prisma", "order", "count", 3), ("f", "supabase", "t", "select", 5)]
    tool = "{ name: 'find_it',\n description: `Finds\n it` , inputSchema: {} }"
    files = spark.createDataFrame([("lib/tools.ts", tool), ("a/tool.js", tool.replace("Finds", "First")), ("test/tools.ts", tool.replace("find_it", "no")), ("x/tools.ts", tool.replace("inputSchema", "y").replace("find_it", "z"))], "path string, content string")
    assert [tuple(r) for r in extract.tool_definitions(files).collect()] == [("find_it", "a/tool.js", "First  it")]
    r = spark.range(1).select(extract.referenced_paths(F.lit("see ./src/a.ts, (docs/x.md). and lib/http://no `src/a.ts` other/x")).alias("p"), extract.token_set(F.lit("a/parseURL x-ray  a")).alias("t")).first()
    assert r.p == ["docs/x.md", "src/a.ts"] and r.t == ["a", "parse", "url", "x", "ray"]


def test_index(spark):
    d = spark.createDataFrame
    got = index.index_edges(d([("a", "b")], "module string, on string"), d([("c", "a"), ("e", None)], "id string, layer string"), d([("a", "b")], "consumer string, provider string"), d([("f", "a")], "flow string, module string"), d([("q", "b")], "id string, module string"))
    assert {tuple(r) for r in got.collect()} == {("a", "b", "depends_on"), ("a", "c", "owns_concept"), ("a", "b", "contract"), ("f", "a", "step_in_flow"), ("q", "b", "affects")}
    assert [tuple(r) for r in index.concept_counts(d([("c", "a"), ("d", "b"), ("e", "b"), ("f", "")], "id string, layer string")).collect()] == [("b", 2), ("a", 1)]
    s = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None)
    r = spark.range(1).select(
        index.module_text(F.lit("m"), none.cast("string"), s("1", "2", "3", "4")).alias("m"), index.concept_text(F.lit("c"), none.cast("string"), s("x", "y"), none.cast("array<string>")).alias("c"),
        index.contract_text(F.lit("k"), F.lit("p"), F.lit("q"), s("f")).alias("k"), index.flow_text(F.lit("f"), none.cast("string"), s("a.b", "c.d")).alias("f"),
        index.array_changes(s("a", "b"), s("b", "c", "d"), "files").alias("x"), index.array_changes(none.cast("array<string>"), none.cast("array<string>"), "files").alias("y"),
        index.is_other_role(F.lit("test")).alias("t"), index.is_other_role(none.cast("string")).alias("u"), index.is_other_path(F.lit("a/Mocks/b")).alias("v"), index.is_other_path(F.lit("")).alias("w"),
    ).first()
    assert (r.m, r.c) == ("m module:  Files: 1, 2, 3", "c concept: x, y Appears in: ")
    assert (r.k, r.f) == ("k contract: p → q Interface: f", "f flow: trigger= Steps: a.b → c.d")
    assert (r.x, r.y, r.t, r.u, r.v, r.w) == (["+2 files", "-1 files"], [], True, False, True, False)
    aliases = index.module_aliases(d([("app.py", "lib/models.py", 1), ("app.py", "x/models.py", 2), ("app.py", ".env", 3)], "file string, target string, seq int"))
    assert [tuple(r) for r in aliases.collect()] == [("app.py", "models", "x/models.py")]


def test_changes(spark):
    d = spark.createDataFrame
    old = d([("a", "1", "x", 2), ("b", "1", "x", 1), ("c", "1", "x", 1)], "id string, struct_hash string, trigger string, n_steps int")
    new = d([("a", "2", "y", 5), ("b", "1", "z", 1), ("d", "1", None, None)], "id string, struct_hash string, trigger string, n_steps int")
    got = {r.id: (r.status, r.changes) for r in index.layer_changes(old, new, "flow").collect()}
    assert got == {"a": ("changed", "structure changed, trigger changed, steps: 2 → 5"), "c": ("removed", None), "d": ("added", None)}
    assert index.n_changed(old, new).first().n == 3
    old = d([("k", "1", ["f"], "p", "q")], "id string, struct_hash string, interface array<string>, provider string, consumer string")
    new = d([("k", "2", ["g", "h"], "p", "r")], old.schema)
    assert index.layer_changes(old, new, "contract").first().changes == "structure changed, +2 functions, -1 functions, boundary changed"
    symbols = d([("pkg.Save", "Function", "added"), ("x", "Saver", "changed"), ("save", "Class", "removed")], "id string, label string, status string")
    assert {r.id for r in index.recent_matches(symbols, "SAVE").collect()} == {"pkg.Save", "x"}


def test_symbols(spark):
    rows = [("1", "f", "a.py", "Function", None, 1), ("2", "f", "a.py", "Function", None, 2), ("3", "f", "b.py", "Method", "C", 3), ("4", "f", "b.py", "Property", "C", 4), ("5", "f", "c.py", "Class", None, 5)]
    table = index.Symbols(spark.createDataFrame(rows, "id string, name string, file string, label string, owner string, seq int"))
    wanted = spark.createDataFrame([("a.py", "f", "C")], "file string, name string, owner string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert (ids(table.overloads(wanted)), ids(table.exact(wanted))) == (["1", "2"], ["1"])
    assert (ids(table.anywhere(wanted)), ids(table.callables(wanted)), ids(table.fields(wanted))) == (["1", "2", "3", "5"], ["1", "2", "3"], ["4"])


def test_ancestors_and_overrides(spark):
    from terrane.operators import resolution

    rows = [("d", "b", 0, "EXTENDS"), ("d", "i", 1, "IMPLEMENTS"), ("b", "a", 0, "EXTENDS"), ("i", "a", 0, "EXTENDS"), ("i", "j", 1, "EXTENDS"), ("x", "y", 0, "EXTENDS"), ("y", "x", 0, "EXTENDS")]
    got = resolution.ancestors(spark.createDataFrame(rows, "class string, parent string, seq int, kind string"))
    order = {}
    for r in got.orderBy("class", "position").collect():
        order.setdefault(r["class"], []).append((r.ancestor, r.kind))
    assert order["d"] == [("b", "EXTENDS"), ("i", "IMPLEMENTS"), ("a", "EXTENDS"), ("j", "IMPLEMENTS")] and [a for a, _ in order["x"]] == ["y", "x"]
    rows = [("a.f", "a", "f", "Method", 0), ("b.f", "b", "f", "Method", 0), ("i.g", "i", "g", "Method", 0), ("j.g", "j", "g", "Method", 0), ("j.h", "j", "h", "Method", 0), ("d.k", "d", "k", "Property", 0), ("a.k", "a", "k", "Method", 0), ("b.k", "b", "k", "Method", 0)]
    methods = spark.createDataFrame(rows, "id string, class string, name string, label string, seq int")
    told = {}
    for s in ("first-wins", "c3", "implements-split", "qualified-syntax"):
        out = resolution.method_overrides(got.withColumn("strategy", F.lit(s)), methods)
        told[s] = {r.name: (r.method, r.confidence, r.reason) for r in out.collect() if r["class"] == "d"}
    assert told["first-wins"] == {"f": ("b.f", 0.9, "first definition: b::f"), "g": ("i.g", 0.9, "first definition: i::g")}
    assert told["c3"]["f"][2] == "C3 MRO: b::f" and told["qualified-syntax"]["f"][:2] == (None, 0.5)
    assert told["implements-split"] == {"f": ("b.f", 0.95, "class method wins: b::f"), "g": (None, 0.5, "ambiguous: g")}


REFS = [
    (("File", "x", "./a/b.py/", None, None), "a/b.py"), (("Folder", "x", "a\\b", None, None), "a/b/"), (("Route", "x", None, "/u", "GET"), "route:GET /u"), (("Route", "", None, None, None), "route"),
    (("Tool", "t", "f", None, None), "tool:t"), (("Process", None, None, None, None), "process"), (("Function", " f ", "a.py", None, None), "a.py#f"), (("Class", "C", "", None, None), "class:C"),
    (("Class", None, None, None, None), "class"), ((None, None, None, None, None), "unknown-target"), ((None, "n", None, None, None), "n"),
]
ROOTS = [
    (("apps/web", "none", ""), "app"), (("packages/x/gen", "none", ""), "generated"), (("libs/x", "none", ""), "package"), (("cmd/tool", "none", ""), "app"), (("cmd", "none", ""), "repo-core"), (("src/a", "package", "x"), "repo-core"),
    (("a/tests", "none", ""), "test"), (("tools", "none", ""), "tooling"), (("x/y", "nested-repo", "x"), "unknown"), (("x/y", "package", "apps/x"), "app"), (("x/y", "inferred-package", "x"), "package"), (("x", "root", ""), "repo-core"),
]


def test_refs_and_roots(spark):
    df = spark.createDataFrame([x for x, _ in REFS], "label string, name string, path string, route string, method string")
    assert [r.r for r in df.select(names.impacted_ref(*map(F.col, df.columns)).alias("r")).collect()] == [w for _, w in REFS]
    df = spark.createDataFrame([x for x, _ in ROOTS], "path string, kind string, at string")
    assert [r.r for r in df.select(names.root_role(*map(F.col, df.columns)).alias("r")).collect()] == [w for _, w in ROOTS]


def test_freshness(spark):
    rows = [(False, True, "a", "a", "x", "x"), (True, False, "a", "a", "x", "x"), (True, True, "a", None, "x", "x"), (True, True, "a", "b", "x", "x"), (True, True, "a", "a", "x", "y"), (True, True, "a", "a", None, None)]
    df = spark.createDataFrame(rows, "m boolean, g boolean, h string, ch string, d string, cd string")
    got = [(r.f.fresh, r.f.reason) for r in df.select(index.freshness(*map(F.col, df.columns)).alias("f")).collect()]
    assert got == [(False, "no-meta"), (True, "no-git"), (True, "no-git"), (False, "head-changed"), (False, "working-tree-dirty"), (True, None)]


def test_small_rules(spark):
    d = spark.createDataFrame
    assert sorted(r.file for r in index.changed_files(d([("a",), ("b",)], "file string"), d([("b",), ("",), (None,)], "file string")).collect()) == ["a", "b"]
    stale, hit = d([("x",), ("y",), ("y",)], "id string"), d([("y",)], "id string")
    assert [sorted(r.id for r in index.enrichment_targets(stale, hit, p).collect()) for p in ("force-affected", "affected-only")] == [["x", "y"], ["y"]]
    closures = d([("k", [("u", "must", 0.5, ["a", "b"])]), ("e", [])], "id string, members array<struct<unit:string,level:string,confidence:double,reasons:array<string>>>")
    assert [tuple(r) for r in index.closure_member_facts(closures).collect()] == [("k", "u", "must", 0.5, "a; b")]
    files = d([("m", "b.py"), ("m", "a.py"), ("m", "r.md"), ("m", "x.json"), ("m", "y.yml"), ("n", "Makefile")], "module string, file string")
    assert {r.module: r.description for r in index.describe_files(files).collect()} == {"m": "5 files (2 .py, 1 JSON config, 1 markdown doc). Sample: a.py, b.py, r.md", "n": "1 file (1 .<none>). Sample: Makefile"}
    symbols = d([("m", "saveUser", "run"), ("m", "loadUser", "run"), ("n", "ab", None)], "module string, name string, entry string")
    assert [tuple(r) for r in index.describe_names(symbols).collect()] == [("m", "User operations: user, load, save (entry: run)")]
    roots = d([("a", 0.5, 1, "p"), ("a", 0.9, 2, "q"), ("a", 0.9, 3, "r")], "path string, confidence double, seq int, role string")
    assert [(r.path, r.role) for r in index.surest_roots(roots).collect()] == [("a", "q")]
    assert [tuple(r) for r in index.best_scopes(d([("m", "s", 1.0), ("m", "s", 3.0)], "module string, scope string, score double")).collect()] == [("m", "s", 3.0)]
    lines = d([(k, "x" * 9) for k in range(1, 17)], "nth int, line string")
    assert [index.within_budget(lines, n).count() for n in (160, 159, 100, 5)] == [16, 12, 9, 1]
