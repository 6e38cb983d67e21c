"""Hand-made cases of architecture, traces, types, middleware, phases and corrections."""

from terrane.operators import architecture as arch


def test_leaves_and_groups(spark):
    d = spark.createDataFrame
    files = d([("m", f"f{i}") for i in range(16)] + [("n", "x"), ("n", "x")], "module string, file string")
    got = {r.module: r for r in arch.leaf_stats(files, d([("m", 4, 3), ("m", 2, None), ("gone", 9, 9)], "module string, cyclomatic int, depth int")).collect()}
    assert (got["m"].file_count, got["m"].total_cyclomatic, got["m"].risk_score) == (16, 6, 12 + 48) and got["n"].risk_score == 3
    groups, nodes = files.withColumnRenamed("module", "group"), d([("a", "m"), ("b", "m"), ("c", "n")], "id string, group string")
    edges = d([("a", "b"), ("a", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {r.group: r for r in arch.group_kinds(groups, nodes, edges).collect()}
    assert (got["m"].kind, got["n"].kind, got["n"].cohesion) == ("group", "leaf", 0.0) and abs(got["m"].cohesion - 1 / 3) < 1e-9
    assert {r.kind for r in arch.group_kinds(groups, nodes, edges, depth=3).collect()} == {"leaf"}
    assert {r.kind for r in arch.group_kinds(groups, nodes, edges.where("src = 'x'")).collect()} == {"leaf"}


def test_contained_traces(spark):
    paths = {1: ["a", "b", "c", "d"], 2: ["b", "c"], 3: ["b", "d"], 4: ["a", "b", "c", "d"], 5: ["c"], 6: ["b", "ca"], 7: ["ca"], 8: ["x", "fo"], 9: ["x", "foo"], 10: [], 11: ["f"]}
    got = arch.drop_contained(spark.createDataFrame(list(paths.items()), "trace int, path array<string>"))
    assert sorted(r.trace for r in got.collect()) == [1, 3, 6, 9, 11]
    assert arch.drop_contained(spark.createDataFrame([], "trace int, path array<string>")).count() == 0


def test_entries_and_middleware(spark):
    d = spark.createDataFrame
    got = arch.process_entries(d([("p", "n1"), ("q", None)], "id string, entry string"), d([("n1", "a.ts")], "id string, file string"), d([("r1", "a.ts"), ("r2", "b.ts")], "id string, file string"))
    assert [(r.src, r.dst, r.confidence) for r in got.collect()] == [("r1", "p", 0.85)]
    routes = d([("/api/x", ["log", "auth"]), ("/home", None)], "path string, middleware array<string>")
    assert {r.path: r.middleware for r in arch.attach_middleware(routes, ["auth"], ["/api/.*"]).collect()} == {"/api/x": ["auth", "log"], "/home": []}
    assert {r.path: r.middleware for r in arch.attach_middleware(routes, ["auth"], []).collect()} == {"/api/x": ["auth", "log"], "/home": ["auth"]}


def test_types_spread(spark):
    d = spark.createDataFrame
    known = d([("", "app", "App"), ("f", "u", "User")], "scope string, name string, type string")
    pending = d(
        [
            (1, "f", "c", "copy", "b", None), (2, "f", "b", "field", "u", "address"), (3, "f", "z", "method", "c", "zip"), (4, "f", "g", "copy", "app", None),
            (5, "f", "k", "call", "make", None), (6, "f", "k", "copy", "u", None), (7, "f", "u", "call", "make", None), (8, "nowhere", "v", "call", "make", None), (9, "f", "w", "copy", "w", None),
        ],
        "seq int, scope string, name string, kind string, source string, member string",
    )
    members = d([("User", "field", "address", "Address"), ("Address", "method", "zip", "Zip")], "owner string, kind string, member string, type string")
    got = arch.propagate_types(known, pending, d([("make", "Made")], "callee string, type string"), members)
    want = {("", "app"): "App", ("f", "u"): "User", ("f", "b"): "Address", ("f", "c"): "Address", ("f", "z"): "Zip", ("f", "g"): "App", ("f", "k"): "Made"}
    assert {(r.scope, r.name): r.type for r in got.collect()} == want


def test_corrections(spark):
    d = spark.createDataFrame
    rows = d([(2, "b", "k", "open", "high"), (1, "a", "k", "accepted", "medium"), (3, "c", "k", "open", "low"), (4, "d", "k", "rejected", "high"), (5, "e", "k", "open", None)], "seq int, id string, kind string, status string, confidence string")
    assert [(r.nth, r.id) for r in arch.correction_plan(rows).orderBy("nth").collect()] == [(1, "a"), (2, "b")]
    rows = d([("a", ["x.py", "gone.py"], ["n"], "n", "m", "CALLS"), ("b", None, ["lost"], None, None, None)], "id string, evidence array<string>, nodes array<string>, src string, dst string, type string")
    got = arch.correction_findings(rows, d([("x.py",)], "file string"), d([("n",)], "id string"), d([("n", "m", "CALLS")], "src string, dst string, type string"))
    assert {(r.id, r.code, r.ref) for r in got.collect()} == {("a", "EVIDENCE_FILE_MISSING", "gone.py"), ("a", "EDGE_PRESENT", "n CALLS m"), ("b", "NODE_MISSING", "lost")}


def test_phases(spark):
    rows = [(None, None, 0), (True, "change", 0), (True, "architecture", 3), (True, "general", 3), (True, "general", 12), (True, None, None)]
    tasks = spark.createDataFrame(rows, "has_facts boolean, intent string, unknown int")
    tasks = tasks.selectExpr("*", "0 AS changed_files", "'complete' AS index_status", "0 AS graph_gaps", "0 AS stale_docs", "cast(null as int) AS contradicted")
    got = [(r.phase, r["mode"]) for r in arch.task_phase(tasks).collect()]
    assert got == [("bootstrap", "none"), ("review", "none"), ("enrich", "architecture-enrich"), ("enrich", "bounded-stale-enrich"), ("enrich", "docs-consistency-review"), ("develop", "none")]
