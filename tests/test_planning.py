"""Hand-made cases of plans, reviews, doctrine, status and resolution."""

from terrane.operators import planning, resolution


def test_plans_follow_what_is_there(spark):
    rows = [("none", False, False, False), ("canon", True, False, False), ("all", True, True, True), ("null", None, None, None)]
    got = planning.change_plans(spark.createDataFrame(rows, "target string, has_canonical boolean, has_closure boolean, has_abstraction boolean")).collect()
    best = {r.target: r.option for r in got if r.recommended}
    assert best == {"none": "local_patch", "canon": "canonicalize_path", "all": "canonicalize_path", "null": "local_patch"} or best["all"] in ("canonicalize_path", "cluster_wide_closure")
    assert {r.option for r in got if r.target == "none"} == {"local_patch", "compatibility_bridge"}
    assert len([r for r in got if r.target == "all"]) == 5 and all(0 <= r.total_score <= 1 for r in got)
    assert abs(sum(planning.DIMENSIONS.values()) - 1) < 1e-9


def test_review(spark):
    d = spark.createDataFrame
    units = d([("u1", "a.py", "m", "f"), ("u2", "b.py", "n", "f")], "unit string, file string, module string, family string")
    closures = d([("u1", "u2", "must")], "target string, unit string, level string")
    canonical = d([("c1", "f", "n"), ("c2", "f", "m")], "id string, family string, module string")
    got = planning.review_findings(d([("a.py",)], "file string"), d([("x = legacy_shim()",), ("use the legacy path",)], "line string"), units, closures, canonical)
    assert {(r.kind, r.ref) for r in got.collect()} == {("compatibility_layer", "use the legacy path"), ("compatibility_layer", "x = legacy_shim()"), ("local_patch", "u2"), ("canonical_bypass", "c1")}


def test_doctrine(spark):
    d = spark.createDataFrame
    modules, none = d([("m",), ("n",)], "id string"), d([], "id string")
    notes = d([("m", "constraint", "no cycles", False), ("m", "intent", "old", True), ("n", "note", "x", False)], "module string, type string, content string, stale boolean")
    got = planning.doctrine(modules, none, none, notes)
    assert {(r.kind, r.strength) for r in got.collect()} == {("principle", "soft"), ("constraint", "hard")}
    assert planning.relevant_doctrine(got, none).count() == 1
    assert planning.relevant_doctrine(got, modules).count() == 2


def test_status(spark):
    d = spark.createDataFrame
    nodes = d([("module", "1", "1"), ("module", "1", None), ("flow", "1", None)], "layer string, struct_hash string, source_hash string")
    assert {r.layer: (r.enriched, r.stale, r.status) for r in planning.coverage(nodes).collect()} == {"module": (1, 0, "partial"), "flow": (0, 0, "none")}
    old = d([("a", "kept")], "id string, note string")
    assert {r.id: r.note for r in planning.preserve_zones(d([("a", None), ("b", "new")], "id string, note string"), old, ["note"]).collect()} == {"a": "kept", "b": "new"}
    notes = d([("a", False, None), ("b", True, "before"), ("c", False, None)], "id string, stale boolean, stale_reason string")
    got = planning.mark_stale(notes, d([("a",), ("b",)], "id string"), "changed")
    assert {r.id: (r.stale, r.stale_reason) for r in got.collect()} == {"a": (True, "changed"), "b": (True, "before"), "c": (False, None)}
    claims = d([("1", "x", "v"), ("2", "x", "w"), ("3", "y", "v"), ("4", "z", "v"), ("5", "x", None)], "claim string, subject string, expects string")
    got = planning.consistency(claims, d([("x", "v")], "subject string, value string"), d([("y",)], "subject string"))
    assert [r.finding for r in got.orderBy("claim").collect()] == ["confirmed", "contradicted", "graph-gap", "stale-doc", "unknown"]
    over = d([("t", "why", ["e"]), (" ", "why", ["e"]), ("t", "why", [])], "target string, reason string, evidence array<string>")
    assert [r.valid for r in planning.valid_overrides(over).collect()] == [True, False, False]


def test_diverse():
    got = planning.diverse(["saveUser", "saveUserNow", "loadOrder", "saveOrder"], "save order", 2)
    assert got[0] == "saveOrder" and len(got) == 2


def test_overloads_and_dispatch(spark):
    d = spark.createDataFrame
    calls = d([(1, "f", "free", 1), (2, "f", "free", 2), (3, "C", "constructor", None), (4, "g", "free", None)], "call int, name string, form string, n_args int")
    cands = d([("f", "f1", "Function", 1, 1), ("f", "f2", "Function", 3, 2), ("C", "C", "Class", None, None), ("C", "cf", "Function", 0, 0), ("g", "g1", "Function", 0, 0), ("g", "g2", "Function", 1, 1)], "name string, symbol string, label string, n_params int, n_required int")
    assert {r.call: r.symbol for r in resolution.overloads(calls, cands).collect()} == {1: "f1", 2: "f2", 3: "C"}
    sent = d([(1, "m", "I", "I.m")], "call int, name string, receiver string, target string")
    files = d([("I", "a"), ("I", "b")], "interface string, file string")
    methods = d([("a", "m", "A.m"), ("b", "m", "I.m"), ("c", "m", "C.m")], "file string, name string, symbol string")
    assert [r.symbol for r in resolution.interface_dispatch(sent, files, methods).collect()] == ["A.m"]


def test_implements_needs_one_match(spark):
    d = spark.createDataFrame
    classes = d([("A", "I")], "class string, interface string")
    methods = d([("A", "m", "int", "A.m"), ("I", "m", "int", "I.m1"), ("I", "m", "str", "I.m2"), ("A", "n", None, "A.n"), ("I", "n", "x", "I.n1"), ("I", "n", "y", "I.n2")], "owner string, name string, params string, symbol string")
    assert [tuple(r) for r in resolution.method_implements(classes, methods).collect()] == [("A.m", "I.m1", 1.0)]


def test_re_exports_and_imports(spark):
    d = spark.createDataFrame
    b = d([("x", "i", "f"), ("loop", "p", "q")], "binding string, file string, name string")
    e = d([("i", "f", "j", "g"), ("j", "g", "k", "h"), ("p", "q", "p2", "q"), ("p2", "q", "p", "q")], "file string, name string, to_file string, to_name string")
    assert [tuple(r) for r in resolution.follow_exports(b, e, d([("k", "h", "S")], "file string, name string, symbol string")).collect()] == [("x", "S")]
    files = d([("src/a/util.ts",), ("src/b/util/index.ts",), ("lib/core.py",)], "path string")
    imports = d([("src/m.ts", "./util"), ("src/m.ts", "b/util"), ("x.py", "lib.core")], "file string, raw string")
    assert {r.raw: r.target for r in resolution.import_targets(imports, files).collect()} == {"./util": "src/a/util.ts", "b/util": "src/b/util/index.ts", "lib.core": "lib/core.py"}
    assert resolution.gap_ratio(files.toDF("file"), d([("lib/core.py",)], "file string")) == 2 / 3


def test_dispatch_shuffles_no_pairs(spark):
    d = spark.createDataFrame
    files, methods = d([("I", "f"), ("I", "g"), ("J", "g")], "interface string, file string"), d([("f", "m", "x"), ("g", "m", "x"), ("g", "m", "y"), ("g", "m", "y")], "file string, name string, symbol string")
    calls = d([(1, "m", "I", "x"), (1, "m", "J", "x"), (2, "m", "I", None), (2, "m", "I", None), (3, "n", "I", None), (None, "m", "J", "y")], "call int, name string, receiver string, target string")
    found = resolution.interface_dispatch(calls, files, methods)
    assert sorted(((r.call, r.symbol) for r in found.collect()), key=str) == [(1, "y"), (2, "x"), (2, "y"), (None, "x")]
    # Only calls that are given repeatedly are made distinct.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    head = plan[: plan.index("Aggregate [call")] if "Aggregate [call" in plan else plan
    assert "Union" in head


def test_dispatch_sends_no_copies_through_the_driver(spark):
    d = spark.createDataFrame
    files, methods = d([("I", "f"), ("I", "g")], "interface string, file string"), d([("f", "m", "x"), ("g", "m", "y")], "file string, name string, symbol string")
    calls = d([(1, "m", "I", "x"), (2, "m", "I", "z")], "call int, name string, receiver string, target string")
    found = resolution.interface_dispatch(calls, files, methods)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.call, r.symbol) for r in found.collect()) == [(1, "y"), (2, "x"), (2, "y")]
