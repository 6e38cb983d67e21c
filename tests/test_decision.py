"""Decision rules on literal cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import names
from terrane.operators import change, decision, families, graph


def test_symmetry(spark):
    rows = [
        ("f", "u1", "repository", "m", ["save", "order"]), ("f", "u2", "repository", "m", ["drop", "user"]),  # one kind and module: hard
        ("f", "u3", "unknown", "n", ["x1"]), ("f", "u4", "unknown", "n", ["x2"]),  # one unknown kind and module: soft
        ("f", "u5", "repository", "n", ["save", "order", "all"]),  # .45 + .25 * 2/3 with u1
        ("f", "u6", "handler", "m", ["save", "order"]),  # .3 + .25 with u1
        ("g", "u7", "repository", "m", ["save", "order"]), ("f", "u8", "worker", "o", None),
    ]
    units = spark.createDataFrame(rows, "family string, unit string, kind string, module string, words array<string>")
    got = {(r.from_unit, r.to_unit): (r.strength, r.score) for r in decision.symmetry_edges(units).collect()}
    assert got == {("u1", "u2"): ("hard", 0.75), ("u3", "u4"): ("soft", 0.75), ("u1", "u5"): ("soft", 0.617), ("u1", "u6"): ("soft", 0.55)}
    assert decision.symmetry_edges(units.limit(0)).collect() == []


def test_symmetry_against_all_pairs(spark):
    draw, words = random.Random(3), [f"w{k}" for k in range(7)]
    rows = [("f", f"u{k:03}", draw.choice(["a", "b", "unknown"]), draw.choice("mn"), draw.sample(words, draw.randint(0, 5))) for k in range(90)]
    want = {}
    for (_, u, k1, m1, w1), (_, v, k2, m2, w2) in itertools.combinations(sorted(rows), 2):
        shared = len(set(w1) & set(w2)) / len(set(w1) | set(w2)) if w1 or w2 else 0
        score = 0.45 * (k1 == k2) + 0.3 * (m1 == m2) + 0.25 * shared
        if k1 == k2 != "unknown" and m1 == m2:
            want[u, v] = "hard"
        elif score >= 0.55:
            want[u, v] = "soft"
    units = spark.createDataFrame(rows, "family string, unit string, kind string, module string, words array<string>")
    assert {(r.from_unit, r.to_unit): r.strength for r in decision.symmetry_edges(units).collect()} == want


def test_closure(spark):
    units = spark.createDataFrame([("f", "u1", "a"), ("f", "u2", "a"), ("f", "u3", "b"), ("g", "u4", "c"), ("g", "u5", None)], "family string, unit string, file string")
    edges = spark.createDataFrame([("f", "u1", "u2", "hard", 0.75)], "family string, from_unit string, to_unit string, strength string, score double")
    rules = spark.createDataFrame([("a", "c", 0.6)], "a string, b string, confidence double")
    got = {(r.target, r.unit): (r.level, r.confidence) for r in decision.closure_members(units, edges, rules).collect()}
    must, should, maybe = ("must_review", 0.75), ("should_review", 0.6), ("must_change_if_strategy_selected", 0.5)
    assert got["u1", "u2"] == got["u2", "u1"] == must
    assert got["u1", "u4"] == got["u4", "u2"] == should
    assert got["u1", "u3"] == got["u3", "u1"] == got["u4", "u5"] == got["u5", "u4"] == maybe
    assert len(got) == 2 + 4 + 6


@pytest.mark.parametrize("row, want", [
    ((2, 3, "stable", 1, 0.9, 10), (5, 5, 5, 2, "LOW")),
    ((10, 30, "volatile", 40, 0.0, 10), (25, 25, 25, 25, "CRITICAL")),
    ((None, None, None, 0, None, 4), (0, 0, 0, 12, "LOW")),
    ((4, 5, "active", 2, 0.5, 20), (17, 15, 5, 13, "MEDIUM")),
])
def test_risk(spark, row, want):
    df = spark.createDataFrame([("m", *row)], "module string, max_nesting int, max_cyclomatic int, stability string, in_degree int, density double, n_modules int")
    r = decision.risk_score(df).first()
    assert (r.complexity, r.churn, r.coupling, r.coverage, r.bucket) == want and r.risk == sum(want[:4])


def test_impact_risk(spark):
    got = spark.range(12).select(graph.impact_risk(F.col("id")).alias("r")).collect()
    assert [r.r for r in got] == ["LOW", *["MEDIUM"] * 9, "HIGH", "HIGH"]


def test_cochange_leaves_out_commits_of_one_file(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "a"), (6, "b"), *[(7, f"x{k}") for k in range(31)], (7, "a")]
    got = change.cochange(spark.createDataFrame(rows, "commit int, file string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 2, 1.0)]


PATHS = [
    ("src/a.test.ts", True, True), ("tests/a.py", True, True), ("pkg/x_test.go", True, True), ("a/spec/b.rb", False, True), ("lib/Test/x.c", False, True),
    ("src/__tests__/a.js", True, True), ("src/contest.py", False, False), ("lib/FooTests.swift", False, True), ("a/__mocks__/b.js", False, True), ("src/latest_news.ts", True, False),
]


def test_test_paths(spark):
    df = spark.createDataFrame([(p,) for p, *_ in PATHS], "p string")
    got = df.select("p", names.is_test_file(F.col("p")).alias("a"), names.is_test_path(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in got] == PATHS


ROLES = [
    (("src/x.test.ts", "src", 9.0, 9, 9, 9), ("test", 0.98)), (("api/gen/x.go", "api", 0.0, 0, 0, 0), ("generated", 0.95)), (("api/x_pb2.py", "api", 0.0, 0, 0, 0), ("generated", 0.95)),
    (("examples/x.ts", "examples", 0.0, 0, 0, 0), ("example", 0.92)), (("scripts/x.ts", "scripts", 0.0, 0, 0, 0), ("dev_tool", 0.9)), (("core/plugins/x.ts", "core", 0.0, 0, 0, 0), ("peripheral", 0.85)),
    (("src/core/x.ts", "src", 0.0, 6, 4, 3), ("prod_core", 0.865)), (("src/server/x.ts", "src", 0.0, 6, 0, 0), ("prod_entrypoint", 0.755)),
    (("src/core/x.ts", "src", 1.5, 0, 0, 0), ("prod_entrypoint", 0.661)), (("src/core/x.ts", "src", 0.0, 0, 0, 0), ("peripheral", 0.45)),
]


def test_roles(spark):
    df = spark.createDataFrame([x for x, _ in ROLES], "p string, m string, e double, x int, r int, c int")
    got = df.select(names.infer_role(*map(F.col, "pmexrc")).alias("r")).collect()
    assert [(r.r.role, r.r.confidence) for r in got] == [want for _, want in ROLES]
    weights = spark.createDataFrame([("prod_core",), ("test",), ("other",)], "r string").select(names.role_weight(F.col("r")).alias("w")).collect()
    assert [r.w for r in weights] == [1.0, 0.05, None]


def test_words_and_scopes(spark):
    r = spark.range(1).select(
        names.split_words(F.lit("parseHTTPRequest_v2 x")).alias("w"), names.resource_words(F.lit("saveUserOrder")).alias("n"), names.is_noisy(F.lit("shouldSave")).alias("t"),
        *[names.scope_hint(F.lit(m), F.lit(p)).alias(k) for k, m, p in (("a", "pkg", "pkg/src/api/x.ts"), ("b", "pkg", "pkg/api/x.ts"), ("c", "other", "src/cli/x.ts"), ("d", "m", ""), ("e", "m", "x/y.ts"))],
    ).first()
    assert (r.w, r.n, r.t) == (["parse", "http", "request", "v2"], ["user", "order"], True)
    assert (r.a, r.b, r.c, r.d, r.e) == ("pkg/api", "pkg/api", "src/cli", "m", "m")


def test_roots_sinks_and_kinds(spark):
    r = spark.range(1).select(
        families.roots(F.lit("savingUpdatedRunningAdded")).alias("r"),
        families.sink_role(F.array(F.lit("handleOrder"), F.lit("saveOrder")), F.array(F.lit("api"))).alias("a"), families.sink_role(F.array(F.lit("renderPage")), F.array(F.lit("ui"))).alias("b"),
        families.operation_kind(F.lit("handleX"), F.lit("m")).alias("c"), families.operation_kind(F.lit("x1"), F.lit("userservice")).alias("d"), families.operation_kind(F.lit("zip"), F.lit("m")).alias("e"),
    ).first()
    assert r.r == ["save", "update", "running", "add"]
    assert (r.a, r.b, r.c, r.d, r.e) == ("repository_write", "formatting", "handler", "service", "unknown")


@pytest.fixture
def flows(spark):
    rows = [(f"f{k}", j, fn, m) for k in range(3) for j, (fn, m) in enumerate([("createOrder", "api"), ("validateOrder", "core"), ("saveOrder", "db")])]
    rows += [("f3", 0, "createOrder", "api"), ("f3", 1, "saveOrder", "other"), ("t", 0, "testAll", "test"), ("u", 0, "xx", "nowhere")]
    steps = spark.createDataFrame(rows, "flow string, step int, function string, module string")
    fn = [("1", "createOrder", "api", "prod_entrypoint", True, 0, 4.0), ("2", "validateOrder", "core", "prod_core", True, 3, 0.0), ("3", "saveOrder", "db", "prod_core", True, 4, 0.0), ("4", "testAll", "test", "test", True, 0, 0.0)]
    functions = spark.createDataFrame(fn, "id string, name string, module string, role string, public boolean, callers long, entry_score double")
    contracts = spark.createDataFrame([("api--core", "api", "core")], "id string, consumer string, provider string")
    return steps, functions, contracts


def test_paths_families_and_units(flows):
    steps, functions, contracts = flows
    paths = families.path_instances(steps, functions, contracts)
    got = {r.flow: (r.family, r.contracts, r.sink_role) for r in paths.collect()}
    assert got["f0"] == ("create:repository_write", ["api--core"], "repository_write") and got["f3"][1] == []
    assert set(got) == {"f0", "f1", "f2", "f3", "u"}  # a flow of tests weighs too little, unknown functions half
    assert got["u"][0] == "misc:unknown"
    fam = {r.family: (r.n_paths, r.confidence, r.status, r.resources) for r in families.concern_families(paths).collect()}
    assert fam == {"create:repository_write": (4, 0.95, "confirmed", "order"), "misc:unknown": (1, 0.55, "candidate", "xx")}
    units = {r.unit: (r.kind, r.n_paths) for r in families.operation_units(paths).collect()}
    assert units == {"api:createOrder": ("unknown", 4), "core:validateOrder": ("validator", 3), "db:saveOrder": ("repository", 3), "other:saveOrder": ("repository", 1), "nowhere:xx": ("unknown", 1)}


def test_canonical(flows):
    steps, functions, contracts = flows
    paths = families.path_instances(steps, functions, contracts)
    got = {r.family: r for r in families.canonical_paths(paths, functions).collect()}
    best = got["create:repository_write"]
    # .75 * .5 + 1 * .2 + .15 + .15 = .875; purity (.95 + 1 + 1) / 3; visibility .875 * .7 + .983 * .3
    assert (best.n_paths, best.coverage, best.confidence, best.visibility, best.deviations, best.status) == (3, 0.75, 0.875, 0.908, 1, "canonical")
    assert got["misc:unknown"].status == "candidate" and got["misc:unknown"].role_purity == 0.4
    assert families.canonical_paths(paths.limit(0), functions).collect() == []


def test_call_paths(spark):
    fn = [("a", "handleSave", "api", "prod_entrypoint", True), ("b", "orderStore", "core", "prod_core", True), ("c", "saveRow", "db", "prod_core", False), ("d", "x1", "api", "test", True), ("e", "y1", "db", "test", True)]
    functions = spark.createDataFrame(fn, "id string, name string, module string, role string, public boolean")
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("b", "gone"), ("d", "e")], "src string, dst string")
    entries = spark.createDataFrame([("a",), ("d",), ("gone",)], "id string")
    got = [(r.flow, r.functions, r.modules) for r in families.call_paths(functions, calls, entries).collect()]
    assert got == [("a>b>c>b", ["handleSave", "orderStore", "saveRow", "orderStore"], ["api", "core", "db", "core"])]  # d and e are tests
    contracts = spark.createDataFrame([("b", "api--core"), ("c", "core--db"), ("e", "z")], "function string, contract string")
    none = spark.createDataFrame([("other",)], "entry string")
    r = families.call_path_instances(functions, calls, entries, contracts, none).first()
    assert (r.family, r.contracts, r.entry, r.sink, r.sink_role) == ("save:repository_write", ["api--core", "core--db"], "handleSave", "orderStore", "repository_write")
    covered = spark.createDataFrame([("handleSave",)], "entry string")
    assert families.call_path_instances(functions, calls, entries, contracts, covered).collect() == []


def test_a_canonical_path_its_members_and_what_deviates(spark):
    kind = "id string, flow string, family string, functions array<string>, modules array<string>, contracts array<string>, entry string, sink string, sink_role string"
    rows = [("b", "1", "save:w", ["f", "g", "save"], ["api", "svc", "db"], [], "f", "save", "w"), ("a", "2", "save:w", ["h", "g", "save"], ["api", "svc", "db"], [], "h", "save", "w"), ("c", "3", "save:w", ["f", "keep"], ["api", "log"], [], "f", "keep", "w")]
    paths = spark.createDataFrame(rows, kind)
    best = spark.createDataFrame([("save:w", "api>svc>db|save|w|")], "family string, signature string")
    [d] = families.canonical_details(paths, best).collect()
    assert (d.canonical, d.owner, d.entries, d.model, d.symbols) == ("canonical:save:w", "db", ["f", "h"], "a", ["h", "g", "save"])
    assert {r.flow for r in families.canonical_members(paths, best).collect()} == {"1", "2"}
    assert [tuple(r) for r in families.deviations(paths, best).collect()] == [("save:w", "c", "3", "log", "keep", ["h", "g", "save"], "deviates from save")]


def test_levels_of_abstraction(spark):
    kinds = spark.createDataFrame([("a", "repository_write", 3), ("b", "repository_write", 4), ("c", "validation", 9), ("d", "validation", 2), ("e", "unknown", 3)], "family string, sink_role string, n_paths long")
    units = spark.createDataFrame([("m:x", "a", "m"), ("n:y", "b", "n"), ("k:z", "b", "k"), ("m:c", "c", "m")], "unit string, family string, module string")
    canonical = spark.createDataFrame([("b", "canonical"), ("a", "candidate")], "family string, status string")
    got = {r.family: (r.level, r.owner, r.n_units, r.confidence, r.status) for r in decision.abstraction_details(kinds, units, canonical).collect()}
    assert got == {"a": ("lift_to_canonical_path", "m", 1, 0.76, "candidate"), "b": ("extract_service", "k", 2, 0.83, "recommended"), "c": ("extract_helper", "m", 1, 0.95, "recommended"), "e": ("extract_helper", "unknown", 0, 0.76, "candidate")}


def test_rules_in_order(spark):
    rules = spark.createDataFrame([("b", "c", 2, 0.5), ("a", "z", 2, 0.5), ("a", "b", 9, 0.5), ("x", "y", 1, 1.0)], "a string, b string, together long, confidence double")
    assert [(r.a, r.b) for r in change.ranked_rules(rules).collect()] == [("x", "y"), ("a", "b"), ("a", "z"), ("b", "c")]
    assert change.ranked_rules(rules, 2).count() == 2
