"""Decision inputs on literal facts, and the families, units and canonical paths that follow from them."""

import pytest
from pyspark.sql import functions as F

from terrane.operators import families, inputs as I

NODES = "id string, label string, name string, path string, exported boolean, language string"


def made(spark, nodes, edges=(), steps=(), entries=(), modules=(), contracts=()):
    t = spark.createDataFrame
    return I.decision_inputs(
        t(list(nodes), NODES), t([(a, b, "CALLS") for a, b in edges], "src string, dst string, type string"), t(list(steps), "process string, id string"), t([(x,) for x in entries], "id string"),
        t(list(modules), "module string, path string"), t(list(contracts), "id string, consumer string, provider string, interface array<string>"),
    )


API = [
    ("runApi", "Function", "runApi", "src/api/main.ts", True, "typescript"), ("handleSave", "Function", "handleSave", "src/api/handler.ts", False, "typescript"), ("saveState", "Function", "saveState", "src/db/store.ts", True, "typescript"),
    ("shouldRunApi", "Function", "shouldRunApi", "src/api/main.test.ts", True, "typescript"), ("testAgent", "Function", "testAgent", "tests/api/test_agent.py", True, "python"), ("Store", "Class", "Store", "src/db/store.ts", True, None),
    ("lost", "Method", None, None, None, "klingon"),
]


@pytest.fixture(scope="module")
def found(spark):
    return made(
        spark, API, [("runApi", "handleSave"), ("handleSave", "saveState"), ("handleSave", "saveState"), ("shouldRunApi", "runApi"), ("lost", "saveState")], [("proc", "runApi"), ("proc", "handleSave"), ("proc", "saveState"), ("proc", "saveState")], ["runApi"],
        [("api", "src/api/main.ts"), ("api", "src/api/handler.ts"), ("api", "src/api/main.test.ts"), ("db", "src/db/store.ts")], [("api--db", "api", "db", ["saveState"])],
    )


def test_functions_with_all_that_is_known(found):
    by = {r.id: r for r in found.functions.collect()}
    assert set(by) == {"runApi", "handleSave", "saveState", "lost"}  # neither tests nor classes
    s = by["saveState"]
    assert (s.module, s.callers, s.callees, s.external_refs, s.process_refs, s.contract_refs, s.entry_score) == ("db", 2, 0, 1, 1, 1, 0.0)
    assert (s.verbs, s.resources, s.public) == (["save"], ["state"], True)
    assert (by["runApi"].callers, by["runApi"].external_refs, by["runApi"].entry_score) == (1, 0, 1 / 2 * 2)
    assert (by["lost"].name, by["lost"].module, by["lost"].path, by["lost"].language, by["lost"].exported) == ("lost", "unknown", "", "typescript", False)


def test_relations_of_functions(found):
    assert {tuple(r) for r in found.contracts.collect()} == {("saveState", "api--db"), ("handleSave", "api--db")}
    assert {tuple(r) for r in found.processes.collect()} == {("runApi", "proc"), ("handleSave", "proc"), ("saveState", "proc")}
    assert {tuple(r) for r in found.calls.collect()} == {("runApi", "handleSave"), ("handleSave", "saveState"), ("shouldRunApi", "runApi"), ("lost", "saveState")}
    assert {r.id for r in found.entries.collect()} == {"runApi"}


def fixture(spark, flows):
    names = [(f"{v}{n}", m, f"src/{m}/{n.lower()}.ts", e) for n in ("User", "Admin") for v, m, e in (("runSave", "api", True), ("prepare", "service", False), ("save", "db", True))]
    nodes = [(f"fn:{m}.{x}", "Function", x, p, e, "typescript") for x, m, p, e in names]
    ids = [n[0] for n in nodes]
    edges = [(ids[k], ids[k + 1]) for k in (0, 1, 3, 4)]
    got = made(spark, nodes, edges, [("p1", i) for i in ids[:3]] + [("p2", i) for i in ids[3:]], [ids[0], ids[3]], {(m, p) for _, m, p, _ in names}, [("service--db", "service", "db", ["saveUser", "saveAdmin"])])
    rows = [(f, k, x, m) for f, part in (("p1", names[:3]), ("p2", names[3:])) for k, (x, m, *_) in enumerate(part)] if flows else []
    flows_ = spark.createDataFrame(rows, "flow string, step int, function string, module string")
    hops = spark.createDataFrame([("service--db", "service", "db")], "id string, consumer string, provider string")
    return got, families.path_instances(flows_, got.functions, hops)


def test_flows_of_one_kind_are_a_family(spark):
    got, paths = fixture(spark, flows=True)
    found = {r.id: r for r in paths.collect()}
    assert len(found) == 2 and {r.family for r in found.values()} == {"save:repository_write"} and {tuple(r.contracts) for r in found.values()} == {("service--db",)}
    [family] = families.concern_families(paths).collect()
    assert (family.name, family.n_paths, family.entry_kinds, family.status, family.resources) == ("save repository write", 2, "flow_trigger", "confirmed", "admin,user")
    assert {r.symbol for r in families.operation_units(paths).collect()} == {f"{v}{n}" for v in ("runSave", "prepare", "save") for n in ("User", "Admin")}
    calls = families.call_path_instances(got.functions, got.calls, got.entries, got.contracts, paths.select("entry"))
    assert calls.count() == 0  # their entries begin flows


def test_calls_stand_in_where_no_flow_begins(spark):
    got, paths = fixture(spark, flows=False)
    assert paths.count() == 0
    calls = families.call_path_instances(got.functions, got.calls, got.entries, got.contracts, paths.select("entry"))
    rows = {r.flow: r for r in calls.collect()}
    assert set(rows) == {"fn:api.runSaveUser", "fn:api.runSaveAdmin"} and {r.entry_kind for r in rows.values()} == {"canonical_entry"}
    assert rows["fn:api.runSaveUser"].functions == ["runSaveUser", "prepareUser", "saveUser"] and rows["fn:api.runSaveUser"].contracts == ["service--db"]
    shown = families.canonical_paths(calls, got.functions.withColumn("is", F.lit(1))).collect()
    assert [(r.family, r.n_paths, r.contract_reuse) for r in shown] == [("save:repository_write", 1, 1.0)]


def test_empty_inputs(spark):
    got = made(spark, API[:1])
    assert [(r.id, r.callers, r.role) for r in got.functions.collect()] == [("runApi", 0, "peripheral")] and got.contracts.collect() == [] and got.entries.collect() == []
