"""Modules on the cases that define them."""

import pytest

from terrane.operators import modules as M


def nodes(spark, rows):
    return spark.createDataFrame([(i, name, path, exported) for i, name, path, exported in rows], "id string, name string, path string, exported boolean")


def calls(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def members(spark, groups):
    return spark.createDataFrame([(i, c) for c, ids in groups.items() for i in ids], "id string, community string")


def told(spark, rows, pairs=(), groups=None):
    out = {}
    for r in M.file_modules(nodes(spark, rows), calls(spark, list(pairs)), members(spark, groups or {})).collect():
        out.setdefault(r.module, set()).add(r.path)
    return out


def many(name, path, n, first=0):
    return [(f"{name}{i}", f"{name}{i}", path.format(i), True) for i in range(first, first + n)]


def test_first_folders_entries_and_dependencies(spark):
    rows = [("f1", "HandleRequest", "api/handler.go", True), ("f3", "ValidateInput", "api/validate.go", True), ("f5", "Twice", "api/handler.go", True), ("f2", "QueryDB", "db/query.go", True)]
    rows += [("m", "Main", "main.go", True), ("t", "TestMain", "db/main_test.go", True), ("h", "helper", "zz/h.go", False), ("n", "nowhere", None, True)]
    pairs = [("f1", "f2"), ("f1", "f3"), ("m", "f1"), ("m", "t"), ("h", "t"), ("f1", "t"), ("n", "f1")]
    got = {r.module: r for r in M.modules(nodes(spark, rows), calls(spark, pairs), members(spark, {"c": ["f1"]})).collect()}
    assert sorted(got) == ["_root", "api", "db", "zz"]
    assert (got["api"].n_files, got["api"].canonical_entry, got["api"].depends_on, got["api"].depended_by) == (2, "HandleRequest", "db", "_root")
    assert got["db"].canonical_entry == "QueryDB" and got["db"].depended_by == "_root,api,zz"  # a test is called most, but is no entry
    assert got["zz"].canonical_entry == "" and len(got["zz"].struct_hash) == 8


def test_large_folders_are_split_by_communities(spark):
    rows = many("DeliverMessage", "cli/transport_{}.go", 30) + many("ControlState", "cli/control_{}.go", 30)
    groups = {"c0": [f"DeliverMessage{i}" for i in range(30)], "c1": [f"ControlState{i}" for i in range(30)]}
    got = told(spark, rows, groups=groups)
    assert {k: len(v) for k, v in got.items()} == {"cli/control": 30, "cli/deliver": 30}
    assert set(told(spark, rows)) == {"cli"}  # no communities at all
    assert set(told(spark, rows[:10] + rows[30:40], groups=groups)) == {"cli"}


def test_files_without_members_go_by_stem_then_by_their_own_words(spark):
    rows = many("LeaseFunc", "cli/lease_{}.go", 40) + many("TransportMsg", "cli/transport_{}.go", 15) + many("Odd", "cli/lease_{}.go", 6, first=100) + [("x", "Odd", "cli/lease_1_test.go", True)]
    got = told(spark, rows, groups={"c": [f"LeaseFunc{i}" for i in range(40)]})
    assert {k: len(v) for k, v in got.items()} == {"cli/lease": 47, "cli/transport": 15}


@pytest.mark.parametrize(("to_a", "to_b", "home"), [(5, 1, "session"), (1, 5, "control"), (2, 2, "control"), (0, 0, "session")])
def test_small_parts_go_where_they_are_called(spark, to_a, to_b, home):
    rows = many("SessionFunc", "cli/session_{}.go", 31) + many("ControlFunc", "cli/control_{}.go", 30) + many("TinyThing", "cli/tiny_{}.go", 3)
    groups = {n: [f"{n}{i}" for i in range(31)] for n in ("SessionFunc", "ControlFunc", "TinyThing")}
    pairs = [(f"TinyThing{i % 3}", f"SessionFunc{i}") for i in range(to_a)] + [(f"ControlFunc{i}", f"TinyThing{i % 3}") for i in range(to_b)]
    got = told(spark, rows, pairs, groups)
    assert set(got) == {"cli/control", "cli/session"} and "cli/tiny_0.go" in got[f"cli/{home}"]


def test_large_parts_are_split_by_second_folders(spark):
    rows = many("SyncA", "cli/a/sync_{}.go", 60) + many("SyncB", "cli/b/sync_{}.go", 50) + many("SyncC", "cli/sync_{}.go", 7)
    groups = {"c": [r[0] for r in rows]}
    got = told(spark, rows, groups=groups)
    assert {k: len(v) for k, v in got.items()} == {"cli/a": 60, "cli/b": 50, "cli/sync": 7}
    flat = many("SyncA", "cli/a/sync_{}.go", 120)
    assert {k: len(v) for k, v in told(spark, flat, groups={"c": [r[0] for r in flat]}).items()} == {"cli/sync": 120}


def test_empty_tables(spark):
    none = nodes(spark, [("a", "b", "c/d", True)]).limit(0)
    assert M.file_modules(none, calls(spark, [("a", "b")]), members(spark, {"c": ["a"]})).collect() == []
    assert M.modules(none, calls(spark, [("a", "b")]), members(spark, {"c": ["a"]})).collect() == []
