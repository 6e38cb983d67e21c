"""Findings on enrichment jobs, and what targets of changes mean, on literal cases."""

import hashlib

from terrane.operators import evidence as E, targets as T


def test_jobs_with_and_without_what_they_refer_to(spark):
    t = spark.createDataFrame
    sha = hashlib.sha256(b"text").hexdigest()
    jobs = t([("good", "architecture-element", "el", "text", sha), ("bare", None, "el", None, None), ("bad", "architecture-perspective", "none", "text", "0"), ("lost", "architecture-element", "gone", None, None)],
             "job string, target_kind string, target string, output string, output_hash string")
    rows = [("good", "file", "a.ts", None), ("good", "file", "x", "b.ts"), ("good", "node", "n1", None), ("good", "node", "n1", None), ("good", "relation", "n1->n2", None), ("good", "route", "r1", None), ("good", "module", "m1", None), ("good", "note", "free", None),
            ("bad", "file", "c.ts", None), ("bad", "route", "n1", None), ("bad", "tool", "t9", None), ("bad", "process", "p9", None), ("bad", "node", "n9", None), ("bad", "relation", "n2->n1", None), ("bad", "relation", "n2", None), ("bad", "module", "m9", None), ("bad", "decision", "d", None),
            ("lost", "node", "anchored", None)]
    evidence = t(rows, "job string, kind string, ref string, file string")
    known = [t([("a.ts",), ("b.ts",)], "path string"), t([("el",)], "id string"), t([("persp",)], "id string"), t([("node", "anchored")], "kind string, ref string")]
    facts = t([("n1", "Function"), ("n2", "Function"), ("r1", "Route"), ("anchored", "Class")], "id string, label string"), t([("n1", "n2")], "src string, dst string"), t([("m1",)], "id string")
    found = E.job_findings(jobs, evidence, *known, facts)
    told = {(r.job, r.level, r.code, r.kind, r.ref) for r in found.collect()}
    assert told == {
        ("bare", "error", "MISSING_EVIDENCE", None, None), ("bare", "error", "MISSING_TARGET", None, None), ("bad", "error", "MISSING_FILE", "file", "c.ts"), ("bad", "error", "OUTPUT_HASH_MISMATCH", None, None),
        ("bad", "error", "MISSING_ARCHITECTURE_PERSPECTIVE", "architecture-perspective", "none"), ("lost", "error", "MISSING_ARCHITECTURE_ELEMENT", "architecture-element", "gone"),
        *[("bad", "error", "MISSING_GRAPH_ANCHOR", k, r) for k, r in (("route", "n1"), ("tool", "t9"), ("process", "p9"), ("node", "n9"), ("relation", "n2->n1"), ("module", "m9"))],
        ("bad", "warning", "UNSUPPORTED_ANCHOR_VALIDATION", "relation", "n2"), ("bad", "warning", "UNSUPPORTED_ANCHOR_VALIDATION", "decision", "d"),
    }
    status = {r.job: (r.ok, r.errors, r.warnings) for r in E.job_status(jobs, found).collect()}
    assert status == {"good": (True, 0, 0), "bare": (False, 2, 0), "bad": (False, 9, 2), "lost": (False, 1, 0)}
    offline = E.job_findings(jobs, evidence, *known)
    warned = {(r.job, r.kind, r.ref) for r in offline.where("level = 'warning'").collect()}
    assert ("good", "node", "n1") in warned and ("lost", "node", "anchored") not in warned and ("bad", "decision", "d") in warned


UNITS = [
    ("api:saveUser", "api", "src/api", "saveUser", "prod_core"), ("db:saveUser", "db", "src/db", "saveUser", "prod_core"), ("db:loadState", "db", "src/db", "loadState", "prod_entrypoint"),
    ("web:render", "web", "web/pages", "renderPage", "peripheral"), ("t:saveUser", "t", "tests/x", "saveUser", "test"), ("x:handlerX", "x", "x/userland", "superHandler", None),
]


def units(spark):
    return spark.createDataFrame(UNITS, "unit string, module string, scope string, symbol string, role string")


def test_matches_by_name_word_and_part(spark):
    asked = ["api:saveUser", "db", "web/pages", "loadState", "user", "dstat", "nothing", "--", "perha", None, "er"]
    found = T.unit_matches(units(spark), spark.createDataFrame([(a,) for a in asked], "target string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.target, {})[r.unit] = round(r.score, 6)
    assert got["api:saveUser"]["api:saveUser"] == 100 and got["api:saveUser"]["t:saveUser"] == 2.5
    assert got["db"] == {"db:saveUser": 95, "db:loadState": 90.25} and got["web/pages"] == {"web:render": 40.5}
    assert got["loadState"]["db:loadState"] == 80.75
    assert got["user"] == {"api:saveUser": 50, "db:saveUser": 50, "t:saveUser": 2.5}
    assert got["dstat"] == {"db:loadState": 19} and got["perha"] == {"x:handlerX": 9}
    assert set(got["er"]) == {"api:saveUser", "db:saveUser", "t:saveUser", "web:render", "x:handlerX"} and got["er"]["web:render"] == 9
    assert "nothing" not in got and "--" not in got


def test_the_two_weightiest_scopes(spark):
    more = [(f"u{i}", "m", s, f"save{i}", "prod_core") for i, s in enumerate(["save/a", "save/a", "save/b", "save/c", "save/c", "save/c", "other"])]
    all_ = units(spark).union(spark.createDataFrame(more, units(spark).schema))
    matches = T.unit_matches(all_, spark.createDataFrame([("save",), ("db",)], "target string"))
    got = {}
    for r in T.focus_units(matches, all_).collect():
        got.setdefault(r.target, set()).add(r.unit)
    assert got["save"] == {"u0", "u1", "u3", "u4", "u5"} and got["db"] == {"db:saveUser"}


def test_plans_of_targets_that_no_unit_matches(spark):
    t = spark.createDataFrame
    edges = t([("a", "b"), ("b", "c"), ("c", "d"), ("z", "a"), ("a", "concept"), ("concept", "e")], "src string, dst string")
    modules = t([("a", "runA"), ("b", None), ("c", "runC"), ("d", "runD"), ("e", "runE"), ("z", "")], "module string, entry string")
    focus = t([("t1", "a"), ("t2", "d")], "target string, module string")
    got = {(r.target, r.option): (r.modules, r.entries, r.discouraged) for r in T.fallback_plans(t([("t1",), ("t2",), ("t3",)], "target string"), focus, edges, modules).collect()}
    assert got == {
        ("t1", "recommended-scope"): (["a", "b", "c", "e", "z"], ["runA", "runC", "runE"], False), ("t1", "local-patch"): (["a"], ["runA"], True),
        ("t2", "recommended-scope"): (["b", "c", "d"], ["runC", "runD"], False), ("t2", "local-patch"): (["d"], ["runC"], True), ("t3", "recommended-scope"): ([], [], False), ("t3", "local-patch"): ([], [], True),
    }
