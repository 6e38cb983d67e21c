"""Traces, processes, entry scores and path ids on literal cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from terrane.functions.entrypoints import entry_score, name_multiplier, path_multiplier
from terrane.operators import families, graph, processes


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def found(df):
    return sorted(tuple(r.path) for r in df.collect())


def test_an_entry_is_closed_once_it_has_its_traces(spark):
    # s has 4 callees, each of 4, each of 4: 16 traces of three nodes would be enough, but those go on to 64 leaves.
    pairs = [("s", f"a{i}") for i in range(4)] + [(f"a{i}", f"b{i}{j}") for i in range(4) for j in range(4)]
    deep = [(f"b{i}{j}", f"c{i}{j}{k}") for i in range(4) for j in range(4) for k in range(4)]
    starts = spark.createDataFrame([("s",)], "id string")
    assert found(processes.traces(edges(spark, pairs), starts)) == sorted([("s", f"a{i}", f"b{i}{j}") for i in range(3) for j in range(4)])
    # One short way among long ones comes first, though it is the last by name.
    got = found(processes.traces(edges(spark, [p for p in pairs + deep if p[0] != "b33"]), starts))
    assert len(got) == 12 and ("s", "a3", "b33") in got and ("s", "a2", "b22", "c222") not in got


def test_traces_stop_at_their_depth_and_at_cycles(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    starts = spark.createDataFrame([("n00",), ("x",)], "id string")
    got = found(processes.traces(edges(spark, [*chain, ("x", "y"), ("y", "z"), ("z", "x")]), starts))
    assert got == [tuple(f"n{i:02}" for i in range(10)), ("x", "y", "z")]


def test_the_best_entries_come_first_until_twice_the_number(spark):
    rows = [("a", "a9", ["a", "m", "a9"]), ("a", "a8", ["a", "a8", "q"]), ("b", "b9", ["b", "m", "b9"]), ("c", "c9", ["c", "m", "c9"])]
    traces = spark.createDataFrame(rows, "start string, finish string, path array<string>")
    scores = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.5)], "id string, score double")
    assert {r.start for r in processes.first_traces(traces, scores, 1).collect()} == {"a", "b"}
    assert processes.first_traces(traces, scores, 9).count() == 4


def test_traces_within_others_go(spark):
    rows = [("a", "d", ["a", "b", "c", "d"]), ("b", "d", ["b", "c", "d"]), ("a", "c", ["a", "b", "c"]), ("a", "d", ["a", "c", "d"])]
    got = processes.whole_traces(spark.createDataFrame(rows, "start string, finish string, path array<string>"))
    assert found(got) == [("a", "b", "c", "d"), ("a", "c", "d")]


@pytest.mark.parametrize(
    ("name", "language", "factor"),
    [("handleLogin", "", 1.5), ("getUser", "java", 0.3), ("gettysburg", "", 1.0), ("Main", "go", 1.5), ("createUser", "java", 1.5), ("createUser", "go", 1.0), ("get_items", "python", 1.5), ("UserHelper", "", 0.3), ("_handleX", "", 0.3), ("Post_handler", "rust", 1.5), ("", "", 1.0)],
)
def test_names_of_entry_points(spark, name, language, factor):
    assert spark.range(1).select(name_multiplier(F.lit(name), F.lit(language))).first()[0] == factor


@pytest.mark.parametrize(
    ("path", "factor"),
    [("pages/index.tsx", 3.0), ("pages/_app.tsx", 1.0), ("pages/api/x.ts", 3.0), ("app/a/page.tsx", 3.0), ("app/api/x/route.ts", 3.0), ("app/layout.tsx", 2.0), ("app/_layout.tsx", 2.0), ("app/+html.tsx", 1.5), ("app/x+api.ts", 3.0), ("app/home.tsx", 2.5),
     ("src/routes/a.ts", 2.5), ("a\\controllers\\B.java", 3.0), ("x/views.py", 3.0), ("x/api/a.py", 2.0), ("x/api/__init__.py", 1.0), ("cmd/main.go", 3.0), ("main.c", 3.0), ("src/app.c", 2.5), ("app/Jobs/X.php", 2.5), ("lib/util.py", 1.0), ("Rakefile", 1.5)],
)
def test_places_of_entry_points(spark, path, factor):
    assert spark.range(1).select(path_multiplier(F.lit(path))).first()[0] == factor


def test_entry_points_use_all_factors(spark):
    rows = [("a", "handleA", "src/routes/a.ts", "typescript", True, False, 1.0), ("b", "getB", "lib/b.ts", "typescript", True, False, 2.0), ("c", "useC", "lib/c.ts", "typescript", False, False, 1.0), ("t", "handleT", "x", "go", True, True, 1.0)]
    nodes = spark.createDataFrame(rows, "id string, name string, path string, language string, exported boolean, is_test boolean, framework double")
    got = {r.id: r.score for r in graph.entry_points(nodes, edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("t", "a")])).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": round(2 / 3 * 2 * 1.5 * 2.5, 6), "b": round(1 / 2 * 2 * 0.3 * 2, 6), "c": round(1 / 3 * 1.5, 6)}
    row = spark.range(1).select(entry_score(F.lit(None).cast("string"), F.lit(True), F.lit(0), F.lit(2), F.lit(None).cast("string")))
    assert row.first()[0] == 4.0


def test_paths_of_calls_merge_by_what_they_name(spark):
    rows = [("e", "runSave", "api", "prod_core", True), ("p1", "prepare", "svc", "prod_core", False), ("p2", "prepare", "svc", "prod_core", False), ("s", "saveUser", "db", "prod_core", True)]
    functions = spark.createDataFrame(rows, "id string, name string, module string, role string, public boolean")
    calls = edges(spark, [("e", "p1"), ("e", "p2"), ("p1", "s"), ("p2", "s")])
    contracts = spark.createDataFrame([("p1", "svc--db"), ("p2", "api--svc"), ("s", "svc--db")], "function string, contract string")
    none = spark.createDataFrame([], "entry string")
    entries = spark.createDataFrame([("e",)], "id string")
    [r] = families.call_path_instances(functions, calls, entries, contracts, none).collect()
    told = {"familyKey": "save:repository_write", "functions": "runSave>prepare>saveUser", "modules": "api>svc>db", "source": "e"}
    assert r.id == hashlib.sha256(json.dumps(told, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:8]
    assert (r.flow, r.family, r.entry_kind, r.contracts) == ("e", "save:repository_write", "canonical_entry", ["api--svc", "svc--db"])
    covered = spark.createDataFrame([("runSave",)], "entry string")
    assert families.call_path_instances(functions, calls, entries, contracts, covered).count() == 0


def test_a_unit_counts_paths_and_not_their_short_ids(spark):
    one = ("aaaaaaaa", "1", "save:x", ["f", "g"], ["m", "n"])
    two = ("aaaaaaaa", "2", "save:x", ["f", "g"], ["m", "n"])
    paths = spark.createDataFrame([one, two], "id string, flow string, family string, functions array<string>, modules array<string>")
    assert {r.n_paths for r in families.operation_units(paths).collect()} == {2}


def test_a_walk_writes_less_than_its_paths(spark, monkeypatch):
    n = 60
    functions = spark.createDataFrame([(k, f"f{k}", f"m{k % 2}", "prod_core", True) for k in range(n)], "id long, name string, module string, role string, public boolean")
    calls = spark.createDataFrame([(k, (k * 3 + j) % n) for k in range(n) for j in range(1, 4)], "src long, dst long")
    written, write = [], families.materialize
    monkeypatch.setattr(families, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    entries = functions.select("id")
    paths = {tuple(r.path) for r in families.call_paths(functions, calls, entries).collect()}
    assert sum(df.count() for df in written) < len(paths) / 2
    to = {k: sorted({(k * 3 + j) % n for j in range(1, 4)}) for k in range(n)}

    def walk(path):
        if len(path) == 6 or path[-1] in path[:-1]:
            return [path]
        return [p for x in to[path[-1]] for p in walk((*path, x))]

    assert paths == {p for k in range(n) for p in walk((k,)) if len({x % 2 for x in p}) > 1}
    for most in (1, 2, 3, 5):
        got = [tuple(r.path) for r in families.call_paths(functions, calls, entries, most).collect()]
        cut = {p[:most] for k in range(n) for p in walk((k,))}
        assert len(got) == len(set(got)) and set(got) == {p for p in cut if len({x % 2 for x in p}) > 1}


def test_only_paths_with_twin_steps_are_held_against_others(spark):
    rows = [(k, f"f{k}", f"m{k % 3}", "prod_core", True) for k in range(8)] + [(8, "f1", "m1", "prod_core", True), (9, "f5", "m2", "prod_core", False), (10, "z", None, "prod_core", True), (11, "z", None, "prod_core", True)]
    functions = spark.createDataFrame(rows, "id long, name string, module string, role string, public boolean")
    pairs = [(0, 1), (0, 8), (0, 2), (1, 3), (8, 3), (8, 4), (2, 5), (2, 9), (3, 6), (4, 7), (5, 7), (9, 7), (6, 0), (7, 10), (7, 11), (10, 1), (11, 1)]
    calls = spark.createDataFrame(pairs, "src long, dst long")
    contracts = spark.createDataFrame([(8, "c8"), (9, "c9"), (5, "c5"), (11, "c11"), (1, "c1")], "function long, contract string")
    none, entries = spark.createDataFrame([], "entry string"), functions.select("id")
    known, after, own = {r[0]: r for r in rows}, {}, {8: "c8", 9: "c9", 5: "c5", 11: "c11", 1: "c1"}
    for a, b in sorted(pairs):
        after.setdefault(a, []).append(b)
    for most in (2, 3, 4, 6):
        want = {}
        ways = [[k] for k in known]
        while ways:
            way = ways.pop()
            if len(way) < most and way[-1] in after and way[-1] not in way[:-1]:
                ways += [[*way, b] for b in after[way[-1]][:3]]
            elif len(way) > 1 and len({known[k][2] for k in way}) > 1:
                want.setdefault((way[0], tuple(known[k][1] for k in way), tuple(known[k][2] for k in way)), set()).update(own[k] for k in way if k in own)
        found = families.entry_paths(functions, calls, entries, contracts, none, most=most)
        got = [((r.flow, tuple(r.functions), tuple(r.modules)), r.contracts) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan[: plan.index("Aggregate")] and "RepartitionByExpression" not in plan
