"""Queries whose work grew faster than their tables: the same rows, by plans that do not multiply them."""

from itertools import product

import pytest

from terrane.operators import architecture, change, decision, graph, processes, resolution
from terrane.plans import wholes
from terrane.plans.cypher import Graph
from terrane.sources.store import projection_hash


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("MATCH (n:N)-[:C]->(c:X), (n)-[:S]->(s:X) WHERE c.name CONTAINS 'k' RETURN n.name AS n, count(DISTINCT c) AS c, count(DISTINCT s) AS s", {("hub", 30, 40), (None, 1, 1)}),
        ("MATCH (n:N)-[:C]->(c), (n)-[:S]->(s), (s)-[:T]->(t) RETURN n.id AS n, max(c.id) AS c, collect(DISTINCT t.name) AS t", {("h", "c9", ("t",))}),
        ("MATCH (n:N)-[:C]->(c), (n)-[:S]->(s), (s)-[:T]->(t) RETURN count(DISTINCT c) AS c, min(s.id) AS s", {(50, "s3")}),
        ("MATCH (n:N)-[:C]->(c), (n)-[:S]->(s) WHERE c.id = 'c7' OR s.id = 's5' RETURN n.id AS n, count(DISTINCT c) AS c, count(DISTINCT s) AS s", {("h", 50, 40)}),
    ],
)
def test_patterns_of_a_hub_are_not_multiplied(spark, text, expected):
    nodes = [("h", "N", "hub"), ("i", "N", None), ("j", "N", "alone"), ("t1", "X", "t")]
    nodes += [(f"c{k}", "X", "k" if k < 30 else "z") for k in range(50)] + [(f"s{k}", "X", "k") for k in range(40)] + [("d", "X", "k"), ("e", "X", "k")]
    edges = [("h", f"c{k}", "C") for k in range(50)] + [("h", f"s{k}", "S") for k in range(40)] + [("i", "d", "C"), ("i", "e", "S"), ("j", "d", "C"), ("s3", "t1", "T"), ("s4", "t1", "T")]
    df = Graph(spark.createDataFrame(nodes, "id string, label string, name string"), spark.createDataFrame(edges, "src string, dst string, type string")).query(text)
    assert {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()} == expected
    if "OR" not in text:  # a condition on both patterns needs both
        assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()


def _units(spark, rows):
    return spark.createDataFrame(rows, "family string, unit string, kind string, module string, file string, words array<string>")


def test_pairs_of_a_family_are_not_shuffled(spark):
    rows = [("f", f"u{k}", "ab"[k % 2] if k % 7 else "unknown", f"m{k % 3}", f"x{k % 4}", [f"w{k % 2}", f"v{k % 3}", f"t{k % 5}"]) for k in range(24)]
    rows += [("g", "u1", "a", "m0", "x9", ["w0"]), ("g", "z", "a", "m0", "x1", None), (None, "n", "a", "m0", "x2", ["w1"]), ("g", "z", "a", "m1", "x3", ["w0"]), ("g", None, "a", "m0", "x1", ["w0"]), ("g", "y", None, "m0", None, ["w0"])]
    units, rules = _units(spark, rows), spark.createDataFrame([("x0", "x1", 0.7), ("x1", "x0", 0.9), ("x2", "x3", 0.6), ("x1", "x9", 0.8)], "a string, b string, confidence double")
    got = decision.closure_members(units, None, rules)
    want = decision.closure_members(units, decision.symmetry_edges(units), rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    reasons = {r.reason for r in got.collect()}
    assert reasons == {"symmetry", "cochange", "family"}
    once = got._jdf.queryExecution().executedPlan().toString().split("Aggregate(")[0]  # the branch of units that are given once comes first
    assert "Exchange hashpartitioning(target" not in once and "Exchange hashpartitioning(part" in once


def test_symmetry_pairs_are_not_made_distinct(spark):
    rows = [("f", f"u{k % 28}", "ab"[k % 2], f"m{k % 3}", "x", [f"w{k % 2}", f"v{k % 3}", f"t{k % 5}", f"s{k % 7}"]) for k in range(40)]
    rows += [("f", "e1", "a", "m1", "x", []), ("f", "e2", "a", "m2", "x", None), ("f", "e3", None, "m2", "x", ["w1"]), ("f", "q", "c", "m9", "x", ["a\0b"]), ("f", "r", "d", "m9", "x", ["a", "b"])]
    units = _units(spark, rows)
    found = decision.symmetry_edges(units)
    want = []
    for x, y in product(rows, rows):
        if x[1] < y[1] and None not in (x[2], y[2]):
            a, b = set(x[5] or ()), set(y[5] or ())
            score = (x[2] == y[2]) * 0.45 + (x[3] == y[3]) * 0.3 + (len(a & b) / len(a | b) if a | b else 0.0) * 0.25
            hard = x[2] == y[2] and x[3] == y[3]
            if hard or score >= 0.55:
                want.append(("f", x[1], y[1], round(score, 3), "hard" if hard else "soft"))
    assert sorted((r.family, r.from_unit, r.to_unit, round(r.score, 2), r.strength) for r in found.collect()) == sorted((*w[:3], round(w[3], 2), w[4]) for w in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("to_unit" in line for line in plan.splitlines() if "Aggregate [" in line)


def test_only_the_first_imports_of_the_same_names_meet_them(spark):
    imports = [(f, t, (f * t) % 4 if t % 5 else None) for f in range(6) for t in range(12) if (f + t) % 3]
    exports = [(t, f"n{k}", (t * 7 + k) % 11) for t in range(12) for k in range(3 + t % 2)] + [(t, None, t) for t in (1, 2, 4)] + [(3, "n0", None), (3, "n1", 0)]
    best = {}
    for (f, t, seq), (u, name, symbol) in product(imports, exports):
        if t == u:
            key, rank = (f, name), ((seq is not None, seq or 0), (symbol is not None, symbol or 0), symbol)
            best[key] = min(best.get(key, rank), rank, key=lambda x: x[:2])
    got = change.wildcard_bindings(spark.createDataFrame(imports, "file long, target long, seq long"), spark.createDataFrame(exports, "target long, name string, symbol long"))
    assert {(r.file, r["name"]): r.symbol for r in got.collect()} == {k: v[2] for k, v in best.items()}
    assert "rank(seq" in got._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_traces_travel_as_hashes(spark):
    names = ["a", "ab", "b", "ba", "c"]
    paths = [[names[(k * m + m) % 5] for m in range(1, 2 + k % 5)] for k in range(60)] + [["zz"], ["zz", "q"], ["z"], ["q", "z"], ["q", "zz"]]
    inside = lambda p, o: any(o[i : i + len(p) - 1] == p[:-1] and (o[i + len(p) - 1] == p[-1] if len(p) == 1 else o[i + len(p) - 1].startswith(p[-1])) for i in range(len(o) - len(p) + 1))
    once = {tuple(p): k for k, p in reversed(list(enumerate(paths)))}
    want = {k for p, k in once.items() if not any(o != p and inside(p, o) for o in once)}
    df = architecture.drop_contained(spark.createDataFrame(list(enumerate(paths)), "trace int, path array<string>"))
    assert {r.trace for r in df.collect()} == want
    exchanged = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("stem" in line for line in exchanged)


def test_edges_of_nodes_are_sorted_in_many_parts(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("b", "a", 2), ("a", "z", 3), ("z", "a", 4), (None, "a", 5), ("b", "b", 6)], "src string, dst string, n int")
    got = graph.drop_dangling(nodes, edges)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", 1), ("a", "b", 1), ("b", "a", 2), ("b", "b", 6)]
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2


def test_cohesion_meets_each_edge_once(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("a", "y")], "id string, community string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("c", "q"), ("a", "c")], "src string, dst string")
    got = graph.cohesion(members, edges)
    both = [(s, d) for s, d in map(tuple, edges.collect())] + [(d, s) for s, d in map(tuple, edges.collect())]
    ends = [(c, o) for s, d in both for i, c in map(tuple, members.collect()) for j, o in map(tuple, members.collect()) if (i, j) == (s, d)]
    want = {c: (sum(e == (c, c) for e in ends), sum(e[0] == c for e in ends)) for c in "xyz"}
    assert {r.community: (r.internal, r.total) for r in got.collect()} == want
    assert got._jdf.queryExecution().analyzed().toString().count("Union") == 0


def test_votes_of_a_node_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("d", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert {r.id: r.community for r in graph.label_propagation(nodes, edges, 1).collect()} == {"a": "b", "b": "a", "c": "a", "d": "c", "e": "d", "f": "f"}
    told = dict(plans)
    assert "Exchange hashpartitioning(src#" in told["lpa"] and "REPARTITION_BY_NUM" in told["lpa"] and not any("hashpartitioning(src" in x and "community" in x for x in told["lpa"].splitlines())


def shuffled_rows(spark, run, told=lambda stage: stage.shuffleWriteRecords()):
    """What ``run`` returns, and the rows that its jobs shuffled, or the sum of another figure of their stages."""
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): told(found.apply(k)) for k in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def first_ways(rows, depth=60):
    """Each class's ancestors in order, with their kinds, by walking all shortest ways."""
    bases = {}
    for c, p, seq, kind in rows:
        bases.setdefault(c, []).append((p, seq, kind))
    out = set()
    for c in bases:
        known, level = {}, {}
        for p, seq, kind in bases[c]:
            level[p] = min(level.get(p, ((seq,), kind)), ((seq,), kind))
        for n in range(1, depth):
            level = {a: x for a, x in level.items() if a not in known}
            known |= {a: (n, *x) for a, x in level.items()}
            onward = {}
            for a, (key, kind) in level.items():
                for p, seq, _ in bases.get(a, ()):
                    onward[p] = min(onward.get(p, ((*key, seq), kind)), ((*key, seq), kind))
            level = onward
        order = sorted(known, key=lambda a: (*known[a][:2], a))
        out |= {(c, a, known[a][2], k) for k, a in enumerate(order)}
    return out


def test_first_ways_to_ancestors(spark):
    rows = [(k, k // 2, 0, "EXTENDS") for k in range(1, 90)] + [(k, k // 3, 1, "IMPLEMENTS") for k in range(3, 90)]
    rows += [(0, 70, 0, "EXTENDS"), (100, 101, 0, "IMPLEMENTS"), (100, 102, 0, "EXTENDS"), (101, 103, 2, "EXTENDS"), (102, 104, 2, "EXTENDS"), (103, 105, 0, "EXTENDS"), (104, 105, 0, "EXTENDS"), (105, 100, 0, "EXTENDS")]
    got = resolution.ancestors(spark.createDataFrame(rows, "class int, parent int, seq int, kind string"))
    assert sorted(map(tuple, got.collect())) == sorted(first_ways(rows))
    assert resolution.ancestors(spark.createDataFrame([], "class int, parent int, seq int, kind string")).count() == 0


def test_ancestors_are_shuffled_as_lists(spark):
    rows = spark.range(1, 401).selectExpr("id AS class", "id - 1 AS parent", "0 AS seq", "'EXTENDS' AS kind")
    n, moved = shuffled_rows(spark, lambda: resolution.ancestors(rows).groupBy().count().first()[0])
    assert n == 400 * 401 // 2
    assert moved < n / 3


def test_methods_are_not_shuffled_for_each_ancestor(spark):
    rows = spark.range(1, 401).selectExpr("id AS class", "id - 1 AS parent", "0 AS seq", "'EXTENDS' AS kind")
    methods = spark.range(401).selectExpr("concat(id, '.m') AS id", "id AS class", "concat('m', id % 5) AS name", "'Method' AS label", "0 AS seq")
    order = resolution.ancestors(rows).selectExpr("*", "'c3' AS strategy")
    got, moved = shuffled_rows(spark, lambda: resolution.method_overrides(order, methods).collect())
    nearest = {(k, m): [j for j in range(k - 1, -1, -1) if j % 5 == m] for k in range(1, 401) for m in range(5) if k % 5 != m}
    assert sorted((r["class"], r["name"], r.method) for r in got) == sorted((k, f"m{m}", f"{js[0]}.m") for (k, m), js in nearest.items() if len(js) > 1)
    assert moved < 400 * 401 // 2 / 3  # pairs of class and ancestor


def test_reused_inputs_are_hashed_in_all_parts(spark, sf, monkeypatch):
    given, cached = [], wholes.derived.cached_result

    def seen(store, name, inputs, settings, compute):
        given.append(inputs["calls"])
        return cached(store, name, inputs, settings, compute)

    monkeypatch.setattr(wholes.derived, "cached_result", seen)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        out = wholes.reused_results(spark, sf)
        sizes = given[1].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {(r.run, r.reused) for r in out.collect()} == {(1, False), (2, True), (3, False)}
    assert len(sizes) == 24 and max(sizes) < sum(sizes) / 8


def test_hash_of_rows_tells_repeats_and_nulls(spark):
    kind = "a string, b string"
    rows = [("x", None), ("y", "z"), ("y", "z")]
    sets = [rows, rows[:2], [*rows, ("y", "z")], [(None, "x"), *rows[1:]], [("x", ""), *rows[1:]], [("x", None), ("z", "y"), ("z", "y")], [rows[0], rows[0], rows[1]], []]
    assert len({projection_hash(spark.createDataFrame(s, kind)) for s in sets}) == len(sets)
    assert projection_hash(spark.createDataFrame(rows, kind).coalesce(1)) == projection_hash(spark.createDataFrame(rows[::-1], kind).repartition(3).select("b", "a"))


def test_callees_and_nodes_are_not_sent_to_the_driver(spark, tmp_path):
    n = 100_000
    spark.range(n).selectExpr("id AS src", "id + 1 AS dst").write.parquet(f"{tmp_path}/edges")
    spark.range(n + 1).selectExpr("id", "concat('name', id) AS name", "concat('c', id % 7) AS community", "false AS exported", "false AS is_test").write.parquet(f"{tmp_path}/nodes")
    edges, nodes = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/nodes")

    def run():
        entries = graph.entry_points(nodes, edges, 2)
        found = processes.traces(edges, entries)
        return found.collect(), processes.processes(found, nodes.select("id", "name"), nodes.select("id", "community"), 20).collect()

    (found, told), sent = shuffled_rows(spark, run, lambda stage: stage.resultSize())
    assert sorted((r.start, r.finish, tuple(r.path)) for r in found) == [(0, 9, tuple(range(10))), (1, 10, tuple(range(1, 11)))]
    assert sorted((r.process, r.label, r.entry, r.terminal) for r in told) == [("proc_0_name0", "Name0 → Name9", 0, 9), ("proc_1_name1", "Name1 → Name10", 1, 10)]
    assert sent < 5_000_000
