"""However deep a graph or a hierarchy is, levels and orders are found to the end."""

from terrane.operators import graph, resolution


def test_topological_levels_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(0, 39), (3, 3)], "src long, dst long")
    assert {r.id: r.level for r in graph.topological_levels(nodes, edges).collect()} == {i: i for i in range(40)}
    assert graph.topological_levels(nodes.limit(0), edges.limit(0)).collect() == []


def test_ancestors_of_a_chain_of_hundreds(spark):
    n = 300
    rows = [(f"c{i:03}", f"c{i + 1:03}", 0, "EXTENDS") for i in range(n)] + [("c000", "c007", 1, "IMPLEMENTS"), ("c000", "c007", 2, "EXTENDS")]
    got = resolution.ancestors(spark.createDataFrame(rows, "class string, parent string, seq int, kind string"))
    assert got.count() == n * (n + 1) // 2
    top = {r.ancestor: (r.position, r.kind) for r in got.where("class = 'c000'").collect()}
    assert top["c001"] == (0, "EXTENDS") and top["c007"] == (1, "IMPLEMENTS") and top["c002"] == (2, "EXTENDS") and top["c008"] == (3, "IMPLEMENTS")


def test_c3_of_a_chain_and_of_bases_that_cannot_agree(spark):
    rows = [("h", f"c{i:02}", f"c{i + 1:02}", 0) for i in range(25)]
    rows += [("bad", "X", "A", 0), ("bad", "X", "B", 1), ("bad", "Y", "B", 0), ("bad", "Y", "A", 1), ("bad", "Z", "X", 0), ("bad", "Z", "Y", 1), ("bad", "W", "Z", 0)]
    got = {}
    for r in graph.method_resolution_order(spark.createDataFrame(rows, "hierarchy string, class string, parent string, seq int")).orderBy("class", "position").collect():
        got.setdefault((r["class"], r.strategy), []).append(r.ancestor)
    assert got["c00", "c3"] == [f"c{i:02}" for i in range(26)]
    assert got["X", "c3"] == ["X", "A", "B"] and got["Z", "bfs"] == ["Z", "X", "Y", "A", "B"] and got["W", "bfs"] == ["W", "Z", "X", "Y", "A", "B"]


def test_c3_merge_is_no_recursion():
    order = None
    lists = []
    for k in range(3000):
        order = graph.c3_merge(f"c{k}", lists)
        lists = [order, [f"c{k}"]]
    assert order[0] == "c2999" and order[-1] == "c0" and len(order) == 3000
    # The textbook's example.
    o = {x: [x, "O"] for x in "ABCDE"}
    k1, k2, k3 = (graph.c3_merge(n, [*(o[b] for b in bs), list(bs)]) for n, bs in (("K1", "ABC"), ("K2", "DBE"), ("K3", "DA")))
    assert k1 == ["K1", "A", "B", "C", "O"] and graph.c3_merge("Z", [k1, k2, k3, ["K1", "K2", "K3"]]) == ["Z", "K1", "K2", "K3", "D", "A", "B", "C", "E", "O"]
