"""Properties and hand-made cases of the graph operators."""

import pytest
from pyspark.sql import functions as F

from terrane.operators import graph


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(a, b, kind, 1.0) for a, b in pairs], "src string, dst string, type string, confidence double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def ranks(df):
    return {r.id: r["rank"] for r in df.collect()}


def test_k_hop_levels_are_disjoint_and_skip_seeds(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    got = {r.id: r.depth for r in graph.k_hop(e, nodes(spark, ["a"]), 5).collect()}
    assert got == {"b": 1, "c": 2, "d": 3}


def test_k_hop_type_filter_holds_before_seen(spark):
    e = edges(spark, [("a", "b")], "IMPORTS").union(edges(spark, [("a", "c"), ("c", "b")]))
    got = {r.id: r.depth for r in graph.k_hop(e, nodes(spark, ["a"]), 3, types=["CALLS"]).collect()}
    assert got == {"c": 1, "b": 2}


def test_upstream_is_the_dual_of_downstream(spark):
    pairs = [("a", "b"), ("b", "c"), ("d", "c")]
    e = edges(spark, pairs)
    down = {(s, r.id) for s in "abcd" for r in graph.k_hop(e, nodes(spark, [s]), 3).collect()}
    up = {(r.id, s) for s in "abcd" for r in graph.k_hop(e, nodes(spark, [s]), 3, "upstream").collect()}
    assert down == up


def test_page_rank_sums_to_one_and_follows_in_degree(spark):
    n = nodes(spark, "abcd")
    got = ranks(graph.page_rank(n, edges(spark, [("a", "c"), ("b", "c"), ("c", "d"), ("d", "d")])))
    assert sum(got.values()) == pytest.approx(1)
    assert got["c"] > got["a"]


def test_page_rank_of_few_and_of_unknown_focus(spark):
    none = edges(spark, [("x", "y")])
    assert ranks(graph.page_rank(nodes(spark, []), none)) == {}
    assert ranks(graph.page_rank(nodes(spark, ["a"]), none)) == {"a": pytest.approx(1)}
    got = ranks(graph.page_rank(nodes(spark, "ab"), none, nodes(spark, ["z"])))
    assert got["a"] == pytest.approx(got["b"])


def test_page_rank_focus(spark):
    n, e = nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = ranks(graph.page_rank(n, e, nodes(spark, ["b"])))
    assert got["b"] == max(got.values())


def test_topological_levels_put_cycles_last(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("c", "x")])
    got = {r.id: r.level for r in graph.topological_levels(nodes(spark, "abcxy"), e).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3}


def test_simple_paths_end_at_leaves_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")])
    got = {tuple(r.path) for r in graph.simple_paths(e, nodes(spark, ["a"]), hops=5).collect()}
    assert got == {("a", "b", "c"), ("a", "b", "d")}


def test_communities_partition_the_nodes(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")])
    got = graph.label_propagation(nodes(spark, "abcxyz"), e)
    rows = {r.id: r.community for r in got.collect()}
    assert set(rows) == set("abcxyz") and rows["z"] == "z"
    assert rows["x"] in "xy"
    c = {r.community: r.cohesion for r in graph.cohesion(got, e).collect()}
    assert all(0 <= v <= 1 for v in c.values())


def test_c3_and_its_fallback(spark):
    rows = [("h", "D", "B", 0), ("h", "D", "C", 1), ("h", "B", "A", 0), ("h", "C", "A", 0), ("bad", "X", "Y", 0), ("bad", "Y", "X", 0)]
    df = spark.createDataFrame(rows, "hierarchy string, class string, parent string, seq int")
    got = graph.method_resolution_order(df).collect()
    assert [r.ancestor for r in sorted((r for r in got if r["class"] == "D"), key=lambda r: r.position)] == ["D", "B", "C", "A"]
    assert {r.strategy for r in got if r["class"] in "XY"} == {"bfs"}


def test_tree_of_paths(spark):
    got = graph.containment_tree(spark.createDataFrame([("a/b/c",), ("a/d",), ("",)], "path string"))
    assert {(r.id, r.parent) for r in got.collect()} == {("a", None), ("a/b", "a"), ("a/b/c", "a/b"), ("a/d", "a")}


def test_dangling_edges_go(spark):
    assert graph.drop_dangling(nodes(spark, "ab"), edges(spark, [("a", "b"), ("a", "z")])).count() == 1


def test_no_plan_has_python_on_the_hot_path(spark, sf):
    from terrane.plans import registry

    for name in ("contract_map", "bm25_search", "vector_topk", "cochange_rules", "interval_overlap"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin")), name


def test_scan_reads_only_what_is_needed(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_quantity") > 45).select("l_partkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "l_comment" not in plan
