"""Searches over whole documents, embeddings that follow their nodes, results that are reused."""

import json
import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import documents as D
from terrane.sources import derived
from terrane.sources.store import GraphStore


def test_strings_of_any_schema(spark):
    kind = "id string, n int, a array<struct<x:string,y:int,z:array<string>>>, m map<string,struct<s:string>>, s struct<t:string,u:struct<v:string>>, e struct<>"
    rows = [("i", 1, [("a", 2, ["b", None]), None], {"key": ("c",)}, ("d", ("e",)), ()), ("j", None, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = {r.id: r.text for r in D.whole_documents({"k": (df, "id")}).collect()}
    assert got == {"i": "i a b c d e", "j": "j"}


def brute(docs, query, least=0.0):
    words = {k: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if len(w) > 1] for k, t in docs.items()}
    n, average = len(docs), sum(map(len, words.values())) / len(docs)
    out = {}
    for k, ws in words.items():
        score = 0
        for t in query.split():
            df = sum(t in x for x in words.values())
            tf = ws.count(t)
            score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / average))
        if score > 0 and score >= least:
            out[k] = round(score, 9)
    return out


def test_kinds_share_one_index(spark):
    docs = {("a", "1"): "red fox red", ("a", "2"): "blue fox", ("b", "1"): "red", ("b", "2"): "", ("b", "3"): "green green GREEN x"}
    df = spark.createDataFrame([(k, i, t) for (k, i), t in docs.items()], "kind string, id string, text string")
    index = D.postings(df)
    assert {(r.term, r.kind, r.id): (r.tf, r.len) for r in index[0].collect()}[("green", "b", "3")] == (3, 3)
    for query, least in (("red fox", 0.0), ("red red fox", 0.5), ("green zzz", 0.0), ("fox", 0.7)):
        got = {(r.kind, r.id): round(r.score, 9) for r in D.search_documents(index, query, least=least).collect()}
        assert got == brute(docs, query, least)
    assert D.search_documents(index, "").collect() == [] and D.search_documents(index, "nothing").collect() == []
    assert D.search_documents(D.postings(df.limit(0)), "red").collect() == []


def test_a_search_reads_the_postings_of_its_terms(spark):
    index = D.postings(spark.createDataFrame([("k", "1", "red fox")], "kind string, id string, text string"))
    plan = index[0].where(F.col("term").isin("red"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [red])]" in plan or "EqualTo(term,red)" in plan


def test_architecture_search(spark):
    perspectives = spark.createDataFrame([("overall", "Overall architecture")], "perspective string, label string")
    rows = [("overall", "store", "Store", "src/store", ["src/store/db.ts"], ["openStore"], None, ["a--b"], None), ("overall", "web/ui", "UI", "src/web", None, None, None, None, ["login"])]
    elements = spark.createDataFrame(rows, "perspective string, element string, label string, directory string, files array<string>, functions array<string>, provides array<string>, consumes array<string>, flows array<string>")
    told = spark.createDataFrame([("overall/store", "Keeps facts on disk"), ("overall", "All of it")], "path string, text string")
    got = D.architecture_search(perspectives, elements, told, "facts login").collect()
    assert {(r.kind, r.id) for r in got} == {("element", "architecture/overall/store"), ("element", "architecture/overall/web/ui")} and all(r.score >= 0.5 for r in got)
    assert [r.id for r in D.architecture_search(perspectives, elements, told, "overall").collect()] == ["architecture/overall"]
    assert D.architecture_search(perspectives, elements, told, "src", least=5.0).collect() == []


def nodes(spark, rows):
    return spark.createDataFrame(rows, "layer string, id string, struct_hash string, text string")


@pytest.fixture
def counted(tmp_path):
    """An embedding function that notes its calls in a folder, as it runs in workers."""
    folder = str(tmp_path / "calls")

    def embed(texts):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(list(texts), f)
        return derived.hashed_vectors(texts)

    def calls():
        import os

        return [json.load(open(f"{folder}/{x}")) for x in (os.listdir(folder) if os.path.isdir(folder) else [])]

    return embed, calls


def test_only_what_changed_is_embedded(spark, tmp_path, counted):
    embed, calls = counted
    store = GraphStore(spark, str(tmp_path / "store"))
    rows = [("module", f"m{i}", f"h{i}", f"text {i}") for i in range(50)] + [("concept", "m0", "h0", "another layer"), ("flow", "f", None, "no hash")]
    assert derived.refresh_embeddings(store, nodes(spark, rows).coalesce(1), "a", embed) == {"total": 52, "embedded": 52, "cached": 0, "removed": 0}
    assert sum(map(len, calls())) == 52 and max(map(len, calls())) == 20
    assert derived.refresh_embeddings(store, nodes(spark, rows[::-1] + rows[:1]), "a", embed) == {"total": 52, "embedded": 1, "cached": 51, "removed": 1}  # the one without hash
    assert sum(map(len, calls())) == 53
    rows[3] = ("module", "m3", "new", "changed")
    assert derived.refresh_embeddings(store, nodes(spark, rows[1:-1]), "a", embed) == {"total": 50, "embedded": 1, "cached": 49, "removed": 3}
    assert sum(map(len, calls())) == 54
    assert derived.refresh_embeddings(store, nodes(spark, rows[1:-1]), "b", embed)["embedded"] == 50
    assert derived.refresh_embeddings(store, nodes(spark, rows[1:-1]), "b", embed, force=True)["embedded"] == 50
    kept = {(r.layer, r.id): r for r in store.read("embeddings", derived.EMBEDDINGS).collect()}
    assert len(kept) == 50 and kept["module", "m3"].struct_hash == "new" and kept["module", "m3"].model == "b"
    assert [round(x, 5) for x in kept["module", "m3"].vector] == [round(x, 5) for x in derived.hashed_vectors(["changed"])[0]]
    assert derived.refresh_embeddings(store, nodes(spark, rows).limit(0), "b", embed) == {"total": 0, "embedded": 0, "cached": 0, "removed": 50}


def test_a_wrong_number_of_vectors_stops_and_keeps_the_old_table(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    derived.refresh_embeddings(store, nodes(spark, [("l", "a", "1", "t")]), "m", derived.hashed_vectors)
    with pytest.raises(Exception, match="vectors for"):
        derived.refresh_embeddings(store, nodes(spark, [("l", "a", "2", "t")]), "m", lambda texts: [])
    assert [r.struct_hash for r in store.read("embeddings", derived.EMBEDDINGS).collect()] == ["1"]


def test_results_are_reused_for_the_same_rows(spark, tmp_path):
    store, made = GraphStore(spark, str(tmp_path)), []
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", None), ("a", "c", 0.5)], "src string, dst string, confidence double")

    def run(df, **settings):
        def compute():
            made.append(1)
            return df.groupBy("src").agg(F.count("*").alias("n"))

        found, reused = derived.cached_result(store, "out", {"edges": df}, settings, compute)
        return {r.src: r.n for r in found.collect()}, reused

    assert run(edges, most=3) == ({"a": 2, "b": 1}, False)
    assert run(edges.orderBy(F.desc("dst")).repartition(3), most=3) == ({"a": 2, "b": 1}, True) and len(made) == 1
    assert run(edges, most=4)[1] is False
    assert run(edges.union(edges.limit(1)), most=4)[1] is False
    assert run(edges.withColumn("confidence", F.when(F.col("dst") == "b", 0.8).otherwise(F.col("confidence"))), most=4)[1] is False and len(made) == 4


def test_copies_score_the_same_in_any_order(spark):
    rows = [("d", f"{k:02}", t, tf, 40) for k in range(20) for t, tf in (("red", 1), ("blue", 3), ("green", 7), ("black", 2), ("white", 5), ("grey", 11))]
    rows = [r for k in range(20) for r in (lambda x: x if k % 2 else x[::-1])([r for r in rows if r[1] == f"{k:02}"])]
    posts = spark.createDataFrame(rows, "kind string, id string, term string, tf int, len int").coalesce(1)
    for words in ("red blue green black white grey", "red blue green", "black white grey red", "grey blue white", "red red white green"):
        got = D.search_documents((posts, spark.createDataFrame([(90, 31.7)], "n long, average double")), words, 10).collect()
        assert [r.id for r in got] == [f"{k:02}" for k in range(10)] and len({r.score for r in got}) == 1


def test_refreshes_send_no_vectors_through_the_driver(spark, tmp_path, monkeypatch):
    store, plans, write = GraphStore(spark, str(tmp_path)), [], GraphStore.write
    nodes = spark.range(20).selectExpr("'m' AS layer", "id", "id AS struct_hash", "'x' AS text")
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(GraphStore, "write", lambda self, name, df, *rest, **more: plans.append(told(df)) or write(self, name, df, *rest, **more))
    for embedded in (20, 0):
        assert derived.refresh_embeddings(store, nodes, "a", derived.hashed_vectors)["embedded"] == embedded
    assert len(plans) == 2 and not any("BroadcastExchange" in p for p in plans)
