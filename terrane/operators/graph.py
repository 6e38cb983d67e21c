"""Traversal, ranking and structure of property graphs.

A graph is ``nodes`` (``id``, further columns) and ``edges`` (``src``, ``dst``, ``type``, ``confidence``). Iterative
operators run one job per level over DataFrames and write every level to the shared scratch folder, so a lost executor
costs a re-read of one level.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.entrypoints import entry_score
from terrane.functions.scratch import drop, materialize, materialize_at
from terrane.operators.resolution import ancestors


def oriented(edges: DataFrame, direction: str = "downstream") -> DataFrame:
    """Edges as ``a`` -> ``b`` in the direction of travel: downstream, upstream or both."""
    down = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", "confidence")
    up = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type", "confidence")
    return {"downstream": down, "upstream": up}.get(direction, down.union(up))


def k_hop(
    edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "downstream", types: Iterable[str] | None = None
) -> DataFrame:
    """``id``, ``depth`` (least number of hops) of all that is reachable from ``seeds`` (``id``), seeds left out.

    The type filter holds before a node counts as seen. Each level is one join of the frontier with the edges and one
    anti-join with what has been seen; an empty frontier ends it.
    """
    steps = oriented(edges if types is None else edges.where(F.col("type").isin(list(types))), direction).select("a", "b")
    frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for level in range(1, depth + 1):
        reached = frontier.join(steps, frontier.id == steps.a).select(F.col("b").alias("id")).distinct()
        frontier = materialize(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def impact_risk(n: Column) -> Column:
    """LOW for none, MEDIUM up to 9, else HIGH."""
    return F.when(n == 0, "LOW").when(n <= 9, "MEDIUM").otherwise("HIGH")


def neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``neighbor``, ``way`` (in or out), ``type`` for every edge at ``ids`` (``id``)."""
    out = edges.join(ids, edges.src == ids.id).select("id", F.col("dst").alias("neighbor"), F.lit("out").alias("way"), "type")
    into = edges.join(ids, edges.dst == ids.id).select("id", F.col("src").alias("neighbor"), F.lit("in").alias("way"), "type")
    return out.union(into)


def context(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """For every id: its label and, by direction and lower-cased type, the sorted neighbours' count and first and last."""
    near = neighbors(edges, ids).withColumn("type", F.lower("type"))
    grouped = near.groupBy("id", "way", "type").agg(
        F.count("*").alias("n"), F.min("neighbor").alias("first_neighbor"), F.max("neighbor").alias("last_neighbor")
    )
    return grouped.join(nodes.select("id", "label"), "id")


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes.

    Sorted rows take many times their shuffled bytes, by which adaptive execution puts partitions together: the number of these is fixed.
    """
    parts, ids = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.select("id")
    kept = edges.repartition(parts, "src").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.repartition(parts, "dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def page_rank(
    nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-6
) -> DataFrame:
    """``id``, ``rank``. Loops are dropped, parallel edges kept, unknown ends dropped.

    Rank without a way out goes back by the teleport vector: uniform, or uniform over ``focus`` (``id``) if any of it
    is a node. Stops once no rank moves by ``tolerance``. An iteration shuffles edges' contributions once; the edges
    are written once, with their source's out-degree.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    base = nodes.select("id").distinct()
    teleport = base.withColumn("t", F.lit(1.0 / n))
    if focus is not None:
        chosen = base.join(focus.select("id").distinct(), "id", "left_semi")
        k = chosen.count()
        if k:
            teleport = base.join(chosen.withColumn("t", F.lit(1.0 / k)), "id", "left").fillna(0.0, ["t"])
    links = drop_dangling(nodes, edges.where("src <> dst").select("src", "dst"))
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    steps = materialize(links.join(degree, "src"), "links")
    state = materialize(teleport.join(degree.withColumnRenamed("src", "id"), "id", "left").withColumn("rank", F.lit(1.0 / n)), "rank")
    for _ in range(iterations):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        given = steps.join(state.select(F.col("id").alias("src"), "rank"), "src")
        given = given.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        fresh = F.lit(1 - damping) * F.col("t") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("t"))
        later = state.withColumnRenamed("rank", "was").join(given, "id", "left").select("id", "t", "degree", "was", fresh.alias("rank"))
        later = materialize(later, "rank")
        moved = later.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0] if tolerance > 0 else 1.0
        state = later.drop("was")
        if moved < tolerance:
            break
    return state.select("id", "rank")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``level``: 0 without incoming edges, else one more than the highest predecessor's; members of cycles, and what follows them, share the last level + 1.

    However many levels there are, each is one small table of those that still wait, dropped when the next is written, and an
    addition to the table of levels.
    """
    spark = nodes.sparkSession
    steps = materialize(drop_dangling(nodes, edges.where("src <> dst")).select("src", "dst").distinct(), "topo")
    waits = steps.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("waits"))
    state, at = materialize_at(nodes.select("id").distinct().join(waits, "id", "left").select("id", F.coalesce("waits", F.lit(0)).alias("waits")), "topo")
    kind = nodes.select("id", F.lit(0).alias("level")).schema
    _, folder = materialize_at(spark.createDataFrame([], kind), "levels")
    level = 0
    while not (ready := state.where("waits = 0").select("id")).isEmpty():
        ready.withColumn("level", F.lit(level)).write.mode("append").parquet(folder)
        met = steps.join(ready.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        later, there = materialize_at(state.where("waits > 0").join(met, "id", "left").select("id", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")), "topo")
        drop(spark, at)
        state, at = later, there
        level += 1
    return spark.read.schema(kind).parquet(folder).union(state.select("id", F.lit(level).alias("level")))


def top_callees(edges: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct callees of every caller, by id."""
    once = edges.where("src <> dst").select("src", "dst").distinct()
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("nth") <= n).drop("nth")


def simple_paths(edges: DataFrame, starts: DataFrame, hops: int = 3, fan: int = 4, least: int = 3) -> DataFrame:
    """``start``, ``finish``, ``path`` (ids in order): paths without a repeated node that end at a leaf, a closed cycle or after ``hops``.

    Every node goes to its first ``fan`` callees. Paths of fewer than ``least`` nodes are left out.
    """
    steps = materialize(top_callees(edges, fan), "callees")
    paths = starts.select(F.array("id").alias("path"), F.col("id").alias("tip"))
    done = None
    for _ in range(hops):
        tried = paths.join(steps, paths.tip == steps.src, "left")
        longer = tried.where(F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst")))
        longer = longer.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tip"))
        tips = tried.groupBy("path").agg(F.max(F.when(F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst")), 1).otherwise(0)).alias("on"))
        ended = tips.where("on = 0").select("path")
        done = ended if done is None else done.union(ended)
        paths = materialize(longer, "paths")
    done = done.union(paths.select("path"))
    done = done.where(F.size("path") >= least)
    return done.select(F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("finish"), "path")


def longest_per_ends(paths: DataFrame) -> DataFrame:
    """The longest path for every start and finish; the smallest of equals."""
    order = Window.partitionBy("start", "finish").orderBy(F.size("path").desc(), "path")
    return paths.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``id``, ``community``: each round a node takes its neighbours' commonest community, the smallest of equals.

    Deterministic and synchronous; a node without neighbours keeps its own id.
    """
    parts = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as in :func:`drop_dangling`
    both = edges.where("src <> dst").select("src", "dst")
    both = materialize(both.union(both.select("dst", "src")).repartition(parts, "src").distinct(), "lpa-edges")
    state = nodes.select("id").distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        met = both.repartition(parts, "dst").join(state.withColumnRenamed("id", "dst"), "dst").select("src", "community")
        # One shuffle by the node serves its votes and their commonest.
        votes = met.repartition(parts, "src").groupBy("src", "community").agg(F.count("*").alias("n"))
        # The commonest is the largest count; of those, the smallest name: the least of (-count, name).
        best = votes.groupBy("src").agg(F.min(F.struct(-F.col("n"), "community")).getField("community").alias("vote"))
        state = state.join(best, state.id == best.src, "left").select("id", F.coalesce("vote", "community").alias("community"))
        state = materialize(state, "lpa")
    return state


def cohesion(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """``community``, ``members``, ``internal``, ``total``, ``cohesion``: the share of its members' neighbour edges that stay inside."""
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("community"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    # Each edge meets its two ends once, for both directions; what is told twice is the pairs of communities.
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst").groupBy("community", "other").agg(F.count("*").alias("n"))
    ends = ends.select(F.explode(F.array(F.struct("community", "other", "n"), F.struct(F.col("other").alias("community"), F.col("community").alias("other"), "n"))).alias("x")).select("x.*")
    sums = ends.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("other"), F.col("n")).otherwise(0)).alias("internal"), F.sum("n").alias("total"))
    size = membership.groupBy("community").agg(F.count("*").alias("members"))
    out = size.join(sums, "community", "left").fillna(0, ["internal", "total"])
    return out.withColumn("cohesion", F.when(F.col("total") > 0, F.col("internal") / F.col("total")).otherwise(0.0))


def containment_tree(paths: DataFrame) -> DataFrame:
    """``id``, ``parent``, ``depth`` for every prefix of the '/'-separated ``path``s, each once."""
    parts = paths.select(F.filter(F.split("path", "/"), lambda x: x != "").alias("p")).where(F.size("p") > 0)
    every = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    return every.select(
        F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("id"),
        F.when(F.col("depth") > 1, F.array_join(F.slice("p", 1, F.col("depth") - 1), "/")).alias("parent"),
        "depth",
    ).distinct()


def entry_points(nodes: DataFrame, edges: DataFrame, top: int = 200) -> DataFrame:
    """The ``top`` nodes by entry score: ``id``, ``callers``, ``callees``, ``score``; nodes without callees and test files are out.

    ``nodes``: ``id``, ``exported`` (boolean), ``is_test`` (boolean) and, where known, ``name``, ``path``, ``language`` and ``framework`` (a factor of
    its own marks), which multiply the ratio of callees to callers.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    both = nodes.where("not is_test").join(out.hint("merge"), "id").join(into.hint("merge"), "id", "left").fillna(0, ["callers"])  # never a broadcast of a row each node
    known = lambda c: F.col(c) if c in nodes.columns else F.lit(None)
    score = entry_score(known("name").cast("string"), F.col("exported"), F.col("callers"), F.col("callees"), known("path").cast("string"), known("language").cast("string"), known("framework").cast("double"))
    return both.select("id", "callers", "callees", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def c3_merge(own: str, lists: list[list[str]]) -> list[str] | None:
    """A class before the merge of its bases' orders and the list of its bases; None if no order suits all of them.

    A base is next if it stands in no list but at its head. Heads move, and tails are counted, so the time is that of the lists' lengths.
    """
    tails: dict[str, int] = {}
    for x in lists:
        for name in x[1:]:
            tails[name] = tails.get(name, 0) + 1
    heads, out = [0] * len(lists), [own]
    while True:
        open_ = [(x, h) for x, h in zip(lists, heads) if h < len(x)]
        if not open_:
            return out
        good = next((x[h] for x, h in open_ if not tails.get(x[h])), None)
        if good is None:
            return None
        out.append(good)
        for k, x in enumerate(lists):
            if heads[k] < len(x) and x[heads[k]] == good:
                heads[k] += 1
                if heads[k] < len(x):
                    tails[x[heads[k]]] -= 1


def method_resolution_order(inherits: DataFrame) -> DataFrame:
    """``class``, ``position``, ``ancestor``, ``strategy`` from ``hierarchy``, ``class``, ``parent``, ``seq`` (order of bases).

    C3 linearisation, level by level: a class is worked out, in a row of its own, once all its bases are. Classes on a cycle, or whose
    bases' orders cannot be reconciled, and all below them have their ancestors in breadth-first order instead (``bfs``). Names count
    within their hierarchy; repeated rows count once. No hierarchy is gathered in one place, and its depth is not bounded.
    """
    spark = inherits.sparkSession
    rows = inherits.select("hierarchy", "class", "parent", "seq").distinct()
    up = rows.groupBy("hierarchy", "class", "parent").agg(F.min("seq").alias("seq"))
    up = materialize(up.withColumn("n_bases", F.count("*").over(Window.partitionBy("hierarchy", "class"))), "bases")
    bases = up.select("hierarchy", F.col("parent").alias("class")).join(up.select("hierarchy", "class").distinct(), ["hierarchy", "class"], "left_anti").distinct()
    merge = F.udf(lambda own, found: c3_merge(own, [list(x) for x in found]), "array<string>")
    done, folder = materialize_at(bases.select("hierarchy", "class", F.array("class").alias("order")), "c3")
    kind = done.schema
    fresh, at = materialize_at(done, "c3-level")
    while not fresh.isEmpty():
        # Classes below this level whose bases are all known by now.
        near = up.join(fresh.select("hierarchy", F.col("class").alias("parent")), ["hierarchy", "parent"], "left_semi").select("hierarchy", "class").distinct()
        known = spark.read.schema(kind).parquet(folder).select("hierarchy", F.col("class").alias("parent"), "order")
        met = up.join(near, ["hierarchy", "class"], "left_semi").join(known, ["hierarchy", "parent"])
        one = F.array_sort(F.collect_list(F.struct("seq", "parent", "order"))).alias("b")
        ready = met.groupBy("hierarchy", "class").agg(one, F.max("n_bases").alias("n")).where(F.size("b") == F.col("n"))
        merged = ready.select("hierarchy", "class", merge("class", F.concat(F.col("b.order"), F.array(F.col("b.parent")))).alias("order"))
        later, there = materialize_at(merged.where("order IS NOT NULL"), "c3-level")
        later.write.mode("append").parquet(folder)
        drop(spark, at)
        fresh, at = later, there
    done = spark.read.schema(kind).parquet(folder)
    good = done.select("hierarchy", "class", F.posexplode("order").alias("position", "ancestor"), F.lit("c3").alias("strategy"))
    key = F.struct("hierarchy", F.col("class").alias("name"))
    rest = up.join(done, ["hierarchy", "class"], "left_anti").select("hierarchy", "class").distinct()
    if rest.isEmpty():
        return good.select("class", F.col("position").cast("long").alias("position"), "ancestor", "strategy")
    whole = up.select(key.alias("class"), F.struct("hierarchy", F.col("parent").alias("name")).alias("parent"), "seq", F.lit("EXTENDS").alias("kind"))
    order = ancestors(whole).where(F.col("class") != F.col("ancestor")).join(rest.select(key.alias("class")), "class", "left_semi")
    nth = F.row_number().over(Window.partitionBy("class").orderBy("position"))
    below = order.select(F.col("class.hierarchy").alias("hierarchy"), F.col("class.name").alias("class"), nth.alias("position"), F.col("ancestor.name").alias("ancestor"))
    broken = rest.select("hierarchy", "class", F.lit(0).alias("position"), F.col("class").alias("ancestor")).union(below)
    both = good.union(broken.withColumn("strategy", F.lit("bfs")))
    return both.select("class", F.col("position").cast("long").alias("position"), "ancestor", "strategy")
