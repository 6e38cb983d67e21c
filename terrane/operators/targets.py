"""What a change's target means: the units that match it, their scopes, and the modules around it where no unit does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.extract import token_set
from terrane.functions.names import role_weight
from terrane.functions.scratch import materialize

# What a match is worth, the best that holds: the unit's id, module, scope or symbol, a word of them, a part of their text.
ID, MODULE, SCOPE, SYMBOL, WORD, PART = 100, 95, 90, 85, 50, 20


def plain(text: Column) -> Column:
    """Lower-cased letters and digits, all else as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def unit_matches(units: DataFrame, targets: DataFrame) -> DataFrame:
    """``target``, ``unit``, ``score`` of every unit that matches a target, weighted by its role (null: peripheral).

    ``units``: ``unit``, ``module``, ``scope``, ``symbol``, ``role``; ``targets``: ``target``. Equal names are equi-joins, words an inverted index, and of targets that match nothing
    so far the parts of a text are found by its first three letters and then verified, so no target meets all units.
    A target without letters and digits matches by equal names only.
    """
    units = materialize(units.select("unit", "module", "scope", "symbol", role_weight(F.coalesce("role", F.lit("peripheral"))).alias("weight")).dropDuplicates(["unit"]), "units")
    wanted = targets.select("target").where("target IS NOT NULL").distinct()
    found = None
    for column, score in (("unit", ID), ("module", MODULE), ("scope", SCOPE), ("symbol", SYMBOL)):
        hit = units.select("unit", F.col(column).alias("target")).join(wanted, "target").select("target", "unit", F.lit(score).alias("base"))
        found = hit if found is None else found.union(hit)
    words = units.select("unit", F.explode(F.array_distinct(F.concat(*[token_set(F.coalesce(F.col(c), F.lit(""))) for c in ("symbol", "scope", "module")]))).alias("word"))
    asked = wanted.select("target", F.explode(token_set(F.col("target"))).alias("word")).where("word <> ''")
    found = found.union(words.join(asked, "word").select("target", "unit", F.lit(WORD)))
    found = materialize(found.groupBy("target", "unit").agg(F.max("base").alias("base")), "matches")
    left = wanted.join(found.select("target").distinct(), "target", "left_anti").withColumn("text", plain(F.col("target"))).where("text <> ''")
    left = left.withColumn("head", F.left("text", F.lit(3)))
    texts = units.select(F.explode(F.array_distinct(F.array(plain(F.coalesce("symbol", F.lit(""))), plain(F.coalesce("scope", F.lit("")))))).alias("whole")).distinct().where("whole <> ''")
    starts = F.sequence(F.lit(1), F.char_length("whole"))
    heads = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr("whole", i, n)))))
    parts = texts.select("whole", F.explode(heads).alias("head")).join(left, "head").where(F.contains("whole", "text")).select("target", "whole").distinct()
    own = units.select("unit", F.explode(F.array_distinct(F.array(plain(F.coalesce("symbol", F.lit(""))), plain(F.coalesce("scope", F.lit("")))))).alias("whole"))
    found = found.union(parts.join(own, "whole").select("target", "unit", F.lit(PART)).distinct())
    return found.join(units.select("unit", "weight"), "unit").select("target", "unit", (F.col("base") * F.col("weight")).alias("score")).where("score > 0")


def focus_units(matches: DataFrame, units: DataFrame) -> DataFrame:
    """``target``, ``unit``, ``scope``: the best matches of each target; of those whose scope shares a word with it, if there are any, the ones in its two weightiest scopes.

    ``units`` as in :func:`unit_matches`. Scopes weigh the sum of their units' roles; of equals the first by name.
    """
    best = matches.groupBy("target").agg(F.max("score").alias("score"))
    top = matches.join(best, ["target", "score"], "left_semi").join(units.select("unit", "scope", role_weight(F.coalesce("role", F.lit("peripheral"))).alias("weight")).dropDuplicates(["unit"]), "unit")
    near = F.arrays_overlap(token_set(F.col("target")), token_set(F.coalesce("scope", F.lit(""))))
    top = materialize(top.withColumn("near", F.coalesce(near, F.lit(False))), "focus")
    scopes = top.where("near").groupBy("target", "scope").agg(F.sum("weight").alias("w"))
    order = Window.partitionBy("target").orderBy(F.desc(F.round("w", 9)), "scope")
    two = scopes.withColumn("nth", F.row_number().over(order)).where("nth <= 2").select("target", "scope")
    chosen = top.where("near").join(two, ["target", "scope"], "left_semi")
    others = top.join(two.select("target").distinct(), "target", "left_anti")
    return chosen.union(others.select(*chosen.columns)).select("target", "unit", "scope")


def related_modules(focus: DataFrame, edges: DataFrame, modules: DataFrame, hops: int = 2) -> DataFrame:
    """``target``, ``module``: the modules of each target (``focus``: ``target``, ``module``) and those within ``hops`` edges, one way or the other.

    ``edges``: ``src``, ``dst`` between nodes of all layers; ``modules``: ``module``. A way goes with the edges or against them, not both. Each hop is a join of
    what is new, for all targets at once.
    """
    start = focus.select("target", F.col("module").alias("id")).distinct()
    seen = start
    for a, b in (("src", "dst"), ("dst", "src")):
        steps = edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
        frontier = known = start
        for _ in range(hops):
            fresh = frontier.join(steps, "id").select("target", F.col("next").alias("id")).distinct()
            frontier = materialize(fresh.join(known, ["target", "id"], "left_anti"), "around")
            known = known.union(frontier)
        seen = seen.union(known)
    near = seen.distinct().join(modules.select(F.col("module").alias("id")).distinct(), "id", "left_semi")
    return near.union(start.select("id", "target")).select("target", F.col("id").alias("module")).distinct()


def fallback_plans(targets: DataFrame, focus: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """``target``, ``option`` (recommended-scope or local-patch), ``modules``, ``entries``, ``discouraged``: plans for targets that no family knows.

    ``modules``: ``module``, ``entry`` (null: none). The recommended scope is the neighbourhood of the target's modules with all its entries, sorted; a local patch is
    its own modules with the first of those entries, and is discouraged. A target without modules has both, empty.
    """
    around = related_modules(focus, edges, modules)
    entries = around.join(modules.groupBy("module").agg(F.min("entry").alias("entry")), "module", "left")
    wide = entries.groupBy("target").agg(F.array_sort(F.collect_set("module")).alias("all"), F.array_sort(F.collect_list(F.when(F.col("entry") != "", F.col("entry")))).alias("entries"))
    own = focus.groupBy("target").agg(F.array_sort(F.collect_set("module")).alias("own"))
    none = F.array().cast("array<string>")
    both = targets.select("target").distinct().join(wide, "target", "left").join(own, "target", "left")
    both = both.select("target", *[F.coalesce(c, none).alias(c) for c in ("all", "entries", "own")])
    option = lambda name, scope, list_, bad: F.struct(F.lit(name).alias("option"), scope.alias("modules"), list_.alias("entries"), F.lit(bad).alias("discouraged"))
    return both.select("target", F.inline(F.array(option("recommended-scope", F.col("all"), F.col("entries"), False), option("local-patch", F.col("own"), F.slice("entries", 1, 1), True))))
