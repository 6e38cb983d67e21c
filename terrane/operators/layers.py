"""Semantic layers over a graph: modules, contracts, concepts, flows, complexity and roll-ups.

``calls`` below: ``src``, ``dst``, ``src_module``, ``dst_module`` and what an operator names besides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F


def module_of(path: Column) -> Column:
    """The first segment of a file's path; ``_root`` if it has none."""
    return F.when(F.instr(path, "/") == 0, "_root").otherwise(F.get(F.split(path, "/"), F.lit(0)))


def joined(values: Column) -> Column:
    """The distinct values, sorted, separated by commas."""
    return F.array_join(F.sort_array(F.collect_set(values)), ",")


def contracts(calls: DataFrame, name: str = "name") -> DataFrame:
    """``id``, ``consumer``, ``provider``, ``interface`` (sorted names), ``n_calls`` for calls from one module to another."""
    crossing = calls.where("src_module <> dst_module")
    out = crossing.groupBy(F.col("src_module").alias("consumer"), F.col("dst_module").alias("provider"))
    out = out.agg(joined(F.col(name)).alias("interface"), F.count("*").alias("n_calls"))
    return out.select(F.concat_ws("--", "consumer", "provider").alias("id"), "consumer", "provider", "interface", "n_calls")


def module_dependencies(calls: DataFrame) -> DataFrame:
    """``module``, ``depends_on``, ``depended_by``: sorted names of the modules called and calling."""
    pairs = calls.where("src_module <> dst_module").select("src_module", "dst_module").distinct()
    on = pairs.groupBy(F.col("src_module").alias("module")).agg(joined(F.col("dst_module")).alias("depends_on"))
    by = pairs.groupBy(F.col("dst_module").alias("module")).agg(joined(F.col("src_module")).alias("depended_by"))
    return on.join(by, "module", "full").fillna("", ["depends_on", "depended_by"])


def canonical_entry(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``module``, ``entry``, ``in_calls``: the exported symbol (``id``, ``module``, ``exported``) called most from outside; the smallest of equals."""
    outside = calls.where("src_module <> dst_module").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    counted = symbols.where("exported").join(outside, "id", "left").fillna(0, ["n"])
    best = counted.groupBy("module").agg(F.min(F.struct(-F.col("n"), F.col("id"))).alias("best"))
    return best.select("module", F.col("best.id").alias("entry"), (-F.col("best.col1")).alias("in_calls"))


def concepts(terms: DataFrame, stop_words: Iterable[str] = (), least: int = 3, once: bool = False) -> DataFrame:
    """``term``, ``n_symbols``, ``n_modules``, ``home`` from ``term``, ``symbol``, ``module``.

    Terms of at least ``least`` distinct symbols; home is the module with most of them, the smaller name of equals.
    Counting by module first combines map-side, so a term that every symbol has makes one row per task and module. ``once``: the rows are
    distinct already, as those of a symbol's own distinct terms are, and are not shuffled to make them so.
    """
    kept = terms.where(~F.col("term").isin(list(stop_words))) if stop_words else terms
    by_module = (kept if once else kept.distinct()).groupBy("term", "module").agg(F.count("*").alias("n"))
    out = by_module.groupBy("term").agg(
        F.sum("n").alias("n_symbols"), F.count("*").alias("n_modules"), F.min(F.struct(-F.col("n"), F.col("module"))).alias("best")
    )
    return out.where(F.col("n_symbols") >= least).select("term", "n_symbols", "n_modules", F.col("best.module").alias("home"))


def flow_steps(events: DataFrame, order: list[str]) -> DataFrame:
    """``flow``, ``step`` (from 1), ``module`` ('unknown' if null)."""
    nth = F.row_number().over(Window.partitionBy("flow").orderBy(*order))
    return events.select("flow", nth.alias("step"), F.coalesce("module", F.lit("unknown")).alias("module"), *order)


def flow_edges(steps: DataFrame) -> DataFrame:
    """``source``, ``target``, ``weight``: how often a flow goes from one module to another one in consecutive steps, nulls skipped."""
    last = F.lag("module").over(Window.partitionBy("flow").orderBy("step"))
    pairs = steps.where(F.col("module").isNotNull()).withColumn("source", last).where("source <> module")
    return pairs.groupBy("source", F.col("module").alias("target")).agg(F.count("*").alias("weight"))


def complexity(functions: DataFrame, top: int = 3) -> DataFrame:
    """``module``, ``max_cyclomatic``, ``avg_cyclomatic`` (2 places), ``n_functions``, ``hotspots`` from ``module``, ``id``, ``cyclomatic``, ``depth``."""
    hot = Window.partitionBy("module").orderBy((F.col("depth") * F.col("cyclomatic")).desc(), "id")
    first = functions.withColumn("nth", F.row_number().over(hot)).where(F.col("nth") <= top)
    names = first.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"].cast("string")), ",").alias("hotspots"))
    sums = functions.groupBy("module").agg(
        F.max("cyclomatic").alias("max_cyclomatic"), F.round(F.avg("cyclomatic"), 2).alias("avg_cyclomatic"), F.count("*").alias("n_functions")
    )
    return sums.join(names, "module")


def rollup(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """``level``, ``name``, ``n``, ``size``, ``peak``, ``risk`` (weighted by size) of every group at every level.

    ``leaves``: the level columns, outermost first, ``size``, ``risk``. One pass over the leaves: partial sums by the
    innermost level feed all others.
    """
    inner = leaves.groupBy(*levels).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("peak"), F.sum(F.col("size") * F.col("risk")).alias("mass"))
    tagged = inner.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("name")) for x in levels])).alias("g"), "n", "size", "peak", "mass")
    sums = tagged.groupBy("g.level", "g.name").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("peak").alias("peak"), F.sum("mass").alias("mass"))
    return sums.withColumn("risk", F.when(F.col("size") > 0, F.col("mass") / F.col("size")).otherwise(0.0)).drop("mass")


def component_edges(calls: DataFrame, label: str = "name", labels: int = 3) -> DataFrame:
    """``source``, ``target``, ``weight``, ``labels`` (the first few distinct, sorted) between modules."""
    crossing = calls.where("src_module <> dst_module")
    by_label = crossing.groupBy(F.col("src_module").alias("source"), F.col("dst_module").alias("target"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    out = by_label.groupBy("source", "target").agg(F.sum("n").alias("weight"), F.sort_array(F.collect_set("label")).alias("all"))
    return out.select("source", "target", "weight", F.array_join(F.slice("all", 1, labels), ",").alias("labels"))


def test_density(files: DataFrame, covered: DataFrame) -> DataFrame:
    """``module``, ``density``: covered share of the files (``file``, ``module``) that are no tests, 2 places; 0 without any."""
    hit = covered.select("file").distinct().withColumn("hit", F.lit(1))
    out = files.join(hit, "file", "left").groupBy("module").agg(F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*"), 2).alias("density"))
    return out
