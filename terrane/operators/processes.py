"""Execution flows: from traces of calls to named processes and their steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terrane.functions.names import sanitize, split_words
from terrane.functions.scratch import materialize
from terrane.operators.architecture import drop_contained
from terrane.operators.graph import longest_per_ends, top_callees

# Words that say nothing of a module.
NOISE = (
    "get set new create handle error config init type data info item list map test mock base default internal util helper manager service handler "
    "processor builder factory impl abstract interface command func run load write read parse string options args result value node file path name"
).split()


def calls(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """``src``, ``dst`` of calls that are at least so sure (``type``, ``confidence``)."""
    return edges.where((F.col("type") == "CALLS") & (F.coalesce("confidence", F.lit(1.0)) >= least)).select("src", "dst")


def traces(edges: DataFrame, entries: DataFrame, depth: int = 10, fan: int = 4, least: int = 3) -> DataFrame:
    """``start``, ``finish``, ``path`` of each entry's first ``3 * fan`` traces, the shorter first, then by the order of callees.

    A trace ends at a leaf, where all callees are on it already, or at ``depth`` nodes; each node goes to its first ``fan`` callees.
    Level by level: shorter traces come first, so an entry that has its number is closed and its open ways are dropped.
    """
    most = 3 * fan
    steps = materialize(top_callees(edges, fan).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("callees")), "callees")
    open_ = entries.select(F.col("id").alias("start"), F.array("id").alias("path"), F.col("id").alias("tip")).distinct()
    done, first = None, Window.partitionBy("start").orderBy(F.size("path"), "path")
    for n in range(1, depth + 1):
        if n < depth:
            tried = open_.join(steps.hint("merge"), F.col("tip") == F.col("src"), "left")  # never a broadcast: all callees would go through the driver at each level
            onward = F.filter("callees", lambda x: ~F.array_contains("path", x))
            tried = materialize(tried.select("start", "path", F.coalesce(onward, F.array()).alias("next")), "traced")
            ended = tried.where(F.size("next") == 0).select("start", "path")
        else:
            ended = open_.select("start", "path")
        if n >= least:
            done = ended if done is None else done.union(ended)
            done = materialize(done.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most).select("start", "path"), "traces")
        if n < depth:
            open_ = tried.select("start", F.explode("next").alias("tip"), "path").select("start", F.concat("path", F.array("tip")).alias("path"), "tip")
            if done is not None:
                full = done.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= most)
                open_ = open_.join(full, "start", "left_anti")
    return done.select("start", F.element_at("path", -1).alias("finish"), "path")


def first_traces(found: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """The traces of the best entries (``id``, ``score``), one entry after the other, until there are twice ``most``; the entry that reaches it is whole.

    ``entries`` are a report of at most some hundred rows, so their running total is one small window.
    """
    each = entries.select(F.col("id").alias("start"), "score").join(found.groupBy("start").agg(F.count("*").alias("n")), "start")
    order = Window.orderBy(F.desc("score"), "start").rowsBetween(Window.unboundedPreceding, -1)
    taken = each.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < 2 * most)
    return found.join(taken.select("start"), "start", "left_semi")


def whole_traces(found: DataFrame) -> DataFrame:
    """Traces that lie within no longer one, as :func:`architecture.drop_contained` compares them."""
    named = found.select("start", "finish", "path", F.transform("path", lambda x: x.cast("string")).alias("named"))
    kept = drop_contained(named.select(F.array_join("named", "->").alias("trace"), F.col("named").alias("path"))).select("trace")
    return named.join(kept, F.array_join("named", "->") == F.col("trace"), "left_semi").select("start", "finish", "path").distinct()


def most_processes(n_symbols: int) -> int:
    """A tenth of the symbols, at least 20 and at most 300."""
    return max(20, min(300, int(n_symbols / 10 + 0.5)))


def processes(found: DataFrame, nodes: DataFrame, membership: DataFrame, most: int) -> DataFrame:
    """``process``, ``label``, ``kind``, ``step_count``, ``communities``, ``entry``, ``terminal``, ``trace`` of the ``most`` longest traces.

    ``found``: ``start``, ``finish``, ``path``, of which the longest of each pair of ends is taken (ties: the smaller path);
    ``nodes``: ``id``, ``name``; ``membership``: ``id``, ``community``. Processes are numbered in that order, from 0; that is a report of at most
    300 rows, so the number is taken after the limit. A trace through two communities or more is cross_community.
    """
    top = longest_per_ends(found).orderBy(F.size("path").desc(), "path").limit(most)
    place = F.row_number().over(Window.orderBy(F.size("path").desc(), "path")) - 1
    top = top.withColumn("idx", place)
    steps = top.select("idx", F.explode("path").alias("id")).join(membership.hint("merge"), "id").groupBy("idx").agg(F.array_sort(F.collect_set("community")).alias("communities"))
    a, b = nodes.select(F.col("id").alias("start"), F.col("name").alias("from_name")), nodes.select(F.col("id").alias("finish"), F.col("name").alias("to_name"))
    both = top.join(steps, "idx", "left").join(a.hint("merge"), "start", "left").join(b.hint("merge"), "finish", "left")
    name, last = F.coalesce("from_name", F.lit("Unknown")), F.coalesce("to_name", F.lit("Unknown"))
    big = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))
    communities = F.coalesce("communities", F.array().cast("array<string>"))
    return both.select(
        F.concat(F.lit("proc_"), F.col("idx").cast("string"), F.lit("_"), sanitize(name)).alias("process"),
        F.concat(big(name), F.lit(" → "), big(last)).alias("label"),
        F.when(F.size(communities) > 1, "cross_community").otherwise("intra_community").alias("kind"),
        F.size("path").alias("step_count"), F.array_join(communities, ",").alias("communities"),
        F.col("start").alias("entry"), F.col("finish").alias("terminal"), F.col("path").alias("trace"),
    )


def steps(found: DataFrame) -> DataFrame:
    """``process``, ``step`` (from 1), ``id`` of every node of a process."""
    return found.select("process", F.posexplode("trace").alias("step", "id")).select("process", (F.col("step") + 1).alias("step"), "id")


def module_labels(members: DataFrame) -> DataFrame:
    """``module``, ``label``: the word that most of a module's symbols (``module``, ``name``) have, the longer of equals, then the first by alphabet."""
    words = members.select("module", F.explode_outer(F.array_distinct(split_words(F.col("name")))).alias("word"))
    good = words.where(~F.col("word").isin(*NOISE)).groupBy("module", "word").agg(F.count("*").alias("n"))
    best = good.groupBy("module").agg(F.min(F.struct(-F.col("n"), -F.char_length("word"), "word")).getField("word").alias("label"))
    return members.select("module").distinct().join(best, "module", "left").select("module", F.coalesce("label", F.lit("misc")).alias("label"))


def community_labels(members: DataFrame) -> DataFrame:
    """``community``, ``label`` from ``community`` (number), ``name``, ``path``.

    The commonest parent folder that is not a general one; else the common beginning of more than two names, of more than two
    letters; else Cluster_ and the number. Ties between folders go to the first by name.
    """
    general = ("src", "lib", "core", "utils", "common", "shared", "helpers")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    folder = members.withColumn("folder", F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))))
    counted = folder.where(F.col("folder").isNotNull() & ~F.lower("folder").isin(*general)).groupBy("community", "folder").agg(F.count("*").alias("n"))
    best = counted.groupBy("community").agg(F.min(F.struct(-F.col("n"), "folder")).getField("folder").alias("folder"))
    names = members.where(F.coalesce("name", F.lit("")) != "").groupBy("community").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count("*").alias("n"))
    near = F.least(F.char_length("low"), F.char_length("high"))
    shared = F.filter(F.sequence(F.lit(0), near), lambda k: F.left("low", k.cast("int")) == F.left("high", k.cast("int")))
    prefix = F.left("low", F.array_max(shared).cast("int"))
    names = names.select("community", F.when((F.col("n") > 2) & (F.char_length(prefix) > 2), prefix).alias("prefix"))
    both = members.select("community").distinct().join(best, "community", "left").join(names, "community", "left")
    told = F.coalesce("folder", "prefix")
    big = F.concat(F.upper(F.left(told, F.lit(1))), F.substring(told, 2, 1 << 30))
    return both.select("community", F.coalesce(big, F.concat(F.lit("Cluster_"), F.col("community").cast("string"))).alias("label"))
