"""Architecture: leaf figures, where to split, recursion plans; traces, type propagation, middleware, task phases and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.scratch import materialize

#: A group of at most so many files is a leaf, as is one this deep or of a larger cohesion.
LEAF_FILES, LEAF_DEPTH, LEAF_COHESION = 15, 3, 0.7
#: Confidence of corrections, from low to high.
CONFIDENCE = ("low", "medium", "high")


def leaf_stats(files: DataFrame, functions: DataFrame) -> DataFrame:
    """``module``, ``file_count``, ``function_count``, ``total_cyclomatic``, ``max_cyclomatic``, ``max_nesting_depth``, ``risk_score`` of every module with files.

    ``files``: ``module``, ``file``; ``functions``: ``module``, ``cyclomatic``, ``depth`` (null counts as 0). Half of the
    risk is the worst cyclomatic number times the deepest nesting, half is three points a file; each stops at 50.
    """
    sizes = files.groupBy("module").agg(F.count_distinct("file").alias("file_count"))
    whole = lambda name, c: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    sums = functions.groupBy("module").agg(
        F.count("*").alias("n"), F.sum("cyclomatic").alias("total"), F.max("cyclomatic").alias("most"), F.max("depth").alias("deepest")
    )
    both = sizes.join(sums, "module", "left").select(
        "module",
        "file_count",
        whole("function_count", F.col("n")),
        whole("total_cyclomatic", F.col("total")),
        whole("max_cyclomatic", F.col("most")),
        whole("max_nesting_depth", F.col("deepest")),
    )
    risk = F.least(F.lit(50), F.col("max_cyclomatic") * F.col("max_nesting_depth")) + F.least(F.lit(50), F.col("file_count") * 3)
    return both.withColumn("risk_score", risk.cast("long"))


def group_kinds(files: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """``group``, ``n_files``, ``cohesion``, ``kind`` ('leaf' or 'group', which is to be split further).

    ``files``: ``group``, ``file``; ``nodes``: ``id``, ``group``; ``edges``: ``src``, ``dst``. Cohesion is the share of
    inner edges among all that touch the group, 1 without any. Ends that are no node belong to no group.
    """
    of = nodes.select("id", "group").distinct()
    ends = edges.join(of.select(F.col("id").alias("src"), F.col("group").alias("a")), "src", "left")
    ends = ends.join(of.select(F.col("id").alias("dst"), F.col("group").alias("b")), "dst", "left")
    touched = ends.groupBy("a", "b").agg(F.count("*").alias("n"))
    sides = touched.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("group"), F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0).alias("inner"), "n")
    shares = sides.where(F.col("group").isNotNull()).groupBy("group").agg((F.sum("inner") / F.sum("n")).alias("cohesion"))
    out = files.groupBy("group").agg(F.count_distinct("file").alias("n_files")).join(shares, "group", "left")
    out = out.withColumn("cohesion", F.coalesce("cohesion", F.lit(1.0)))
    leaf = (F.col("n_files") <= LEAF_FILES) | F.lit(depth >= LEAF_DEPTH) | (F.col("cohesion") > LEAF_COHESION)
    return out.withColumn("kind", F.when(leaf, "leaf").otherwise("group"))


def recursion_plan(elements: DataFrame, terminal: str = "code_element") -> DataFrame:
    """``id``, ``action`` ('recurse' or 'leaf'), ``n_children`` from ``id``, ``parent_id``, ``level``; elements of the terminal level have no children."""
    below = elements.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    n = F.when(F.col("level") == terminal, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    out = elements.select("id", "level").join(below, "id", "left").select("id", n.alias("n_children"))
    return out.select("id", F.when(F.col("n_children") > 0, "recurse").otherwise("leaf").alias("action"), "n_children")


def drop_contained(traces: DataFrame) -> DataFrame:
    """``trace``, ``path`` (names in order) of the traces that are no part of another one; of equal paths the smallest ``trace`` stays.

    A path is a part of a longer one if its names follow each other there; of the last name a beginning is enough, as
    in a comparison of joined names, but for paths of one name. Every path is expanded into its own parts, so it is an equi-join whose rows grow
    with the square of a path's length, which enumeration bounds, and not with the number of paths.
    """
    size, digest = F.size("path"), lambda p: [F.xxhash64(p), F.xxhash64(F.lit(1), p)]  # paths and stems are told apart by 128 bits
    once = traces.where(size > 0).groupBy("path").agg(F.min("trace").alias("trace")).select("trace", "path", F.struct(size, F.xxhash64("path")).alias("me"))
    h, g = digest(F.slice("path", 1, size - 1))
    own = once.select("trace", F.xxhash64("path").alias("key"), "me", F.element_at("path", size).alias("last"), h.alias("h"), g.alias("g"))
    starts = once.select("path", "me", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    # A path of one name lies in any longer one that has the name: each name once, with the longest path that holds it.
    single = starts.groupBy(F.element_at("path", F.col("at")).alias("last")).agg(F.max("me").alias("in"))
    alone = own.where("me.col1 = 1").join(single, "last").where(F.col("in") > F.col("me"))
    spans = starts.where(F.col("at") < size).select("path", "me", "at", F.explode(F.sequence(F.lit(2), size - F.col("at") + 1)).alias("n"))
    h, g = digest(F.slice("path", F.col("at"), F.col("n") - 1))
    parts = spans.select(h.alias("h"), g.alias("g"), F.element_at("path", (F.col("at") + F.col("n") - 1).cast("int")).alias("whole"), F.col("me").alias("in"))
    # Names that follow a stem; a path never removes itself.
    later = own.where("me.col1 > 1").join(parts, ["h", "g"]).where(F.startswith("whole", "last") & ((F.col("in") > F.col("me")) | (F.col("whole") != F.col("last"))))
    gone = alone.select("trace", "key").union(later.select("trace", "key")).distinct()
    return once.withColumn("key", F.xxhash64("path")).join(gone, ["trace", "key"], "left_anti").select("trace", "path")


def process_entries(processes: DataFrame, nodes: DataFrame, handlers: DataFrame) -> DataFrame:
    """ENTRY_POINT_OF edges: ``src``, ``dst``, ``type``, ``confidence`` from routes and tools to the processes that begin in their file.

    ``processes``: ``id``, ``entry``; ``nodes``: ``id``, ``file``; ``handlers``: ``id``, ``file``.
    """
    begins = processes.select(F.col("id").alias("dst"), F.col("entry")).join(nodes.select(F.col("id").alias("entry"), "file"), "entry")
    found = begins.join(handlers.select(F.col("id").alias("src"), "file"), "file").select("src", "dst").distinct()
    return found.select("src", "dst", F.lit("ENTRY_POINT_OF").alias("type"), F.lit(0.85).alias("confidence"))


def propagate_types(known: DataFrame, pending: DataFrame, returns: DataFrame, members: DataFrame, rounds: int = 10) -> DataFrame:
    """``scope``, ``name``, ``type``: ``known`` and what follows from ``pending`` in at most ``rounds`` rounds; a first type stays.

    ``pending``: ``seq``, ``scope``, ``name``, ``kind``, ``source``, ``member``. Kind 'call' takes what ``returns``
    (``callee``, ``type``) says of ``source``; 'copy' the type of ``source`` in its scope, else in the file's scope
    (''); 'field' and 'method' look up the type of ``source`` in its scope and then ``member`` in ``members``
    (``owner``, ``kind``, ``member``, ``type``). The smallest ``seq`` wins among those of one round.
    """
    env = materialize(known.groupBy("scope", "name").agg(F.min("type").alias("type")), "types")
    called = returns.groupBy(F.col("callee").alias("source")).agg(F.min("type").alias("found"))
    held = members.groupBy(F.col("owner").alias("base"), "kind", "member").agg(F.min("type").alias("found"))
    for _ in range(rounds):
        # A scope without any type yet resolves nothing.
        open_ = pending.join(env.select("scope").distinct(), "scope", "left_semi").join(env.select("scope", "name"), ["scope", "name"], "left_anti")
        here = env.select("scope", F.col("name").alias("source"), F.col("type").alias("base"))
        outer = env.where("scope = ''").select(F.col("name").alias("source"), F.col("type").alias("outer"))
        based = open_.where("kind <> 'call'").join(here, ["scope", "source"], "left").join(outer, "source", "left")
        columns = ["seq", "scope", "name", "found"]
        fresh = open_.where("kind = 'call'").join(called, "source").select(*columns)
        fresh = fresh.union(based.where("kind = 'copy'").withColumn("found", F.coalesce("base", "outer")).select(*columns))
        fresh = fresh.union(based.where("kind <> 'copy'").join(held, ["base", "kind", "member"]).select(*columns))
        fresh = fresh.where(F.col("found").isNotNull()).groupBy("scope", "name").agg(F.min_by("found", "seq").alias("type"))
        fresh = materialize(fresh, "types")
        if fresh.isEmpty():
            break
        env = materialize(env.union(fresh.select("scope", "name", "type")), "types")
    return env


def attach_middleware(routes: DataFrame, labels: list[str], matchers: list[str]) -> DataFrame:
    """``routes`` (``path``, ``middleware`` array) with ``labels`` put first wherever a matcher (a regular expression of the whole path) holds; none: everywhere."""
    holds = F.lit(not matchers)
    for m in matchers:
        holds = holds | F.col("path").rlike(f"^(?:{m})$")
    mine, had = F.array(*[F.lit(x) for x in labels]).cast("array<string>"), F.coalesce("middleware", F.array().cast("array<string>"))
    return routes.withColumn("middleware", F.when(holds, F.concat(mine, F.array_except(had, mine))).otherwise(had))


def task_phase(tasks: DataFrame) -> DataFrame:
    """``tasks`` with ``phase`` and ``mode``.

    Columns: ``has_facts``, ``intent``, ``changed_files``, ``index_status``, ``graph_gaps``, ``stale_docs``, ``unknown``,
    ``contradicted``; null counts as false, none or 0. Without facts a task begins with bootstrap; a change goes to
    review; doubts lead to enrichment, of the kind that fits them; all else is development.
    """
    n = lambda name: F.coalesce(name, F.lit(0))
    partial = F.coalesce(F.col("index_status") == "partial", F.lit(False))
    settled = (n("graph_gaps") == 0) & (n("stale_docs") == 0) & (n("contradicted") == 0)
    change = (n("changed_files") > 0) | F.coalesce(F.col("intent") == "change", F.lit(False))
    architecture = F.coalesce(F.col("intent") == "architecture", F.lit(False))
    mode = F.when(~F.coalesce("has_facts", F.lit(False)) | change, "none")
    mode = mode.when(architecture & (~settled | (n("unknown") > 0) | partial), "architecture-enrich")
    mode = mode.when(~settled | (n("unknown") >= 12), "docs-consistency-review")
    mode = mode.when((n("unknown") > 0) | partial, "bounded-stale-enrich").otherwise("none")
    phase = F.when(~F.coalesce("has_facts", F.lit(False)), "bootstrap").when(change, "review").when(F.col("mode") != "none", "enrich").otherwise("develop")
    return tasks.withColumn("mode", mode).withColumn("phase", phase)


def confidence_rank(confidence: Column) -> Column:
    """Place of a confidence among :data:`CONFIDENCE`, from 1; 0 for any other."""
    return F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.coalesce(confidence, F.lit("")))


def correction_plan(corrections: DataFrame, least: str = "medium") -> DataFrame:
    """``nth``, ``id``, ``kind``, ``confidence`` of open or accepted corrections of at least this confidence, numbered by ``seq``."""
    good = corrections.where(F.col("status").isin("open", "accepted") & (confidence_rank(F.col("confidence")) > CONFIDENCE.index(least)))
    return good.select(F.row_number().over(Window.orderBy("seq", "id")).alias("nth"), "id", "kind", "confidence")  # people wrote them: few rows


def correction_findings(corrections: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``, ``code``, ``ref``: what corrections name but the facts lack.

    ``corrections``: ``id``, ``evidence`` (array of files), ``nodes`` (array of ids), ``src``, ``dst``, ``type`` (an edge
    that is said to be missing, or null). An edge that is there already is a finding, too.
    """
    named = lambda column, code: corrections.select("id", F.lit(code).alias("code"), F.explode(F.array_distinct(column)).alias("ref"))
    lost = named("evidence", "EVIDENCE_FILE_MISSING").join(files.select(F.col("file").alias("ref")), "ref", "left_anti")
    gone = named("nodes", "NODE_MISSING").join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti")
    there = corrections.select("id", "src", "dst", "type").join(edges.select("src", "dst", "type").distinct(), ["src", "dst", "type"])
    there = there.select("id", F.lit("EDGE_PRESENT").alias("code"), F.concat_ws(" ", "src", "type", "dst").alias("ref"))
    columns = ["id", "code", "ref"]
    return lost.select(*columns).union(gone.select(*columns)).union(there)
