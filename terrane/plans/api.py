"""One function per tool: each takes tables and returns a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.scratch import materialize
from terrane.operators import change, decision, graph, search
from terrane.plans.cypher import Graph

IMPACT_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "CONTAINS", "FETCHES", "HANDLES_ROUTE", "HANDLES_TOOL", "STEP_IN_PROCESS", "QUERIES", "ACCESSES")


def cypher(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    return Graph(nodes, edges).query(text)


def impact(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", depth: int = 3) -> DataFrame:
    """What a change of ``seeds`` reaches, with its depth and the risk of the whole."""
    hit = graph.k_hop(edges, seeds, depth, direction, IMPACT_TYPES)
    n = hit.agg(F.count("*").alias("n"))
    return hit.crossJoin(n).withColumn("risk", graph.impact_risk(F.col("n"))).drop("n")  # one row of a count


def query(docs: DataFrame, nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Keyword hits first, then nodes by name."""
    return search.hybrid(search.bm25(docs, text), search.code_search(nodes, text), limit)


def processes_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``node``, ``process``, ``step`` of the processes that ids are steps of."""
    steps = edges.where("type = 'STEP_IN_PROCESS'")
    return steps.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("process"), "step")


#: Types by which a change of lines reaches others, and labels that no line change is told for.
DIFF_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY", "ACCESSES", "HANDLES_ROUTE", "FETCHES", "HANDLES_TOOL", "STEP_IN_PROCESS")
NO_LINES = ("File", "Folder", "Community", "Process")


def changed_nodes(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id`` of the nodes whose lines a hunk (``file``, ``start``, ``end``) touches; ``nodes`` may have a ``label``, by which files, folders and the like are left out."""
    ranges = change.merge_ranges(hunks.withColumnRenamed("file", "key")).withColumn("a_id", F.monotonically_increasing_id())
    some = nodes.where(~F.coalesce("label", F.lit("")).isin(*NO_LINES)) if "label" in nodes.columns else nodes
    spans = some.where("endLine >= startLine and startLine > 0").select(F.col("filePath").alias("key"), F.col("id").alias("b_id"), F.col("startLine").alias("start"), F.col("endLine").alias("end"))
    return change.overlaps(ranges, spans, 200).select(F.col("b_id").alias("id")).distinct()


def detect_changes(hunks: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, most: int = 200) -> DataFrame:
    """``id``, ``how`` (changed or affected), ``depth`` from diff hunks: merged, overlapped with nodes' lines, and followed; the first ``most`` affected are told."""
    touched = changed_nodes(hunks, nodes)
    reached = graph.k_hop(edges, touched, depth, "upstream", IMPACT_TYPES).orderBy("depth", "id").limit(most)
    return touched.select("id", F.lit("changed").alias("how"), F.lit(0).alias("depth")).union(reached.select("id", F.lit("affected"), "depth"))


def diff_risk(affected: Column, processes: Column) -> Column:
    """HIGH from 50 affected symbols or 10 steps of processes, MEDIUM from 10 or 1, else LOW."""
    return F.when((affected >= 50) | (processes >= 10), "HIGH").when((affected >= 10) | (processes > 0), "MEDIUM").otherwise("LOW")


def change_summary(hunks: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """One row: ``changed``, ``affected`` (all that is reached, not only what a report tells), ``processes`` (steps of processes that are changed symbols), ``risk``."""
    touched = materialize(changed_nodes(hunks, nodes), "touched")
    affected = graph.k_hop(edges, touched, depth, "upstream", DIFF_TYPES).agg(F.count("*").alias("affected"))
    steps = processes_of(edges, touched).select("node", "process").distinct().agg(F.count("*").alias("processes"))
    row = touched.agg(F.count("*").alias("changed")).crossJoin(affected).crossJoin(steps)  # one row each
    return row.withColumn("risk", diff_risk(F.col("affected"), F.col("processes")))


def route_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``route``, ``handlers``, ``consumers`` (sorted): one pass over the edges at routes."""
    at = edges.where("type in ('HANDLES_ROUTE', 'FETCHES')").join(nodes.where("label = 'Route'").select(F.col("id").alias("dst")), "dst")
    out = at.groupBy(F.col("dst").alias("route")).agg(
        F.sort_array(F.collect_set(F.when(F.col("type") == "HANDLES_ROUTE", F.col("src")))).alias("handlers"),
        F.sort_array(F.collect_set(F.when(F.col("type") == "FETCHES", F.col("src")))).alias("consumers"),
    )
    none = F.array().cast("array<string>")
    routes = nodes.where("label = 'Route'").select(F.col("id").alias("route"))
    return routes.join(out, "route", "left").select("route", F.coalesce("handlers", none).alias("handlers"), F.coalesce("consumers", none).alias("consumers"))


def tool_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tool``, ``handlers`` (sorted)."""
    at = edges.where("type = 'HANDLES_TOOL'").groupBy(F.col("dst").alias("tool")).agg(F.sort_array(F.collect_set("src")).alias("handlers"))
    tools = nodes.where("label = 'Tool'").select(F.col("id").alias("tool"))
    return tools.join(at, "tool", "left")


def canonical_for(canonical: DataFrame, concern: str, least: float = 0.55) -> DataFrame:
    return canonical.where((F.col("targetConcern") == concern) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "id")


def closure_for(members: DataFrame, unit: str) -> DataFrame:
    return members.where(F.col("target") == unit).orderBy("unit")


def review_findings(reviews: DataFrame, flags: DataFrame, plan: str) -> DataFrame:
    """Findings of the reviews that flag ``plan`` (``from``: review, ``to``: plan)."""
    return reviews.join(flags.where(F.col("to") == plan).select(F.col("from").alias("id")), "id", "left_semi").orderBy("id")


def rename_module(table_: DataFrame, old: str, new: str, columns: list[str]) -> DataFrame:
    """The table with a module renamed in plain and array columns, and within contract ids."""
    out = table_
    for c in columns:
        if out.schema[c].dataType.typeName() == "array":
            out = out.withColumn(c, F.transform(c, lambda x: F.when(x == old, new).otherwise(x)))
        else:
            parts = F.transform(F.split(c, "--"), lambda x: F.when(x == old, new).otherwise(x))
            out = out.withColumn(c, F.array_join(parts, "--"))
    return out


def migrate_annotations(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """``old_module``, ``new_module``: the module that holds more than ``least`` of the old one's files, the largest share first."""
    a = old.select(F.col("module").alias("old_module"), "file").distinct()
    size = a.groupBy("old_module").agg(F.count("*").alias("size"))
    shared = a.join(new.select(F.col("module").alias("new_module"), "file").distinct(), "file").groupBy("old_module", "new_module").agg(F.count("*").alias("n"))
    ratio = shared.join(size, "old_module").where(F.col("n") / F.col("size") > least)
    best = F.row_number().over(Window.partitionBy("old_module").orderBy(F.desc("n"), "new_module"))
    return ratio.withColumn("k", best).where("k = 1").select("old_module", "new_module")


def lint(symbols: DataFrame, calls: DataFrame, rules: DataFrame, most: int = 20) -> DataFrame:
    """``rule``, ``severity``, ``subject``: the first ``most`` of a rule, then one row for the others' number; errors first."""
    dead = decision.dead_code(symbols, calls).select(F.lit("dead-code").alias("rule"), F.lit("INFO").alias("severity"), F.col("id").alias("subject"))
    bad = decision.forbidden(calls, rules).select(F.lit("forbidden"), F.lit("ERROR"), F.concat("src_module", F.lit(" -> "), "dst_module"))
    found = dead.union(bad)
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("subject"))
    shown = found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    more = found.groupBy("rule", "severity").agg(F.count("*").alias("n")).where(F.col("n") > most)
    rest = more.select("rule", "severity", F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("subject"))
    order = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return shown.union(rest).orderBy(order, "rule", "subject")


def markdown(df: DataFrame) -> str:
    """A bounded result as a Markdown table; rows come one partition at a time."""
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.toLocalIterator()])


def mermaid(edges: DataFrame) -> str:
    """A bounded component graph (``source``, ``target``, ``weight``) as a Mermaid diagram."""
    rows = [(r.source, r.target, r.weight) for r in edges.orderBy("source", "target").toLocalIterator()]
    ids = {n: f"n{k}" for k, n in enumerate(sorted({x for a, b, _ in rows for x in (a, b)}))}
    quoted = lambda n: n.replace('"', "'")
    return "\n".join(["graph LR", *(f'  {i}["{quoted(n)}"]' for n, i in ids.items()), *(f"  {ids[a]} -->|{w}| {ids[b]}" for a, b, w in rows)])
