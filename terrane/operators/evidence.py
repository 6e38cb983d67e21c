"""Whether what enrichment jobs refer to exists: one union of existence joins, each failure with its own code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Labels of nodes that references of these kinds must have.
LABELS = {"route": "Route", "tool": "Tool", "process": "Process"}
UNSUPPORTED = ("module", "node", "relation", "process", "route", "tool", "decision")


def _finding(df: DataFrame, level: str, code: str, message: Column | str, kind: str | None = "kind", ref: str | None = "ref") -> DataFrame:
    one = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return df.select("job", F.lit(level).alias("level"), F.lit(code).alias("code"), one(kind).alias("kind"), one(ref).alias("ref"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def job_findings(
    jobs: DataFrame, evidence: DataFrame, files: DataFrame, elements: DataFrame, perspectives: DataFrame, anchors: DataFrame, facts: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> DataFrame:
    """``job``, ``level`` (error or warning), ``code``, ``kind``, ``ref``, ``message`` of all that is wrong with the jobs' targets, outputs and references.

    ``jobs``: ``job``, ``target_kind``, ``target``, ``output``, ``output_hash`` (both null: no output); ``evidence``: ``job``, ``kind``, ``ref``, ``file`` (of a file reference, else its ref); ``files``: ``path``;
    ``elements`` of the workspace: ``id``; ``perspectives``: ``id``; ``anchors``: ``kind``, ``ref`` that the workspace itself refers to, its modules' source paths with them.
    ``facts`` are nodes (``id``, ``label``), edges (``src``, ``dst``) and modules (``id``) of the graph. With them nodes, routes, tools, processes, modules and relations (``from->to``) must be there;
    without, a reference that the workspace does not know either is a warning. Decisions are always a warning. Each kind of reference is one semi- or anti-join, however
    many jobs refer to it. Repeated references of a job are told once.
    """
    refs = evidence.select("job", "kind", "ref", F.coalesce("file", "ref").alias("file")).distinct()
    no_target = jobs.where((F.coalesce("target", F.lit("")) == "") | (F.coalesce("target_kind", F.lit("")) == ""))
    out = [_finding(no_target, "error", "MISSING_TARGET", "Enrichment job must declare a target kind and id.", None, None)]
    bare = jobs.join(refs.select("job").distinct(), "job", "left_anti")
    out.append(_finding(bare, "error", "MISSING_EVIDENCE", "Enrichment job must include at least one evidence anchor.", None, None))
    paths = files.select(F.col("path").alias("file")).distinct()
    lost = refs.where("kind = 'file'").join(paths, "file", "left_anti")
    out.append(_finding(lost, "error", "MISSING_FILE", F.concat(F.lit("Evidence file does not exist: "), "file")))
    wrong = jobs.where(F.col("output").isNotNull() & ~F.coalesce(F.sha2(F.col("output").cast("binary"), 256) == F.col("output_hash"), F.lit(False)))
    out.append(_finding(wrong, "error", "OUTPUT_HASH_MISMATCH", "Enrichment job output hash does not match output content.", None, None))
    for kind, known, code, name in (("architecture-element", elements, "MISSING_ARCHITECTURE_ELEMENT", "workspace element"), ("architecture-perspective", perspectives, "MISSING_ARCHITECTURE_PERSPECTIVE", "perspective")):
        gone = jobs.where(F.col("target_kind") == kind).join(known.select(F.col("id").alias("target")).distinct(), "target", "left_anti")
        out.append(_finding(gone, "error", code, F.concat(F.lit(f"Architecture {name} does not exist: "), "target"), "target_kind", "target"))
    graph_kinds = UNSUPPORTED if facts is None else ("decision",)
    own = anchors.select("kind", "ref").distinct()
    own = own.union(elements.select(F.lit("module"), "id"))
    unsure = refs.where(F.col("kind").isin(*graph_kinds)).join(own.distinct(), ["kind", "ref"], "left_anti")
    module = F.when(F.col("kind") == "module", "Module").otherwise(F.col("kind"))
    out.append(_finding(unsure, "warning", "UNSUPPORTED_ANCHOR_VALIDATION", F.concat(module, F.lit(" anchor is recorded but not yet validated against the graph: "), "ref")))
    if facts is not None:
        nodes, edges, modules = facts
        ids = nodes.select(F.col("id").alias("ref"), "label").distinct()
        missing = lambda df, text: out.append(_finding(df, "error", "MISSING_GRAPH_ANCHOR", F.concat(F.lit(f"{text} does not exist: "), "ref")))
        missing(refs.where("kind = 'node'").join(ids.select("ref"), "ref", "left_anti"), "Code node")
        for kind, label in LABELS.items():
            missing(refs.where(F.col("kind") == kind).join(ids.where(F.col("label") == label).select("ref"), "ref", "left_anti"), f"{label} node")
        missing(refs.where("kind = 'module'").join(modules.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti"), "Module semantic artifact")
        ends = F.split("ref", "->")
        pairs = refs.where("kind = 'relation'").withColumns({"src": F.coalesce(F.get(ends, F.lit(0)), F.lit("")), "dst": F.coalesce(F.get(ends, F.lit(1)), F.lit(""))})
        told = (F.col("src") != "") & (F.col("dst") != "")
        missing(pairs.where(told).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), "Code relation")
        out.append(_finding(pairs.where(~told), "warning", "UNSUPPORTED_ANCHOR_VALIDATION", F.concat(F.lit("Relation anchor must use from->to format for graph-backed validation: "), "ref")))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def job_status(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """``job``, ``ok`` (no error), ``errors``, ``warnings`` of every job."""
    counts = findings.groupBy("job").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = jobs.select("job").distinct().join(counts, "job", "left").fillna(0, ["errors", "warnings"])
    return out.select("job", (F.col("errors") == 0).alias("ok"), "errors", "warnings")
