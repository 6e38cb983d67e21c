"""Consistency rules over the semantic layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Uncovered files that are told one by one, and the share of modules with missing files from which the map is stale.
SHOWN, STALE_PERCENT = 20, 30


def _issues(rows: DataFrame, level: str, kind: str, node: Column | str, layer: Column | str, *message: Column | str) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(
        F.lit(level).alias("level"), F.lit(kind).alias("type"), col(node).cast("string").alias("node_id"), (col(layer)).alias("layer"),
        F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]).alias("message"),
    )


def lint(
    nodes: DataFrame, annotations: DataFrame, module_files: DataFrame, dependencies: DataFrame, files: DataFrame,
    concept_files: DataFrame, contracts: DataFrame, flow_steps: DataFrame,
) -> DataFrame:
    """``level``, ``type``, ``node_id``, ``layer``, ``message`` of every broken rule.

    ``nodes``: ``layer``, ``id``, ``struct_hash``, ``source_hash`` (null: not enriched); ``annotations``: ``layer``, ``id``, ``nth``,
    ``stale``, ``reason``; ``module_files``: ``module``, ``file``; ``dependencies``: ``module``, ``on``; ``files``: ``file`` (those that exist);
    ``concept_files``: ``concept``, ``file``; ``contracts``: ``id``, ``provider``, ``consumer``; ``flow_steps``: ``flow``, ``module``.
    Of files that no module claims the first ``SHOWN`` are told and the others counted: that is the report.
    """
    there = files.select("file").distinct()
    modules = nodes.where("layer = 'module'").select(F.col("id").alias("module")).distinct()
    missing = module_files.distinct().join(there, "file", "left_anti")
    out = _issues(missing, "ERROR", "MISSING_FILE", "module", F.lit("module"), "Module \"", F.col("module"), "\" references missing file: ", F.col("file"))

    old = nodes.where("source_hash <> struct_hash")
    hashes = F.when(F.col("layer") == "module", F.concat(F.lit(" (source_hash "), "source_hash", F.lit(" ≠ struct_hash "), "struct_hash", F.lit(")"))).otherwise("")
    title = F.initcap("layer")
    out = out.union(_issues(old, "WARN", "STALE_ENRICHMENT", "id", "layer", title, " \"", F.col("id"), "\" enrichment is stale", hashes))

    stale = annotations.where("stale")
    why = F.coalesce("reason", F.lit("unknown reason"))
    out = out.union(_issues(stale, "WARN", "STALE_ANNOTATION", "id", "layer", "Annotation ", F.col("nth"), " on \"", F.col("id"), "\" is stale: ", why))

    linked = dependencies.select(F.explode(F.array("module", "on")).alias("module")).distinct()
    alone = modules.where("module <> '_root'").join(module_files.select("module").distinct(), "module", "left_semi").join(linked, "module", "left_anti")
    out = out.union(_issues(alone, "INFO", "ORPHAN_MODULE", "module", F.lit("module"), "Module \"", F.col("module"), "\" has no dependencies or dependents (isolated)"))

    free = there.join(module_files.select("file").distinct(), "file", "left_anti")
    shown = free.orderBy("file").limit(SHOWN)
    out = out.union(_issues(shown, "INFO", "UNCOVERED_FILE", "file", F.lit("module"), "Source file not claimed by any module: ", F.col("file")))
    more = free.agg((F.count("*") - SHOWN).alias("n")).where("n > 0")
    out = out.union(_issues(more, "INFO", "UNCOVERED_FILE", F.lit("_summary"), F.lit("module"), F.col("n"), f" more uncovered source files (only first {SHOWN} shown)"))

    lost = concept_files.distinct().join(there, "file", "left_anti")
    out = out.union(_issues(lost, "WARN", "MISSING_CONCEPT_REF", "concept", F.lit("concept"), "Concept \"", F.col("concept"), "\" references missing file: ", F.col("file")))

    for end in ("provider", "consumer"):
        gone = contracts.join(modules, contracts[end] == modules.module, "left_anti")
        out = out.union(_issues(gone, "ERROR", "CONTRACT_MODULE_MISSING", "id", F.lit("contract"), "Contract \"", F.col("id"), f"\" references missing {end} module: ", F.col(end)))

    astray = flow_steps.where(F.col("module") != "").join(modules, "module", "left_anti").groupBy("flow").agg(F.min("module").alias("module"))
    out = out.union(_issues(astray, "WARN", "FLOW_MODULE_MISSING", "flow", F.lit("flow"), "Flow \"", F.col("flow"), "\" step references missing module: ", F.col("module")))

    broken = modules.agg(F.count("*").alias("all")).crossJoin(missing.agg(F.count_distinct("module").alias("bad")))  # two rows of counts
    share = broken.where(F.col("all") > 0).select(F.floor(F.col("bad") / F.col("all") * 100 + 0.5).alias("percent")).where(F.col("percent") > STALE_PERCENT)
    told = ("Map staleness: HIGH (", F.col("percent"), "% of modules have missing files). Compile again.")
    return out.union(_issues(share, "WARN", "HIGH_STALENESS", F.lit("_map"), F.lit("module"), *told))
