"""What decisions are made from: a function's place, role, callers, processes and contracts, put together from facts and layers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from terrane.functions.entrypoints import BY_LANGUAGE, entry_score
from terrane.functions.names import ACTIONS, infer_role, is_noisy, resource_words, scope_hint, split_words
from terrane.functions.scratch import materialize


@dataclass(frozen=True)
class DecisionInputs:
    """Tables by function id.

    ``functions``: ``id``, ``name``, ``label``, ``path``, ``module``, ``scope``, ``language``, ``exported``, ``public``, ``role``, ``role_confidence``, ``callers``, ``callees``,
    ``external_refs``, ``process_refs``, ``contract_refs``, ``entry_score``, ``verbs``, ``resources``; ``calls``: ``src``, ``dst``; ``contracts``: ``function``, ``contract``;
    ``processes``: ``function``, ``process``; ``entries``: ``id``.
    """

    functions: DataFrame
    calls: DataFrame
    contracts: DataFrame
    processes: DataFrame
    entries: DataFrame


def decision_inputs(nodes: DataFrame, edges: DataFrame, steps: DataFrame, process_entries: DataFrame, modules: DataFrame, contracts: DataFrame) -> DecisionInputs:
    """The inputs of ``nodes`` (``id``, ``label``, ``name``, ``path``, ``exported``, ``language``), ``edges`` (``src``, ``dst``, ``type``), ``steps`` (``process``, ``id``),
    ``process_entries`` (``id``), ``modules`` (``module``, ``path``) and ``contracts`` (``id``, ``consumer``, ``provider``, ``interface``: array of names).

    Functions and methods count, but for those in test files. A file of no module is in ``unknown``. A caller is external if its file is known and of
    another module, or of none. A function has the contracts that its module provides under its name, and those that its module consumes under a callee's.
    Entries are those of processes, and functions of production code that score above 1 and are not named like a test step.
    Unknown languages count as typescript, as unnamed nodes by their id. Repeated calls, steps and files count once.
    """
    files = modules.groupBy("path").agg(F.max("module").alias("module"))
    named = nodes.select(
        "id", "label", F.coalesce("name", F.col("id").cast("string")).alias("name"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("exported", F.lit(False)).alias("exported"),
        F.when(F.col("language").isin(*BY_LANGUAGE, "vue"), F.col("language")).otherwise("typescript").alias("language"),
    ).dropDuplicates(["id"])
    placed = materialize(named.join(files, "path", "left"), "placed")
    calls = materialize(edges.where("type = 'CALLS'").select("src", "dst").distinct(), "calls")
    functions = placed.where(F.col("label").isin("Function", "Method")).withColumn("home", F.col("module")).withColumn("module", F.coalesce("module", F.lit("unknown")))
    met = calls.join(placed.select(F.col("id").alias("src"), F.col("path").alias("from_path"), F.col("module").alias("from_module")), "src", "left")
    met = met.join(functions.select(F.col("id").alias("dst"), F.col("module").alias("to_module")), "dst")
    outside = (F.coalesce("from_path", F.lit("")) != "") & ~F.coalesce(F.col("from_module") == F.col("to_module"), F.lit(False))
    into = met.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count_if(outside).alias("external_refs"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    processes = materialize(steps.select(F.col("id").alias("function"), "process").distinct(), "process-refs")
    of_process = processes.groupBy(F.col("function").alias("id")).agg(F.count("*").alias("process_refs"))
    sides = contracts.select(F.col("provider").alias("module")).union(contracts.select("consumer")).groupBy("module").agg(F.count("*").alias("contract_refs"))
    all_ = functions.join(into, "id", "left").join(out, "id", "left").join(of_process, "id", "left").join(sides, "module", "left")
    all_ = all_.fillna(0, ["callers", "external_refs", "callees", "process_refs", "contract_refs"])
    score = F.when(F.col("callees") > 0, entry_score(F.col("name"), F.col("exported"), F.col("callers"), F.col("callees"), F.col("path"), F.col("language"))).otherwise(0.0)
    role = infer_role(F.col("path"), F.col("module"), F.col("entry_score"), F.col("external_refs"), F.col("process_refs"), F.col("contract_refs"))
    all_ = all_.withColumn("entry_score", score).withColumn("r", role).where("r.role <> 'test'")
    told = materialize(
        all_.select(
            "id", "name", "label", "path", "module", scope_hint(F.col("module"), F.col("path")).alias("scope"), "language", "exported", (F.col("exported") | ~F.col("name").startswith("_")).alias("public"),
            F.col("r.role").alias("role"), F.col("r.confidence").alias("role_confidence"), "callers", "callees", "external_refs", "process_refs", "contract_refs", "entry_score",
            F.filter(split_words(F.col("name")), lambda w: w.isin(*ACTIONS)).alias("verbs"), resource_words(F.col("name")).alias("resources"),
        ),
        "decision-functions",
    )
    each = contracts.select(F.col("id").alias("contract"), "consumer", "provider", F.explode("interface").alias("symbol"))
    own = told.select(F.col("id").alias("function"), F.col("module").alias("provider"), F.col("name").alias("symbol")).join(each, ["provider", "symbol"]).select("function", "contract")
    callee = calls.join(placed.where(F.col("name") != "").select(F.col("id").alias("dst"), F.col("name").alias("symbol")), "dst").select(F.col("src").alias("function"), "symbol").distinct()
    used = callee.join(told.select(F.col("id").alias("function"), F.col("module").alias("consumer")), "function").join(each, ["consumer", "symbol"]).select("function", "contract")
    good = told.where((F.col("entry_score") > 1) & ~is_noisy(F.col("name")) & F.col("role").isin("prod_core", "prod_entrypoint")).select("id")
    return DecisionInputs(told, calls, own.union(used).distinct(), processes, process_entries.select("id").union(good).distinct())
