"""Change plans, reviews, doctrine, dirty sets and status over the decision plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# The weights of a plan's dimensions, and each option's scores on them. A pair holds the score where the
# condition (a canonical path, a closure, an abstraction is there) holds and where it does not.
DIMENSIONS = {
    "doctrine_alignment": 0.18,
    "canonical_alignment": 0.18,
    "closure_completeness": 0.2,
    "abstraction_quality": 0.14,
    "future_debt": 0.12,
    "compatibility_risk": 0.08,
    "complexity_delta": 0.05,
    "migration_cost": 0.05,
}
CONDITIONS = {"canonical_alignment": "has_canonical", "closure_completeness": "has_closure", "abstraction_quality": "has_abstraction"}
OPTIONS = {
    "local_patch": (None, False, [0.45, (0.2, 0.55), (0.25, 0.7), (0.25, 0.6), 0.3, 0.65, 0.95, 0.9]),
    "extract_helper": ("has_abstraction", False, [0.76, (0.62, 0.55), (0.65, 0.45), 0.9, 0.78, 0.82, 0.62, 0.56]),
    "canonicalize_path": ("has_canonical", False, [0.83, 0.95, (0.8, 0.62), (0.72, 0.58), 0.84, 0.9, 0.58, 0.46]),
    "cluster_wide_closure": ("has_closure", False, [0.81, (0.77, 0.55), 0.97, (0.68, 0.5), 0.8, 0.88, 0.44, 0.36]),
    "compatibility_bridge": (None, True, [0.22, 0.1, 0.2, 0.18, 0.12, 0.15, 0.55, 0.72]),
}
COMPATIBILITY = r"(?i)\b(legacy|compat(ibility)?|shim|polyfill|deprecated|backward)"


def option_table(spark: SparkSession) -> DataFrame:
    """``option``, ``needs``, ``discouraged``, ``dimension``, ``weight``, ``given``, ``if_true``, ``if_false``: 40 rows."""
    rows = []
    for option, (needs, discouraged, scores) in OPTIONS.items():
        for (dimension, weight), score in zip(DIMENSIONS.items(), scores):
            yes, no = score if isinstance(score, tuple) else (score, score)
            rows.append((option, needs, discouraged, dimension, weight, CONDITIONS.get(dimension), yes, no))
    return spark.createDataFrame(rows, "option string, needs string, discouraged boolean, dimension string, weight double, given string, if_true double, if_false double")


def change_plans(targets: DataFrame) -> DataFrame:
    """``target``, ``option``, ``total_score``, ``confidence``, ``discouraged``, ``recommended`` for every option that applies.

    ``targets``: ``target``, ``has_canonical``, ``has_closure``, ``has_abstraction``. The best option that is not
    discouraged is recommended, the earlier name of equals; a local patch is discouraged where anything better is there.
    """
    facts = F.create_map(*[x for c in ("has_canonical", "has_closure", "has_abstraction") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(False)))])
    rows = targets.select("target", facts.alias("facts"), F.lit(1).alias("one")).join(F.broadcast(option_table(targets.sparkSession).withColumn("one", F.lit(1))), "one")
    holds = lambda c: F.coalesce(F.try_element_at("facts", F.col(c)), F.lit(True))
    rows = rows.where(F.col("needs").isNull() | holds("needs")).withColumn("score", F.when(holds("given"), F.col("if_true")).otherwise(F.col("if_false")))
    better = F.exists(F.map_values("facts"), lambda x: x)
    rows = rows.withColumn("discouraged", F.col("discouraged") | ((F.col("option") == "local_patch") & better))
    out = rows.groupBy("target", "option", "discouraged").agg(F.round(F.sum(F.col("score") * F.col("weight")), 3).alias("total_score"), F.round(F.avg("score"), 3).alias("confidence"))
    order = Window.partitionBy("target").orderBy("discouraged", F.desc("total_score"), "option")
    return out.withColumn("recommended", F.row_number().over(order) == 1)


def review_findings(changed: DataFrame, added: DataFrame, units: DataFrame, closures: DataFrame, canonical: DataFrame) -> DataFrame:
    """``kind``, ``severity``, ``ref``: compatibility code, closures that a patch leaves open, canonical paths that it goes around.

    ``changed``: ``file``; ``added``: ``line``; ``units``: ``unit``, ``file``, ``module``, ``family``; ``closures``: ``target``, ``unit``, ``level``;
    ``canonical``: ``id``, ``family``, ``module``. A changed module is that of any unit in a changed file.
    """
    words = changed.where(F.col("file").rlike(COMPATIBILITY)).select(F.col("file").alias("ref"))
    words = words.union(added.where(F.col("line").rlike(COMPATIBILITY)).select("line")).distinct()
    first = words.select(F.lit("compatibility_layer").alias("kind"), F.lit("warning").alias("severity"), "ref")
    files = changed.select("file").distinct()
    hit = units.join(files, "file", "left_semi")
    must = closures.where("level = 'must'").join(hit.select(F.col("unit").alias("target")), "target", "left_semi").select("unit").distinct()
    open_ = units.join(must, "unit", "left_semi").join(files, "file", "left_anti")
    second = open_.select(F.lit("local_patch"), F.lit("warning"), F.col("unit"))
    around = canonical.join(hit.select("family").distinct(), "family", "left_semi").join(hit.select("module").distinct(), "module", "left_anti")
    third = around.select(F.lit("canonical_bypass"), F.lit("warning"), F.col("id"))
    return first.union(second).union(third)


def doctrine(modules: DataFrame, contracts: DataFrame, flows: DataFrame, annotations: DataFrame, evidence: int = 5) -> DataFrame:
    """``kind``, ``strength``, ``scope``, ``statement``, ``evidence`` (sorted ids): rules that a repository's layers imply or its authors wrote.

    ``annotations``: ``module``, ``type``, ``content``, ``stale``; stale ones and types but constraint and intent are left out.
    """

    def implied(df: DataFrame, least: int, kind: str, text: str) -> DataFrame:
        n = df.agg(F.count("*").alias("n"))
        few = df.select("id").distinct().orderBy("id").limit(evidence).agg(F.array_sort(F.collect_list("id")).alias("evidence"))
        both = few.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").where(F.col("n") >= least)
        return both.select(F.lit(kind).alias("kind"), F.lit("soft").alias("strength"), F.lit("repo").alias("scope"), F.lit(text).alias("statement"), "evidence")

    out = implied(modules, 2, "principle", "Change the module that owns a behaviour before adding a way between modules.")
    out = out.union(implied(contracts, 1, "preferred_pattern", "Extend a contract that is there rather than go around it."))
    out = out.union(implied(flows, 1, "preferred_pattern", "Review the whole flow that a change touches."))
    own = annotations.where("not stale and type in ('constraint', 'intent')")
    hard = F.col("type") == "constraint"
    own = own.select(
        F.when(hard, "constraint").otherwise("decision_note"), F.when(hard, "hard").otherwise("soft"), F.lit("module"), "content", F.array("module")
    )
    return out.union(own)


def relevant_doctrine(statements: DataFrame, modules: DataFrame) -> DataFrame:
    """Repository-wide statements, and those whose evidence names one of ``modules`` (``id``)."""
    named = statements.where("scope <> 'repo'").withColumn("id", F.explode("evidence")).join(modules.select("id").distinct(), "id", "left_semi")
    return statements.where("scope = 'repo'").union(named.select(*statements.columns)).distinct()


def dirty_set(changed: DataFrame, exports: DataFrame, members: DataFrame) -> DataFrame:
    """``kind`` (file, symbol, module), ``id`` of what a change of ``file``s makes stale; ``exports``: ``file``, ``name``; ``members``: ``module``, ``file``."""
    files = changed.select("file").distinct()
    symbols = exports.join(files, "file", "left_semi").select(F.concat_ws("::", "file", "name").alias("id")).distinct()
    modules = members.join(files, "file", "left_semi").select("module").distinct()
    out = files.select(F.lit("file").alias("kind"), F.col("file").cast("string").alias("id"))
    return out.union(symbols.select(F.lit("symbol"), "id")).union(modules.select(F.lit("module"), "module"))


def coverage(nodes: DataFrame) -> DataFrame:
    """``layer``, ``n``, ``enriched``, ``stale``, ``status`` of nodes (``layer``, ``struct_hash``, ``source_hash``)."""
    out = nodes.groupBy("layer").agg(
        F.count("*").alias("n"), F.count("source_hash").alias("enriched"), F.count_if(F.col("source_hash") != F.col("struct_hash")).alias("stale")
    )
    status = F.when(F.col("enriched") == 0, "none").when(F.col("enriched") < F.col("n"), "partial").otherwise("complete")
    return out.withColumn("status", status)


def preserve_zones(fresh: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``fresh`` with what people and models wrote in ``columns`` before, where they hold nothing themselves; source hashes stay as stored."""
    old = previous.select("id", *[F.col(c).alias(f"__old_{c}") for c in columns])
    both = fresh.join(old, "id", "left")
    return both.select(*[F.coalesce(F.col(c), F.col(f"__old_{c}")).alias(c) if c in columns else F.col(c) for c in fresh.columns])


def mark_stale(annotations: DataFrame, changed: DataFrame, reason: str) -> DataFrame:
    """Annotations (``id``, ``stale``, ``stale_reason``) of changed ``id``s marked; those that were stale keep their reason."""
    ids = changed.select("id", F.lit(True).alias("__hit")).distinct()
    both = annotations.join(ids, "id", "left")
    hit = F.col("__hit") & ~F.col("stale")
    return both.withColumn("stale_reason", F.when(hit, reason).otherwise(F.col("stale_reason"))).withColumn("stale", F.col("stale") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def consistency(claims: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """``claim``, ``finding`` for documents' claims (``claim``, ``subject``, ``expects``) against facts (``subject``, ``value``) and known ``subject``s.

    confirmed or contradicted where a fact is known, graph-gap where only a source names the subject, else stale-doc.
    """
    known = facts.groupBy("subject").agg(F.collect_set("value").alias("values"))
    named = sources.select("subject", F.lit(True).alias("named")).distinct()
    both = claims.join(known, "subject", "left").join(named, "subject", "left")
    finding = (
        F.when(F.col("expects").isNull(), "unknown")
        .when(F.array_contains("values", F.col("expects")), "confirmed")
        .when(F.col("values").isNotNull(), "contradicted")
        .when(F.col("named"), "graph-gap")
        .otherwise("stale-doc")
    )
    return both.select("claim", finding.alias("finding"))


def valid_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides with ``valid``: target and reason are not blank and there is evidence (array)."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return overrides.withColumn("valid", filled("target") & filled("reason") & F.coalesce(F.size("evidence") > 0, F.lit(False)))


def diverse(entries: list[str], target: str, limit: int) -> list[str]:
    """Of a bounded list, the names nearest to ``target`` that differ among themselves: relevance less 8 times the largest overlap and long names' excess."""

    def words(name: str) -> set[str]:
        out, run = set(), ""
        for c in name + " ":
            if not c.isalnum() or (c.isupper() and run and run[-1].islower()):
                out.add(run.lower())
                run = ""
            run += c if c.isalnum() else ""
        return out - {""}

    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    wanted, left, chosen = words(target), sorted(set(entries)), []
    while left and len(chosen) < limit:
        worth = lambda e: 10 * len(words(e) & wanted) - 8 * max((share(words(e), words(c)) for c in chosen), default=0) - max(0, len(e) - 48) / 16
        best = max(left, key=lambda e: (worth(e), [-ord(c) for c in e]))
        chosen.append(best)
        left.remove(best)
    return chosen
