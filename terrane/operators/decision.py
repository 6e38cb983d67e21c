"""Decision plane: symmetry, closures, abstractions, rules and risks. Families and canonical paths are in :mod:`families`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.scratch import materialize

KIND, MODULE, WORDS = 0.45, 0.3, 0.25
SOFT_AT = 0.55


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _likeness() -> tuple[Column, Column]:
    """The score and strength of two units with ``k1``, ``k2`` (kinds), ``m1``, ``m2`` (modules), ``w1``, ``w2`` (words)."""
    alike_kind, alike_module = F.col("k1") == F.col("k2"), F.col("m1") == F.col("m2")
    score = alike_kind.cast("int") * KIND + alike_module.cast("int") * MODULE + jaccard(F.col("w1"), F.col("w2")) * WORDS
    score = F.when(alike_kind | alike_module, score)  # words alone are too little
    return score, F.when(alike_kind & alike_module & (F.col("k1") != "unknown"), "hard").when(score >= SOFT_AT, "soft")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _words() -> Column:
    return F.array_sort(F.array_distinct(F.coalesce("words", F.array().cast("array<string>"))))


def symmetry_edges(units: DataFrame) -> DataFrame:
    """``family``, ``from_unit``, ``to_unit``, ``score``, ``strength`` of the unordered pairs of a family that are alike.

    ``units``: ``family``, ``unit``, ``kind``, ``module``, ``words`` (array). Units of one kind, not ``unknown``, in one
    module are ``hard``; others are ``soft`` from a score of ``SOFT_AT``: .45 for the kind, .3 for the module, .25 times the words'
    Jaccard similarity. So pairs of one kind in two modules need a similarity of .4, and pairs of two kinds in one module
    equal words: they come from an index of each unit's rarest words, of which such a pair shares one, and from the words
    as a whole; nothing else is paired. A pair that shares several of the rarest words is told at the first one, so pairs are neither shuffled nor held.
    """
    units = materialize(units.select("family", "unit", "kind", "module", _words().alias("words"), F.monotonically_increasing_id().alias("row")), "units")
    parts = _parts(units)
    side = lambda n, unit, *more: [F.col("unit").alias(unit), F.col("kind").alias(f"k{n}"), F.col("module").alias(f"m{n}"), F.col("words").alias(f"w{n}"), *more]
    ordered, cross = F.col("from_unit") < F.col("to_unit"), F.col("m1") != F.col("m2")

    def met(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
        """All ordered pairs of rows with equal keys, by a fixed number of tasks: few bytes make many pairs."""
        a = rows.select(*keys, *side(1, "from_unit", *[F.col(c).alias(f"{c}1") for c in more])).repartition(parts, *keys)
        b = rows.select(*keys, *side(2, "to_unit", *[F.col(c).alias(f"{c}2") for c in more]))
        return a.join(b.hint("merge"), keys).where(ordered)

    same = met(units.withColumns({"a": F.col("kind"), "b": F.col("module")}), ["family", "a", "b"])
    equal = met(units.where(F.size("words") > 0).withColumns({"a": F.col("module"), "b": F.array_join("words", "\0")}), ["family", "a", "b"]).where((F.col("k1") != F.col("k2")) & (F.col("w1") == F.col("w2")))

    word = units.select("family", "kind", "row", F.explode("words").alias("word"))
    often = word.groupBy("family", "kind", "word").agg(F.count("*").alias("often"))
    least = (SOFT_AT - KIND) / WORDS
    ranked = word.join(often, ["family", "kind", "word"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("all"))
    n = F.size("all")
    rare = ranked.select("row", F.slice(F.col("all.word"), 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int")).alias("rare"))
    index = units.join(rare, "row").withColumns({"a": F.col("kind"), "b": F.explode("rare")})
    near = met(index, ["family", "a", "b"], "rare").where(cross & (F.col("b") == F.element_at(F.array_intersect("rare1", "rare2"), 1)))

    columns = ["family", "from_unit", "to_unit", "k1", "k2", "m1", "m2", "w1", "w2"]
    both = same.select(columns).union(equal.select(columns)).union(near.select(columns))
    score, strength = _likeness()
    out = both.select("family", "from_unit", "to_unit", F.round(score, 3).alias("score"), strength.alias("strength"))
    return out.where(F.col("strength").isNotNull())


def closure_members(units: DataFrame, symmetry: DataFrame | None, cochange: DataFrame) -> DataFrame:
    """``target``, ``unit``, ``level``, ``reason``, ``confidence``: what has to be looked at, or changed, with a unit.

    ``units``: ``family``, ``unit``, ``file``; ``cochange``: ``a``, ``b``, ``confidence`` of files. Symmetry outranks
    co-change of files, which outranks a shared family; each member is told once. Of several rules for one pair of files the first in the order of
    :func:`change.ranked_rules` counts: the surest.

    Without ``symmetry``, it is that of :func:`symmetry_edges` (``units`` then have ``kind``, ``module``, ``words`` too), told for each pair of a family where it
    meets. All pairs of a family are members, so the result grows with the square of families; it is streamed: only pairs with a unit that is given
    repeatedly are shuffled. Units are dealt evenly by their name, and each part meets its own copy of the others.
    """
    if symmetry is not None:
        return _members_by(units, symmetry, cochange)
    rules = cochange.select("a", "b", "confidence").union(cochange.select("b", "a", "confidence")).where("a <> b")
    rules = materialize(rules.groupBy("a", "b").agg(F.max("confidence").alias("confidence")), "rules")
    by_file = rules.groupBy(F.col("a").alias("file")).agg(F.map_from_entries(F.collect_list(F.struct("b", "confidence"))).alias("rules"))
    each = units.select("family", "unit", "file", "kind", "module", _words().alias("words"), (F.count("*").over(Window.partitionBy("unit")) > 1).alias("often"))
    each = materialize(each.join(by_file, "file", "left"), "units")
    parts = _parts(units)
    deal = 4 * parts

    def dealt(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
        x = x.withColumn("part", F.pmod(F.xxhash64("target"), F.lit(deal))).repartition(parts, "part", *on)
        y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
        return x.join(y.hint("merge"), ["part", *on]).where("target <> unit")  # the copies are many: never a broadcast

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        mine = x.select("family", F.col("unit").alias("target"), F.col("kind").alias("k1"), F.col("module").alias("m1"), F.col("words").alias("w1"), "rules")
        peer = y.select("family", "unit", "file", F.col("kind").alias("k2"), F.col("module").alias("m2"), F.col("words").alias("w2"))
        score, strength = _likeness()
        kin = dealt(mine, peer, "family").select("target", "unit", F.round(score, 3).alias("score"), strength.alias("strength"), F.element_at("rules", F.col("file")).alias("rule"))
        alike, ruled = F.col("strength").isNotNull(), F.col("rule").isNotNull()
        of = lambda first, second, third: F.when(alike, first).when(ruled, second).otherwise(third)
        kin = kin.select(
            "target", "unit", of(F.lit(1), F.lit(2), F.lit(3)).alias("priority"),
            of(F.when(F.col("strength") == "hard", "must_review").otherwise("should_review"), F.lit("should_review"), F.lit("must_change_if_strategy_selected")).alias("level"),
            of(F.lit("symmetry"), F.lit("cochange"), F.lit("family")).alias("reason"), of(F.col("score"), F.col("rule"), F.lit(0.5)).alias("confidence"),
        )
        ruled_by = x.select(F.col("family").alias("f1"), F.col("unit").alias("target"), F.explode("rules").alias("file", "confidence"))
        far = dealt(ruled_by, y.select("family", "unit", "file"), "file").where(~F.coalesce(F.col("f1") == F.col("family"), F.lit(False)))
        return kin.union(far.select("target", "unit", F.lit(2), F.lit("should_review"), F.lit("cochange"), "confidence"))

    one, many = each.where("not often"), each.where("often")
    repeated = pairs(many, each).union(pairs(one, many)).withColumn("weight", -F.col("confidence"))
    return pairs(one, one).select("target", "unit", "level", "reason", "confidence").union(_best(repeated))


def _best(every: DataFrame) -> DataFrame:
    best = every.groupBy("target", "unit").agg(F.min(F.struct("priority", "weight", "level", "reason", "confidence")).alias("x"))
    return best.select("target", "unit", "x.level", "x.reason", "x.confidence")


def _members_by(units: DataFrame, symmetry: DataFrame, cochange: DataFrame) -> DataFrame:
    ends = symmetry.select(F.col("from_unit").alias("target"), F.col("to_unit").alias("unit"), "strength", "score")
    ends = ends.union(symmetry.select("to_unit", "from_unit", "strength", "score"))
    level = F.when(F.col("strength") == "hard", "must_review").otherwise("should_review")
    first = ends.select("target", "unit", F.lit(1).alias("priority"), level.alias("level"), F.lit("symmetry").alias("reason"), F.col("score").alias("confidence"))
    rules = cochange.select("a", "b", "confidence").union(cochange.select("b", "a", "confidence")).where("a <> b")
    a = units.select(F.col("unit").alias("target"), F.col("file").alias("a"))
    b = units.select("unit", F.col("file").alias("b"))
    second = rules.join(a, "a").join(b, "b").where("target <> unit")
    second = second.select("target", "unit", F.lit(2).alias("priority"), F.lit("should_review").alias("level"), F.lit("cochange").alias("reason"), "confidence")
    mine, peer = units.select("family", F.col("unit").alias("target")), units.select("family", "unit")
    third = mine.join(peer, "family").where("target <> unit")
    third = third.select("target", "unit", F.lit(3).alias("priority"), F.lit("must_change_if_strategy_selected").alias("level"), F.lit("family").alias("reason"), F.lit(0.5).alias("confidence"))
    every = first.union(second).union(third).withColumn("weight", -F.col("confidence"))
    return _best(every)


def abstractions(paths: DataFrame, least: int = 3) -> DataFrame:
    """``family``, ``n_paths``, ``confidence`` = min(.95, .55 + .07 n) for families of ``least`` paths or more."""
    out = paths.groupBy("family").agg(F.count("*").alias("n_paths")).where(F.col("n_paths") >= least)
    return out.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.55 + 0.07 * F.col("n_paths")), 4))


def abstraction_details(families: DataFrame, units: DataFrame, canonical: DataFrame, least: int = 3) -> DataFrame:
    """``family``, ``level``, ``owner``, ``n_units``, ``n_paths``, ``confidence``, ``status`` of what families of ``least`` paths or more could share.

    ``families``: ``family``, ``sink_role``, ``n_paths``; ``units``: ``unit``, ``family``, ``module``; ``canonical``: ``family``, ``status``. A family that writes and has no canonical path is
    lifted to one; else units of several modules suggest a service, of one a helper. The first unit's module owns it; from four paths it is recommended.
    """
    many = families.where(F.col("n_paths") >= least)
    own = units.groupBy("family").agg(F.count("*").alias("n_units"), F.count_distinct("module").alias("n_modules"), F.min_by("module", "unit").alias("owner"))
    told = canonical.where("status = 'canonical'").select("family", F.lit(True).alias("told")).distinct()
    out = many.join(own, "family", "left").join(told, "family", "left").fillna(0, ["n_units", "n_modules"])
    lift = F.col("told").isNull() & (F.col("sink_role") == "repository_write")
    level = F.when(lift, "lift_to_canonical_path").when(F.col("n_modules") > 1, "extract_service").otherwise("extract_helper")
    confidence = F.round(F.least(F.lit(0.95), 0.55 + F.col("n_paths") * 0.07), 3)
    status = F.when(F.col("n_paths") >= 4, "recommended").otherwise("candidate")
    return out.select("family", level.alias("level"), F.coalesce("owner", F.lit("unknown")).alias("owner"), "n_units", "n_paths", confidence.alias("confidence"), status.alias("status"))


def shape_check(provided: DataFrame, accessed: DataFrame) -> DataFrame:
    """``route``, ``n_keys``, ``n_accessed``, ``missing``, ``status`` from (``route``, ``key``) of responses and of consumers."""
    keys = provided.where(F.col("key").isNotNull()).groupBy("route").agg(F.collect_set("key").alias("keys"))
    used = accessed.where(F.col("key").isNotNull()).groupBy("route").agg(F.collect_set("key").alias("used"))
    missing = F.sort_array(F.array_except("used", "keys"))
    out = keys.join(used, "route").select("route", F.size("keys").alias("n_keys"), F.size("used").alias("n_accessed"), F.array_join(missing, ",").alias("missing"))
    return out.withColumn("status", F.when(F.col("missing") == "", "OK").otherwise("MISMATCH"))


def api_risk(consumers: Column, mismatches: Column) -> Column:
    """HIGH from 10 consumers or 4 mismatches, MEDIUM from 4 or 1, else LOW."""
    return F.when((consumers >= 10) | (mismatches >= 4), "HIGH").when((consumers >= 4) | (mismatches >= 1), "MEDIUM").otherwise("LOW")


def risk_score(modules: DataFrame) -> DataFrame:
    """``module``, four factors of 0 to 25, ``risk`` and ``bucket``.

    ``modules``: ``module``, ``max_nesting``, ``max_cyclomatic``, ``stability`` (null: no history), ``in_degree``, ``density`` (null:
    unknown), ``n_modules``. Factors are whole numbers, halves rounded up.
    """
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    up = lambda c: F.least(F.lit(25), half_up(c))
    churn = F.when(F.col("stability") == "stable", 5).when(F.col("stability") == "active", 15).when(F.col("stability") == "volatile", 25).otherwise(0)
    raw = F.col("max_nesting") * F.col("max_cyclomatic")
    out = modules.select(
        "module",
        F.when(raw.isNotNull(), up(raw / 30 * 25)).otherwise(0).alias("complexity"),  # least() passes over nulls
        churn.alias("churn"),
        up(F.col("in_degree") / F.greatest(F.col("n_modules") * 0.5, F.lit(5.0)) * 25).alias("coupling"),
        F.coalesce(half_up((1 - F.col("density")) * 25), F.lit(12)).alias("coverage"),
    )
    out = out.withColumn("risk", F.col("complexity") + F.col("churn") + F.col("coupling") + F.col("coverage"))
    bucket = F.when(F.col("risk") <= 25, "LOW").when(F.col("risk") <= 50, "MEDIUM").when(F.col("risk") <= 75, "HIGH").otherwise("CRITICAL")
    return out.withColumn("bucket", bucket)


def dead_code(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols (``id``) that nothing calls."""
    return symbols.join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id")


def forbidden(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """``src_module``, ``dst_module``, ``n`` of calls that a rule (``src_module``, ``dst_module``) forbids."""
    hit = calls.join(rules.distinct(), ["src_module", "dst_module"], "left_semi")
    return hit.groupBy("src_module", "dst_module").agg(F.count("*").alias("n"))
