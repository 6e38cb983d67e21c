"""Change plane: diffs, churn, co-change, intervals, staleness, upserts and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def diff(before: DataFrame, after: DataFrame, key: str = "id", value: str = "hash") -> DataFrame:
    """``key``, ``status``: added, removed, changed or unchanged; null values compare as equal to null."""
    a = before.select(key, F.col(value).alias("__old"), F.lit(True).alias("__in_old"))
    b = after.select(key, F.col(value).alias("__new"), F.lit(True).alias("__in_new"))
    both = a.join(b, key, "full_outer")
    status = (
        F.when(F.col("__in_old").isNull(), "added")
        .when(F.col("__in_new").isNull(), "removed")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged")
        .otherwise("changed")
    )
    return both.select(key, status.alias("status"))


def transitions(snapshots: DataFrame) -> DataFrame:
    """Rows of ``snapshots`` (``tag``, ``id``, ``hash``; every id at every tag, null if absent) that differ from the tag before."""
    order = Window.partitionBy("id").orderBy("tag")
    was = snapshots.withColumn("was", F.lag("hash").over(order)).withColumn("nth", F.row_number().over(order))
    return was.where("nth > 1").withColumn("changed", ~F.col("hash").eqNullSafe(F.col("was"))).select("tag", "id", "changed")


def churn(snapshots: DataFrame) -> DataFrame:
    """``id``, ``n_changes``, ``last_change``, ``ratio``, ``stability``: stable to .2, active to .5, else volatile."""
    out = transitions(snapshots).groupBy("id").agg(
        F.count_if("changed").alias("n_changes"), F.max(F.when(F.col("changed"), F.col("tag"))).alias("last_change"), F.count("*").alias("n")
    )
    ratio = F.col("n_changes") / F.col("n")
    stability = F.when(ratio <= 0.2, "stable").when(ratio <= 0.5, "active").otherwise("volatile")
    return out.select("id", "n_changes", "last_change", F.round(ratio, 4).alias("ratio"), stability.alias("stability"))


def temporal_coupling(snapshots: DataFrame, least: int = 2, ratio: float = 0.4) -> DataFrame:
    """``a``, ``b``, ``co``, ``either``, ``coupling`` of ids that change at the same tags; thresholds hold before rounding to 2 places."""
    hits = transitions(snapshots).where("changed").select("tag", "id")
    n = hits.groupBy("id").agg(F.count("*").alias("n"))
    a, b = hits.withColumnRenamed("id", "a"), hits.withColumnRenamed("id", "b")
    pairs = a.join(b, "tag").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co")).where(F.col("co") >= least)
    both = pairs.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    both = both.withColumn("either", F.col("na") + F.col("nb") - F.col("co")).where(F.col("co") / F.col("either") >= ratio)
    return both.select("a", "b", "co", "either", F.round(F.col("co") / F.col("either"), 2).alias("coupling"))


def cochange(commits: DataFrame, least: int = 2, confidence: float = 0.5, most_files: int | None = 30) -> DataFrame:
    """``a``, ``b``, ``together``, ``confidence`` of files that change in the same commits (``commit``, ``file``).

    Confidence is together / the larger count, filtered after rounding to 3 places. Commits of one file, and of more than
    ``most_files`` distinct files, are no evidence and are left out: that is the feature, and it also bounds the pairs of a commit.
    """
    once = commits.distinct()
    sizes = once.groupBy("commit").agg(F.count("*").alias("k")).where("k > 1")
    some = sizes if most_files is None else sizes.where(F.col("k") <= most_files)
    once = once.join(some.select("commit"), "commit", "left_semi")
    counts = once.groupBy("file").agg(F.count("*").alias("n"))
    a, b = once.withColumnRenamed("file", "a"), once.withColumnRenamed("file", "b")
    pairs = a.join(b, "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    both = pairs.join(counts.select(F.col("file").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
    out = both.withColumn("confidence", F.round(F.col("together") / F.greatest("na", "nb"), 3))
    return out.where(F.col("confidence") >= confidence).select("a", "b", "together", "confidence")


def ranked_rules(rules: DataFrame, limit: int | None = None) -> DataFrame:
    """Rules in their order: the surest first, of equals those of more commits, then by name; the first ``limit``, if given."""
    ordered = rules.orderBy(F.desc("confidence"), F.desc("together"), "a", "b")
    return ordered if limit is None else ordered.limit(limit)


def merge_ranges(ranges: DataFrame, gap: int = 1) -> DataFrame:
    """``key``, ``start``, ``end`` with ranges that overlap or lie within ``gap`` made one; one sort per key.

    Ranges without a start come last, as in SQL: they join a key's last range, and stand by themselves only where a key has no other.
    """
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    marked = ranges.withColumn("fresh", fresh)
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Distinct (``key``, ``a_id``, ``b_id``) of intervals (``key``, ``start``, ``end``) that overlap; integers, ends inclusive.

    An equi-join on key and on bins of ``width``, not a range join within a key: a hot key is spread over its bins. A
    pair is told in the bin of the later start only, so none is told twice. ``a``: ``a_id``; ``b``: ``b_id``.
    """
    bins = lambda d, s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    x = a.where("start <= end").select("key", "a_id", F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = b.where("start <= end").select("key", "b_id", F.col("start").alias("s2"), F.col("end").alias("e2"))
    x, y = x.withColumn("bin", bins(x, "s1", "e1")), y.withColumn("bin", bins(y, "s2", "e2"))
    both = x.join(y, ["key", "bin"]).where((F.col("s1") <= F.col("e2")) & (F.col("e1") >= F.col("s2")))
    return both.where(F.col("bin") == F.floor(F.greatest("s1", "s2") / width)).select("key", "a_id", "b_id")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``path``, ``prefix``: the longest of ``prefixes`` that is the path or ends at a '/' in it, null if none.

    Each path offers its own prefixes to an equi-join, so the work grows with its depth and not with the other table.
    """
    parts = F.split("path", "/")
    own = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    own = own.select("path", F.array_join(F.slice(F.split("path", "/"), 1, F.col("k")), "/").alias("prefix"))
    hit = own.join(prefixes.distinct(), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.select("path").distinct().join(hit, "path", "left")


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``ref``, ``symbol``, ``tier``, ``confidence``: all symbols of the best tier for each reference.

    Same file .95, else an imported file .9, else anywhere .5. ``references``: ``ref``, ``file``, ``name``; ``symbols``:
    ``symbol``, ``file``, ``name``; ``imports``: ``file``, ``target``. One join by name finds all candidates.
    """
    s = symbols.select("symbol", F.col("file").alias("home"), "name")
    i = imports.distinct().select("file", F.col("target").alias("home"), F.lit(True).alias("imported"))
    found = references.join(s, "name").join(i, ["file", "home"], "left")
    tier = F.when(F.col("file") == F.col("home"), 1).when(F.col("imported"), 2).otherwise(3)
    ranked = found.select("ref", "symbol", tier.alias("tier"))
    best = ranked.withColumn("best", F.min("tier").over(Window.partitionBy("ref"))).where("tier = best")
    return best.select("ref", "symbol", "tier", F.element_at(F.array(F.lit(0.95), F.lit(0.9), F.lit(0.5)), F.col("tier")).alias("confidence"))


def latest(rows: DataFrame, key: str, version: list[Column]) -> DataFrame:
    """The row of every key with the largest version; an aggregate, combined map-side, and no window."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def stale(nodes: DataFrame) -> DataFrame:
    """``id``, ``reason`` for nodes (``id``, ``struct_hash``, ``source_hash``) not enriched, or enriched from another content."""
    why = F.when(F.col("source_hash").isNull(), "missing").when(F.col("source_hash") != F.col("struct_hash"), "outdated")
    return nodes.select("id", why.alias("reason")).where(F.col("reason").isNotNull())


def affected(changed: DataFrame, files: DataFrame, calls: DataFrame) -> DataFrame:
    """``kind``, ``id`` of modules with a changed file (``file``) and of contracts at either end of which one is."""
    modules = files.join(changed.select("file").distinct(), "file", "left_semi").select(F.col("module")).distinct()
    pairs = calls.where("src_module <> dst_module").select("src_module", "dst_module").distinct()
    a = pairs.join(modules.withColumnRenamed("module", "src_module"), "src_module", "left_semi").select("src_module", "dst_module")
    b = pairs.join(modules.withColumnRenamed("module", "dst_module"), "dst_module", "left_semi").select("src_module", "dst_module")
    contracts = a.union(b).distinct().select(F.lit("contract").alias("kind"), F.concat_ws("--", "src_module", "dst_module").alias("id"))
    return modules.select(F.lit("module").alias("kind"), F.col("module").alias("id")).union(contracts)


def wildcard_bindings(imports: DataFrame, exports: DataFrame, most: int = 1000) -> DataFrame:
    """``file``, ``name``, ``symbol``: the names that a file gets from all of its imports; the first import wins, up to ``most`` a file.

    ``imports``: ``file``, ``target``, ``seq``; ``exports``: ``target``, ``name``, ``symbol``. Of a file's imports with the same names only the first,
    and those that are equally early, can win; only they meet their names.
    """
    told = exports.groupBy("target", "name").agg(F.min(F.struct("symbol")).getField("symbol").alias("symbol"))
    names = told.groupBy("target").agg(F.unhex(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name")))), 256)).alias("names"))
    # Sorted rows take many times their shuffled bytes, by which adaptive execution puts partitions together: the number of these is fixed.
    parts = 4 * int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    early = imports.join(names, "target").repartition(parts, "file").withColumn("early", F.rank().over(Window.partitionBy("file", "names").orderBy("seq")))
    first = early.where("early = 1").select("file", "target", "seq")
    found = first.join(told, "target").repartition(parts, "file").groupBy("file", "name").agg(F.min(F.struct("seq", "symbol")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("x.seq", "name"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).select("file", "name", F.col("x.symbol").alias("symbol"))
