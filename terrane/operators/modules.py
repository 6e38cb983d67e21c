"""Modules of files: by folder, large folders split by communities, small parts merged, large parts split by folder again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrane.functions.names import is_test_path, struct_hash
from terrane.functions.scratch import materialize
from terrane.operators.layers import canonical_entry, module_dependencies, module_of
from terrane.operators.processes import module_labels

#: A folder of more files is split; parts of fewer files are merged; parts of more files are split by folder.
SPLIT, SMALL, REFINE = 50, 5, 100


def file_stem(path: Column) -> Column:
    """What files of one purpose begin with: control_state.go, control_test.go -> control."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    return F.get(F.split(F.regexp_replace(name, "_test$", ""), "_"), F.lit(0))


def _most(df: DataFrame, by: list[str], label: str = "label", n: str = "n") -> DataFrame:
    """The ``label`` with the greatest ``n`` for each ``by``, the smallest of equals."""
    return df.groupBy(*by).agg(F.min(F.struct(-F.col(n), F.col(label))).getField(label).alias(label))


def file_modules(nodes: DataFrame, calls: DataFrame, membership: DataFrame) -> DataFrame:
    """``path``, ``module`` of every file of ``nodes`` (``id``, ``name``, ``path``); nodes without a path are in none.

    ``calls``: ``src``, ``dst``; ``membership``: ``id``, ``community``. A file's module is its first folder. Folders of more than 50 files are
    split, if there are communities at all: a community is labelled by the word that most of its names in that folder have, a file by the label
    of most of its members, else by that of most labelled files with its stem, else by its own names. Parts of fewer than 5 files
    go to the large part with most calls between them, else to the largest. Parts of more than 100 files in two
    second folders or more are split by those; what lies in none keeps the label. Of equals the smallest label is taken, throughout.
    All counts are grouped map-side, so that one folder of all files is no more than one row a task in them.
    """
    known = nodes.where("path IS NOT NULL").select("id", "name", "path", module_of(F.col("path")).alias("dir"))
    files = known.select("path", "dir").distinct()
    big = files.groupBy("dir").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("dir")
    any_ = membership.where("community IS NOT NULL").limit(1).select(F.lit(True).alias("any"))
    big = big.join(F.broadcast(any_)).select("dir")  # one row, or none
    split = materialize(known.join(big, "dir", "left_semi"), "split-nodes")
    # Labels of communities, and of files by their members.
    members = split.join(membership.where("community IS NOT NULL").select("id", "community"), "id")
    group = F.struct("dir", "community")
    named = module_labels(members.select(group.alias("module"), "name")).select("module.dir", "module.community", "label")
    votes = members.join(named, ["dir", "community"]).groupBy("dir", "path", "label").agg(F.count("*").alias("n"))
    by_members = materialize(_most(votes, ["dir", "path"]), "file-labels")
    rest = split.select("dir", "path").distinct().join(by_members, ["dir", "path"], "left_anti").withColumn("stem", file_stem(F.col("path")))
    stems = by_members.withColumn("stem", file_stem(F.col("path"))).groupBy("dir", "stem", "label").agg(F.count("*").alias("n"))
    by_stem = rest.join(_most(stems, ["dir", "stem"]), ["dir", "stem"], "left").select("dir", "path", "label")
    alone = split.join(by_stem.where("label IS NULL"), ["dir", "path"], "left_semi")
    own = module_labels(alone.select(F.struct("dir", "path").alias("module"), "name")).select("module.dir", "module.path", "label")
    labels = materialize(by_members.select("dir", "path", "label").union(by_stem.where("label IS NOT NULL")).union(own), "file-labels")
    # Small parts go to a large one.
    size = materialize(labels.groupBy("dir", "label").agg(F.count("*").alias("n")), "parts")
    large = size.where(F.col("n") >= SMALL)
    where = split.join(labels, ["dir", "path"]).select("id", "dir", "label")
    a, b = (where.select(F.col("id").alias(x), F.col("dir").alias(f"dir_{x}"), F.col("label").alias(f"label_{x}")) for x in ("src", "dst"))
    met = calls.select("src", "dst").join(a, "src").join(b, "dst").where("dir_src = dir_dst AND label_src <> label_dst")
    met = met.groupBy(F.col("dir_src").alias("dir"), "label_src", "label_dst").agg(F.count("*").alias("n"))
    both = met.select("dir", F.col("label_src").alias("small"), F.col("label_dst").alias("label"), "n").union(met.select("dir", "label_dst", "label_src", "n"))
    small = size.where(F.col("n") < SMALL).select("dir", F.col("label").alias("small"))
    near = both.join(small, ["dir", "small"], "left_semi").join(large.select("dir", "label"), ["dir", "label"], "left_semi")
    near = _most(near.groupBy("dir", "small", "label").agg(F.sum("n").alias("n")), ["dir", "small"])
    widest = _most(large, ["dir"]).withColumnRenamed("label", "widest")
    into = small.join(near, ["dir", "small"], "left").join(widest, "dir").select("dir", F.col("small").alias("label"), F.coalesce("label", "widest").alias("into"))
    merged = labels.join(into, ["dir", "label"], "left").select("dir", "path", F.coalesce("into", "label").alias("label"))
    # Large parts are split by their second folders.
    parts = F.split("path", "/")
    merged = merged.withColumn("folder", F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))))
    wide = merged.groupBy("dir", "label").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("folder", F.lit("_flat"))).alias("folders"))
    wide = wide.where((F.col("n") > REFINE) & (F.col("folders") >= 2)).select("dir", "label", F.lit(True).alias("wide"))
    told = merged.join(wide, ["dir", "label"], "left")
    told = told.select("path", F.concat_ws("/", "dir", F.when(F.col("wide"), F.coalesce("folder", "label")).otherwise(F.col("label"))).alias("module"))
    return told.union(files.join(big, "dir", "left_anti").select("path", F.col("dir").alias("module")))


def modules(nodes: DataFrame, calls: DataFrame, membership: DataFrame) -> DataFrame:
    """``module``, ``canonical_entry``, ``n_files``, ``depends_on``, ``depended_by``, ``struct_hash`` of all modules.

    ``nodes``: ``id``, ``name``, ``path``, ``exported``. The entry is the name of the exported symbol outside tests that is called
    most from other modules (ties: the smallest id), empty if there is none. The hash covers the module, its entry and its sorted files, which are
    gathered for it: a module's paths must fit into a row.
    """
    files = materialize(file_modules(nodes, calls, membership), "file-modules")
    placed = materialize(nodes.join(files, "path").select("id", "name", "path", "module", "exported"), "placed")
    a, b = (placed.select(F.col("id").alias(x), F.col("module").alias(f"{x}_module")) for x in ("src", "dst"))
    crossing = materialize(calls.select("src", "dst").join(a, "src").join(b, "dst"), "placed-calls")
    entry = canonical_entry(placed.where(F.coalesce("exported", F.lit(False)) & ~is_test_path(F.col("path"))).select("id", "module", "exported"), crossing)
    entry = entry.select("module", F.col("entry").alias("id")).join(placed.select("id", "name"), "id").select("module", F.col("name").alias("canonical_entry"))
    out = files.groupBy(F.col("module").alias("id")).agg(F.sort_array(F.collect_set("path")).alias("files")).withColumnRenamed("id", "module")
    out = out.join(entry, "module", "left").join(module_dependencies(crossing), "module", "left").fillna("", ["canonical_entry", "depends_on", "depended_by"])
    out = out.withColumn("id", F.col("module")).withColumn("struct_hash", struct_hash("id", "canonical_entry", "files"))
    return out.select("module", "canonical_entry", F.size("files").alias("n_files"), "depends_on", "depended_by", "struct_hash")
