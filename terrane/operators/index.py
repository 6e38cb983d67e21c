"""The derived index of the layers, texts for search, summaries of changes, and lookups of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.names import _any, _slashes, split_words

# Roles and folders that are not production.
OTHER_ROLES = ("test", "generated", "example", "dev_tool")
OTHER_FOLDERS = (
    "/test/", "/tests/", "/testing/", "/integration-tests/", "/example/", "/examples/", "/demo/", "/demos/", "/fixture/", "/fixtures/", "/mock/", "/mocks/",
    "/benchmark/", "/benchmarks/",
)


def index_edges(dependencies: DataFrame, concepts: DataFrame, contracts: DataFrame, flow_steps: DataFrame, concerns: DataFrame) -> DataFrame:
    """``from``, ``to``, ``relation`` of all layers.

    ``dependencies``: ``module``, ``on``; ``concepts``: ``id``, ``layer`` (null or empty: none); ``contracts``: ``consumer``, ``provider``;
    ``flow_steps``: ``flow``, ``module``; ``concerns``: ``id``, ``module``.
    """
    edge = lambda df, a, b, r: df.select(F.col(a).cast("string").alias("from"), F.col(b).cast("string").alias("to"), F.lit(r).alias("relation"))
    owned = concepts.where(F.coalesce("layer", F.lit("")) != "")
    out = edge(dependencies, "module", "on", "depends_on").union(edge(owned, "layer", "id", "owns_concept")).union(edge(contracts, "consumer", "provider", "contract"))
    return out.union(edge(flow_steps, "flow", "module", "step_in_flow")).union(edge(concerns, "id", "module", "affects"))


def concept_counts(concepts: DataFrame) -> DataFrame:
    """``module``, ``n`` of concepts by the module that owns them, the largest first."""
    out = concepts.where(F.coalesce("layer", F.lit("")) != "").groupBy(F.col("layer").alias("module")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "module")


def _first(items: Column, n: int, by: str = ", ") -> Column:
    return F.array_join(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, n), by)


def module_text(id_: Column, responsibility: Column, files: Column) -> Column:
    return F.concat(id_, F.lit(" module: "), F.coalesce(responsibility, F.lit("")), F.lit(" Files: "), _first(files, 3))


def concept_text(id_: Column, definition: Column, aliases: Column, appears_in: Column) -> Column:
    told = F.coalesce(definition, F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), ", "))
    return F.concat(id_, F.lit(" concept: "), told, F.lit(" Appears in: "), _first(appears_in, 3))


def contract_text(id_: Column, provider: Column, consumer: Column, interface: Column) -> Column:
    return F.concat(id_, F.lit(" contract: "), provider, F.lit(" → "), consumer, F.lit(" Interface: "), _first(interface, 5))


def flow_text(id_: Column, trigger: Column, steps: Column) -> Column:
    """``steps``: an array of 'module.function'."""
    return F.concat(id_, F.lit(" flow: trigger="), F.coalesce(trigger, F.lit("")), F.lit(" Steps: "), _first(steps, 5, " → "))


def array_changes(before: Column, after: Column, label: str) -> Column:
    """['+2 files', '-1 files']: how many elements came and went; none if none. A null array is empty."""
    none = F.array().cast("array<string>")
    old, new = F.coalesce(before, none), F.coalesce(after, none)
    came, went = (F.size(F.filter(x, lambda e: ~F.array_contains(y, e))) for x, y in ((new, old), (old, new)))
    say = lambda sign, n: F.when(n > 0, F.concat(F.lit(sign), n.cast("string"), F.lit(f" {label}")))
    return F.filter(F.array(say("+", came), say("-", went)), lambda x: x.isNotNull())


def layer_changes(old: DataFrame, new: DataFrame, layer: str) -> DataFrame:
    """``id``, ``layer``, ``status`` (added, removed, changed), ``changes`` between two versions of a layer; what is unchanged is left out.

    Both: ``id``, ``struct_hash`` and what the layer has to tell of a change: modules ``files``, ``entry``; contracts ``interface``,
    ``provider``, ``consumer``; flows ``trigger``, ``n_steps``. Ids are unique in each.
    """
    both = old.select("id", F.struct(*[c for c in old.columns if c != "id"]).alias("was")).join(new.select("id", F.struct(*[c for c in new.columns if c != "id"]).alias("now")), "id", "full")
    differs = lambda name: ~F.col(f"was.{name}").eqNullSafe(F.col(f"now.{name}"))
    told = [F.array(F.lit("structure changed"))]
    note = lambda when, text: F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))
    if layer == "module":
        told += [array_changes(F.col("was.files"), F.col("now.files"), "files"), note(differs("entry"), F.lit("entry changed"))]
    elif layer == "contract":
        told += [array_changes(F.col("was.interface"), F.col("now.interface"), "functions"), note(differs("provider") | differs("consumer"), F.lit("boundary changed"))]
    elif layer == "flow":
        a, b = (F.coalesce(f"{x}.n_steps", F.lit(0)).cast("string") for x in ("was", "now"))
        told += [note(differs("trigger"), F.lit("trigger changed")), note(a != b, F.concat(F.lit("steps: "), a, F.lit(" → "), b))]
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(differs("struct_hash"), "changed")
    out = both.select("id", F.lit(layer).alias("layer"), status.alias("status"), F.concat(*told).alias("told")).where("status IS NOT NULL")
    return out.select("id", "layer", "status", F.when(F.col("status") == "changed", F.array_join("told", ", ")).alias("changes"))


def n_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row ``n``: ids (``id``, ``struct_hash``) that are new, changed or gone."""
    both = old.select("id", F.col("struct_hash").alias("was")).join(new.select("id", F.col("struct_hash").alias("now")), "id", "full")
    return both.agg(F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("n"))


def recent_matches(symbols: DataFrame, keyword: str) -> DataFrame:
    """Rows of a change summary's symbols (``id``, ``label``, ``status``), added or changed, whose id or label holds the keyword in any case."""
    text = F.lower(F.concat_ws(" ", "id", "label"))
    return symbols.where(F.col("status").isin("added", "changed") & text.contains(keyword.lower()))


def is_other_role(role: Column) -> Column:
    """Whether a unit's role keeps it out of decisions; an unknown role does not."""
    return F.coalesce(role, F.lit("peripheral")).isin(*OTHER_ROLES)


def is_other_path(path: Column) -> Column:
    """Whether a path, module or scope lies in a folder that is not production."""
    return F.coalesce(_any(_slashes(path)[1], OTHER_FOLDERS) & (path != ""), F.lit(False))


def module_aliases(imports: DataFrame) -> DataFrame:
    """``file``, ``alias``, ``target``: the file stem under which each imported module is known in a file; the last import (``seq``) wins, of equals the larger target."""
    alias = F.regexp_replace(F.regexp_extract("target", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return imports.withColumn("alias", alias).where("alias <> ''").groupBy("file", "alias").agg(F.max_by("target", F.struct("seq", "target")).alias("target"))


def changed_files(diff: DataFrame, staged: DataFrame) -> DataFrame:
    """``file`` of all files that differ or are staged, each once."""
    return diff.select("file").union(staged.select("file")).where(F.coalesce("file", F.lit("")) != "").distinct()


def freshness(has_meta: Column, has_git: Column, head: Column, compiled_head: Column, dirty: Column, compiled_dirty: Column) -> Column:
    """Struct of ``fresh`` and ``reason``: whether an index still tells of the tree, by its commit and the fingerprint of what is not committed."""
    told = lambda fresh, reason: F.struct(F.lit(fresh).alias("fresh"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(~has_meta, told(False, "no-meta"))
        .when(~has_git | compiled_head.isNull() | head.isNull(), told(True, "no-git"))
        .when(head != compiled_head, told(False, "head-changed"))
        .when(~dirty.eqNullSafe(compiled_dirty), told(False, "working-tree-dirty"))
        .otherwise(told(True, None))
    )


def enrichment_targets(stale: DataFrame, affected: DataFrame, policy: str) -> DataFrame:
    """``id`` of the stale nodes that are enriched anew: all under the policies stale-if-available and force-affected, else those that a change affects."""
    once = stale.select("id").distinct()
    return once if policy in ("stale-if-available", "force-affected") else once.join(affected.select("id").distinct(), "id", "left_semi")


def closure_member_facts(closures: DataFrame) -> DataFrame:
    """``closure``, ``unit``, ``level``, ``confidence``, ``reasons`` (joined by '; ') from ``id`` and ``members``, an array of structs, exploded."""
    rows = closures.select(F.col("id").alias("closure"), F.explode("members").alias("m"))
    return rows.select("closure", F.col("m.unit").alias("unit"), "m.level", "m.confidence", F.array_join("m.reasons", "; ").alias("reasons"))


def describe_files(module_files: DataFrame) -> DataFrame:
    """``module``, ``description`` of modules (``module``, ``file``) by the kinds of their files: the three commonest, and the first three files by name."""
    kind = F.regexp_extract("file", r"\.([a-zA-Z0-9]+)$", 1)
    rows = module_files.select("module", "file", F.lower(F.when(kind == "", "<none>").otherwise(kind)).alias("kind"))
    n, many = F.col("n").cast("string"), F.when(F.col("n") > 1, "s").otherwise("")
    label = (
        F.when(F.col("kind") == "md", F.concat(n, F.lit(" markdown doc"), many))
        .when(F.col("kind") == "json", F.concat(n, F.lit(" JSON config"), many))
        .when(F.col("kind").isin("yaml", "yml"), F.concat(n, F.lit(" YAML file"), many))
        .otherwise(F.concat(n, F.lit(" ."), "kind"))
    )
    counted = rows.groupBy("module", "kind").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("n"), "kind")))
    kinds = counted.where("place <= 3").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("place", label.alias("label")))).alias("k"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy("file")))
    sample = first.groupBy("module").agg(F.count("*").alias("all"), F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col("file")))).alias("s"))
    told = F.concat(
        F.col("all").cast("string"), F.lit(" file"), F.when(F.col("all") > 1, "s").otherwise(""), F.lit(" ("), F.array_join("k.label", ", "),
        F.lit("). Sample: "), F.array_join("s", ", "),
    )
    return sample.join(kinds, "module").select("module", told.alias("description"))


def describe_names(symbols: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """``module``, ``description`` by the five commonest words of three letters or more in the names of its exported symbols (``module``, ``name``, ``entry``)."""
    words = symbols.select("module", F.explode(split_words(F.col("name"))).alias("word")).where(F.char_length("word") >= 3)
    words = words.where(~F.col("word").isin(*skip)) if skip else words
    counted = words.groupBy("module", "word").agg(F.count("*").alias("n"))
    counted = counted.withColumn("place", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("n"), "word"))).where("place <= 5")
    top = counted.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    both = top.join(symbols.groupBy("module").agg(F.first("entry", True).alias("entry")), "module")
    big = F.initcap(F.get("w.word", F.lit(0)))
    ends = F.when(F.coalesce("entry", F.lit("")) != "", F.concat(F.lit(" (entry: "), "entry", F.lit(")"))).otherwise("")
    return both.select("module", F.concat(big, F.lit(" operations: "), F.array_join("w.word", ", "), ends).alias("description"))


def best_scopes(units: DataFrame) -> DataFrame:
    """``module``, ``scope``, ``score``: the best score of each module and scope."""
    return units.groupBy("module", "scope").agg(F.max("score").alias("score"))


def surest_roots(candidates: DataFrame) -> DataFrame:
    """Of the candidates (``path``, ``confidence``, ``seq`` and more) for each root, the surest; the first of equals."""
    others = [c for c in candidates.columns if c != "path"]
    best = candidates.groupBy("path").agg(F.max_by(F.struct(*others), F.struct("confidence", -F.col("seq"))).alias("x"))
    return best.select("path", *[F.col(f"x.{c}").alias(c) for c in others])


def within_budget(lines: DataFrame, most_chars: int) -> DataFrame:
    """The first rows of ``lines`` (``nth`` from 1, ``line``) that a report of ``most_chars`` characters holds.

    Where all do not fit, three quarters of the rows are tried, and three quarters of those, down to one. Each line counts its line break.
    """
    total = lines.agg(F.count("*").alias("n")).first().n
    sizes, n = [total], total
    while n > 1:
        n = int(n * 0.75)
        sizes.append(n)
    upto = [F.sum(F.when(F.col("nth") <= k, F.char_length("line") + 1)).alias(f"c{i}") for i, k in enumerate(sizes)]
    used = lines.agg(*upto).first()
    fits = next((k for i, k in enumerate(sizes) if (used[f"c{i}"] or 0) <= most_chars), sizes[-1])
    return lines.where(F.col("nth") <= fits)


class Symbols:
    """Lookups in a table of symbols: ``id``, ``name``, ``file``, ``label``, ``owner``, ``seq`` (order of definition)."""

    CALLABLE = ("Function", "Method", "Constructor")

    def __init__(self, symbols: DataFrame) -> None:
        self.symbols = symbols

    def overloads(self, wanted: DataFrame) -> DataFrame:
        """All definitions of each ``file``, ``name``."""
        return self.symbols.join(wanted.select("file", "name").distinct(), ["file", "name"], "left_semi")

    def exact(self, wanted: DataFrame) -> DataFrame:
        """The first definition of each ``file``, ``name``."""
        first = self.overloads(wanted).groupBy("file", "name").agg(F.min_by("id", "seq").alias("id"))
        return self.symbols.join(first.select("id"), "id", "left_semi")

    def anywhere(self, wanted: DataFrame) -> DataFrame:
        """Definitions of each ``name`` in any file; properties are not known globally."""
        return self.symbols.where("label <> 'Property'").join(wanted.select("name").distinct(), "name", "left_semi")

    def callables(self, wanted: DataFrame) -> DataFrame:
        return self.anywhere(wanted).where(F.col("label").isin(*self.CALLABLE))

    def fields(self, wanted: DataFrame) -> DataFrame:
        """Properties by ``owner`` and ``name``."""
        return self.symbols.where("label = 'Property'").join(wanted.select("owner", "name").distinct(), ["owner", "name"], "left_semi")
