"""Concern families: how flows and calls become paths, paths become families and operation units, and families get a canonical path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.names import ACTIONS, role_weight, split_words
from terrane.functions.scratch import materialize

# Words of names by what they tell.
GENERIC = "run handle process execute init setup register check add list load".split()
ALIASES = {
    "creation": "create", "created": "create", "creates": "create", "update": "update", "updated": "update", "updating": "update", "updates": "update",
    "finding": "find", "finds": "find", "loading": "load", "loaded": "load", "listing": "list", "saving": "save", "saved": "save", "usagef": "usage", "usaget": "usage",
}
NOISE = "as can does do be is are to from with without for of in on off by new main misc".split()
SINKS = (
    ("repository_write", "save persist store write commit update create delete".split()),
    ("repository_read", "read query list load fetch get".split()),
    ("validation", "validate check auth authorize".split()),
    ("formatting", "usage format template render print".split()),
)
PENALISED = "process build set run add check misc unknown".split()
SPECIFIC = [w for w in ACTIONS if w not in GENERIC]
#: Least mean weight of roles of a flow's functions.
LEAST_ROLE = 0.2


def normal_root(word: Column) -> Column:
    """A word as the verb or noun that it stands for."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    short = lambda n: F.left(word, F.greatest(F.char_length(word) - n, F.lit(0)))
    return (
        F.when(F.map_contains_key(alias, word), F.try_element_at(alias, word))
        .when(word.endswith("ing") & short(3).isin(*ACTIONS), short(3))
        .when(word.endswith("ed") & short(2).isin(*ACTIONS), short(2))
        .otherwise(word)
    )


def roots(text: Column) -> Column:
    """The normal words of a name, in order."""
    return F.transform(split_words(text), normal_root)


def sink_role(symbols: Column, modules: Column) -> Column:
    """What a path does in the end, by all its words: the first kind of which there is one."""
    found = roots(F.concat_ws(" ", F.concat_ws(" ", symbols), F.concat_ws(" ", modules)))
    out = F.lit("unknown")
    for name, words in reversed(SINKS):
        out = F.when(F.arrays_overlap(found, F.array(*[F.lit(w) for w in words])), name).otherwise(out)
    return out


def operation_kind(symbol: Column, module: Column) -> Column:
    """handler, validator, repository, service, worker or unknown, by the words of symbol and module."""
    found = split_words(F.concat_ws(" ", symbol, module))
    has = lambda *words: F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))
    return (
        F.when(has("handle"), "handler")
        .when(has("validate", "check", "auth"), "validator")
        .when(has("save", "persist", "store", "query", "read", "write"), "repository")
        .when(has("service") | module.contains("service"), "service")
        .when(has("worker"), "worker")
        .otherwise("unknown")
    )


def family_heads(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """``path``, ``head``: the word that names the family of each path (``path``, ``signals``: array of names).

    The first specific action in the first name; else, of specific actions if there are any and of all words if not, the
    one that is most of its occurrences in all ``functions`` (``name``), .4 more for a specific action. Ties go to the
    word that the path has more often, then to the longer one, then by alphabet. Without any word it is ``misc``.
    """
    specific = lambda w: w.isin(*SPECIFIC)
    first = F.get(F.filter(roots(F.get("signals", F.lit(0))), lambda w: specific(w) & ~w.isin(*NOISE)), F.lit(0))
    named = paths.select("path", "signals", first.alias("first"))
    every = functions.select(F.explode(roots(F.col("name"))).alias("root")).groupBy("root").agg(F.count("*").alias("everywhere"))
    words = named.where("first IS NULL").select("path", F.explode(F.flatten(F.transform("signals", roots))).alias("root"))
    words = words.where(~F.col("root").isin(*NOISE) & (F.char_length("root") >= 3)).groupBy("path", "root").agg(F.count("*").alias("here"))
    scored = words.join(every, "root", "left").withColumn("specific", specific(F.col("root")))
    score = F.round(F.col("here") / F.coalesce("everywhere", F.lit(1)) + F.when(F.col("specific"), 0.4).otherwise(0.0), 9)
    order = Window.partitionBy("path").orderBy(F.desc("specific"), F.desc("score"), F.desc("here"), F.desc(F.char_length("root")), "root")
    best = scored.withColumn("score", score).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("path", F.col("root").alias("best"))
    return named.join(best, "path", "left").select("path", F.coalesce("first", "best", F.lit("misc")).alias("head"))


def path_instances(flows: DataFrame, functions: DataFrame, contracts: DataFrame) -> DataFrame:
    """``id``, ``flow``, ``family``, ``functions``, ``modules``, ``contracts``, ``entry``, ``entry_kind``, ``sink``, ``sink_role`` of every flow.

    ``flows``: ``flow``, ``step``, ``function``, ``module``; ``functions``: ``id``, ``name``, ``module``, ``role``, ``public``;
    ``contracts``: ``id``, ``consumer``, ``provider``. Flows whose known functions weigh less than ``LEAST_ROLE`` in the mean are left out.
    """
    known = functions.groupBy("module", "name").agg(F.max_by(F.struct("role", "public"), "id").alias("f"))
    known = known.select("module", F.col("name").alias("function"), F.col("f.role").alias("role"), F.col("f.public").alias("public"))
    steps = flows.select("flow", "step", "function", "module").join(known, ["module", "function"], "left")
    ahead = Window.partitionBy("flow").orderBy("step")
    hops = contracts.groupBy("consumer", "provider").agg(F.max("id").alias("contract"))
    steps = steps.withColumn("provider", F.lead("module").over(ahead)).join(hops.withColumnRenamed("consumer", "module"), ["module", "provider"], "left")
    public = F.col("public") & F.col("role").isin("prod_core", "prod_entrypoint")
    one = F.struct("step", "function", "module", "contract", F.when(public, F.col("function")).alias("public"))
    paths = steps.groupBy("flow").agg(F.array_sort(F.collect_list(one)).alias("s"), F.avg(role_weight(F.col("role"))).alias("weight"))
    paths = paths.where(F.coalesce("weight", F.lit(0.5)) >= LEAST_ROLE)
    names = F.col("s.function")
    some = lambda field: F.array_distinct(F.filter(F.col(f"s.{field}"), lambda x: x.isNotNull()))
    paths = paths.select(
        F.col("flow"), names.alias("functions"), F.col("s.module").alias("modules"), some("contract").alias("contracts"),
        F.get(names, F.lit(0)).alias("entry"), F.element_at(names, -1).alias("sink"), some("public").alias("public"),
    )
    return _told(paths, functions, "flow_trigger")


def path_id(source: Column, family: Column, functions: Column, modules: Column) -> Column:
    """8 hex digits of a path's canonical JSON. They are a label; what counts paths uses :func:`path_key`."""
    joined = F.struct(family.alias("familyKey"), F.array_join(functions, ">").alias("functions"), F.array_join(modules, ">").alias("modules"), source.cast("string").alias("source"))
    return F.substring(F.sha2(F.to_json(joined), 256), 1, 8)


def path_key() -> Column:
    """128 bits of all that tells one path from another."""
    return F.md5(F.to_json(F.struct("flow", "family", "functions", "modules")))


def _told(paths: DataFrame, functions: DataFrame, entry_kind: str) -> DataFrame:
    """Paths (``flow``, ``functions``, ``modules``, ``contracts``, ``entry``, ``sink``, ``public``) with their family, sink's role and id."""
    # Many flows take the same way: what its words tell is worked out once for each.
    way = F.struct("functions", "modules", "public")
    paths = materialize(paths.withColumn("way", F.md5(F.to_json(way))), "flows")
    ways = paths.groupBy("way").agg(F.first(way).alias("w")).select("way", "w.*")
    ways = materialize(ways.withColumn("sink_role", sink_role(F.col("functions"), F.col("modules"))), "ways")
    ends = F.array(F.get("functions", F.lit(0)), F.element_at("functions", -1))
    heads = family_heads(ways.select(F.col("way").alias("path"), F.array_distinct(F.concat(ends, "public")).alias("signals")), functions)
    named = ways.join(heads.withColumnRenamed("path", "way"), "way").select("way", "sink_role", F.concat_ws(":", "head", "sink_role").alias("family"))
    out = paths.join(named, "way")
    out = out.withColumn("id", path_id(F.col("flow"), F.col("family"), F.col("functions"), F.col("modules")))
    return out.select("id", "flow", "family", "functions", "modules", "contracts", "entry", F.lit(entry_kind).alias("entry_kind"), "sink", "sink_role")


def _grown(rows: DataFrame, levels: int) -> DataFrame:
    """``way`` of ``rows`` (besides others) after up to ``levels`` further steps along ``next``, a tree of callees, ``open``: whether all were taken and led to new functions,
    and ``twins``: how many steps had another beside them to a function of the same name and module."""
    if not levels:
        return rows.withColumn("open", F.lit(True))
    for level in range(levels):
        rows = rows.withColumn("c", F.explode_outer("next")).drop("next")
        fresh = F.coalesce(~F.array_contains("way.id", F.col("c.id")), F.lit(False))
        grown = {"way": F.when(F.col("c.id").isNull(), F.col("way")).otherwise(F.concat("way", F.array(F.struct("c.id", "c.f")))), "twins": F.col("twins") + F.coalesce(F.col("c.twin").cast("int"), F.lit(0))}
        rows = rows.withColumns(grown | ({"open": fresh} if level == levels - 1 else {"next": F.when(fresh, F.col("c.next"))})).drop("c")
    return rows


def _twins(tree: Column, levels: int) -> Column:
    """Whether a step of a tree of callees has a twin."""
    return F.coalesce(F.exists(tree, lambda c: c["twin"] | _twins(c["next"], levels - 1) if levels > 1 else c["twin"]), F.lit(False))


def _halves(functions: DataFrame, calls: DataFrame, entries: DataFrame, most: int, fan: int) -> tuple[DataFrame, int]:
    """First halves of the paths of :func:`call_paths`: ``flow``, ``way`` (of ``id`` and what ``functions`` (``id``, ``f``: a struct with ``name``, ``module``, ``weight``) say of it),
    ``twins`` as of :func:`_grown`, and ``next``, the tree of callees that second halves come from; its depth.

    Each function has the tree of its callees in a row, half of a path deep. A path's first half comes from its entry's tree, its second from that of the function it
    has come to: one join of first halves, which are few, and no table of every step. What is known of a function stands in the tree, so nothing
    is gathered by paths.
    """
    late = max(most // 2, 1)
    early = max(most - late - 1, 0)  # steps of a first half
    known = materialize(functions.select("id", "f"), "known")
    ids = known.select("id")
    steps = calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    steps = steps.withColumn("nth", nth).where(F.col("nth") <= fan).select("src", "dst")
    steps = materialize(steps.join(known.withColumnRenamed("id", "dst"), "dst").select("src", F.struct(F.col("dst").alias("id"), "f").alias("c")), "calls")

    def below(tree: DataFrame | None) -> DataFrame:
        deep = tree is not None
        met = steps.join(tree.select(F.col("src").alias("dst"), "next").hint("merge"), F.col("c.id") == F.col("dst"), "left") if deep else steps
        lists = met.groupBy("src").agg(F.collect_list(F.struct("c.id", "c.f", *(["next"] if deep else []))).alias("next"))
        alike = lambda c: F.filter("next", lambda x: x["f"]["name"].eqNullSafe(c["f"]["name"]) & x["f"]["module"].eqNullSafe(c["f"]["module"]))
        told = lambda c: F.struct(*(c[x].alias(x) for x in ("id", "f", *(["next"] if deep else []))), (F.size(alike(c)) > 1).alias("twin"))
        return lists.select("src", F.transform("next", told).alias("next"))

    tree = None
    for _ in range(early):
        tree = below(tree)
    begun = known.join(entries.select("id").distinct(), "id", "left_semi")
    if tree is not None:
        tree = materialize(tree, "trees")
        begun = begun.join(tree.withColumnRenamed("src", "id").hint("merge"), "id", "left")  # trees are small files but large rows: no broadcast
    begun = begun.select(F.col("id").alias("flow"), F.array(F.struct("id", "f")).alias("way"), F.lit(0).alias("twins"), *(["next"] if early else []))
    halves = materialize(_grown(begun, early), "halves")
    for _ in range(late - early):
        tree = below(tree)
    onward = halves.where("open").withColumn("tip", F.element_at("way", -1)["id"]).join(tree.withColumnRenamed("src", "tip").hint("merge"), "tip", "left")
    return onward.select("flow", "way", "twins", "next").unionByName(halves.where("not open").select("flow", "way", "twins"), allowMissingColumns=True), late


def _ends(halves: DataFrame, late: int, most: int, least_role: float) -> DataFrame:
    """``flow``, ``path`` (ids), ``fs`` (what is known of each) and ``twins`` of the paths that begin as :func:`_halves` say."""
    done = _grown(halves, late).select("flow", F.col("way.id").alias("path"), F.col("way.f").alias("fs"), "twins").where(F.size("path") <= most)
    mean = F.aggregate("fs.weight", F.lit(0.0), lambda x, y: x + y) / F.size("fs")
    return done.where((F.size("path") >= 2) & (F.size(F.array_distinct("fs.module")) >= 2) & (mean >= least_role))


def call_paths(functions: DataFrame, calls: DataFrame, entries: DataFrame, most: int = 6, fan: int = 3, least_role: float = 0.28) -> DataFrame:
    """``flow``, ``path`` (ids), ``functions``, ``modules``: paths along calls from each entry (``id``), through two modules or more.

    ``functions``: ``id``, ``name``, ``module``, ``role``; ``calls``: ``src``, ``dst``. A function goes to its first ``fan`` callees by id. A path ends
    where nothing known is called, at ``most`` functions, and at a function that it has been at, which it then names twice.
    Paths whose roles weigh less than ``least_role`` in the mean are left out.
    """
    known = functions.select("id", F.struct("name", "module", role_weight(F.col("role")).alias("weight")).alias("f"))
    out = _ends(*_halves(known, calls, entries, most, fan), most, least_role)
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("flow"), "path", F.col("fs.name").alias("functions"), F.col("fs.module").alias("modules"))


def entry_paths(functions: DataFrame, calls: DataFrame, entries: DataFrame, contracts: DataFrame, covered: DataFrame, most: int = 6, fan: int = 3, least_role: float = 0.28) -> DataFrame:
    """``flow``, ``functions``, ``modules``, ``contracts``, ``public``, ``entry``, ``sink`` of :func:`call_paths` whose entry's name no flow (``covered``: ``entry``) begins with; ``flow`` is the entry's id.

    ``contracts``: ``function`` (id), ``contract``: those that a function provides or consumes; a path has all of its functions', sorted.
    Paths of one entry through functions of the same names and modules are one path, with the contracts of all.
    """
    own = contracts.groupBy(F.col("function").alias("id")).agg(F.collect_set("contract").alias("contracts"))
    none = F.array().cast("array<string>")
    shown = F.col("public") & F.col("role").isin("prod_core", "prod_entrypoint")
    known = functions.join(own, "id", "left").select("id", F.struct("name", "module", role_weight(F.col("role")).alias("weight"), F.coalesce("contracts", none).alias("contracts"), F.coalesce(shown, F.lit(False)).alias("shown")).alias("f"))
    begins = functions.join(entries.select("id").distinct(), "id", "left_semi").join(covered.select(F.col("entry").alias("name")).distinct(), "name", "left_anti").select("id")
    halves, late = _halves(known, calls, begins, most, fan)

    def told(rows: DataFrame) -> DataFrame:
        return rows.select(
            "flow", F.col("fs.name").alias("functions"), F.col("fs.module").alias("modules"), F.array_sort(F.array_distinct(F.flatten("fs.contracts"))).alias("contracts"),
            F.array_distinct(F.transform(F.filter("fs", lambda x: x["shown"]), lambda x: x["name"])).alias("public"),
        )

    # Paths of the same names part where a function has two callees of the same name and module: no path without such a step needs to be held against others.
    alone = told(_ends(halves, late, most, least_role).where("twins = 0"))
    some = halves.where((F.col("twins") > 0) | _twins(F.col("next"), late))
    both = told(_ends(some, late, most, least_role).where("twins > 0")).groupBy("flow", "functions", "modules")
    both = both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("contracts")))).alias("contracts"), F.max("public").alias("public"))
    return alone.unionByName(both).withColumns({"entry": F.get("functions", F.lit(0)), "sink": F.element_at("functions", -1)})


def call_path_instances(functions: DataFrame, calls: DataFrame, entries: DataFrame, contracts: DataFrame, covered: DataFrame, most: int = 6, fan: int = 3, least_role: float = 0.28) -> DataFrame:
    """As :func:`path_instances`, of :func:`entry_paths`."""
    return _told(entry_paths(functions, calls, entries, contracts, covered, most, fan, least_role), functions, "canonical_entry")


def concern_families(paths: DataFrame) -> DataFrame:
    """``family``, ``name``, ``sink_role``, ``entry_kinds``, ``n_paths``, ``resources``, ``confidence`` = min(.95, .55 + .15 (n - 1)), ``status`` (confirmed from two).

    A family's member paths are the rows of ``paths`` that name it.
    """
    words = paths.select("family", F.explode("functions").alias("f")).distinct().select("family", F.explode(split_words(F.col("f"))).alias("w"))
    nouns = words.where(~F.col("w").isin(*ACTIONS)).groupBy("family").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("resources"))
    out = paths.groupBy("family").agg(F.count("*").alias("n_paths"), F.first("sink_role").alias("sink_role"), F.array_join(F.array_sort(F.collect_set("entry_kind")), ",").alias("entry_kinds")).join(nouns, "family", "left")
    return out.select(
        "family",
        F.replace(F.replace(F.replace("family", F.lit(":"), F.lit(" ")), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")).alias("name"),
        "sink_role", "entry_kinds", "n_paths", F.coalesce("resources", F.lit("")).alias("resources"),
        F.round(F.least(F.lit(0.95), 0.55 + 0.15 * (F.col("n_paths") - 1)), 4).alias("confidence"),
        F.when(F.col("n_paths") >= 2, "confirmed").otherwise("candidate").alias("status"),
    )


def operation_units(paths: DataFrame) -> DataFrame:
    """``unit``, ``family``, ``module``, ``symbol``, ``kind``, ``n_paths``: every function of a path once, with the family of its first path."""
    steps = paths.select("id", path_key().alias("key"), "family", F.explode(F.arrays_zip("functions", "modules")).alias("s"))
    steps = steps.select("id", "key", "family", F.col("s.functions").alias("symbol"), F.coalesce("s.modules", F.lit("unknown")).alias("module"))
    out = steps.groupBy("module", "symbol").agg(F.min_by("family", F.struct("id", "family")).alias("family"), F.count_distinct("key").alias("n_paths"))
    return out.select(F.concat_ws(":", "module", "symbol").alias("unit"), "family", "module", "symbol", operation_kind(F.col("symbol"), F.col("module")).alias("kind"), "n_paths")


def signature() -> Column:
    """What makes paths alike: modules, sink and contracts."""
    return F.concat_ws("|", F.concat_ws(">", "modules"), "sink", "sink_role", F.concat_ws(">", "contracts"))


def canonical_paths(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """The best path of each family: ``family``, ``signature``, ``n_paths``, ``coverage``, ``fan_in``, ``contract_reuse``, ``entry_strength``,
    ``role_purity``, ``visibility``, ``confidence``, ``deviations``, ``status``.

    ``functions``: ``id``, ``name``, ``module``, ``callers``, ``entry_score``, ``role``. Paths are alike if modules, sink and contracts
    are. The score weighs coverage .5, the sink's fan-in .2, contracts .15 and the entry's strength .15. A path is canonical if two
    or more flows take it, its score is .55 or more, its visibility .66, and its lead .05.
    """
    at_most = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / most))
    fan_in = functions.groupBy(F.col("name").alias("sink")).agg(F.max_by("callers", "id").alias("callers"))
    most = functions.agg(F.greatest(F.lit(1), F.max("callers")).alias("most"))  # one row
    one = functions.groupBy("module", "name").agg(F.max_by(F.struct("entry_score", "role"), "id").alias("f"))
    entries = one.select(F.col("module").alias("at"), F.col("name").alias("entry"), F.col("f.entry_score").alias("entry_score"))
    members = paths.withColumn("signature", signature()).withColumn("at", F.get("modules", F.lit(0)))
    members = members.join(entries, ["at", "entry"], "left").join(fan_in, "sink", "left").crossJoin(F.broadcast(most))
    groups = members.groupBy("family", "signature", "sink_role").agg(
        F.count("*").alias("n_paths"),
        F.max(at_most(F.coalesce("callers", F.lit(0)), F.col("most"))).alias("fan_in"),
        F.max(F.when(F.size("contracts") > 0, 1.0).otherwise(0.0)).alias("contract_reuse"),
        F.avg(at_most(F.coalesce("entry_score", F.lit(0.0)), 4)).alias("entry_strength"),
    )
    whole = paths.groupBy("family").agg(F.count("*").alias("n_all"))
    groups = groups.join(whole, "family").withColumn("coverage", F.col("n_paths") / F.col("n_all"))
    score = F.round(F.col("coverage") * 0.5 + F.col("fan_in") * 0.2 + F.col("contract_reuse") * 0.15 + F.col("entry_strength") * 0.15, 9)
    order = Window.partitionBy("family").orderBy(F.desc("score"), F.desc("n_paths"), "signature")
    ranked = groups.withColumn("score", score).withColumn("nth", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("nth = 1")
    # Roles of the best path's functions, in all its flows.
    steps = members.select("family", "signature", F.explode(F.arrays_zip("functions", "modules")).alias("s"))
    steps = steps.select("family", "signature", F.col("s.functions").alias("name"), F.col("s.modules").alias("module"))
    steps = steps.join(ranked.select("family", "signature"), ["family", "signature"], "left_semi").join(one, ["module", "name"])
    purity = steps.groupBy("family").agg(F.avg(role_weight(F.col("f.role"))).alias("role_purity"))
    out = ranked.join(purity, "family", "left").withColumn("role_purity", F.coalesce("role_purity", F.lit(0.4)))
    penalty = F.when(F.split("family", ":")[0].isin(*PENALISED), 0.18).otherwise(0.0) + F.when(F.col("sink_role") == "unknown", 0.15).otherwise(0.0)
    seen = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") * 0.7 + F.col("role_purity") * 0.3 - penalty)), 3)
    good = (F.col("n_paths") >= 2) & (F.col("score") >= 0.55) & (F.col("visibility") >= 0.66) & (F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 9) >= 0.05))
    out = out.withColumn("visibility", seen).withColumn("status", F.when(good, "canonical").otherwise("candidate"))
    rounded = [F.round(c, 3).alias(c) for c in ("coverage", "fan_in", "contract_reuse", "entry_strength", "role_purity")]
    return out.select(
        "family", "signature", "n_paths", *rounded, "visibility", F.round("score", 3).alias("confidence"), (F.col("n_all") - F.col("n_paths")).alias("deviations"), "status"
    )


def canonical_details(paths: DataFrame, canonical: DataFrame) -> DataFrame:
    """``family``, ``canonical`` (id), ``owner``, ``entries``, ``model``, ``symbols``: what :func:`canonical_paths` (``canonical``) stands for.

    The model is the group's path of the smallest id (ties: the smallest flow); its last module owns the path, and its functions are what
    others are held against. Entries are the distinct first functions of the group, sorted: as many as a family has ways in.
    """
    group = paths.withColumn("signature", signature()).join(canonical.select("family", "signature"), ["family", "signature"], "left_semi")
    first = F.struct("id", F.col("flow").cast("string").alias("flow"))
    out = group.groupBy("family").agg(F.min_by(F.struct("id", "functions", "modules"), first).alias("m"), F.array_sort(F.collect_set("entry")).alias("entries"))
    owner = F.coalesce(F.element_at("m.modules", -1), F.lit("unknown"))
    return out.select("family", F.concat(F.lit("canonical:"), "family").alias("canonical"), owner.alias("owner"), "entries", F.col("m.id").alias("model"), F.col("m.functions").alias("symbols"))


def canonical_members(paths: DataFrame, canonical: DataFrame) -> DataFrame:
    """``family``, ``id``, ``flow`` of the paths that are their family's canonical one."""
    group = paths.withColumn("signature", signature()).join(canonical.select("family", "signature"), ["family", "signature"], "left_semi")
    return group.select("family", "id", "flow")


def deviations(paths: DataFrame, canonical: DataFrame) -> DataFrame:
    """``family``, ``id``, ``flow``, ``module``, ``symbol``, ``missing``, ``reason``: a row for every path that goes another way than its family's canonical one.

    ``missing`` are the model's functions that the path does not have, in their order. A family with a third of all paths is joined with one row, which is small.
    """
    details = canonical_details(paths, canonical).select("family", "symbols")
    named = paths.withColumn("signature", signature())
    off = named.join(canonical.select("family", "signature"), ["family", "signature"], "left_anti").join(details, "family")
    missing = F.filter("symbols", lambda x: ~F.array_contains("functions", x))
    reason = F.concat(F.lit("deviates from "), F.element_at("symbols", -1))
    return off.select("family", "id", "flow", F.coalesce(F.element_at("modules", -1), F.lit("unknown")).alias("module"), F.col("sink").alias("symbol"), missing.alias("missing"), reason.alias("reason"))
