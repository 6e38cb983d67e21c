"""Where the sources of a workspace lie: its boundaries, what there is to read about it, and the roots of its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.names import root_role
from terrane.functions.scratch import materialize
from terrane.operators.change import longest_prefix

# Names of manifests and instructions, endings of documents, assets and sources, folders that are passed over or hold no root.
MANIFESTS = "package.json pyproject.toml Cargo.toml go.mod pom.xml build.gradle build.gradle.kts requirements.txt tsconfig.json".split()
INSTRUCTIONS = "AGENTS.md CLAUDE.md".split()
DOCUMENTS = ".md .mdx .txt .rst .adoc .yaml .yml .json .mmd".split()
ASSETS = ".png .jpg .jpeg .gif .webp .svg .ico .bmp .avif .pdf .woff .woff2 .ttf .otf .eot .mp3 .wav .ogg .mp4 .webm".split()
PASSED = ".git .worktrees node_modules dist build out target coverage .cache .turbo .next".split()
SOURCES = ".ts .tsx .js .jsx .mjs .cjs .py .go .rs .java .kt .kts .c .h .cpp .hpp .cs .php .rb .swift .dart .vue .svelte".split()
PERIPHERAL = "docs doc test tests example examples samples scripts tools tooling fixtures fixture benchmarks benchmark generated .generated".split()
PRIORITY = {"readme": 0, "agent-instructions": 1, "manifest": 2, "architecture-doc": 3, "docs": 4, "example": 10}
MAX_DEPTH, MAX_CANDIDATES, SAMPLE = 5, 400, 8


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def _ending(path: Column) -> Column:
    """The lower-cased ending of a file's name; empty if there is none, or only a leading dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def _folders(path: Column) -> Column:
    """All folders above a path, the root as '.', from the top."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit(".")), below)).otherwise(F.array(F.lit(".")))


def _depth(folder: Column) -> Column:
    return F.when(folder == ".", 0).otherwise(F.size(F.split(folder, "/")))


def workspace_layout(files: DataFrame, max_depth: int = MAX_DEPTH, max_candidates: int = MAX_CANDIDATES, store: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Directories (``path``, ``kind``, ``depth``), candidates (``path``, ``kind``, ``reason``, ``boundary``, ``nth``) and one row of counts, of ``files`` (``path``).

    Kinds of directories: repo-root, nested-repo (holds a ``.git`` folder with a file), package (a manifest), asset, docs, example, and ``store`` with ``architecture-store`` below it.
    A directory can be of several kinds. Folders of the passed-over names are not entered, nor is anything deeper than ``max_depth``. Candidates
    are files to read about the workspace, the nearest boundary (the root or a nested repository) with them; the first ``max_candidates`` by kind, boundary and path
    are told. The counts tell besides how many folders lay deeper and how many candidates came after, so that no limit is silent.
    The order of candidates is one window over those that are told per partition first.
    """
    paths = files.where("path IS NOT NULL").select(_clean(F.col("path")).alias("path")).distinct()
    parts = F.split("path", "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    git = paths.where(F.array_contains(above, ".git")).select(F.regexp_extract("path", r"^(.*?)/?\.git/", 1).alias("folder")).where("folder <> ''")
    known = paths.where(~F.arrays_overlap(above, F.array(*map(F.lit, PASSED))))
    known = known.withColumns({"folder": F.when(F.size(parts) > 1, F.array_join(above, "/")).otherwise("."), "name": F.element_at(parts, -1), "ending": _ending(F.col("path"))})
    known = materialize(known.withColumn("depth", _depth(F.col("folder"))), "layout")
    folders = known.select(F.explode(_folders(F.col("path"))).alias("path")).union(git.select(F.explode(_folders(F.concat("folder", F.lit("/x")))))).distinct().withColumn("depth", _depth(F.col("path")))
    here = folders.where(F.col("depth") <= max_depth)
    base, p = F.element_at(F.split("path", "/"), -1), F.col("path")
    under = lambda *names: F.lit(False) if not names else (p == names[0]) | p.startswith(f"{names[0]}/") | under(*names[1:])
    own = under(store) if store else F.lit(False)
    shown = known.where(F.col("depth") <= max_depth)
    kinds = [
        here.where("path = '.'").select("path", F.lit("repo-root").alias("kind")),
        git.distinct().where(_depth(F.col("folder")) <= max_depth).select("folder", F.lit("nested-repo")),
        shown.where(F.col("name").isin(*MANIFESTS)).select("folder", F.lit("package")),
        shown.where(F.col("ending").isin(*ASSETS) & (F.col("folder") != ".")).select("folder", F.lit("asset")),
        here.where(~own & (under("docs") | base.isin("docs", "doc", "architecture", "adr"))).select("path", F.lit("docs")),
        here.where(under("example", "examples")).select("path", F.lit("example")),
    ]
    if store:
        kinds += [here.where(own).select(F.lit(store), F.lit("store")), here.where(under(f"{store}/architecture")).select(F.lit(f"{store}/architecture"), F.lit("architecture-store"))]
    found = kinds[0]
    for k in kinds[1:]:
        found = found.union(k)
    directories = materialize(found.distinct().withColumn("depth", _depth(F.col("path"))), "directories")
    low, name = F.lower("name"), F.col("name")
    example = p.startswith("example/") | p.startswith("examples/")
    doc = F.col("ending").isin(*DOCUMENTS)
    book = p.startswith("docs/") | p.startswith("doc/") | p.startswith("architecture/") | p.startswith("adr/")
    kind = (
        F.when(example, F.when(low.startswith("readme") | name.isin(*MANIFESTS) | doc, "example"))
        .when(low.startswith("readme"), "readme")
        .when(name.isin(*INSTRUCTIONS), "agent-instructions")
        .when(name.isin(*MANIFESTS), "manifest")
        .when(book & doc, F.when(p.contains("/architecture/") | p.startswith("architecture/") | p.startswith("adr/"), "architecture-doc").otherwise("docs"))
    )
    reasons = {"example": "local example/reference material", "readme": "README-like file", "agent-instructions": "agent instruction file", "manifest": "project/package manifest"}
    told = shown.withColumn("kind", kind).where("kind IS NOT NULL")
    reason = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), F.col("kind")), F.lit("documentation file"))
    nested = directories.where("kind = 'nested-repo'").select(F.col("path").alias("prefix"))
    told = told.join(longest_prefix(told.select("path"), nested), "path", "left").select("path", "kind", reason.alias("reason"), F.coalesce("prefix", F.lit(".")).alias("boundary"))
    first = F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("kind")) - F.when(F.col("boundary") == ".", 2).otherwise(0) + F.when(example, 20).otherwise(0)
    told = materialize(told.withColumn("first", first), "candidates")
    chosen = told.orderBy("first", "path", "kind").limit(max_candidates)
    nth = F.row_number().over(Window.orderBy("first", "path", "kind"))
    counts = directories.agg(
        F.count("*").alias("directories"), F.count_if(F.col("kind").isin("repo-root", "nested-repo")).alias("repo_boundaries"),
        *[F.count_if(F.col("kind") == k).alias(c) for k, c in (("package", "packages"), ("asset", "asset_dirs"), ("docs", "docs_dirs"), ("example", "example_dirs"))],
    )
    beyond = folders.agg(F.count_if(F.col("depth") > max_depth).alias("deeper_dirs"))
    number = told.agg(F.count("*").alias("n")).select(F.least(F.col("n"), F.lit(max_candidates)).alias("candidates"), F.greatest(F.col("n") - max_candidates, F.lit(0)).alias("more_candidates"))
    return directories, chosen.withColumn("nth", nth).drop("first"), counts.crossJoin(F.broadcast(number)).crossJoin(F.broadcast(beyond))  # one row each


def source_roots(files: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``path``, ``role``, ``boundary``, ``boundary_kind``, ``reason``, ``confidence``, ``file_count``, ``sample_files``, ``selected`` of every source root.

    ``files``: ``path``; ``boundaries``: ``path``, ``kind`` (package or nested-repo), beside the root and what lies below packages, apps, libs or crates. A file belongs to the
    nearest boundary above it. Within one the usual folders are roots: src and its Java and Kotlin trees, each command of cmd, internal, pkg, and folders with Python that are not peripheral;
    in the root, if there is none of them, the only other folder, where no source lies beside it. Other boundaries without any have no root. A root that two boundaries tell
    is the surer one's, the longer boundary's of equals. Samples are the first 8 files. Only counts and 8 names a root are gathered.
    """
    paths = files.where("path IS NOT NULL").select(_clean(F.col("path")).alias("path")).distinct()
    paths = materialize(paths.where(_ending(F.col("path")).isin(*SOURCES)), "source-files")
    inferred = paths.select(F.regexp_extract("path", "^((?:packages|apps|libs|crates)/[^/]+)/", 1).alias("boundary")).where("boundary <> ''").distinct()
    given = boundaries.where(F.col("kind").isin("package", "nested-repo")).select(_clean(F.col("path")).alias("boundary"), "kind").groupBy("boundary").agg(F.min("kind").alias("kind"))
    both = inferred.join(given, "boundary", "full").select("boundary", F.coalesce("kind", F.lit("inferred-package")).alias("kind"))
    at = longest_prefix(paths, both.select(F.col("boundary").alias("prefix"))).join(both.withColumnRenamed("boundary", "prefix"), "prefix", "left")
    root = F.lit("."), F.lit("repo-root")
    at = at.select("path", F.coalesce("prefix", root[0]).alias("boundary"), F.coalesce("kind", root[1]).alias("kind"))
    rel = F.when(F.col("boundary") == ".", F.col("path")).otherwise(F.expr("substring(path, char_length(boundary) + 2)"))
    at = materialize(at.withColumn("rel", rel), "bounded-files")
    r = F.col("rel")
    python = F.regexp_extract(r, r"^([^/.][^/]*)/.+\.py$", 1)
    offer = lambda when, local, reason, confidence: F.when(when, F.struct(local.alias("local"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")))
    lit = F.lit
    offers = F.array(
        offer(r.startswith("src/main/java/"), lit("src/main/java"), "Detected Java source root within boundary.", 1.0),
        offer(r.startswith("src/main/kotlin/"), lit("src/main/kotlin"), "Detected Kotlin source root within boundary.", 1.0),
        offer(r.startswith("src/"), lit("src"), "Detected src/ source root within boundary.", 0.98),
        offer(r.rlike("^cmd/[^/]+/"), F.regexp_extract(r, "^(cmd/[^/]+)/", 1), "Detected Go command source root.", 1.0),
        offer(r.startswith("internal/"), lit("internal"), "Detected internal/ source root within boundary.", 0.98),
        offer(r.startswith("pkg/"), lit("pkg"), "Detected pkg/ source root within boundary.", 0.98),
        offer((python != "") & ~python.isin(*PERIPHERAL), python, "Detected root-level Python package within boundary.", 0.86),
    )
    found = at.select("boundary", "kind", F.inline(F.filter(offers, lambda x: x.isNotNull()))).groupBy("boundary", "kind", "local").agg(F.max(F.struct("confidence", "reason")).alias("x"))
    found = materialize(found.select("boundary", "kind", "local", "x.reason", "x.confidence"), "local-roots")
    top = F.when(F.instr(r, "/") > 0, F.split(r, "/")[0])
    alone = at.where("boundary = '.'").join(found.select("boundary").distinct(), "boundary", "left_anti").groupBy("boundary", "kind")
    alone = alone.agg(F.count_if(top.isNull()).alias("beside"), F.collect_set(F.when(~top.isin(*PERIPHERAL), top)).alias("tops")).where((F.size("tops") == 1) & (F.col("beside") == 0))
    found = found.union(alone.select("boundary", "kind", F.get("tops", F.lit(0)), F.lit("Fallback top-level source directory within repo root."), F.lit(0.6)))
    # Roots have three segments at most, so each file offers its first three folders to an equi-join.
    parts = F.split("rel", "/")
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(3))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    mine = at.where(F.instr("rel", "/") > 0).select("boundary", "path", F.explode(heads).alias("local")).join(found, ["boundary", "local"])
    nth = F.row_number().over(Window.partitionBy("boundary", "local").orderBy("path"))
    counts = mine.groupBy("boundary", "kind", "local", "reason", "confidence").agg(F.count("*").alias("file_count"))
    sample = mine.withColumn("nth", nth).where(F.col("nth") <= SAMPLE).groupBy("boundary", "local").agg(F.array_sort(F.collect_list("path")).alias("sample_files"))
    out = counts.join(sample, ["boundary", "local"]).withColumn("path", F.when(F.col("boundary") == ".", F.col("local")).otherwise(F.concat_ws("/", "boundary", "local")))
    out = out.withColumn("role", root_role(F.col("path"), F.col("kind"), F.col("boundary")))
    rest = ["role", "boundary", F.col("kind").alias("boundary_kind"), "reason", "confidence", "file_count", "sample_files", F.col("role").isin("repo-core", "app", "package").alias("selected")]
    first = F.struct("confidence", F.char_length("boundary"), "boundary")
    best = out.groupBy("path").agg(F.max_by(F.struct(*rest), first).alias("x"))
    return best.select("path", "x.*")


def boundary_counts(roots: DataFrame) -> DataFrame:
    """``by`` (role or boundary_kind), ``value``, ``roots``, ``selected``: counts of a workspace's source roots."""
    both = [roots.groupBy(F.lit(c).alias("by"), F.col(c).alias("value")).agg(F.count("*").alias("roots"), F.count_if("selected").alias("selected")) for c in ("role", "boundary_kind")]
    return both[0].union(both[1])
