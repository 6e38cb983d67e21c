"""Queries of workspaces and source roots over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.operators import roots as R
from terrane.plans.registry import query
from terrane.sources.tables import table

#: Customers as files of packages, apps, commands, Java trees, documents and nested repositories.
_TREE = """f AS (SELECT CASE c_custkey % 7 WHEN 0 THEN 'packages/p' || c_custkey % 3 || '/src/a' || c_custkey || '.ts' WHEN 1 THEN 'apps/web' || c_custkey % 2 || '/lib/x' || c_custkey || '.py' WHEN 2 THEN 'cmd/tool' || c_custkey % 4 || '/main' || c_custkey || '.go'
      WHEN 3 THEN 'src/main/java/X' || c_custkey || '.java' WHEN 4 THEN 'docs/architecture/d' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.md' ELSE '.py' END WHEN 5 THEN 'ext/nested' || c_nationkey % 2 || '/internal/z' || c_custkey || '.rs'
      ELSE 'tools/hack/y' || c_custkey || '.PY' END AS path, c_custkey % 7 AS form, c_custkey AS k, c_nationkey AS n FROM customer),
    rt AS (SELECT path, CASE form WHEN 0 THEN ['packages/p' || k % 3, 'inferred-package', 'src', 'package'] WHEN 1 THEN ['apps/web' || k % 2, CASE k % 2 WHEN 0 THEN 'package' ELSE 'inferred-package' END, 'lib', 'app'] WHEN 2 THEN ['.', 'repo-root', 'cmd/tool' || k % 4, 'app']
      WHEN 3 THEN ['.', 'repo-root', 'src/main/java', 'repo-core'] WHEN 5 THEN ['ext/nested' || n % 2, 'nested-repo', 'internal', 'unknown'] END AS x FROM f WHERE form IN (0, 1, 2, 3, 5) UNION ALL SELECT path, ['.', 'repo-root', 'src', 'repo-core'] FROM f WHERE form = 3),
    ro AS (SELECT CASE x[1] WHEN '.' THEN x[3] ELSE x[1] || '/' || x[3] END AS path, x[1] AS boundary, x[2] AS boundary_kind, x[3] AS l, x[4] AS role, count(*) AS file_count, list_sort(list(path))[1:8] AS sample_files FROM rt GROUP BY ALL)"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    k, text = F.col("c_custkey"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    forms = [
        text("packages/p", k % 3, "/src/a", k, ".ts"), text("apps/web", k % 2, "/lib/x", k, ".py"), text("cmd/tool", k % 4, "/main", k, ".go"), text("src/main/java/X", k, ".java"),
        text("docs/architecture/d", k, F.when(k % 2 == 0, ".md").otherwise(".py")), text("ext/nested", F.col("c_nationkey") % 2, "/internal/z", k, ".rs"), text("tools/hack/y", k, ".PY"),
    ]
    return table(spark, sf, "customer").select(F.element_at(F.array(*forms), (k % 7 + 1).cast("int")).alias("path"))


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    given = spark.createDataFrame([("ext/nested0", "nested-repo"), ("./ext/nested1", "nested-repo"), ("apps/web0", "package"), ("apps/none", "package"), (".", "repo-root")], "path string, kind string")
    return R.source_roots(_tree(spark, sf), given)


@query(
    f"""WITH {_TREE} SELECT path, role, boundary, boundary_kind, CASE l WHEN 'src' THEN 'Detected src/ source root within boundary.' WHEN 'lib' THEN 'Detected root-level Python package within boundary.' WHEN 'src/main/java' THEN 'Detected Java source root within boundary.'
    WHEN 'internal' THEN 'Detected internal/ source root within boundary.' ELSE 'Detected Go command source root.' END AS reason, CASE WHEN l IN ('src', 'internal') THEN 0.98 WHEN l = 'lib' THEN 0.86 ELSE 1.0 END::DOUBLE AS confidence, file_count, sample_files, role <> 'unknown' AS selected FROM ro"""
)
def source_roots(spark: SparkSession, sf: str) -> DataFrame:
    return _roots(spark, sf)


@query(
    f"""WITH {_TREE} SELECT 'role' AS "by", role AS value, count(*) AS roots, count(*) FILTER (role <> 'unknown') AS selected FROM ro GROUP BY 2 UNION ALL SELECT 'boundary_kind', boundary_kind, count(*), count(*) FILTER (role <> 'unknown') FROM ro GROUP BY 2"""
)
def root_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.boundary_counts(_roots(spark, sf))


#: Parts as files of a workspace: manifests, notes, pictures, nested repositories and deep folders.
_LAYOUT = """d AS (SELECT p_partkey AS k, p_partkey % 9 AS m, 'm' || p_size % 6 AS a, lower(p_type) AS t FROM part),
    f AS (SELECT DISTINCT CASE m WHEN 0 THEN 'packages/' || a || '/package.json' WHEN 1 THEN 'docs/architecture/' || a || '.md' WHEN 2 THEN 'pkg/' || t || '/icons/' || a || '.PNG' WHEN 3 THEN 'example/' || t || '/README' || a || '.md' WHEN 4 THEN 'external/' || a || '/.git/HEAD'
      WHEN 5 THEN 'external/' || a || '/README.md' WHEN 6 THEN 'a/b/c/d/e/' || a || '/go.mod' WHEN 7 THEN 'node_modules/' || a || '/package.json' ELSE CASE WHEN t = 'promo' THEN 'Readme.' || a ELSE 'docs/' || t || '/notes.rst' END END AS path, m, a, t FROM d)"""


def _layout(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, t = F.col("p_partkey"), F.lower("p_type")
    a = F.concat(F.lit("m"), (F.col("p_size") % 6).cast("string"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [
        text("packages/", a, "/package.json"), text("docs/architecture/", a, ".md"), text("pkg/", t, "/icons/", a, ".PNG"), text("example/", t, "/README", a, ".md"), text("external/", a, "/.git/HEAD"), text("external/", a, "/README.md"),
        text("a/b/c/d/e/", a, "/go.mod"), text("node_modules/", a, "/package.json"), F.when(t == "promo", text("Readme.", a)).otherwise(text("docs/", t, "/notes.rst")),
    ]
    return R.workspace_layout(table(spark, sf, "part").select(F.element_at(F.array(*forms), (k % 9 + 1).cast("int")).alias("path")), max_candidates=20)


@query(
    f"""WITH {_LAYOUT}, g AS (SELECT '.' AS path, 'repo-root' AS kind UNION SELECT 'external/' || a, 'nested-repo' FROM f WHERE m = 4 UNION SELECT 'packages/' || a, 'package' FROM f WHERE m = 0 UNION SELECT 'pkg/' || t || '/icons', 'asset' FROM f WHERE m = 2
      UNION SELECT 'docs', 'docs' UNION SELECT 'docs/architecture', 'docs' FROM f WHERE m = 1 UNION SELECT 'docs/' || t, 'docs' FROM f WHERE m = 8 AND t <> 'promo' UNION SELECT 'example', 'example' UNION SELECT 'example/' || t, 'example' FROM f WHERE m = 3)
    SELECT path, kind, CASE path WHEN '.' THEN 0 ELSE len(string_split(path, '/')) END::INT AS depth FROM g"""
)
def workspace_directories(spark: SparkSession, sf: str) -> DataFrame:
    return _layout(spark, sf)[0]


@query(
    f"""WITH {_LAYOUT}, c AS (SELECT DISTINCT path, CASE m WHEN 0 THEN 'manifest' WHEN 1 THEN 'architecture-doc' WHEN 3 THEN 'example' WHEN 5 THEN 'readme' ELSE CASE WHEN t = 'promo' THEN 'readme' ELSE 'docs' END END AS kind,
      CASE WHEN m = 5 AND a IN (SELECT a FROM f WHERE m = 4) THEN 'external/' || a ELSE '.' END AS boundary FROM f WHERE m IN (0, 1, 3, 5, 8)),
    p AS (SELECT *, CASE kind WHEN 'readme' THEN 0 WHEN 'manifest' THEN 2 WHEN 'architecture-doc' THEN 3 WHEN 'docs' THEN 4 ELSE 30 END - CASE boundary WHEN '.' THEN 2 ELSE 0 END AS first_ FROM c),
    n AS (SELECT *, row_number() OVER (ORDER BY first_, path, kind)::INT AS nth FROM p)
    SELECT path, kind, CASE kind WHEN 'readme' THEN 'README-like file' WHEN 'manifest' THEN 'project/package manifest' WHEN 'example' THEN 'local example/reference material' ELSE 'documentation file' END AS reason, boundary, nth FROM n WHERE nth <= 20"""
)
def workspace_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _layout(spark, sf)[1]


@query(
    f"""WITH {_LAYOUT}, n AS (SELECT count(DISTINCT path) AS n FROM f WHERE m IN (0, 1, 3, 5, 8)), x AS (SELECT count(DISTINCT a) FILTER (m = 4) AS g, count(DISTINCT a) FILTER (m = 0) AS p, count(DISTINCT t) FILTER (m = 2) AS s, 2 + count(DISTINCT t) FILTER (m = 8 AND t <> 'promo') AS d,
      1 + count(DISTINCT t) FILTER (m = 3) AS e, count(DISTINCT a) FILTER (m = 6) AS deep FROM f)
    SELECT 1 + g + p + s + d + e AS directories, 1 + g AS repo_boundaries, p AS packages, s AS asset_dirs, d AS docs_dirs, e AS example_dirs, least(n, 20) AS candidates, greatest(n - 20, 0) AS more_candidates, deep AS deeper_dirs FROM x, n"""
)
def workspace_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _layout(spark, sf)[2]
