"""Queries of enrichment evidence and of change targets over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.functions.scratch import materialize
from terrane.operators import evidence as E, targets as T
from terrane.plans.registry import query
from terrane.sources.tables import table


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


#: Customers as jobs, their orders as references to files, suppliers, nations and sales.
_JOBS = """jb AS (SELECT c_custkey AS job, CASE c_custkey % 3 WHEN 0 THEN 'architecture-element' WHEN 1 THEN 'architecture-perspective' END AS target_kind, CASE c_custkey % 3 WHEN 1 THEN r_name ELSE n_name END AS target, r_regionkey AS r, n_regionkey, n_nationkey,
      CASE WHEN c_custkey % 2 = 0 THEN c_name END AS output, c_custkey % 4 = 0 AS good FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    ev AS (SELECT DISTINCT o_custkey AS job, ['file', 'node', 'route', 'tool', 'process', 'module', 'relation', 'decision'][o_orderkey % 8 + 1] AS kind, CASE o_orderkey % 8 WHEN 0 THEN 'f' || o_orderkey % 50 WHEN 5 THEN 'NATION_' || o_orderkey % 30
      WHEN 6 THEN CASE WHEN o_orderkey % 16 = 6 THEN 's' || o_orderkey % 150 ELSE 's' || o_orderkey % 150 || '->c' || o_custkey END ELSE 's' || o_orderkey % 150 END AS ref FROM orders),
    sl AS (SELECT DISTINCT 's' || l_suppkey || '->c' || o_custkey AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey), sp AS (SELECT 's' || s_suppkey AS ref, ['Route', 'Tool', 'Process', 'Function'][s_suppkey % 4 + 1] AS label FROM supplier),
    fd AS (SELECT job, 'error' AS level, 'MISSING_TARGET' AS code, NULL AS kind, NULL AS ref FROM jb WHERE target_kind IS NULL UNION ALL SELECT job, 'error', 'MISSING_EVIDENCE', NULL, NULL FROM jb WHERE job NOT IN (SELECT job FROM ev)
      UNION ALL SELECT job, 'error', 'MISSING_FILE', kind, ref FROM ev WHERE kind = 'file' AND substr(ref, 2)::INT >= 40 UNION ALL SELECT job, 'error', 'OUTPUT_HASH_MISMATCH', NULL, NULL FROM jb WHERE output IS NOT NULL AND NOT good
      UNION ALL SELECT job, 'error', 'MISSING_ARCHITECTURE_ELEMENT', target_kind, target FROM jb WHERE target_kind = 'architecture-element' AND n_regionkey = 1 UNION ALL SELECT job, 'error', 'MISSING_ARCHITECTURE_PERSPECTIVE', target_kind, target FROM jb WHERE target_kind = 'architecture-perspective' AND r = 4
      UNION ALL SELECT job, 'warning', 'UNSUPPORTED_ANCHOR_VALIDATION', kind, ref FROM ev WHERE kind = 'decision' OR (kind = 'relation' AND ref NOT LIKE '%->%')
      UNION ALL SELECT job, 'error', 'MISSING_GRAPH_ANCHOR', kind, ref FROM ev WHERE (kind = 'node' AND ref NOT IN (SELECT ref FROM sp)) OR (kind IN ('route', 'tool', 'process') AND (lower(kind), ref) NOT IN (SELECT (lower(label), ref) FROM sp))
        OR (kind = 'module' AND ref NOT IN (SELECT n_name FROM nation)) OR (kind = 'relation' AND ref LIKE '%->%' AND ref NOT IN (SELECT ref FROM sl)))"""


def _findings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf, n)
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(k % 3 == 0, "architecture-element").when(k % 3 == 1, "architecture-perspective")
    output = F.when(k % 2 == 0, F.col("c_name"))
    jobs = c.select(k.alias("job"), kind.alias("target_kind"), F.when(k % 3 == 1, F.col("r_name")).otherwise(F.col("n_name")).alias("target"), output.alias("output"), F.when(k % 4 == 0, F.sha2(F.col("c_name").cast("binary"), 256)).otherwise("x").alias("output_hash"))
    kinds = F.element_at(F.array(*map(F.lit, ("file", "node", "route", "tool", "process", "module", "relation", "decision"))), (o % 8 + 1).cast("int"))
    pair = F.when(o % 16 == 6, _text("s", o % 150)).otherwise(_text("s", o % 150, "->c", F.col("o_custkey")))
    ref = F.when(o % 8 == 0, _text("f", o % 50)).when(o % 8 == 5, _text("NATION_", o % 30)).when(o % 8 == 6, pair).otherwise(_text("s", o % 150))
    evidence = t("orders").select(F.col("o_custkey").alias("job"), kinds.alias("kind"), ref.alias("ref"), F.lit(None).cast("string").alias("file"))
    files = spark.range(40).select(_text("f", F.col("id")).alias("path"))
    labels = F.element_at(F.array(*map(F.lit, ("Route", "Tool", "Process", "Function"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    nodes = t("supplier").select(_text("s", F.col("s_suppkey")).alias("id"), labels.alias("label"))
    edges = t("lineitem").join(t("orders"), F.col("l_orderkey") == o).select(_text("s", F.col("l_suppkey")).alias("src"), _text("c", F.col("o_custkey")).alias("dst")).distinct()
    anchors = spark.createDataFrame([], "kind string, ref string")
    elements, perspectives = t("nation").where("n_regionkey <> 1").select(F.col("n_name").alias("id")), t("region").where("r_regionkey < 4").select(F.col("r_name").alias("id"))
    jobs = materialize(jobs, "jobs")
    return jobs, E.job_findings(jobs, evidence, files, elements, perspectives, anchors, (nodes, edges, t("nation").select(F.col("n_name").alias("id"))))


@query(f"WITH {_JOBS} SELECT job, level, code, kind, ref FROM fd")
def job_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)[1].select("job", "level", "code", "kind", "ref")


@query(
    f"""WITH {_JOBS} SELECT jb.job, count(fd.job) FILTER (level = 'error') = 0 AS ok, count(fd.job) FILTER (level = 'error') AS errors, count(fd.job) FILTER (level = 'warning') AS warnings FROM jb LEFT JOIN fd ON fd.job = jb.job GROUP BY 1"""
)
def job_status(spark: SparkSession, sf: str) -> DataFrame:
    jobs, found = _findings(spark, sf)
    return E.job_status(jobs, found)


#: Parts as units; their brands, types, words and parts of words as targets.
_MATCHES = """p AS (SELECT 'u' || p_partkey AS unit, replace(p_brand, '#', '') AS module, 'src/' || lower(p_type) AS scope, string_split(p_name, ' ') AS w, ['prod_core', 'test', 'peripheral', 'prod_entrypoint'][p_size % 4 + 1] AS role, [1, 0.05, 0.45, 0.95][p_size % 4 + 1]::DOUBLE AS weight FROM part),
    un AS MATERIALIZED (SELECT *, w[1] || upper(left(w[2], 1)) || substr(w[2], 2) AS symbol, lower(w[1] || w[2]) AS text, replace(scope, '/', ' ') AS place FROM p),
    tg AS (SELECT DISTINCT module AS target, [lower(module)] AS words FROM un UNION SELECT DISTINCT scope, string_split(scope, '/') FROM un UNION SELECT DISTINCT w[2], [w[2]] FROM un UNION SELECT DISTINCT substr(w[2], 2, 3), [substr(w[2], 2, 3)] FROM un UNION SELECT DISTINCT symbol, w FROM un WHERE module = 'Brand1'),
    ba AS (SELECT target, unit, weight, CASE WHEN module = target THEN 95 WHEN scope = target THEN 90 WHEN symbol = target THEN 85 WHEN len(list_intersect(words, list_concat(w, [lower(module)], string_split(scope, '/')))) > 0 THEN 50 ELSE 0 END AS base,
      contains(text, target) OR contains(place, target) AS part FROM un CROSS JOIN tg),
    bs AS (SELECT target, max(base) AS most FROM ba GROUP BY 1), mt AS MATERIALIZED (SELECT target, unit, CASE WHEN base > 0 THEN base ELSE 20 END * weight AS score FROM ba JOIN bs USING (target) WHERE base > 0 OR (most = 0 AND part))"""


def _units(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    w = F.split("p_name", " ")
    second, size = F.get(w, F.lit(1)), F.col("p_size")
    symbol, module, scope = F.concat(F.get(w, F.lit(0)), F.initcap(second)), F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.lit("src/"), F.lower("p_type"))
    role = F.when(size % 4 == 0, "prod_core").when(size % 4 == 1, "test").when(size % 4 == 2, "peripheral").otherwise("prod_entrypoint")
    part = table(spark, sf, "part")
    units = materialize(part.select(_text("u", F.col("p_partkey")).alias("unit"), module.alias("module"), scope.alias("scope"), symbol.alias("symbol"), role.alias("role")), "units")
    asked = part.select(F.explode(F.array(module, scope, second, F.substring(second, 2, 3), F.when(module == "Brand1", symbol))).alias("target"))
    return units, asked.where("target IS NOT NULL").distinct()


@query(f"WITH {_MATCHES} SELECT target, unit, round(score, 6) AS score FROM mt")
def unit_matches(spark: SparkSession, sf: str) -> DataFrame:
    units, asked = _units(spark, sf)
    return T.unit_matches(units, asked).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_MATCHES}, tp AS (SELECT mt.target, unit, scope, weight, len(list_intersect(words, string_split(scope, '/'))) > 0 AS near FROM mt JOIN (SELECT target, max(score) AS score FROM mt GROUP BY 1) b ON b.target = mt.target AND b.score = mt.score JOIN un USING (unit) JOIN tg ON tg.target = mt.target),
    tw AS (SELECT target, scope FROM tp WHERE near GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(sum(weight), 9) DESC, scope) <= 2)
    SELECT target, unit, scope FROM tp WHERE near AND (target, scope) IN (SELECT (target, scope) FROM tw) UNION ALL SELECT target, unit, scope FROM tp WHERE target NOT IN (SELECT target FROM tw)"""
)
def focus_units(spark: SparkSession, sf: str) -> DataFrame:
    units, asked = _units(spark, sf)
    return T.focus_units(T.unit_matches(units, asked), units)


@query(
    """WITH m AS (SELECT n_name AS module, n_regionkey AS r, CASE WHEN n_nationkey % 3 > 0 THEN 'run' || n_nationkey END AS entry FROM nation), a AS (SELECT x.module AS target, list_sort(list(y.module)) AS modules, list_sort(coalesce(list(y.entry) FILTER (y.entry IS NOT NULL), [])) AS entries FROM m x JOIN m y ON x.r = y.r GROUP BY 1)
    SELECT target, 'recommended-scope' AS option, modules, entries, FALSE AS discouraged FROM a UNION ALL SELECT target, 'local-patch', [target], entries[1:1], TRUE FROM a"""
)
def fallback_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as targets and modules; those of one region are two edges apart, by way of the region."""
    nation = table(spark, sf, "nation")
    name, region = F.col("n_name"), _text("r", F.col("n_regionkey"))
    edges = nation.select(name.alias("src"), region.alias("dst")).union(nation.select(region, name))
    modules = nation.select(name.alias("module"), F.when(F.col("n_nationkey") % 3 > 0, _text("run", F.col("n_nationkey"))).alias("entry"))
    return T.fallback_plans(nation.select(name.alias("target")), nation.select(name.alias("target"), name.alias("module")), edges, modules)
