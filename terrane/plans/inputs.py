"""Queries of decision inputs, and of what is decided from them, over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.functions.scratch import materialize
from terrane.operators import families, inputs as I, layers
from terrane.plans import adapters as A
from terrane.plans.adapters import with_
from terrane.plans.registry import query
from terrane.sources.tables import table

#: Parts as functions of files in four folders, one of them of no module; orders as processes; contracts from calls between modules.
_INPUTS = f"""{with_("calls")}, nd AS MATERIALIZED (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Method' WHEN 1 THEN 'Class' ELSE 'Function' END AS label, ['handle', 'get', 'load', 'on'][p_partkey % 4 + 1] || replace(p_brand, '#', '') AS name,
      ['api', 'db', 'tests', 'gen'][p_size % 4 + 1] AS dir, ['routes/x.ts', 'main.go', 'a.rb'][p_size % 3 + 1] AS file, p_retailprice > 950 AS exported, [1.5, 0.3, 1, 1.5][p_partkey % 4 + 1]::DOUBLE * [2.5, 3, 1][p_size % 3 + 1]::DOUBLE AS factor FROM part),
    pl AS MATERIALIZED (SELECT *, dir || '/' || file AS path, CASE WHEN dir <> 'gen' THEN dir END AS home FROM nd),
    mt AS (SELECT src, dst, x.home AS a, y.home AS b, y.name FROM calls JOIN pl x ON x.id = src JOIN pl y ON y.id = dst),
    ct AS MATERIALIZED (SELECT a || '--' || b AS contract, a AS consumer, b AS provider, list(DISTINCT name) AS interface FROM mt WHERE a <> b GROUP BY 1, 2, 3),
    ic AS (SELECT dst AS id, count(*) AS callers, count(*) FILTER (a IS NULL OR a <> coalesce(b, 'unknown')) AS external_refs FROM mt GROUP BY 1), oc AS (SELECT src AS id, count(*) AS callees FROM calls GROUP BY 1),
    pr AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS process_refs FROM lineitem GROUP BY 1), sd AS (SELECT module, count(*) AS contract_refs FROM (SELECT provider AS module FROM ct UNION ALL SELECT consumer FROM ct) GROUP BY 1),
    al AS (SELECT pl.*, coalesce(home, 'unknown') AS module, coalesce(callers, 0) AS callers, coalesce(external_refs, 0) AS external_refs, coalesce(callees, 0) AS callees, coalesce(process_refs, 0) AS process_refs, coalesce(contract_refs, 0) AS contract_refs
      FROM pl LEFT JOIN ic USING (id) LEFT JOIN oc USING (id) LEFT JOIN pr USING (id) LEFT JOIN sd ON sd.module = home WHERE label <> 'Class' AND dir <> 'tests'),
    sc AS (SELECT *, CASE WHEN callees > 0 THEN callees / (callers + 1) * CASE WHEN exported THEN 2 ELSE 1 END * factor ELSE 0 END AS entry_score FROM al),
    rs AS (SELECT *, least(1, external_refs / 6) * 0.35::DOUBLE + least(1, process_refs / 4) * 0.35::DOUBLE + least(1, contract_refs / 3) * 0.2::DOUBLE + least(1, entry_score / 4) * 0.1::DOUBLE AS s FROM sc),
    fn AS MATERIALIZED (SELECT *, CASE WHEN dir = 'gen' THEN 'generated' WHEN (entry_score > 1.3 OR file = 'main.go') AND (s >= 0.25 OR entry_score >= 1.5) THEN 'prod_entrypoint' WHEN s >= 0.28 THEN 'prod_core' ELSE 'peripheral' END AS role FROM rs),
    ex AS (SELECT contract, consumer, provider, unnest(interface) AS symbol FROM ct),
    fc AS MATERIALIZED (SELECT id AS function, contract FROM fn JOIN ex ON provider = module AND symbol = fn.name UNION SELECT fn.id, contract FROM calls JOIN fn ON fn.id = src JOIN pl ON pl.id = dst JOIN ex ON consumer = module AND symbol = pl.name),
    en AS MATERIALIZED (SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = 1 UNION SELECT id FROM fn WHERE entry_score > 1 AND role IN ('prod_core', 'prod_entrypoint'))"""


def _inputs(spark: SparkSession, sf: str) -> I.DecisionInputs:
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda k, items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    folder = pick(size, ("api", "db", "tests", "gen"))
    label = F.when(size % 5 == 0, "Method").when(size % 5 == 1, "Class").otherwise("Function")
    nodes = materialize(
        table(spark, sf, "part").select(
            key.alias("id"), label.alias("label"), F.concat(pick(key, ("handle", "get", "load", "on")), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"),
            F.concat(folder, F.lit("/"), pick(size, ("routes/x.ts", "main.go", "a.rb"))).alias("path"), (F.col("p_retailprice") > 950).alias("exported"), F.lit(None).cast("string").alias("language"),
            F.when(folder != "gen", folder).alias("module"),
        ),
        "nodes",
    )
    edges = materialize(A.calls(spark, sf).select("src", "dst", "type"), "edges")
    a, b = (nodes.select(F.col("id").alias(x), F.col("module").alias(f"{x}_module"), F.col("name").alias(f"{x}_name")) for x in ("src", "dst"))
    crossing = edges.join(a, "src").join(b, "dst").withColumnRenamed("dst_name", "name")
    contracts = layers.contracts(crossing).select("id", "consumer", "provider", F.split("interface", ",").alias("interface"))
    lines = table(spark, sf, "lineitem")
    steps = lines.select(F.col("l_orderkey").alias("process"), F.col("l_partkey").alias("id"))
    entries = lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("id"))
    modules = nodes.where("module IS NOT NULL").select("module", "path").distinct()
    return I.decision_inputs(nodes, edges, steps, entries, modules, contracts)


@query(
    _INPUTS
    + """ SELECT id, name, label, path, module, dir || '/' || CASE WHEN file = 'routes/x.ts' THEN 'routes' ELSE file END AS scope_, exported, role, callers, callees, external_refs, process_refs, contract_refs, round(entry_score, 6) AS entry_score,
    CASE WHEN role = 'generated' THEN 0.95 WHEN role = 'prod_entrypoint' THEN floor((0.65 + s * 0.3) * 1000 + 0.5) / 1000 WHEN role = 'prod_core' THEN floor((0.55 + s * 0.35) * 1000 + 0.5) / 1000 ELSE floor((0.45 + s * 0.2) * 1000 + 0.5) / 1000 END AS role_confidence,
    list_filter([CASE WHEN id % 4 < 3 THEN ['handle', 'get', 'load'][id % 4 + 1] END], lambda x: x IS NOT NULL) AS verbs FROM fn"""
)
def decision_functions(spark: SparkSession, sf: str) -> DataFrame:
    found = _inputs(spark, sf).functions
    scope = F.when(F.col("module") == "unknown", F.concat(F.lit("gen/"), F.when(F.col("path").contains("routes"), "routes").otherwise(F.element_at(F.split("path", "/"), -1)))).otherwise(F.col("scope"))
    return found.withColumn("entry_score", F.round("entry_score", 6)).select(
        "id", "name", "label", "path", "module", scope.alias("scope_"), "exported", "role", "callers", "callees", "external_refs", "process_refs", "contract_refs", "entry_score", "role_confidence", "verbs"
    )


@query(_INPUTS + " SELECT function, contract FROM fc")
def function_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return _inputs(spark, sf).contracts


@query(_INPUTS + " SELECT id FROM en")
def decision_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _inputs(spark, sf).entries


@query(
    _INPUTS.replace("WITH", "WITH RECURSIVE", 1)
    + """, wt AS (SELECT id, name, module, role, CASE role WHEN 'generated' THEN 0.08 WHEN 'prod_entrypoint' THEN 0.95 WHEN 'prod_core' THEN 1 ELSE 0.45 END::DOUBLE AS weight FROM fn),
    step AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM wt) AND dst IN (SELECT id FROM wt) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3),
    walk AS (SELECT [id] AS path, id AS tip, FALSE AS again FROM wt WHERE id IN (SELECT id FROM en) UNION ALL SELECT list_append(path, dst), dst, list_contains(path, dst) FROM walk JOIN step ON tip = src WHERE len(path) < 6 AND NOT again),
    done AS (SELECT path FROM walk WHERE (again OR len(path) = 6 OR NOT EXISTS (SELECT 1 FROM step WHERE src = tip)) AND len(path) >= 2),
    ats AS (SELECT path, unnest(path) AS id, unnest(range(len(path))) AS nth FROM done),
    pa AS (SELECT path, list(name ORDER BY nth) AS functions, list(module ORDER BY nth) AS modules FROM ats JOIN wt USING (id) GROUP BY 1 HAVING count(DISTINCT module) >= 2 AND avg(weight) >= 0.28),
    un AS (SELECT path[1] AS flow, functions, modules, functions[1] AS entry, functions[-1] AS sink, path FROM pa WHERE functions[1] NOT LIKE 'handleBrand2%'),
    hp AS (SELECT flow, functions, modules, list_sort(list(DISTINCT contract)) AS contracts FROM (SELECT flow, functions, modules, unnest(path) AS function FROM un) JOIN fc USING (function) GROUP BY 1, 2, 3)
    SELECT un.flow, un.functions, un.modules, any_value(entry) AS entry, any_value(sink) AS sink, coalesce(any_value(contracts), []) AS contracts FROM un LEFT JOIN hp ON hp.flow = un.flow AND hp.functions = un.functions AND hp.modules = un.modules GROUP BY 1, 2, 3"""
)
def call_path_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of calls from all entries that no flow begins with; their families, which :func:`families.call_path_instances` tells besides, are no part of the result and not worked out."""
    found = _inputs(spark, sf)
    covered = found.functions.where("name LIKE 'handleBrand2%'").select(F.col("name").alias("entry"))
    out = families.entry_paths(found.functions, found.calls, found.entries, found.contracts, covered)
    return out.select("flow", "functions", "modules", "entry", "sink", "contracts")
