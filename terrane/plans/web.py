"""Queries of routes and of facts in source texts that the driver's tables are made into, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.functions.shapes import response_shapes as read_shapes
from terrane.operators import routes as R
from terrane.plans.registry import query
from terrane.sources.tables import table


def _pick(key: F.Column, items: list[F.Column]) -> F.Column:
    return F.element_at(F.array(*items), (key % len(items) + 1).cast("int"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size % 5 AS c, string_split(p_name, ' ')[2] AS w, lower(p_type) AS t, p_size FROM part),
    s AS (SELECT 'p' || k || CASE WHEN c = 4 THEN '.php' ELSE '.ts' END AS path, CASE c WHEN 0 THEN ['data', 'total'] WHEN 1 THEN ['error', 'code'] WHEN 2 THEN [w, 'ok'] WHEN 3 THEN [t, 'b_' || p_size] ELSE [t, 'x'] END AS keys,
      CASE WHEN c IN (0, 3) THEN 'success' ELSE 'error' END AS kind FROM p),
    d AS (SELECT 'd' || doc_id || '.ts' AS path, ['id', 'lang_' || coalesce(lang, 'none'), 'n' || doc_id % 7] AS keys, 'success' AS kind FROM documents)
    SELECT path, unnest(keys) AS key, kind, unnest(range(len(keys)))::INT AS seq FROM (SELECT * FROM s UNION ALL SELECT * FROM d)"""
)
def response_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Handlers of five forms by part, and whole documents as comments and strings before the call that counts."""
    k, w, t, size = F.col("p_partkey"), F.get(F.split("p_name", " "), F.lit(1)), F.lower("p_type"), F.col("p_size")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    forms = [
        text("export async function GET() {\n  return Response.json({ data: rows, 'total': n });\n}"),
        text("res.status(404).json({ error: '", F.col("p_name"), " }', code: { inner: 1 } })"),
        text("NextResponse.json({ ", w, ", ok: true }, { status: 500 })"),
        text("// res.json({ no: 1 })\nres.json({ ...rest, ", t, ": `}`, b_", size, " })"),
        text("http_response_code(422); echo json_encode(['", t, "' => 1, 'x' => ['y' => 2]]);"),
    ]
    parts = table(spark, sf, "part").select(text("p", k, F.when(size % 5 == 4, ".php").otherwise(".ts")).alias("path"), _pick(size, forms).alias("content"))
    body, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("none"))
    quoted = F.replace(F.replace(F.replace(body, F.lit("\\"), F.lit("/")), F.lit("`"), F.lit("'")), F.lit("*/"), F.lit(""))
    docs = table(spark, sf, "documents").select(
        text("d", F.col("doc_id"), ".ts").alias("path"), text("/* res.json({ z: 1 }) ", quoted, " */ res.json({ id: `", quoted, "`, lang_", lang, ", n", F.col("doc_id") % 7, ": [1, 2] })").alias("content")
    )
    return read_shapes(parts.union(docs))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size % 4 AS c, replace(p_brand, '#', '') AS b, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS t FROM part)
    SELECT 'p' || k AS path, CASE c WHEN 0 THEN 'POST' WHEN 1 THEN 'default' WHEN 2 THEN 'GET' END AS method, CASE c WHEN 0 THEN ['with' || b, 'log' || t, 'cors'] WHEN 1 THEN ['compose', 'with' || t] WHEN 2 THEN ['with' || b] END AS chain FROM p"""
)
def middleware_chains(spark: SparkSession, sf: str) -> DataFrame:
    b, t = F.replace("p_brand", F.lit("#"), F.lit("")), F.initcap("p_type")
    forms = [
        F.concat(F.lit("export const POST = with"), b, F.lit("( log"), t, F.lit("(\n  cors(async (req) => {})))")),
        F.concat(F.lit("export default compose(with"), t, F.lit("(new Handler("), b, F.lit(")))")),
        F.concat(F.lit("export const PUT = handler(req => 1)\nexport const GET = with"), b, F.lit("(async () => 1)")),
        F.concat(F.lit("const GET = with"), b, F.lit("(a(b))")),
    ]
    found = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), R.middleware_chain(_pick(F.col("p_size"), forms)).alias("m"))
    return found.select("path", "m.method", "m.chain")


def _web(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files of nations' handlers and of customers' and suppliers' pages, and the routes of the handlers."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")).alias("n"))
    handlers = nation.select(F.concat(F.lit("src/app/(shop)/api/"), "n", F.when(F.col("n_nationkey") % 3 == 0, "/[...rest]").otherwise("/[id]"), F.lit("/route.ts")).alias("path"), F.lit("").alias("content"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    call = F.concat(F.lit("const r = await fetch(`/api/"), "n", F.lit("/${id}?page=1`);\nconst { "), F.lower("c_mktsegment"), F.lit(", list } = await r.json(); use(data."), "n", F.lit(".length)"))
    twice = F.when(F.col("c_custkey") % 4 == 0, "axios.get('/api/nation_4/list.php')").otherwise("fetch(base + '/x')")
    pages = c.select(F.concat(F.lit("web/c"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(call, F.lit("\n"), twice).alias("content"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    forms = s.select(F.concat(F.lit("web/s"), F.col("s_suppkey").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit("<form action=\"/api/"), "n", F.lit("/a/b\"></form>")).alias("content"))
    files = handlers.union(pages).union(forms)
    return files, R.route_table(files.select("path"))


_NATIONS = """n AS (SELECT n_nationkey, replace(lower(n_name), ' ', '-') AS n, n_nationkey % 3 = 0 AS rest FROM nation), r AS (SELECT n_nationkey, n, rest, '/api/' || n || CASE WHEN rest THEN '/[...rest]' ELSE '/[id]' END AS route FROM n)"""


@query(f"WITH {_NATIONS} SELECT 'File:src/app/(shop)' || route || '/route.ts' AS src, 'Route:' || route AS dst, 'HANDLES_ROUTE' AS type, 1.0::DOUBLE AS confidence FROM r UNION ALL SELECT DISTINCT 'File:lib/tools/' || lower(p_type) || '.ts', 'Tool:' || p_type, 'HANDLES_TOOL', 1.0 FROM part")
def handler_edges(spark: SparkSession, sf: str) -> DataFrame:
    tools = table(spark, sf, "part").select(F.col("p_type").alias("name"), F.concat(F.lit("lib/tools/"), F.lower("p_type"), F.lit(".ts")).alias("path"))
    return R.handles(_web(spark, sf)[1], tools)


@query(
    f"""WITH {_NATIONS}, fr AS (SELECT route FROM r WHERE n = 'nation_4'),
    c AS (SELECT 'File:web/c' || c_custkey || '.ts' AS src, r.route, c_custkey % 4 = 0 AS twice, [lower(c_mktsegment), 'list', r.n] AS keys, string_split(r.n, '-')[1] AS first_ FROM customer JOIN r ON c_nationkey = n_nationkey),
    e AS (SELECT src, route, keys, first_, CASE WHEN twice THEN 2 ELSE 1 END AS fetches FROM c UNION ALL SELECT src, fr.route, keys, first_, 2 FROM c, fr WHERE twice AND c.route <> fr.route)
    SELECT src, 'Route:' || route AS dst, 'FETCHES' AS type, 0.9::DOUBLE AS confidence, [keys[1], 'list', first_] AS keys, fetches::BIGINT AS fetches FROM e
    UNION ALL SELECT 'File:web/s' || s_suppkey || '.html', 'Route:' || route, 'FETCHES', 0.9, [], 1 FROM supplier JOIN r ON s_nationkey = n_nationkey WHERE rest"""
)
def fetch_edges(spark: SparkSession, sf: str) -> DataFrame:
    files, routes = _web(spark, sf)
    return R.fetches(files, routes)
