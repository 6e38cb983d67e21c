"""Response shapes, wrappers, handlers and fetches on literal sources."""

import time

import pytest
from pyspark.sql import functions as F

from terrane.functions.shapes import php_responses, response_shapes, script_responses
from terrane.operators import decision, routes as R

SCRIPTS = {
    "return Response.json({ data: [{ id: 1 }], total: 1 });": [(["data", "total"], None)],
    "res.status(404).json({ error: 'no', 'detail': { code: 1 } })": [(["error", "detail"], 404)],
    "NextResponse.json({ error }, { status: 500 })": [(["error"], 500)],
    "NextResponse.json({ ok: true }, { headers: {}, status: 201 })": [(["ok"], None)],  # a brace closes before
    "res.json({ ...rest, a, b: c, d() { return 1 }, [e]: 2, 'f': x, g })": [(["a", "b", "f", "g"], None)],
    "res.json({ a: '}', /* b: 1, */ c: \"{\", // d: 2,\n e: `x ${y} }`, f: [1, { z: 2 }, q] })": [(["a", "c", "e", "f"], None)],
    "// res.json({ x: 1 })\n'.json({ y: 1 })'": [],
    "res.json(data); const o = { p: 1 }": [],
    "res.json(wrap({ k: 1 }))": [(["k"], None)],
    "res.json([{ k: 1 }])": [(["k"], None)],
    "res.json({ a: res2.json({ inner: 1 }), b: 2 })": [(["a", "b"], None), (["inner"], None)],
    "res.json({ a: 1, b": [(["a"], None)],
    "res.json({})": [([], None)],
    "": [],
    "$res.json ( { $a: 1, _b: 2 } )": [(["$a", "_b"], None)],
    "res.status( 201 ) .json({ id })": [(["id"], 201)],
}


@pytest.mark.parametrize("text", SCRIPTS)
def test_keys_of_script_responses(text):
    assert script_responses(text) == SCRIPTS[text]


PHP = {
    "<?php echo json_encode(['a' => 1, \"b\" => ['c' => 2], 'd e' => 3]);": [(["a", "b"], None)],
    "http_response_code(404); echo json_encode(array('error' => 'x'));": [(["error"], 404)],
    "http_response_code(500); exit; echo json_encode(['ok' => true]);": [(["ok"], None)],
    "header('HTTP/1.1 403 Forbidden'); die(json_encode(['error' => 1]));": [(["error"], 403)],
    "http_response_code(200); http_response_code(422); json_encode([ 'e' => f(['g' => 1]) ])": [(["e"], 422)],
    "# json_encode(['x' => 1])\njson_encode($data); json_encode(['open' => 1": [],
}


@pytest.mark.parametrize("text", PHP)
def test_keys_of_php_responses(text):
    assert php_responses(text) == PHP[text]


def test_shapes_by_file(spark):
    rows = [("a.ts", "res.json({ a, b }); res.json({ b, c }); res.status(400).json({ a })"), ("b.PHP", "json_encode(['k' => 1])"), ("c.ts", None), (None, "x.json({ q })")]
    files = spark.createDataFrame(rows, "path string, content string").withColumn("key", F.lit(1))
    got = sorted((tuple(r) for r in response_shapes(files).collect()), key=repr)
    assert got == sorted([("a.ts", "a", "success", 0), ("a.ts", "b", "success", 1), ("a.ts", "c", "success", 2), ("a.ts", "a", "error", 3), ("b.PHP", "k", "success", 0), (None, "q", "success", 0)], key=repr)


@pytest.mark.parametrize("text", ["res.json({ a: 1 });\n" * 50_000, "{(" * 500_000, "res.json({" * 100_000, "'" + "\\'" * 500_000, "/*" * 500_000, "})" * 500_000, ".json(" * 160_000, "json_encode([" * 80_000])
def test_a_megabyte_takes_seconds(text):
    began = time.process_time()
    script_responses(text)
    php_responses(text)
    assert time.process_time() - began < 12


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("path", "route"),
    [("app/api/users/route.ts", "/api/users"), ("src/app/(admin)/api/[id]/route.js", "/api/[id]"), ("app/home/route.ts", None), ("pages/api/a/index.ts", "/api/a"), ("pages/api/b.tsx", "/api/b"), ("web\\pages\\api\\c.js", "/api/c"), ("lib/x.ts", None)],
)
def test_routes_of_files(spark, path, route):
    assert value(spark, R.route_of, path) == route


CHAINS = {
    "export const POST = withAuth(withLog( withCors(handler)))": ("POST", ["withAuth", "withLog", "withCors"]),
    "export const GET = withAuth(async (req) => {})": ("GET", ["withAuth"]),
    "export const GET = handler(req => 1)": None,
    "export const GET = memo(async () => 1)\nexport default a(b(function () {}))": ("default", ["a", "b"]),
    "export default withX(new Handler())": ("default", ["withX"]),
    "export const FOO = withA(withB(h))": None,
    "export const PUT =\n  a (\n b (c)))": ("PUT", ["a", "b"]),
    "": None,
}


@pytest.mark.parametrize("text", CHAINS)
def test_chains_of_wrappers(spark, text):
    found = value(spark, R.middleware_chain, text)
    assert (found and (found.method, found.chain)) == CHAINS[text]


CONFIGS = {
    "export function middleware(req) {}\nexport const config = { matcher: ['/api/:path*', \"/x\"] }": (["/api/:path*", "/x"], "middleware", []),
    "export default chain([withAuth, withI18n])\nexport const config = { matcher: '/dash/(.*)' }": (["/dash/(.*)"], "chain", ["withAuth", "withI18n"]),
    "export default withA(withB(handler))": ([], "withA", ["withA", "withB"]),
    "export default async function guard(req) {}": ([], "guard", ["guard"]),
    "const x = 1": ([], "middleware", []),
}


@pytest.mark.parametrize("text", CONFIGS)
def test_project_middleware(spark, text):
    found = value(spark, R.project_middleware, text)
    want = CONFIGS[text]
    assert (found and (found.matchers, found.name, found.wrapped)) == (want if text != "const x = 1" else None)


def test_routes_behind_middleware(spark):
    routes = spark.createDataFrame([("/api/a", ["withX", "own"]), ("/api", None), ("/other", ["own"]), ("/dash/1", None)], "route string, chain array<string>")
    rows = [("middleware.ts", ["/api/:path*", "/dash/(.*)"], "middleware", ["withX"]), ("src/middleware.ts", ["/other"], "guard", []), ("z.ts", [], "last", ["every"]), ("y.ts", ["/((bad"], "broken", [])]
    made = spark.createDataFrame(rows, "path string, matchers array<string>, name string, wrapped array<string>")
    got = {r.route: r.chain for r in R.guarded(routes, made).collect()}
    assert got == {"/api/a": ["every", "withX", "own"], "/api": ["every", "withX"], "/other": ["every", "guard", "own"], "/dash/1": ["every", "withX"]}


def test_a_route_its_consumers_and_the_mismatch(spark):
    rows = [
        ("app/api/users/route.ts", "export async function GET() {\n  return Response.json({ data: [{ id: 1 }], total: 1 });\n}\n"),
        ("web/users.ts", "export async function loadUsers() {\n  const response = await fetch('/api/users');\n  const data = await response.json();\n  return data.missing;\n}\n"),
        ("web/page.html", "<form action='/api/users.php?x=1'></form>"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    routes = R.route_table(files)
    assert [tuple(r) for r in routes.collect()] == [("/api/users", "app/api/users/route.ts")]
    edges = {(r.src, r.dst): (r.type, r.confidence, r["keys"], r.fetches) for r in R.fetches(files, routes).collect()}
    assert edges == {("File:web/users.ts", "Route:/api/users"): ("FETCHES", 0.9, ["missing"], 1), ("File:web/page.html", "Route:/api/users"): ("FETCHES", 0.9, [], 1)}
    sent = response_shapes(files).join(routes, "path").where("kind = 'success'").select("route", "key")
    taken = spark.createDataFrame([("/api/users", "missing")], "route string, key string")
    assert [(r.missing, r.status) for r in decision.shape_check(sent, taken).collect()] == [("missing", "MISMATCH")]
    tools = spark.createDataFrame([("t", "tools/t.ts")], "name string, path string")
    assert {tuple(r) for r in R.handles(routes, tools).collect()} == {
        ("File:app/api/users/route.ts", "Route:/api/users", "HANDLES_ROUTE", 1.0), ("File:tools/t.ts", "Tool:t", "HANDLES_TOOL", 1.0)
    }


def test_urls_meet_routes(spark):
    routes = spark.createDataFrame([(x,) for x in ("/api/a", "/api/[id]", "/api/docs/[...rest]", "/[lang]/x", "/api/a/b")], "route string")
    urls = ["/api/a", "/api/7", "/api/docs", "/api/docs/1/2", "/de/x", "/[param]/x", "/api/a/b", "/api/zzz/q", "/api/[param]"]
    calls = spark.createDataFrame([(f"f{k}", u) for k, u in enumerate(urls)], "path string, url string")
    got = {r.url: r.route for r in R.match_fetches(calls, routes).collect()}
    assert got == {
        "/api/a": "/api/[id]", "/api/7": "/api/[id]", "/api/docs": "/api/[id]", "/api/docs/1/2": "/api/docs/[...rest]", "/de/x": "/[lang]/x", "/[param]/x": "/[lang]/x",
        "/api/a/b": "/api/a/b", "/api/[param]": "/[lang]/x",
    }


@pytest.mark.parametrize(("raw", "url"), [("/a/${x}/b?q=1", "/a/[param]/b"), ("/a.php", "/a"), ("http://x/a", None), ("/a' + b", None), ("/f(x)", None), ("`/t`", "/t")])
def test_fetched_urls(spark, raw, url):
    assert value(spark, R.fetch_url, raw) == url


def test_keys_taken_from_responses(spark):
    text = "const { items, total: n } = await res.json(); let { error } = result; data?.name; response.json(); body.length; res.extra; other.key; const { q } = await fetch('/x');"
    assert value(spark, R.accessed_keys, text) == ["items", "total", "q", "error", "name", "extra"]
