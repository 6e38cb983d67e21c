"""Routes of source files: who handles them, through which wrappers, and who fetches them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Names that end a chain of wrappers, wrappers that only compose, and members of responses that are no keys.
STOPS = "async await function new return if for while switch class const let var req res request response event ctx context next".split()
COMPOSERS = "middleware default chain compose".split()
METHODS = "POST|GET|PUT|DELETE|PATCH|HEAD|OPTIONS"
NO_KEYS = (
    "json text blob arrayBuffer formData ok status headers clone then catch finally map filter forEach reduce find some every push pop shift unshift splice slice "
    "concat join sort reverse includes indexOf length toString valueOf keys values entries appendChild removeChild insertBefore replaceChild replaceChildren "
    "createElement getElementById querySelector querySelectorAll setAttribute getAttribute removeAttribute hasAttribute addEventListener removeEventListener "
    "dispatchEvent classList className parentNode parentElement childNodes children nextSibling previousSibling firstChild lastChild click focus blur submit reset "
    "innerHTML outerHTML textContent innerText"
).split()
_CALLS = r"((?:\s*\w+\s*\()++)"
_WRAPPED = rf"export\s+(?:const\s+({METHODS})\s*=|default\b)\s*" + _CALLS


def route_of(path: Column) -> Column:
    """The URL of a handler by its file's path (``app/api/**/route.*``, groups in parentheses left out, or ``pages/api/**``), else null."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    app = F.regexp_replace(F.regexp_extract(p, r"app/(.+?)/route\.(?:ts|js|tsx|jsx)$", 1), r"\([^)]+\)/?", "")
    page = F.regexp_extract(p, r"pages/(api/.+?)\.(?:ts|js|tsx|jsx)$", 1)
    is_app = p.rlike(r"app/.+?/route\.(?:ts|js|tsx|jsx)$")
    return F.when(is_app, F.when(app.startswith("api/") | (app == "api"), F.concat(F.lit("/"), app))).when(page != "", F.concat(F.lit("/"), F.regexp_replace(page, "/index$", "")))


def route_table(files: DataFrame) -> DataFrame:
    """``route``, ``path`` of the first file (by path) of each URL; ``files``: ``path``."""
    found = files.select("path", route_of(F.col("path")).alias("route")).where("route IS NOT NULL")
    return found.groupBy("route").agg(F.min("path").alias("path"))


def handles(routes: DataFrame, tools: DataFrame) -> DataFrame:
    """HANDLES_ROUTE and HANDLES_TOOL edges (``src``, ``dst``, ``type``, ``confidence``) of ``routes`` (``route``, ``path``) and ``tools`` (``name``, ``path``)."""
    edge = lambda df, label, name: df.select(
        F.concat(F.lit("File:"), "path").alias("src"), F.concat(F.lit(f"{label}:"), name).alias("dst"), F.lit(f"HANDLES_{label.upper()}").alias("type"), F.lit(1.0).alias("confidence")
    )
    return edge(routes, "Route", "route").union(edge(tools, "Tool", "name")).distinct()


def _names(calls: Column) -> Column:
    """``a(b(c(`` -> [a, b, c], up to a name that is no wrapper."""
    every = F.transform(F.filter(F.split(calls, r"\("), lambda x: F.btrim(x) != ""), lambda x: F.regexp_replace(x, r"\s+", ""))
    ends = F.array_position(F.transform(every, lambda x: x.isin(*STOPS)), True)
    return F.when(ends > 0, F.slice(every, 1, (ends - 1).cast("int"))).otherwise(every)


def middleware_chain(content: Column) -> Column:
    """Struct of ``method`` and ``chain`` (wrappers, the outermost first) of the first exported handler that is wrapped; null if none is.

    One wrapper alone counts if its name tells so (``withAuth``); a first name that is a keyword counts as any other first name.
    """
    pick = lambda k: F.regexp_extract_all(content, F.lit(_WRAPPED), F.lit(k))
    head = lambda calls: F.regexp_extract(calls, r"^\s*(\w+)", 1)
    rest = lambda calls: F.regexp_replace(calls, r"^\s*\w+\s*\(", "")
    found = F.transform(
        F.arrays_zip(pick(1).alias("method"), pick(2).alias("calls")),
        lambda x: F.struct(F.when(x["method"] == "", "default").otherwise(x["method"]).alias("method"), F.concat(F.array(head(x["calls"])), _names(rest(x["calls"]))).alias("chain")),
    )
    good = F.filter(found, lambda x: (F.size(x["chain"]) >= 2) | F.get(x["chain"], F.lit(0)).rlike("^with[A-Z]"))
    return F.get(good, F.lit(0))


def project_middleware(content: Column) -> Column:
    """Struct of ``matchers``, ``name`` and ``wrapped`` of a project's middleware file; null if it exports nothing of the kind."""
    one = lambda p, k=1: F.regexp_extract(content, p, k)
    within = one(r"(?s)config\s*=\s*\{[^}]*matcher\s*:\s*\[([^\]]*)\]")
    many = content.rlike(r"(?s)config\s*=\s*\{[^}]*matcher\s*:\s*\[([^\]]*)\]")
    single = one(r"(?s)config\s*=\s*\{[^}]*matcher\s*:\s*(['\"`])([^'\"`]+)\1", 2)
    matchers = F.when(many, F.regexp_extract_all(within, F.lit(r"(['\"`])((?:[^'\"`\\]|\\.)*)\1"), F.lit(2))).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))
    named = content.rlike(r"export\s+(?:async\s+)?function\s+middleware\b") | content.rlike(r"export\s+const\s+middleware\s*=")
    function = content.rlike(r"export\s+default\s+(?:async\s+)?function")
    function_name = one(r"export\s+default\s+(?:async\s+)?function(?:\s+(\w+))?")
    default = one(r"export\s+default\s+(?!function\b)(\w+)")
    name = F.when(named, "middleware").when(function, F.when(function_name != "", function_name).otherwise("middleware")).when(default != "", default).otherwise("middleware")
    listed = F.filter(F.transform(F.split(one(r"(?:chain|compose)\s*\(\s*\[([^\]]+)\]"), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    calls = one(r"export\s+default\s*" + _CALLS)
    first = F.regexp_extract(calls, r"^\s*(\w+)", 1)
    nested = F.concat(F.array(first), _names(F.regexp_replace(calls, r"^\s*\w+\s*\(", "")))
    wrapped = F.when(F.size(listed) > 0, listed).when((first != "") & ~first.isin("function", "async"), nested).otherwise(F.array().cast("array<string>"))
    whole = F.when(name.isin(*COMPOSERS) | F.array_contains(wrapped, name), wrapped).otherwise(F.concat(F.array(name), wrapped))
    some = named | function | (default != "") | (F.size(matchers) > 0) | (F.size(whole) > 0)
    return F.when(some, F.struct(matchers.alias("matchers"), name.alias("name"), whole.alias("wrapped")))


def _fits(pattern: str | None, route: str) -> bool:
    """Whether a matcher's pattern is that of the whole route; none fits all, and one that cannot be read fits nothing."""
    try:
        return pattern is None or re.fullmatch(pattern, route) is not None
    except re.error:
        return False


def guarded(routes: DataFrame, middleware: DataFrame) -> DataFrame:
    """``route``, ``chain``: a route's own wrappers (``routes``: ``route``, ``chain``) behind those of the project's middleware that match it.

    ``middleware``: ``path``, ``matchers``, ``name``, ``wrapped``; a matcher is a prefix (``/a/:path*``), a pattern (with parentheses) or a URL; none matches all.
    A project has a handful of middleware files, so their matchers are expanded into an equi-join for URLs and prefixes; only patterns and files
    without matchers meet all routes, in a broadcast of that handful. Later files stand before earlier ones, by path.
    """
    told = middleware.select("path", F.when(F.size("wrapped") > 0, F.col("wrapped")).otherwise(F.array("name")).alias("wrapped"), F.explode_outer("matchers").alias("m"))
    told = told.withColumn("prefix", F.when(F.col("m").rlike("/:path\\*$"), F.regexp_replace("m", "/:path\\*$", "")))
    told = told.withColumn("kind", F.when(F.col("m").isNull(), "all").when(F.col("prefix").isNotNull(), "prefix").when(F.col("m").contains("("), "pattern").otherwise("exact"))
    parts = F.split("route", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    r = routes.select("route")
    by_prefix = r.select("route", F.explode(above).alias("prefix")).join(told.where("kind = 'prefix'"), "prefix").select("route", "path", "wrapped")
    exact = r.join(told.where("kind = 'exact'").select(F.col("m").alias("route"), "path", "wrapped"), "route")
    loose = told.where("kind IN ('all', 'pattern')").select("path", "wrapped", "kind", "m").distinct()
    fits = F.udf(_fits, "boolean")
    rest = r.join(F.broadcast(loose)).where(fits("m", "route")).select("route", "path", "wrapped")
    met = by_prefix.union(exact).union(rest).distinct().groupBy("route").agg(F.sort_array(F.collect_list(F.struct("path", "wrapped")), False).alias("w"))
    none = F.array().cast("array<string>")
    both = routes.join(met, "route", "left").select("route", F.coalesce("chain", none).alias("own"), F.coalesce(F.flatten("w.wrapped"), none).alias("outer"))
    return both.select("route", F.concat(F.array_distinct("outer"), F.filter("own", lambda x: ~F.array_contains("outer", x))).alias("chain"))


def fetch_url(raw: Column) -> Column:
    """A fetched URL as a route: without query and endings of scripts, expressions as ``[param]``; null if it is no absolute path or is put together."""
    url = F.regexp_replace(F.regexp_replace(F.split(raw, r"\?")[0], r"\$\{[^}]+\}", "[param]"), "^`|`$", "")
    url = F.regexp_replace(url, r"\.(php|asp|aspx|jsp|cgi)$", "")
    return F.when(url.startswith("/") & ~url.contains("+") & ~url.contains("("), url)


def fetched(files: DataFrame) -> DataFrame:
    """``path``, ``url`` of every call of fetch, axios or got in scripts, and of form actions and ``url:`` in pages (``files``: ``path``, ``content``)."""
    all_ = lambda p, k: F.regexp_extract_all("content", F.lit(p), F.lit(k))
    page = F.lower("path").rlike(r"\.(html|htm|ejs|hbs|blade\.php)$")
    calls = all_(r"\b(?:fetch|axios|got)(?:\.(?:get|post|put|delete|patch|head))?\s*\(\s*(['\"`])([^'\"`]+)\1", 2)
    forms = F.concat(all_("action=[\"']([^\"']+)[\"']", 1), all_("url:\\s*[\"']([^\"']+)[\"']", 1))
    raw = F.explode(F.when(page, forms).otherwise(calls))
    return files.select("path", raw.alias("raw")).select("path", fetch_url(F.col("raw")).alias("url")).where("url IS NOT NULL")


def accessed_keys(content: Column) -> Column:
    """The distinct keys that a file takes from responses: destructured from ``.json()``, fetch or a variable named for it, or members of such a variable."""
    body = lambda p: F.flatten(F.transform(F.regexp_extract_all(content, F.lit(p), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"(\w+)\s*(?::\s*\w+)?"), F.lit(1))))
    called = body(r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:await\s+)?(?:\w+\.json\s*\(\)|(?:await\s+)?(?:fetch|axios|got)\s*\([^)]*\)(?:\.then\s*\([^)]*\))?(?:\.json\s*\(\))?)")
    held = body(r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:data|result|response|json|body|res)\b")
    members = F.regexp_extract_all(content, F.lit(r"\b(?:data|response|result|json|body|res)\s*(?:\?\.|\.)(\w+)"), F.lit(1))
    return F.array_distinct(F.concat(called, held, F.filter(members, lambda x: ~x.isin(*NO_KEYS))))


def match_fetches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``path``, ``url``, ``route``: the first route (by name) that each call's URL fits.

    A segment in brackets, on either side, fits any one; a last ``[...x]`` fits any number. Calls and routes of one
    length meet by their first segment, so a route that every file calls is a key of its own.
    """
    split = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    any_ = lambda x: x.startswith("[")
    fits = F.forall(F.zip_with(F.col("r"), F.slice("u", 1, F.size("r")), lambda r, u: (r == u) | any_(r) | any_(u)), lambda ok: F.coalesce(ok, F.lit(False)))
    head = lambda c: F.when(F.coalesce(any_(F.get(c, F.lit(0))), F.lit(False)), "*").otherwise(F.coalesce(F.get(c, F.lit(0)), F.lit("")))
    u = calls.select("path", "url").distinct().withColumn("u", split("url")).withColumn("n", F.size("u"))
    u = u.withColumn("head", F.explode(F.when(head(F.col("u")) == "*", F.array(F.lit("*any"))).otherwise(F.array(head(F.col("u")), F.lit("*")))))
    r = routes.select("route").distinct().withColumn("r", split("route"))
    open_ = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), "r"), -1).rlike(r"^\[\[?\.\.\."), F.lit(False))
    r = r.withColumn("open", open_).withColumn("r", F.when(F.col("open"), F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0)))).otherwise(F.col("r"))).withColumn("m", F.size("r"))
    r = r.withColumn("head", F.explode(F.array(F.when(F.col("m") == 0, F.when(F.col("open"), "*").otherwise("")).otherwise(head(F.col("r"))), F.lit("*any"))))
    fixed = u.join(r.where("not open"), (u["head"] == r["head"]) & (u["n"] == r["m"])).where(fits)
    caught = u.join(r.where("open"), "head").where((F.col("n") >= F.col("m")) & ((F.col("m") == 0) | fits))
    both = fixed.select("path", "url", "route").union(caught.select("path", "url", "route"))
    return both.groupBy("path", "url").agg(F.min("route").alias("route"))


def fetches(files: DataFrame, routes: DataFrame) -> DataFrame:
    """FETCHES edges: ``src``, ``dst``, ``type``, ``confidence``, ``keys`` (those that the file takes from responses), ``fetches`` (its calls that meet a route)."""
    calls = fetched(files)
    met = match_fetches(calls, routes)
    counted = calls.join(met, ["path", "url"])
    n = counted.groupBy("path").agg(F.count("*").alias("fetches"))
    keys = files.select("path", accessed_keys(F.col("content")).alias("keys"))
    out = counted.select("path", "route").distinct().join(n, "path").join(keys, "path", "left")
    return out.select(
        F.concat(F.lit("File:"), "path").alias("src"), F.concat(F.lit("Route:"), "route").alias("dst"), F.lit("FETCHES").alias("type"), F.lit(0.9).alias("confidence"), "keys", "fetches"
    )
