"""Names, paths, predicates and small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a path looks like that holds tests (two rules, which differ), folders that tell a role,
# and weights of roles.
DENSITY_TESTS = r"\.test\.|\.spec\.|/__tests__/|^test/|^tests/|_test\.|test_.*\."
TEST_PARTS = (".test.", ".spec.")
TEST_FOLDERS = (
    "/__tests__/", "/__mocks__/", "/test/", "/tests/", "/testing/", "/integration-tests/", "/test_", "/uitests/", ".tests/", ".test/",
    ".integrationtests/", ".unittests/", "/testproject/", "/spec/",
)
TEST_ENDINGS = ("_test.py", "_test.go", "tests.swift", "test.swift", "tests.cs", "test.cs", "test.php", "spec.php", "_spec.rb", "_test.rb")
GENERATED, GENERATED_ENDINGS = ("/generated/", "/gen/"), (".pb.go", "_pb2.py")
EXAMPLES = ("/example/", "/examples/", "/demo/", "/demos/", "/sample/", "/samples/", "/playground/")
TOOLS = ("/scripts/", "/script/", "/xtask/", "/hack/", "/tooling/", "/benchmarks/")
PLUGINS = ("/default-plugins/", "/plugins/")
MAIN_FILES = ("/main.py", "/main.go", "/main.rs", "/__main__.py")
ROLE_WEIGHTS = {"prod_core": 1.0, "prod_entrypoint": 0.95, "peripheral": 0.45, "example": 0.18, "dev_tool": 0.14, "generated": 0.08, "test": 0.05}
ACTIONS = (
    "add auth authorize build check commit create delete dispatch execute fetch get handle init list load log persist post prepare process put "
    "query read run save send set start store sync trigger update validate write"
).split()


def node_id(label: Column, name: Column) -> Column:
    return F.concat_ws(":", label, name)


def kebab(name: Column) -> Column:
    """httpClient v2 -> http-client-v2."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.btrim(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", "-")), F.lit("-"))


def sanitize(name: Column, most: int = 20) -> Column:
    """Lower case, other characters as one underscore, cut at ``most``."""
    return F.lower(F.substring(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), 1, most))


def struct_hash(*columns: str) -> Column:
    """8 hex digits of the columns' canonical JSON, in order of their names; all depths count."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 8)


def split_words(name: Column) -> Column:
    """httpClient_v2 -> [http, client, v2]: lower-cased words of two characters or more."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\d])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^\p{L}\d]+", " ")), " "), lambda w: F.char_length(w) > 1)


def resource_words(name: Column) -> Column:
    """The words of a name that are no actions."""
    return F.filter(split_words(name), lambda w: ~w.isin(*ACTIONS))


def is_noisy(name: Column) -> Column:
    """Names of test steps and fixtures."""
    return name.rlike(r"^(should|test|given|when|then)[A-Z_]") | name.isin("setUp", "setup", "tearDown", "teardown")


def _any(text: Column, parts: tuple[str, ...], how: str = "contains") -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | getattr(text, how)(x)
    return out


def _slashes(path: Column) -> tuple[Column, Column]:
    """The path in lower case with '/', and the same between two '/'."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return low, F.concat(F.lit("/"), F.regexp_replace(low, "^/+|/+$", ""), F.lit("/"))


def is_test_file(path: Column) -> Column:
    """The rule by which test density tells test files."""
    return path.rlike(DENSITY_TESTS)


def is_test_path(path: Column) -> Column:
    """The rule of entry points and roles, by folder and ending, which differs in what it takes for a test."""
    low, between = _slashes(path)
    return _any(low, TEST_PARTS) | _any(between, TEST_FOLDERS) | _any(low, TEST_ENDINGS, "endswith")


def scope_hint(module: Column, path: Column) -> Column:
    """The module, or module and folder where the path tells it."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    one, two, three = (F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(3))
    own = (
        F.when(two.isin("src", "app", "lib") & (three != ""), F.concat(one, F.lit("/"), three))
        .when(two != "", F.concat(one, F.lit("/"), two))
        .otherwise(module)
    )
    source = one.isin("src", "app", "lib", "pkg", "internal", "cmd") & (two != "")
    return F.when(F.coalesce(path, F.lit("")) == "", module).when(one == module, own).when(source, F.concat(one, F.lit("/"), two)).otherwise(module)


def fixed(value: Column, digits: int) -> Column:
    """A number of zero or more rounded by its binary value, not by its shortest decimal form, as :func:`round` of Spark does."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def infer_role(path: Column, module: Column, entry: Column, external_refs: Column, process_refs: Column, contract_refs: Column) -> Column:
    """Struct of ``role`` and ``confidence``: by the path first, then by how much of the system refers to a function.

    ``entry``: the entry point score. A function that nothing tells is peripheral.
    """
    low, between = _slashes(path)
    share = lambda x, most, weight: F.least(F.lit(1.0), x / most) * weight
    score = share(external_refs, 6, 0.35) + share(process_refs, 4, 0.35) + share(contract_refs, 3, 0.2) + share(entry, 4, 0.1)
    hint = scope_hint(module, path)
    entrance = (entry > 1.3) | _any(hint, ("/server", "/client", "/cli")) | _any(low, MAIN_FILES, "endswith")
    told = lambda role_, confidence: F.struct(F.lit(role_).alias("role"), fixed(confidence, 3).alias("confidence"))
    return (
        F.when(is_test_path(path), told("test", F.lit(0.98)))
        .when(_any(between, GENERATED) | _any(low, GENERATED_ENDINGS, "endswith"), told("generated", F.lit(0.95)))
        .when(_any(between, EXAMPLES), told("example", F.lit(0.92)))
        .when(_any(between, TOOLS), told("dev_tool", F.lit(0.9)))
        .when(_any(between, PLUGINS), told("peripheral", F.lit(0.85)))
        .when(entrance & ((score >= 0.25) | (entry >= 1.5)), told("prod_entrypoint", 0.65 + score * 0.3))
        .when(score >= 0.28, told("prod_core", 0.55 + score * 0.35))
        .otherwise(told("peripheral", 0.45 + score * 0.2))
    )


def role_weight(role_: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv]), role_)


def starts_with_path(path: Column, prefix: Column) -> Column:
    """Whether ``prefix`` is the path or a folder above it; './' in front and '/' behind do not matter."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\./", ""), "/+$", "")
    return (clean(path) == clean(prefix)) | F.startswith(clean(path), F.concat(clean(prefix), F.lit("/")))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4)


def fetch_url(url: Column) -> Column:
    """A fetch call's URL as a route: no origin, query or fragment, template parts as parameters, no '/' behind."""
    path = F.regexp_replace(F.regexp_replace(url, r"^(https?:)?//[^/]+", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(path, r"\$\{[^}]*\}", ":param"), r"(.)/+$", "$1")


def page_route(path: Column) -> Column:
    """The route of a file below pages/ or app/: [x] as :x, [...x] as *, index and page files as their folder."""
    tail = F.regexp_extract(path, r"(?:^|/)(?:pages|app)/(.*)\.(?:tsx|ts|jsx|js)$", 1)
    tail = F.regexp_replace(F.regexp_replace(tail, r"(^|/)(index|page|route)$", ""), r"\([^)]*\)/", "")
    out = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(tail, r"\[\[?\.\.\.[^\]]*\]?\]", "*"), r"\[([^\]]+)\]", ":$1"))
    return F.when(path.rlike(r"(?:^|/)(?:pages|app)/.*\.(?:tsx|ts|jsx|js)$"), out)


def reason_keys(reason: Column) -> Column:
    """The sorted keys of a reason '...|keys:a,b'."""
    found = F.regexp_extract(F.coalesce(reason, F.lit("")), r"\|keys:([^|]*)", 1)
    return F.array_sort(F.filter(F.split(found, ","), lambda x: x != ""))


def accessed_keys(code: Column) -> Column:
    """Property names read off data, result, response, res or json, sorted; methods of promises and arrays are none."""
    found = F.regexp_extract_all(code, F.lit(r"\b(?:data|result|response|res|json)\??\.([A-Za-z_]\w*)"))
    not_keys = F.array(*[F.lit(x) for x in ("then", "catch", "json", "text", "ok", "status", "map", "filter", "forEach", "length")])
    return F.array_sort(F.array_except(found, not_keys))


def json_strings(doc: Column) -> Column:
    """Every string value of a JSON text, in order; keys are none."""
    found = F.regexp_extract_all(doc, F.lit(r'"((?:[^"\\]|\\.)*)"\s*(?=[,\]}])'))
    return F.filter(found, lambda x: x != "")


def impacted_ref(label: Column, name: Column, path: Column, route: Column, method: Column) -> Column:
    """How a report names a node that a change reaches: a path, path#name, or kind:name. ``route`` and ``method`` are a route's, or null."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/+$", ""), r"^\./", "")
    named, kind = F.btrim(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(label, F.lit("")))
    to = F.coalesce(route, named)
    told = F.when(to == "", "route").otherwise(F.concat(F.lit("route:"), F.when(F.coalesce(method, F.lit("")) != "", F.concat(method, F.lit(" "))).otherwise(""), to))
    tagged = lambda tag: F.when(named == "", tag).otherwise(F.concat(F.lit(f"{tag}:"), named))
    return (
        F.when((label == "File") & (clean != ""), clean)
        .when((label == "Folder") & (clean != ""), F.concat(clean, F.lit("/")))
        .when(label == "Route", told)
        .when(label == "Tool", tagged("tool"))
        .when(label == "Process", tagged("process"))
        .when((clean != "") & (named != ""), F.concat(clean, F.lit("#"), named))
        .when(clean != "", clean)
        .when(named != "", F.when(kind == "", named).otherwise(F.concat(kind, F.lit(":"), named)))
        .otherwise(F.when(kind == "", "unknown-target").otherwise(kind))
    )


# Folders of a source root that tell its role.
ROOT_SEGMENTS = (
    ("generated", ("generated", ".generated", "gen", "__generated__")), ("example", ("example", "examples", "samples")),
    ("test", ("test", "tests", "__tests__")), ("tooling", ("scripts", "tools", "tooling", "hack", "hacks", "bin")),
)


def root_role(path: Column, boundary: Column, boundary_path: Column) -> Column:
    """Role of a source root: by its folders, then by where it begins, then by the kind of boundary that it lies in."""
    parts = F.split(path, "/")
    first = parts[0]
    out = F.lit(None).cast("string")
    for role_, names_ in reversed(ROOT_SEGMENTS):
        out = F.when(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in names_])), role_).otherwise(out)
    deep = F.size(parts) > 1
    begins = (
        F.when(deep & first.isin("apps", "cmd"), "app")
        .when(deep & first.isin("packages", "libs", "crates"), "package")
        .when(first.isin("src", "internal", "pkg"), "repo-core")
        .when(boundary == "nested-repo", "unknown")
        .when(boundary.isin("package", "inferred-package"), F.when(boundary_path.startswith("apps/"), "app").otherwise("package"))
        .otherwise("repo-core")
    )
    return F.coalesce(out, begins)
