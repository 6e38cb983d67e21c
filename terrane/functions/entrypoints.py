"""How likely a function is an entry point, by its name, its language and where its file lies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of entry points in any language, in one language, and of helpers.
ANY_LANGUAGE = (
    "(?i)^(main|init|bootstrap|start|run|setup|configure)$", "^handle[A-Z]", "^on[A-Z]", "Handler$", "Controller$", "^process[A-Z]",
    "^execute[A-Z]", "^perform[A-Z]", "^dispatch[A-Z]", "^trigger[A-Z]", "^fire[A-Z]", "^emit[A-Z]",
)
BY_LANGUAGE = {
    "javascript": ("^use[A-Z]",),
    "typescript": ("^use[A-Z]",),
    "python": ("^app$", "(?i)^(get|post|put|delete|patch)_", "^api_", "^view_"),
    "java": ("^do[A-Z]", "^create[A-Z]", "^build[A-Z]", "Service$"),
    "kotlin": ("^on(Create|Start|Resume|Pause|Stop|Destroy)$", "^do[A-Z]", "^create[A-Z]", "^build[A-Z]", "ViewModel$", "^module$", "Service$"),
    "csharp": (
        "^(Get|Post|Put|Delete|Patch)", "Action$", "^On[A-Z]", "Async$", "^Configure$", "^ConfigureServices$", "^Handle$", "^Execute$", "^Invoke$", "^Map[A-Z]",
        "Service$", "^Seed",
    ),
    "go": ("Handler$", "^Serve", "^New[A-Z]", "^Make[A-Z]"),
    "rust": ("(?i)^(get|post|put|delete)_handler$", "^handle_", "^new$", "^run$", "^spawn"),
    "c": (
        "^main$", "^init_", "_init$", "^start_", "_start$", "^run_", "_run$", "^stop_", "_stop$", "^open_", "_open$", "^close_", "_close$", "^create_", "_create$",
        "^destroy_", "_destroy$", "^handle_", "_handler$", "_callback$", "^cmd_", "^server_", "^client_", "^session_", "^window_", "^key_", "^input_", "^output_",
        "^notify_", "^control_",
    ),
    "cpp": (
        "^main$", "^init_", "_init$", "^Create[A-Z]", "^create_", "^Run$", "^run$", "^Start$", "^start$", "^handle_", "_handler$", "_callback$", "^OnEvent", "^on_",
        "::Run$", "::Start$", "::Init$", "::Execute$",
    ),
    "swift": (
        "^viewDidLoad$", "^viewWillAppear$", "^viewDidAppear$", "^viewWillDisappear$", "^viewDidDisappear$", r"^application\(", r"^scene\(", "^body$", "Coordinator$",
        "^sceneDidBecomeActive$", "^sceneWillResignActive$", "^didFinishLaunchingWithOptions$", "ViewController$", "^configure[A-Z]", "^setup[A-Z]", "^makeBody$",
    ),
    "php": (
        "Controller$", "^handle$", "^execute$", "^boot$", "^register$", "^__invoke$", "^(index|show|store|update|destroy|create|edit)$",
        "^(get|post|put|delete|patch)[A-Z]", "^run$", "^fire$", "^dispatch$", "Service$", "Repository$", "^find$", "^findAll$", "^save$", "^delete$",
    ),
    "ruby": ("^call$", "^perform$", "^execute$"),
    "dart": (
        "^main$", "^build$", "^createState$", "^initState$", "^dispose$", "^didChangeDependencies$", "^didUpdateWidget$", "^runApp$", "^onEvent$", "^mapEventToState$",
    ),
}
HELPERS = (
    "^(get|set|is|has|can|should|will|did)[A-Z]", "^_", "(?i)^(format|parse|validate|convert|transform)", "(?i)^(log|debug|error|warn|info)$", "^(to|from)[A-Z]",
    "(?i)^(encode|decode)", "(?i)^(serialize|deserialize)", "(?i)^(clone|copy|deep)", "(?i)^(merge|extend|assign)", "(?i)^(filter|map|reduce|sort|find)", "Helper$",
    "Util$", "Utils$", "(?i)^utils?$", "(?i)^helpers?$",
)
# What a path holds (any of), how it ends (any of) and what its functions' scores are multiplied by; the first that fits counts.
SCRIPTS = (".tsx", ".ts", ".jsx", ".js")
PATHS: tuple[tuple[tuple[str, ...], tuple[str, ...], float], ...] = (
    (("/app/",), ("page.tsx", "page.ts", "page.jsx", "page.js"), 3.0),
    (("/pages/api/",), (), 3.0),
    (("/prisma/",), ("schema.prisma",), 1.5),
    (("/lib/supabase", "/utils/supabase", "/supabase/"), (".ts", ".js"), 1.5),
    (("/routes/",), (".ts", ".js"), 2.5),
    (("/controllers/",), (".ts", ".js"), 2.5),
    (("/handlers/",), (".ts", ".js"), 2.5),
    ((), ("views.py",), 3.0),
    ((), ("urls.py",), 2.0),
    (("/routers/", "/endpoints/", "/routes/"), (".py",), 2.5),
    (("/controller/", "/controllers/"), (".java",), 3.0),
    ((), ("controller.java",), 3.0),
    (("/service/", "/services/"), (".java",), 1.8),
    (("/controller/", "/controllers/"), (".kt",), 3.0),
    ((), ("controller.kt",), 3.0),
    (("/routes/",), (".kt",), 2.5),
    (("/plugins/",), (".kt",), 2.0),
    ((), ("routing.kt", "routes.kt"), 2.5),
    (("/activity/", "/ui/"), (".kt",), 2.5),
    ((), ("activity.kt", "fragment.kt"), 2.5),
    ((), ("/main.kt",), 3.0),
    ((), ("/application.kt",), 2.5),
    (("/controllers/",), (".cs",), 3.0),
    ((), ("controller.cs",), 3.0),
    (("/services/", "/service/"), (".cs",), 1.8),
    (("/middleware/", "/hubs/"), (".cs",), 2.5),
    ((), ("hub.cs",), 2.5),
    ((), ("/program.cs", "/startup.cs"), 3.0),
    (("/backgroundservices/", "/hostedservices/"), (".cs",), 2.0),
    (("/pages/",), (".razor",), 2.5),
    (("/handlers/", "/handler/", "/routes/", "/controllers/"), (".go",), 2.5),
    ((), ("/main.go",), 3.0),
    (("/handlers/", "/routes/"), (".rs",), 2.5),
    ((), ("/main.rs",), 3.0),
    (("/bin/",), (".rs",), 2.5),
    ((), ("/main.c", "/main.cpp", "/main.cc"), 3.0),
    (("/src/",), ("/app.c", "/app.cpp"), 2.5),
    (("/routes/", "/http/controllers/", "/controllers/"), (".php",), 3.0),
    ((), ("controller.php",), 3.0),
    (("/console/commands/", "/commands/", "/jobs/", "/listeners/", "/http/middleware/"), (".php",), 2.5),
    (("/providers/",), (".php",), 1.8),
    (("/policies/",), (".php",), 2.0),
    (("/models/",), (".php",), 1.5),
    (("/services/",), (".php",), 1.8),
    (("/repositories/",), (".php",), 1.5),
    (("/bin/", "/exe/"), (".rb",), 2.5),
    ((), ("/rakefile", ".rake"), 1.5),
)


def _any(path: Column, parts: tuple[str, ...], how: str) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | getattr(path, how)(x)
    return out


def _within(path: Column, *parts: str) -> Column:
    return _any(path, parts, "contains")


def path_multiplier(path: Column) -> Column:
    """What a file's place says of its functions as entry points; 1 if nothing, also for a null path."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    low = F.when(F.startswith(low, F.lit("/")), low).otherwise(F.concat(F.lit("/"), low))
    name = F.element_at(F.split(low, "/"), -1)
    script = _any(low, SCRIPTS, "endswith")
    app = _within(low, "/app/")
    table = [((_within(low, *some) if some else F.lit(True)) & (_any(low, ends, "endswith") if ends else F.lit(True)), factor) for some, ends, factor in PATHS]
    rules = [
        (_within(low, "/pages/") & ~_within(low, "/_", "/api/") & script, 3.0),
        table[0],
        (table[1][0] | (app & _within(low, "/api/") & low.endswith("route.ts")), 3.0),
        (app & ~_within(low, "_layout") & _any(low, ("layout.tsx", "layout.ts"), "endswith"), 2.0),
        (app & script & name.startswith("_layout"), 2.0),
        (app & script & name.startswith("+") & ~name.startswith("+api"), 1.5),
        (app & script & _any(name, ("+api.ts", "+api.tsx"), "endswith"), 3.0),
        (app & script, 2.5),
        *table[2:10],
        (_within(low, "/api/") & low.endswith(".py") & ~low.endswith("__init__.py"), 2.0),
        *table[10:],
    ]
    out = F.lit(1.0)
    for rule, factor in reversed(rules):
        out = F.when(rule, factor).otherwise(out)
    return out


def name_multiplier(name: Column, language: Column) -> Column:
    """.3 for names of helpers, 1.5 for names of entry points in any language or in this one, else 1."""
    named = name.rlike("|".join(ANY_LANGUAGE[1:])) | name.rlike(ANY_LANGUAGE[0])
    for which, patterns in BY_LANGUAGE.items():
        found = F.lit(False)
        for p in (x for x in patterns if x.startswith("(?i)")):
            found = found | name.rlike(p)
        plain = "|".join(x for x in patterns if not x.startswith("(?i)"))
        named = named | ((language == which) & (found | name.rlike(plain)))
    helper = F.lit(False)
    for p in HELPERS:
        helper = helper | name.rlike(p)
    return F.when(helper, 0.3).when(named, 1.5).otherwise(1.0)


def entry_score(name: Column, exported: Column, callers: Column, callees: Column, path: Column, language: Column | None = None, framework: Column | None = None) -> Column:
    """callees / (callers + 1), doubled if exported, times what name, place and the framework's own marks (``framework``) say.

    Null names, paths, languages and marks say nothing.
    """
    named = F.coalesce(name_multiplier(F.coalesce(name, F.lit("")), F.coalesce(language, F.lit("")) if language is not None else F.lit("")), F.lit(1.0))
    marks = F.greatest(F.coalesce(framework, F.lit(1.0)), F.lit(1.0)) if framework is not None else F.lit(1.0)
    return callees / (callers + 1) * F.when(exported, 2.0).otherwise(1.0) * named * F.coalesce(path_multiplier(path), F.lit(1.0)) * marks
