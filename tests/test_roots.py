"""Workspaces and source roots on literal trees."""

from terrane.operators import roots as R

TREE = [
    "README.md", "AGENTS.md", "package.json", "docs/architecture/overview.md", "docs/guide.txt", "docs/logo.bin", "packages/core/package.json", "pkg/octicons/icons/repo-dark.png", "top.png", "example/reference/README.md", "example/x.bin",
    "external/tooling/.git/HEAD", "external/tooling/README.md", "external/tooling/sub/go.mod", ".own/meta.yaml", ".own/architecture/overall/description.md", "node_modules/a/package.json", "a/b/c/d/e/f/pom.xml", "lib/doc/x.py", ".git/HEAD", None,
]


def files(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_directories_and_candidates(spark):
    directories, candidates, counts = R.workspace_layout(files(spark, TREE + TREE[:3]), store=".own")
    kinds = {(r.path, r.kind, r.depth) for r in directories.collect()}
    assert {(".", "repo-root", 0), ("external/tooling", "nested-repo", 2), ("packages/core", "package", 2), ("pkg/octicons/icons", "asset", 3), (".own", "store", 1), (".own/architecture", "architecture-store", 2)} <= kinds
    assert {p for p, k, _ in kinds if k == "package"} == {".", "packages/core", "external/tooling/sub"} and {p for p, k, _ in kinds if k == "asset"} == {"pkg/octicons/icons"}
    assert {p for p, k, _ in kinds if k == "docs"} == {"docs", "docs/architecture", "lib/doc"} and {p for p, k, _ in kinds if k == "example"} == {"example", "example/reference"}
    told = {r.path: r for r in candidates.collect()}
    assert {p: r.kind for p, r in told.items()} == {
        "README.md": "readme", "AGENTS.md": "agent-instructions", "package.json": "manifest", "docs/architecture/overview.md": "architecture-doc", "docs/guide.txt": "docs", "packages/core/package.json": "manifest",
        "example/reference/README.md": "example", "external/tooling/README.md": "readme", "external/tooling/sub/go.mod": "manifest",
    }
    assert told["external/tooling/sub/go.mod"].boundary == "external/tooling" and told["README.md"].nth == 1 and told["example/reference/README.md"].nth == 9
    row = counts.first()
    assert (row.repo_boundaries, row.packages, row.asset_dirs, row.docs_dirs, row.example_dirs, row.candidates, row.more_candidates, row.deeper_dirs) == (2, 3, 1, 3, 2, 9, 0, 1)


def test_limits_are_told(spark):
    many = TREE + [f"example/reference/case-{i}/README.md" for i in range(20)]
    _, candidates, counts = R.workspace_layout(files(spark, many), max_depth=1, max_candidates=4)
    assert [r.path for r in candidates.orderBy("nth").collect()] == ["README.md", "AGENTS.md", "package.json", "docs/guide.txt"]
    assert (counts.first().candidates, counts.first().more_candidates) == (4, 0) and counts.first().deeper_dirs > 20
    _, candidates, counts = R.workspace_layout(files(spark, many), max_candidates=4)
    assert not any(r.path.startswith("example/") for r in candidates.collect()) and counts.first().more_candidates == 25
    directories, candidates, counts = R.workspace_layout(files(spark, ["x"]).limit(0))
    assert directories.collect() == [] and candidates.collect() == [] and counts.first().directories == 0


def told(spark, paths, given=()):
    found = R.source_roots(files(spark, paths), spark.createDataFrame(list(given), "path string, kind string"))
    return {r.path: (r.role, r.boundary, r.boundary_kind, r.confidence, r.file_count) for r in found.collect()}


def test_usual_roots(spark):
    paths = ["src/a.ts", "src/main/java/A.java", "src/main/kotlin/B.kt", "cmd/x/main.go", "cmd/y/z/main.go", "internal/i.go", "pkg/p.go", "tool/t.py", "docs/d.py", "tests/q.py", "scripts/s.sh", "x.txt", "./src/b.ts", "src\\c.ts", None]
    assert told(spark, paths) == {
        "src": ("repo-core", ".", "repo-root", 0.98, 5), "src/main/java": ("repo-core", ".", "repo-root", 1.0, 1), "src/main/kotlin": ("repo-core", ".", "repo-root", 1.0, 1), "cmd/x": ("app", ".", "repo-root", 1.0, 1),
        "cmd/y": ("app", ".", "repo-root", 1.0, 1), "internal": ("repo-core", ".", "repo-root", 0.98, 1), "pkg": ("repo-core", ".", "repo-root", 0.98, 1), "tool": ("repo-core", ".", "repo-root", 0.86, 1),
    }


def test_files_belong_to_the_nearest_boundary(spark):
    paths = ["packages/a/src/x.ts", "packages/a/b/src/y.ts", "apps/w/lib/z.py", "ext/r/src/q.rs", "libs/none/k.c", "samples/p/src/e.ts"]
    got = told(spark, paths, [("packages/a/b", "package"), ("ext/r", "nested-repo"), ("samples/p", "nested-repo"), ("apps/w", "package"), ("docs", "docs")])
    assert got == {
        "packages/a/src": ("package", "packages/a", "inferred-package", 0.98, 1), "packages/a/b/src": ("package", "packages/a/b", "package", 0.98, 1), "apps/w/lib": ("app", "apps/w", "package", 0.86, 1),
        "ext/r/src": ("unknown", "ext/r", "nested-repo", 0.98, 1), "samples/p/src": ("example", "samples/p", "nested-repo", 0.98, 1),
    }


def test_a_folder_alone(spark):
    assert told(spark, ["only/a.go", "only/b/c.go", "docs/x.js"]) == {"only": ("repo-core", ".", "repo-root", 0.6, 2)}
    assert told(spark, ["only/a.go", "beside.go"]) == {} and told(spark, ["one/a.go", "two/b.go"]) == {}


def test_samples_and_counts(spark):
    found = R.source_roots(files(spark, [f"src/f{i:03}.ts" for i in range(50)] + ["tools/x/y.py", "gen/g.py"]), spark.createDataFrame([("tools/x", "package")], "path string, kind string"))
    rows = {r.path: r for r in found.collect()}
    assert rows["src"].sample_files == [f"src/f{i:03}.ts" for i in range(8)] and rows["src"].file_count == 50 and not rows["gen"].selected
    assert {(r.by, r.value): (r.roots, r.selected) for r in R.boundary_counts(found).collect()} == {("role", "repo-core"): (1, 1), ("role", "generated"): (1, 0), ("boundary_kind", "repo-root"): (2, 1)}
    assert R.source_roots(files(spark, ["src/a.ts"]).limit(0), spark.createDataFrame([], "path string, kind string")).collect() == []
