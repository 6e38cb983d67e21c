"""Ignore rules against git's own list; member chains on literal classes."""

import os
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from terrane.operators.access import accesses
from terrane.sources.ignore import glob_pattern, ignored_paths, never_source, parse_rule, sources

RULES = {
    "": ["# comment", "", "*.log", "!keep.log", "/only-root.txt", "deep/**/x.txt", "**/cache-?/", "doc/*.md", "!doc/README.md", "gone/", "!gone/back.txt", "name", "[ab]1.c", "[!z]2.c", "tail/**", "trail  ", r"\#hash", r"\!bang", "x/y/z", "sub dir/"],
    "pkg": ["!*.log", "/local", "lib/", "*.tmp", "!important.tmp"],
    "pkg/inner": ["*", "!*.py", "!deep/"],
}
NAMES = ["a.log", "keep.log", "only-root.txt", "x.txt", "name", "a1.c", "z2.c", "b2.c", "README.md", "other.md", "back.txt", "f.py", "t.tmp", "important.tmp", "local", "trail", "#hash", "!bang", "z", "plain.go"]
PLACES = ["", "deep", "deep/q", "deep/q/r", "cache-1", "p/cache-x", "cache-12", "doc", "doc/sub", "gone", "p/gone", "name", "p/name", "tail", "tail/in", "pkg", "pkg/lib", "pkg/src/lib", "pkg/inner", "pkg/inner/deep", "pkg/local", "x/y", "p/x/y", "sub dir"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A folder of files with ignore files in three folders, and what git takes of it."""
    root = tmp_path_factory.mktemp("tree")
    draw = random.Random(3)
    paths = {f"{p}/{n}".lstrip("/") for p in PLACES for n in NAMES if draw.random() < 0.75}
    folders = {x.rsplit("/", k)[0] for x in paths for k in range(1, x.count("/") + 1)} | {f for f in RULES if f}
    paths -= folders
    for p in sorted(paths):
        if any(q in paths for q in (p.rsplit("/", k)[0] for k in range(1, p.count("/") + 1))):
            paths.discard(p)
            continue
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text("x")
    for folder, lines in RULES.items():
        os.makedirs(root / folder, exist_ok=True)
        (root / folder / ".gitignore").write_text("\n".join(lines) + "\n")
    env = os.environ | {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}
    git = lambda *a: subprocess.run(["git", *a], cwd=root, env=env, check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    taken = {x for x in git("ls-files", "-z", "--others", "--exclude-standard").split("\0") if x}
    return paths, taken


def test_rules_of_three_folders_are_gits(spark, tree):
    paths, taken = tree
    files = spark.createDataFrame([(p,) for p in sorted(paths)] + [(None,)], "path string")
    rules = spark.createDataFrame([(f or None, k, line) for f, lines in RULES.items() for k, line in enumerate(lines)] + [("", 99, None)], "folder string, seq int, line string")
    gone = {r.path for r in ignored_paths(files.union(files), rules).collect()}
    assert len(paths) > 250 and 60 < len(gone) < len(paths) - 60
    assert paths - gone == {t for t in taken if not t.endswith(".gitignore")}
    assert ignored_paths(files, rules.limit(0)).collect() == [] and ignored_paths(files.limit(0), rules).collect() == []


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("a*b", ["ab", "axxb"], ["a/b"]), ("**/x", ["x", "a/b/x"], ["ax"]), ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("[a-c]?", ["a1", "cz"], ["d1", "a/"]), ("[]x]", ["]", "x"], ["y"]), (r"\*", ["*"], ["a"]), ("a[", ["a["], ["a"]), ("x**y", ["xy", "xzzy"], ["x/y"])],
)
def test_globs(glob, yes, no):
    assert all(re.fullmatch(glob_pattern(glob), x) for x in yes) and not any(re.fullmatch(glob_pattern(glob), x) for x in no)


def test_lines_of_rules():
    assert [parse_rule(x) for x in (None, "", "# c", "/", "!", "name ", "!dir/")] == [None, None, None, None, None, (False, False, "name", ""), (True, True, "dir", "")]
    assert parse_rule("a/b")[2:] == (None, "a/b") and parse_rule("*.c")[3].startswith("(?:.*/)?")


def test_what_is_never_a_source(spark):
    rows = {"src/a.ts": False, "node_modules/a.ts": True, "a/dist/b.js": True, "x.MIN.js": True, "yarn.lock": True, "a\\build\\b.c": True, "types.d.ts": True, "m.generated.go": True, "license": False, "LICENSE": True, "a.tar": True, "noext": False, "distx/a.py": False}
    got = {r.path: r.x for r in spark.createDataFrame([(k,) for k in rows], "path string").select("path", never_source(F.col("path")).alias("x")).collect()}
    assert got == rows


def test_go_commands_stay(spark):
    files = spark.createDataFrame([("cmd/tool/main.go", 1), ("cmd/tool/data.json", 2), ("tool/main.go", 3), ("src/main.go", 4), ("dist/x.go", 5), (None, 6)], "path string, size int")
    rules = spark.createDataFrame([("", 0, "tool"), ("", 1, "*.json")], "folder string, seq int, line string")
    assert sorted((r.path, r["size"]) for r in sources(files, rules).collect()) == [("cmd/tool/main.go", 1), ("src/main.go", 4)]


MEMBERS = [
    ("User", "address", "field", "User.address", "Address", 0), ("User", "getAddress", "method", "User.getAddress()", "Address", 1), ("User", "tag", "field", "User.tag", None, 2),
    ("Address", "city", "field", "Address.city", "City", 0), ("City", "name", "field", "City.name", "string", 0), ("City", "name", "field", "City.name2", "other", 1), ("City", "clone", "method", "City.clone()", None, 2),
]
CHAINS = [
    (1, "f", "User", "field:address field:city field:name", False),
    (2, "g", "User", "call:getAddress field:city", True),
    (3, "h", "User", "call:address call:unwrap field:city", False),
    (4, "i", "User", "field:tag field:city", False),
    (5, "j", "User", "field:nothing field:city", False),
    (6, "k", None, "field:address", False),
    (7, "l", "City", "call:clone field:name", False),
    (8, "f", "User", "field:address", False),
    (9, "m", "User", "field:address field:city", None),
    (10, "n", "User", "", False),
]


def test_chains_of_members(spark):
    rows = [(c, s, t, [tuple(x.split(":")) for x in steps.split()], w) for c, s, t, steps, w in CHAINS]
    chains = spark.createDataFrame(rows, "chain long, src string, start string, steps array<struct<kind:string,name:string>>, writes boolean")
    edges, ends = accesses(chains, spark.createDataFrame(MEMBERS, "owner string, name string, kind string, id string, gives string, seq int"))
    got = sorted((r.src, r.dst, r.reason) for r in edges.collect())
    assert got == sorted([("f", "User.address", "read"), ("f", "Address.city", "read"), ("f", "City.name", "read"), ("g", "Address.city", "write"), ("h", "User.address", "read"), ("h", "Address.city", "read"),
                          ("i", "User.tag", "read"), ("m", "User.address", "read"), ("m", "Address.city", "read")])
    assert {r.chain: r.receiver for r in ends.collect()} == {1: "string", 2: "City", 3: "City", 8: "Address", 9: "City"}
    assert {(r.type, r.confidence) for r in edges.collect()} == {("ACCESSES", 1.0)}
    none, _ = accesses(chains.limit(0), spark.createDataFrame(MEMBERS, "owner string, name string, kind string, id string, gives string, seq int"))
    assert none.collect() == []
