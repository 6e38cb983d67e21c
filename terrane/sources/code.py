"""Scans of source trees, version-control text and tolerant JSON."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_BYTES = 512 * 1024

# File suffixes and names of the languages that are told apart.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin",
    "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala",
    "dart": "dart", "md": "markdown",
}
SPECIAL_NAMES = {"Rakefile": "ruby", "Gemfile": "ruby", "Makefile": "make", "Dockerfile": "docker"}
IGNORED = ("node_modules", ".git", "dist", "build", "target", "vendor", "__pycache__", ".venv", "coverage")


def scan_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path``, ``length`` of all files below ``root`` up to ``max_bytes``; the column scan does not read contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= max_bytes).select("path", "length")


def read_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path``, ``text`` of the files that :func:`scan_files` finds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= max_bytes).select("path", F.decode("content", "UTF-8").alias("text"))


def ignored(path: Column, folders: tuple[str, ...] = IGNORED) -> Column:
    """Whether any folder of the path is an ignored one."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in folders]))


def language(path: Column) -> Column:
    """By special file name, else by suffix; null if neither is known."""
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1)))
    known = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(known(SPECIAL_NAMES), name), F.try_element_at(known(LANGUAGES), suffix))


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines as rows, with ``status`` complete or partial for lines that do not parse."""
    full = f"{schema}, _bad string"
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0].value.lstrip().startswith("[")
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", array).json(path)
    return rows.withColumn("status", F.when(F.col("_bad").isNull(), "complete").otherwise("partial")).drop("_bad")


#: Lines of a text that one task carries a value along.
ALONG = 8192


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` (``seq``: whole numbers) with ``name``: the last ``value`` that is not null, up to and with each line.

    In two levels: the last value of each stretch of lines, carried from stretch to stretch, and then along the lines of each; so
    one long text is the work of many tasks, and only one row a stretch passes through one of them.
    """
    rows = lines.withColumns({"__stretch": F.floor(F.col("seq") / ALONG), "__value": value})
    last = rows.where("__value IS NOT NULL").groupBy("__stretch").agg(F.max_by("__value", "seq").alias("__last"))
    stretches = rows.select("__stretch").distinct().join(last, "__stretch", "left")
    earlier = F.last("__last", ignorenulls=True).over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.select("__stretch", earlier.alias("__before"))
    along = Window.partitionBy("__stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("__here", F.last("__value", ignorenulls=True).over(along)).join(stretches, "__stretch")
    return here.withColumn(name, F.coalesce("__here", "__before")).drop("__stretch", "__value", "__last", "__before", "__here")


def git_log(lines: DataFrame, mark: str = "commit ") -> DataFrame:
    """``commit``, ``file`` from the text of ``git log --name-only`` (``value``, ``seq``), where a commit's line begins with ``mark``."""
    begins = F.col("value").startswith(mark)
    rows = carried(lines, F.when(begins, F.substring("value", len(mark) + 1, 40)), "commit").where(~begins & (F.trim("value") != ""))
    return rows.select("commit", F.trim("value").alias("file")).where("commit is not null").distinct()


def diff_hunks(lines: DataFrame) -> DataFrame:
    """``file``, ``start``, ``end`` of the new side of each hunk of a unified diff (``value``, ``seq``); empty hunks are left out."""
    named = F.regexp_extract("value", r"^\+\+\+ b/(.*)$", 1)
    rows = carried(lines, F.when(named != "", named), "file")
    start = F.regexp_extract("value", r"^@@ -\S+ \+(\d+)", 1)
    size = F.regexp_extract("value", r"^@@ -\S+ \+\d+,(\d+)", 1)
    rows = rows.where(start != "").select("file", start.cast("long").alias("start"), F.when(size == "", 1).otherwise(F.try_to_number(size, F.lit("9999999999"))).cast("long").alias("n"))
    return rows.where("n > 0 and file is not null").select("file", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def added_lines(lines: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` added lines of a diff."""
    keep = F.col("value").startswith("+") & ~F.col("value").startswith("+++")
    return lines.where(keep).orderBy("seq").limit(most).select(F.expr("substring(value, 2)").alias("line"))


def headings(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``level``, ``title`` of Markdown headings outside code fences (``path``, ``text``)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("k", "value"))
    order = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.sum(F.when(F.col("value").rlike("^\\s*```"), 1).otherwise(0)).over(order) % 2
    marks = F.regexp_extract("value", r"^(#{1,6})\s+\S", 1)
    found = lines.withColumn("fenced", fenced).where((F.col("fenced") == 0) & (marks != ""))
    return found.select("path", (F.col("k") + 1).cast("long").alias("line"), F.length(marks).alias("level"), F.regexp_extract("value", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1).alias("title"))


_FACTS = "kind string, id string, label string, name string, path string, start long, finish long, exported boolean, cyclomatic long, depth long, src string, dst string, type string"
_BRANCH = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)
_BLOCK = (ast.If, ast.For, ast.While, ast.Try, ast.With)


def _python_facts(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = [("node", f"File:{path}", "File", path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1, False, None, None, None, None, None)]
    edge = lambda a, b, kind: rows.append(("edge", None, None, None, path, None, None, None, None, None, a, b, kind))

    def deep(n: ast.AST, d: int = 0) -> int:
        below = [deep(c, d + isinstance(n, _BLOCK)) for c in ast.iter_child_nodes(n)]
        return max([d + isinstance(n, _BLOCK), *below])

    def visit(n: ast.AST, owner: str, prefix: str) -> None:
        for child in ast.iter_child_nodes(n):
            at, name = owner, prefix
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                label = "Class" if is_class else "Method" if owner.startswith("Class:") else "Function"
                name = f"{prefix}{child.name}"
                at = f"{label}:{path}:{name}"
                branches = 1 + sum(isinstance(x, _BRANCH) for x in ast.walk(child))
                measures = (None, None) if is_class else (branches, deep(child))
                rows.append(("node", at, label, child.name, path, child.lineno, child.end_lineno, not child.name.startswith("_"), *measures, None, None, None))
                edge(owner, at, "HAS_METHOD" if label == "Method" else "DEFINES")
                for base in child.bases if is_class else ():
                    edge(at, ast.unparse(base), "EXTENDS")
                name += "."
            elif isinstance(child, ast.Call):
                f = child.func
                edge(owner, f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "?", "CALLS")
            elif isinstance(child, ast.Import):
                for x in child.names:
                    edge(owner, x.name, "IMPORTS")
            elif isinstance(child, ast.ImportFrom):
                edge(owner, "." * child.level + (child.module or ""), "IMPORTS")
            visit(child, at, name)

    visit(tree, f"File:{path}", "")
    return rows


def python_facts(files: DataFrame) -> DataFrame:
    """Nodes and unresolved edges of Python sources (``path``, ``text``); ``kind`` tells them apart, files that do not parse give none.

    Calls, bases and imports are edges to names; :func:`terrane.operators.change.resolve` finds the symbols. Other
    languages plug in as functions of the same shape.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _FACTS.split(", ")]
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["text"]) for r in _python_facts(p, t or "")]
            out = pd.DataFrame(rows, columns=names)
            for c in ("start", "finish", "cyclomatic", "depth"):
                out[c] = out[c].astype("Int64")
            yield out

    return files.select("path", "text").mapInPandas(run, _FACTS)
