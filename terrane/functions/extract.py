"""Facts out of source text by regular expressions, a table in and a table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What queries, tool definitions and references to paths look like.
PRISMA = r"\bprisma\.(\w+)\.(findMany|findFirst|findUnique|findUniqueOrThrow|findFirstOrThrow|create|createMany|update|updateMany|delete|deleteMany|upsert|count|aggregate|groupBy)\s*\("
SUPABASE = r"\bsupabase\.from\s*\(\s*['\"](\w+)['\"]\s*\)\s*\.(select|insert|update|delete|upsert)\s*\("
TOOL = r"name:\s*['\"](\w+)['\"]\s*,\s*\n?\s*description:\s*[`'\"]([\s\S]*?)[`'\"]"
REFERENCE = r"(?:^|[\s(\"'`])((?:\./)?(?:src|app|apps|packages|lib|cmd|internal|pkg|crates|test|tests|docs|example|examples)/[A-Za-z0-9_./@%+=:-]+)"


def _lines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def orm_queries(files: DataFrame) -> DataFrame:
    """``path``, ``orm``, ``model``, ``method``, ``line`` (from 0) of every query call in ``files`` (``path``, ``content``). A null content has none.

    The text is taken apart once; what goes on is a number of line breaks for each call, summed along the file.
    """
    out = None
    for orm, pattern in (("prisma", PRISMA), ("supabase", SUPABASE)):
        # Files are numbered before their calls are taken out, so that repeated paths stay apart.
        some = files.where(F.col("content").contains(f"{orm}.")).withColumn("file", F.monotonically_increasing_id())
        group = lambda k: F.regexp_extract_all("content", F.lit(pattern), F.lit(k))  # noqa: E731, B023
        before = F.transform(F.split("content", pattern, -1), _lines)
        within = F.transform(group(0), _lines)
        calls = F.arrays_zip(group(1).alias("model"), group(2).alias("method"), within.alias("within"), F.slice(before, 1, F.size(group(0))).alias("before"))
        found = some.select("path", "file", F.posexplode(calls).alias("k", "m"))
        along = Window.partitionBy("file").orderBy("k")
        line = F.sum("m.before").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("m.within").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = found.select("path", F.lit(orm).alias("orm"), F.col("m.model").alias("model"), F.col("m.method").alias("method"), line.cast("int").alias("line"))
        out = rows if out is None else out.union(rows)
    return out


def tool_definitions(files: DataFrame) -> DataFrame:
    """``name``, ``path``, ``description`` (200 characters at most, on one line) of tools, each name from the first file by path.

    Only scripts whose path tells of tools, not of tests or dependencies, and that hold an input schema, count.
    """
    path = F.col("path")
    script = (path.endswith(".ts") | path.endswith(".js")) & F.lower(path).contains("tool")
    some = files.where(script & ~path.contains("node_modules") & ~path.contains("test") & ~path.contains("__") & F.col("content").contains("inputSchema"))
    group = lambda k: F.regexp_extract_all("content", F.lit(TOOL), F.lit(k))
    found = some.select("path", F.posexplode(F.arrays_zip(group(1).alias("name"), group(2).alias("text"))).alias("k", "m"))
    text = F.btrim(F.replace(F.left("m.text", F.lit(200)), F.lit("\n"), F.lit(" ")), F.lit(" \t\n\r\x0b\x0c"))
    first = found.groupBy(F.col("m.name").alias("name")).agg(F.min(F.struct("path", "k", text.alias("description"))).alias("f"))
    return first.select("name", "f.path", "f.description")


def referenced_paths(content: Column) -> Column:
    """The sorted distinct paths of the source tree that a document names, without './' in front or punctuation behind."""
    found = F.regexp_extract_all(content, F.lit(REFERENCE), F.lit(1))
    clean = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[),.;:'\"`\]}]+$", ""), r"^\./", ""))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: ~x.contains("://"))))


def token_set(text: Column) -> Column:
    """The distinct words of free text, with compound names taken apart; a part that has no word of two letters counts whole."""
    from terrane.functions.names import split_words

    parts = F.filter(F.split(F.regexp_replace(text, r"[:/._-]+", " "), r"\s+"), lambda x: x != "")
    words = F.transform(parts, lambda x: F.when(F.size(split_words(x)) > 0, split_words(x)).otherwise(F.array(F.lower(x))))
    return F.array_distinct(F.flatten(words))
