"""Search over whole documents of any schema and kind: their strings as text, one postings table for all kinds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrane.functions.scratch import materialize
from terrane.operators.search import B, K1, tokenize


def strings_of(value: Column, kind: T.DataType) -> Column:
    """All strings of a value of any nested type, in the order of its fields; keys of maps, numbers and nulls are none."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(value.isNull(), none).otherwise(F.array(value))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: strings_of(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return strings_of(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        parts = [strings_of(value.getField(f.name), f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else none
    return none


def whole_documents(kinds: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``kind``, ``id``, ``text`` of the rows of several tables, each given with its id column: all strings of a row, the id included."""
    out = None
    for kind, (df, id_col) in kinds.items():
        text = F.array_join(F.concat(*[strings_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]), " ")
        rows = df.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), text.alias("text"))
        out = rows if out is None else out.union(rows)
    return out


def postings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` (``kind``, ``id``, ``text``): ``term``, ``kind``, ``id``, ``tf``, ``len`` in order of terms, and one row of ``n`` and ``average`` length.

    A document's terms are counted within its row, so nothing is shuffled but the finished postings, which are ranged by term and document: a query
    reads the files of its terms only, and a term of most documents is many files. Empty documents count for ``n``.
    """
    words = materialize(docs.select("kind", "id", tokenize(F.col("text")).alias("w")), "words")
    size = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("average"))
    # Runs of equal words in the sorted array, as places where a run begins.
    row = words.where(F.size("w") > 0).select("kind", "id", F.size("w").alias("len"), F.array_sort("w").alias("w"))
    begins = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", F.greatest(i - 1, F.lit(0)))))
    runs = row.select("kind", "id", "len", "w", begins.alias("b"))
    each = F.transform(
        F.sequence(F.lit(0), F.size("b") - 1),
        lambda k: F.struct(F.get("w", F.get("b", k)).alias("term"), (F.coalesce(F.get("b", k + 1), F.col("len")) - F.get("b", k)).alias("tf")),
    )
    found = runs.select("kind", "id", "len", F.inline(each))
    return materialize(found.repartitionByRange("term", "kind", "id").sortWithinPartitions("term", "kind", "id").select("term", "kind", "id", "tf", "len"), "postings"), materialize(size, "sizes")


def search_documents(index: tuple[DataFrame, DataFrame], query: str, limit: int = 50, least: float = 0.0, kind: str | None = None) -> DataFrame:
    """``kind``, ``id``, ``score`` of the ``limit`` best documents by BM25 with a score above 0 and of ``least`` or more.

    Frequencies and lengths are those of all kinds together; a ``kind`` is chosen from the best, as in a search that is filtered
    afterwards. Terms that a query repeats count repeatedly. Equal scores go by kind and id.
    """
    posts, size = index
    spark = posts.sparkSession
    times: dict[str, int] = {}
    for t in spark.range(1).select(tokenize(F.lit(query)).alias("t")).first().t:
        times[t] = times.get(t, 0) + 1
    empty = posts.select("kind", "id", F.lit(0.0).alias("score")).limit(0)
    row = size.first()
    if not times or not row.n or not row.average:
        return empty
    found = posts.where(F.col("term").isin(*times))
    frequency = {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term of the query
    score = F.lit(0.0)
    norm = K1 * (1 - B + B * F.col("len") / F.lit(float(row.average)))
    for term, n in frequency.items():
        idf = F.log((F.lit(float(row.n)) - n + 0.5) / (F.lit(float(n)) + 0.5) + 1)
        score = F.when(F.col("term") == term, times[term] * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + norm)).otherwise(score)
    # Summed as decimals: a sum of doubles depends on the order in which shuffled rows arrive, and copies of a text must score the same.
    total = F.sum(F.round(score, 12).cast("decimal(28,12)")).cast("double")
    scored = found.groupBy("kind", "id").agg(total.alias("score")).where((F.col("score") > 0) & (F.col("score") >= least))
    best = scored.orderBy(F.desc("score"), "kind", "id").limit(limit)
    return best if kind is None else best.where(F.col("kind") == kind)


def architecture_documents(perspectives: DataFrame, elements: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``kind`` (perspective or element), ``id``, ``text``: what an architecture search reads.

    ``perspectives``: ``perspective``, ``label``; ``elements``: ``perspective``, ``element`` (path), ``label``, ``directory`` and, as arrays, ``files``, ``functions``, ``provides``,
    ``consumes``, ``flows`` (null: none); ``descriptions``: ``path`` (of a perspective or of an element below it), ``text``.
    """
    told = descriptions.groupBy(F.col("path").alias("at")).agg(F.min("text").alias("description"))
    first = perspectives.select(F.col("perspective").alias("at"), F.lit("perspective").alias("kind"), F.array("label").alias("parts"))
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none) for c in ("files", "functions", "provides", "consumes", "flows")]
    second = elements.select(F.concat_ws("/", "perspective", "element").alias("at"), F.lit("element").alias("kind"), F.concat(F.array("label", "directory"), *lists).alias("parts"))
    both = first.union(second).join(told, "at", "left")
    return both.select("kind", F.concat(F.lit("architecture/"), "at").alias("id"), F.concat_ws(" ", "parts", "description").alias("text"))


def architecture_search(perspectives: DataFrame, elements: DataFrame, descriptions: DataFrame, query: str, limit: int = 20, least: float = 0.5) -> DataFrame:
    """``kind``, ``id``, ``score`` of the best perspectives and elements, with a score of ``least`` or more."""
    return search_documents(postings(architecture_documents(perspectives, elements, descriptions)), query, limit, least)
