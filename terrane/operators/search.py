"""Keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.scratch import materialize

K1, B = 1.5, 0.75
_CHAR = "[a-z0-9一-鿿]"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and CJK ideographs, of two characters or more."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9一-鿿]+", " "), " ")
    return F.filter(parts, lambda x: F.char_length(x) > 1)


def split_identifier(name: Column) -> Column:
    """The lower-cased words of a camel, acronym, snake or kebab name, of two characters or more."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " "), lambda x: F.char_length(x) > 1)


def bm25(docs: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """``id``, ``score`` > 0 of every document (``id``, ``text``) for ``query``; repeated query terms count repeatedly.

    Only numbers leave the documents: a row's length and matches are counted within the row by regular expressions,
    each text is read once, and what is shuffled is one small aggregate for document frequencies and the average
    length, not a term table. Empty documents count in both.
    """
    spark = docs.sparkSession
    terms: dict[str, int] = {}
    for t in spark.range(1).select(tokenize(F.lit(query)).alias("t")).first().t:
        terms[t] = terms.get(t, 0) + 1
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    low = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    count = lambda pattern: F.regexp_count("low", F.lit(pattern))
    counts = [count(f"(?<!{_CHAR}){t}(?!{_CHAR})").alias(f"tf{k}") for k, t in enumerate(terms)]
    tf = materialize(low.select("id", count(f"{_CHAR}{{2,}}").alias("len"), *counts), "tf")
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    if not stats.n or not stats.avg:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    norm = k1 * (1 - b + b * F.col("len") / F.lit(float(stats.avg)))
    for k, times in enumerate(terms.values()):
        idf = F.log((F.lit(float(stats.n)) - stats[f"df{k}"] + 0.5) / (F.lit(float(stats[f"df{k}"])) + 0.5) + 1)
        score = score + times * idf * (F.col(f"tf{k}") * (k1 + 1)) / (F.col(f"tf{k}") + norm)
    return tf.select("id", score.alias("score")).where("score > 0")


def top(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` best by ``score``, the smaller id first of equals; a top-k per partition, then of those."""
    return df.orderBy(F.desc("score"), "id").limit(n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    norm = size(a) * size(b)
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def vector_search(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``id``, ``score`` (cosine) for every row of ``vectors`` (``id``, ``vector``)."""
    given = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", cosine(F.col("vector"), given).alias("score"))


def code_score(query: str, name: Column, path: Column, id_: Column) -> Column:
    """1 for an equal name, .85 if within it, .75 within the id, .55 within the path, else .1; case does not matter."""
    q = query.lower()
    has = lambda c: F.lower(c).contains(q)
    return F.when(F.lower(name) == q, 1.0).when(has(name), 0.85).when(has(id_), 0.75).when(has(path), 0.55).otherwise(0.1)


def code_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes (``id``, ``name``, ``path``) that hold ``query`` in name, path or id, case mattering, with their score."""
    hit = F.col("name").contains(query) | F.col("path").contains(query) | F.col("id").contains(query)
    return nodes.where(hit).select("id", code_score(query, F.col("name"), F.col("path"), F.col("id")).alias("score"))


def hybrid(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """All of ``first`` by score, then ``second`` by score, up to ``limit``: ``origin``, ``id``, ``score``, ``position``."""
    a = top(first, limit).withColumn("origin", F.lit("text"))
    b = top(second, limit).withColumn("origin", F.lit("code"))
    both = a.union(b)  # at most twice the limit: one task orders it
    place = F.row_number().over(Window.orderBy(F.desc("origin"), F.desc("score"), "id"))
    return both.withColumn("position", place).where(F.col("position") <= limit).select("origin", "id", "score", "position")
