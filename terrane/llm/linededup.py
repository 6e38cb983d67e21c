"""Line deduplication across documents, with DataFrame functions only.

Occurrences are range-partitioned by their key's hash and the span of ids that the document lies in, and sorted by
document and position within. A pass over that order tells the first occurrence in each document from further ones, and
the first document of each key and span, which is the largest, keeps the key's lines. As the span is part of the range
key, a line that a third of all documents hold is dealt over as many ranges as there are spans; only one row for each
key and span is merged. What comes back is a bitmap per document, as run lengths, and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.columns import let, lower_ascii, trim_ascii
from terrane.functions.scratch import materialize


#: Ranges of ids over which one key's lines are dealt at most.
SPANS = 64


def split_lines(text: Column) -> Column:
    """The \\n-separated lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _identity(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Rows with equal id and text are alike; rows that share an id only are kept apart by their texts' hash."""
    return [docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash")]


def _span(docs: DataFrame, doc_id: Column) -> Column:
    """Which of at most ``SPANS`` ranges of ids, about equally full, a document lies in."""
    shares = [k / SPANS for k in range(1, SPANS)]
    cuts = sorted(set(docs.select(F.percentile_approx(doc_id, shares, 1000).alias("cuts")).first().cuts or []))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= doc_id)) if cuts else F.lit(0)


def occurrences(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text_hash``, ``span``, ``pos``, ``h1``, ``h2`` of every line whose key has ``min_chars`` code points or more."""
    span = _span(docs, docs[id_col].cast("long")).alias("span")
    named = docs.where(docs[id_col].isNotNull()).select(*_identity(docs, id_col, text_col), span, docs[text_col].alias("text"))
    lines = named.select("doc_id", "text_hash", "span", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "span", "pos", trim_ascii(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    key = lower_ascii(F.col("key"))
    return keys.select("doc_id", "text_hash", "span", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """A sorted array of dropped positions as the bitmap's run lengths, kept and dropped in turn, kept first."""

    def runs(d: Column) -> Column:
        starts = F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) != x - 1))
        ends = F.filter(d, lambda x, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != x + 1))
        return let(
            F.struct(starts.alias("s"), ends.alias("e")),
            lambda r: F.concat(
                F.flatten(
                    F.transform(
                        r["s"],
                        lambda s, j: F.array(
                            s - F.when(j == 0, F.lit(0)).otherwise(F.get(r["e"], j - 1) + 1), F.get(r["e"], j) - s + 1
                        ),
                    )
                ),
                F.array(n_lines - F.get(r["e"], F.size(r["e"]) - 1) - 1),
            ),
        )

    return let(dropped, runs)


def first_occurrences(seen: DataFrame) -> DataFrame:
    """``h1``, ``h2``, ``span``, ``doc_id``, ``pos`` of each key's first line in each document, the largest document first.

    Ranges of key and span, sorted by document and position: the pass over that order needs no further shuffle or sort.
    """
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seen.select("h1", "h2", "span", "doc_id", "pos").repartitionByRange(parts, "h1", "h2", "span")
    rows = rows.sortWithinPartitions("h1", "h2", "span", F.desc("doc_id"), "pos")
    before = F.lag("doc_id").over(Window.partitionBy("h1", "h2", "span").orderBy(F.desc("doc_id"), "pos"))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("doc_id"))).drop("before")


def duplicate_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``text_hash``, ``dropped`` (sorted positions) of every document that loses lines.

    A line's key is the line without ASCII white space at both ends and with A-Z in lower case. A key of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold keeps its lines in the largest ``doc_id`` only.
    Keys are compared by two independent 64-bit hashes. Rows with a null id neither count nor lose lines; rows that
    repeat an id count as one document and each loses its own lines; null and empty texts have no key; very long texts are
    read whole, their lines being rows of their own. The largest id is unique, so there are no ties but of rows that repeat it,
    which all keep the line; an empty table gives no rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    seen = materialize(occurrences(docs, min_chars, id_col, text_col), "lines")
    by_span = first_occurrences(seen).groupBy("h1", "h2", "span").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    held = by_span.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    # Written first, so that the join below deals both sides anew and can split a hot line, or broadcasts a small table.
    repeated = materialize(held.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "repeated")
    lost = seen.join(repeated, ["h1", "h2"]).where(F.col("doc_id") < F.col("keeper"))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``text_hash``, ``n_lines``, ``n_dropped``, ``keep_bitmap`` (run lengths: kept, dropped, kept ...)."""
    return _joined(docs, min_chars, min_docs, id_col, text_col, []).select("doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap")


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """As :func:`keep_bitmaps`, with ``kept_text`` (the lines that stay, joined by \\n) and the columns ``keep`` of ``docs``."""
    out = _joined(docs, min_chars, min_docs, id_col, text_col, keep or [])
    kept = F.when(F.col("n_dropped") == 0, F.coalesce(F.col("__text"), F.lit(""))).otherwise(
        let(
            F.flatten(F.transform("keep_bitmap", lambda n, k: F.array_repeat(k % 2 == 0, n))),
            lambda flags: F.array_join(F.filter(split_lines(F.col("__text")), lambda _, i: F.get(flags, i)), "\n"),
        )
    )
    return out.withColumn("kept_text", kept).drop("__text", "text_hash")


def _joined(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    dropped = duplicate_lines(docs, min_chars, min_docs, id_col, text_col)
    texts = docs.select(*_identity(docs, id_col, text_col), docs[text_col].alias("__text"), *[docs[c].alias(f"__keep_{c}") for c in keep])
    both = texts.join(dropped, ["doc_id", "text_hash"], "left")
    n_lines = F.size(split_lines(F.col("__text")))
    return both.select(
        "doc_id",
        "text_hash",
        "__text",
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(keep_runs(F.col("dropped"), n_lines), F.array(n_lines)).alias("keep_bitmap"),
    )
