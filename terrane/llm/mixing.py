"""Mixing sources to target weights, as a time-varying curriculum.

Each source's weight is a schedule over training time. Its integral is the source's target; the cumulative demand,
inverted, assigns a training position to every copy of every document that the mix takes; documents are then
range-sorted by position. Running totals within a source are taken in buckets of bounded size, so that a source with a
third of all documents is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrane.functions.scratch import materialize

#: By rank of the source, repeating: weight, and the schedule's relative height at the start of training; at the end it is 2 less that.
WEIGHTS = (5, 2, 1)
HEADS = (1.5, 1.0, 0.5)
SHARE_PERCENT, MAX_EPOCHS, BUCKET_DOCS, SHELF = 150, 2, 1_000, 10_000


def _order(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, or of the text where there is no id: an order that is the same in every run and engine."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))).cast("binary")
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``n_docs``, ``rank``, ``target`` for every source of ``sizes`` (``source``, ``size``).

    Sources rank by code point, null last; rank r weighs ``weights[r mod n]``. Together they get ``share_percent`` of
    all words, shared by weight; a target stops at ``max_epochs`` times its source's size and the excess is shared
    again by weight until none is above. Sums are of whole numbers, so reruns agree to the last bit. The sources are a
    distributed table throughout: ranks come from range partitions and their offsets.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = by.withColumn("last", F.col("source").isNull()).repartitionByRange(parts, "last", F.col("source").asc_nulls_last())
    ranged = materialize(ordered.withColumn("part", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect()  # one row per partition
    offsets, at = [], 0
    for r in counts:
        offsets += [F.lit(r.part), F.lit(at)]
        at += r.rows
    offset = F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranged.withColumn("rank", (place + offset).cast("long")).withColumn("weight", weight)
    ranked = materialize(ranked.select("source", "source_size", "n_docs", "rank", "weight"), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0  # words per unit of weight; sources whose cap lies at or below it are capped
    cap = max_epochs * F.col("source_size")
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        capped, open_weight = ranked.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        later = (share_percent * total - 100 * capped) / (100 * open_weight)
        if later <= level:
            break
        level = later
    target = F.when(full, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def _when(share: Column, rank: Column, heads: tuple[float, ...]) -> Column:
    """Time in [0, 1] at which a source has met ``share`` of its demand; weights fall or rise linearly from their head."""
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (rank % len(heads) + 1).cast("int"))
    # The integral of head + (2 - 2 head) t is head t + (1 - head) t^2.
    bend = 1 - head
    solved = (F.sqrt(head * head + 4 * bend * share) - head) / (2 * F.when(bend == 0, 1).otherwise(bend))
    return F.when(bend == 0, share).otherwise(solved) + F.lit(0.0)


def _starts(sums: DataFrame) -> DataFrame:
    """``rank``, ``bucket``, ``start`` (words of the buckets before): running totals of ``SHELF`` buckets at a time, and of these."""
    ahead = Window.partitionBy("rank", "shelf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shelves = sums.groupBy("rank", "shelf").agg(F.sum("words").alias("all"))
    above = Window.partitionBy("rank").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    bases = shelves.select("rank", "shelf", F.coalesce(F.sum("all").over(above), F.lit(0)).alias("base"))
    inner = sums.select("rank", "shelf", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("inner"))
    return inner.join(bases, ["rank", "shelf"]).select("rank", "bucket", (F.col("base") + F.col("inner")).alias("start"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    heads: tuple[float, ...] = HEADS,
    share_percent: int = SHARE_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    bucket_docs: int = BUCKET_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``positions``, sorted by first position.

    Documents of a source are read in the order of their hash, again and again until its target is met; the last one
    is cut at the target. ``taken`` counts its words over all readings, never above ``max_epochs`` times its size;
    ``positions`` has a time in [0, 1] for each reading. A null text has no words and is never taken; a null source is
    a source; null ids are kept, in the order of their texts' hash, and repeated rows are taken as separate documents; of a
    very long text only its number of words is carried on; documents whose hashes tie go by id, then by size; an empty table gives no rows. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    text, doc_id = docs[text_col], docs[id_col].cast("long")
    sizes = materialize(
        docs.select(doc_id.alias("doc_id"), docs[source_col].alias("source"), n_words(text).alias("size"), _order(doc_id, text).alias("u")),
        "sizes",
    )
    targets = materialize(source_targets(sizes, weights, share_percent, max_epochs), "targets")
    buckets = F.ceil(F.col("n_docs") / bucket_docs)
    at = F.floor(F.col("u") / F.lit(float(1 << 60)) * buckets)
    named = targets.withColumnRenamed("source", "of")
    placed = sizes.join(named, sizes.source.eqNullSafe(named.of)).drop("of").withColumn("bucket", F.least(at, buckets - 1).cast("long"))
    order = ["u", "doc_id", "size"]
    inside = Window.partitionBy("rank", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    starts = _starts(sums.withColumn("shelf", F.floor(F.col("bucket") / SHELF)))
    both = local.join(starts, ["rank", "bucket"]).withColumn("offset", F.col("start") + F.col("before"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    both = both.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset"))).cast("long"))
    both = both.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    readings = F.when(F.col("taken") == 0, F.lit(0)).otherwise(F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    share = lambda j: F.least(F.lit(1.0), (j * F.col("source_size") + F.col("offset")) / F.col("target"))
    positions = F.transform(
        F.when(readings > 0, F.sequence(F.lit(0), readings - 1)).otherwise(F.array().cast("array<int>")),
        lambda j: _when(share(j), F.col("rank"), heads),
    )
    out = both.select("doc_id", "source", "size", "source_size", "target", "taken", positions.alias("positions"))
    return out.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "doc_id")
