"""Fields that code reads and writes through chains of members: owner by owner, each hop a join with what the owner's class has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrane.functions.scratch import drop, materialize_at

# Methods that give their receiver's type back, where no class says otherwise.
PASSING = "unwrap expect unwrap_or unwrap_or_default unwrap_or_else clone to_owned as_ref as_mut borrow borrow_mut get orElseThrow".split()


def accesses(chains: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ACCESSES edges (``src``, ``dst``, ``type``, ``confidence``, ``reason``: read or write), and ``chain``, ``receiver``: the type each whole chain ends in.

    ``chains``: ``chain`` (id), ``src``, ``start`` (type of what the chain begins with), ``steps`` (array of ``kind``: field or call, ``name``) and ``writes`` (the
    last step is assigned to); ``members``: ``owner`` (type), ``name``, ``kind`` (field or method), ``id``, ``gives`` (declared or returned type), ``seq``.
    A step is the owner's first field of that name; of a call that is no field, its first method; a passing method that the owner lacks keeps the type. A chain
    ends where a step is unknown or gives no type; what it read up to there counts. Each source reads and writes a field once. Hops go on until no
    chain has a step left: as many rounds as the longest chain has steps, each one join of the open chains. Null starts and empty chains have no edges.
    """
    spark = chains.sparkSession
    first = members.groupBy("owner", "name", "kind").agg(F.min(F.struct("seq", "id", "gives")).alias("m"))
    fields = first.where("kind = 'field'").select("owner", "name", F.col("m.id").alias("field"), F.col("m.gives").alias("field_type"))
    methods = first.where("kind = 'method'").select("owner", "name", F.col("m.id").alias("method"), F.col("m.gives").alias("method_type"))
    known = fields.join(methods, ["owner", "name"], "full")
    open_ = chains.where(F.col("start").isNotNull() & (F.size("steps") > 0))
    open_, at = materialize_at(open_.select("chain", "src", F.col("start").alias("owner"), "steps", F.coalesce("writes", F.lit(False)).alias("writes"), F.lit(0).alias("hop")), "chains")
    kind = "src string, dst string, reason string"
    _, edges = materialize_at(spark.createDataFrame([], kind), "accesses")
    ends = chains.select("chain", "start").limit(0).toDF("chain", "receiver")
    ends, ends_at = materialize_at(ends, "receivers")
    while not open_.isEmpty():
        step = F.get("steps", F.col("hop"))
        here = open_.withColumns({"name": step["name"], "call": step["kind"] == "call"}).join(known, ["owner", "name"], "left")
        passing = F.col("call") & F.col("method").isNull() & F.col("name").isin(*PASSING)
        gives = F.when(F.col("field").isNotNull(), F.col("field_type")).when(F.col("call"), F.coalesce("method_type", F.when(passing, F.col("owner"))))
        last = F.col("hop") + 1 == F.size("steps")
        later, there = materialize_at(here.select("chain", "src", gives.alias("gives"), "steps", "writes", "hop", "field", last.alias("last")), "chains")
        reason = F.when(F.col("last") & F.col("writes"), "write").otherwise("read")
        later.where("field IS NOT NULL").select(F.col("src").cast("string").alias("src"), F.col("field").cast("string").alias("dst"), reason.alias("reason")).distinct().write.mode("append").parquet(edges)
        later.where("last AND gives IS NOT NULL").select("chain", F.col("gives").alias("receiver")).write.mode("append").parquet(ends_at)
        drop(spark, at)
        open_, at = materialize_at(later.where("NOT last AND gives IS NOT NULL").select("chain", "src", F.col("gives").alias("owner"), "steps", "writes", (F.col("hop") + 1).alias("hop")), "chains")
        drop(spark, there)
    found = spark.read.schema(kind).parquet(edges).distinct()
    return found.select("src", "dst", F.lit("ACCESSES").alias("type"), F.lit(1.0).alias("confidence"), "reason"), spark.read.schema(ends.schema).parquet(ends_at)
