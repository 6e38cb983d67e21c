"""Derived tables that are kept up to date: embeddings of what changed, and results that are reused while their inputs are the same."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrane.sources.store import GraphStore, projection_hash

EMBEDDINGS = "layer string, id string, struct_hash string, model string, vector array<float>"
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashed_vectors(texts: Sequence[str], size: int = 64) -> list[list[float]]:
    """Vectors of texts without any model: signed counts of their words by hash, of length one. For tests and boxes without a network."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % size] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def refresh_embeddings(store: GraphStore, nodes: DataFrame, model: str, embed: Embed, batch: int = 20, force: bool = False) -> dict[str, int]:
    """Bring the store's embeddings to the state of ``nodes`` (``layer``, ``id``, ``struct_hash``, ``text``); counts of total, embedded, cached and removed.

    Vectors whose layer, id, hash and model are unchanged are reused; only the rest goes to ``embed``, ``batch`` texts a call, in Arrow batches on the
    executors, which need to reach the model. Another model, ``force``, or an empty hash embeds anew. ``embed`` is called once for a row unless a
    task is retried, and returns a vector for each text. Of repeated nodes one counts. The new table stands beside the old one until it is whole.
    """
    spark = store.spark
    wanted = nodes.select("layer", F.col("id").cast("string").alias("id"), F.coalesce(F.col("struct_hash").cast("string"), F.lit("")).alias("struct_hash"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = wanted.groupBy("layer", "id").agg(F.max(F.struct("struct_hash", "text")).alias("x")).select("layer", "id", "x.*")
    old = store.read("embeddings", EMBEDDINGS)
    before = old.count()
    usable = old.where((F.col("model") == model) & (F.col("struct_hash") != "") & F.lit(not force)).select("layer", "id", "struct_hash", "vector")
    both = wanted.join(usable.hint("merge"), ["layer", "id", "struct_hash"], "left")  # never a broadcast: vectors would go through the driver at each refresh
    misses = both.where("vector IS NULL").select("layer", "id", "struct_hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embed(part.column(3).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(vectors, pa.list_(pa.float32()))], names=["layer", "id", "struct_hash", "vector"])

    fresh = misses.mapInArrow(run, "layer string, id string, struct_hash string, vector array<float>").withColumn("new", F.lit(True))
    kept = both.where("vector IS NOT NULL").select("layer", "id", "struct_hash", "vector", F.lit(False).alias("new"))
    store.write("embeddings", fresh.union(kept).select("layer", "id", "struct_hash", F.lit(model).alias("model"), "vector", "new"))
    now = store.read("embeddings", f"{EMBEDDINGS}, new boolean").agg(F.count("*").alias("total"), F.count_if("new").alias("embedded")).first()
    cached = now.total - now.embedded
    return {"total": now.total, "embedded": now.embedded, "cached": cached, "removed": before - cached}


def inputs_hash(inputs: Mapping[str, DataFrame], settings: Mapping[str, Any]) -> str:
    """32 hex digits of the rows of all inputs, in any order, and of the settings."""
    told = {name: projection_hash(df) for name, df in sorted(inputs.items())}
    return hashlib.sha256(json.dumps([told, dict(settings)], sort_keys=True).encode()).hexdigest()[:32]


def cached_result(store: GraphStore, name: str, inputs: Mapping[str, DataFrame], settings: Mapping[str, Any], compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored result if it was made of the same inputs and settings, else ``compute()``, stored; and whether it was reused.

    Rows in another order or in other partitions are the same inputs; one changed, added or repeated row is not. Result and hash are
    written one after the other, the hash last, so a run that stops in between computes again.
    """
    key = inputs_hash(inputs, settings)
    known = store.read(f"{name}_inputs", "hash string, schema string").first()
    if known and known.hash == key:
        return store.read(name, known["schema"]), True
    made = compute()
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    store.write(name, made)
    store.write(f"{name}_inputs", store.spark.createDataFrame([(key, kind)], "hash string, schema string"))
    return store.read(name, kind), False
