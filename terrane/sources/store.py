"""The graph store: facts, artifacts, snapshots, caches and logs as Parquet and JSON folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.functions.scratch import drop, materialize
from terrane.operators.change import latest

NODES = "id string, label string, name string, filePath string, startLine bigint, endLine bigint, isExported boolean, properties string"
EDGES = "`from` string, `to` string, type string, confidence double, reason string, step bigint"
ARTIFACTS = "key string, id string, layer string, structHash string, payload string"
DELETED = "__deleted__"


def project_nodes(raw: DataFrame) -> DataFrame:
    """Nodes with every default: name is the id, path empty, lines 0, not exported, no properties; the first of an id (by ``seq``) wins."""
    has = lambda c, kind, default: F.coalesce(F.col(c).try_cast(kind), default) if c in raw.columns else default.cast(kind)
    rows = raw.select(
        "id", "label", has("name", "string", F.col("id")).alias("name"), has("filePath", "string", F.lit("")).alias("filePath"),
        has("startLine", "bigint", F.lit(0)).cast("bigint").alias("startLine"), has("endLine", "bigint", F.lit(0)).cast("bigint").alias("endLine"),
        has("isExported", "boolean", F.lit(False)).alias("isExported"), has("properties", "string", F.lit("{}")).alias("properties"),
        has("seq", "bigint", F.lit(0)).cast("bigint").alias("seq"),
    )
    return latest(rows, "id", [-F.col("seq")]).drop("seq")


def project_edges(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``; reason empty and step 0 by default."""
    has = lambda c, default: F.coalesce(F.col(c), default) if c in raw.columns else default
    rows = raw.select(
        "from", "to", "type", has("confidence", F.lit(1.0)).cast("double").alias("confidence"), has("reason", F.lit("")).alias("reason"), has("step", F.lit(0)).cast("bigint").alias("step")
    )
    ids = nodes.select("id")
    return rows.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi").select(*rows.columns)


def artifact_key(layer: str = "layer", id_: str = "id") -> Column:
    """layer:id with the id URL-encoded."""
    return F.concat(F.col(layer), F.lit(":"), F.url_encode(F.col(id_)))


def projection_hash(df: DataFrame) -> str:
    """32 hex digits that change with any row, and not with the rows' order or partitions: the number of rows and two sums of their hashes, no sort."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    got = df.agg(F.count("*").alias("n"), total(F.xxhash64(row)).alias("a"), total(F.xxhash64(F.lit(1), row)).alias("b"))
    return got.select(F.substring(F.sha2(F.concat_ws("|", "n", "a", "b"), 256), 1, 32)).first()[0]


class GraphStore:
    """Facts and artifacts below ``root``.

    Tables are written beside the old ones and a small pointer file names the version that counts, so a reader never
    sees half a write and a failed one leaves the old version in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self, name: str) -> int:
        try:
            return self.spark.read.schema("version long").json(f"{self.root}/{name}/current").agg(F.max("version")).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def write(self, name: str, df: DataFrame, by: list[str] | None = None) -> int:
        """A new version of a table, partitioned by ``by``; returns its number."""
        old = self._version(name)
        path = f"{self.root}/{name}/v{old + 1}"
        out = df.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(path)
        self.spark.range(1).select(F.lit(old + 1).cast("long").alias("version")).coalesce(1).write.mode("overwrite").json(f"{self.root}/{name}/current")
        if old > 1:
            drop(self.spark, f"{self.root}/{name}/v{old - 1}")
        return old + 1

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version; an empty table if there is none."""
        version = self._version(name)
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{version}")

    def write_facts(self, nodes: DataFrame, edges: DataFrame) -> bool:
        """Nodes by label and edges by type; False, and nothing written, if the facts are those that are stored."""
        nodes = materialize(project_nodes(nodes), "nodes")
        edges = materialize(project_edges(edges, nodes), "edges")
        mark = f"{projection_hash(nodes)}-{projection_hash(edges)}"
        stored = self.read("facts_hash", "hash string").first()
        if stored and stored.hash == mark:
            return False
        self.write("nodes", nodes, ["label"])
        self.write("edges", edges, ["type"])
        self.write("facts_hash", self.spark.createDataFrame([(mark,)], "hash string"))
        return True

    def nodes(self, label: str | None = None) -> DataFrame:
        df = self.read("nodes", NODES)
        return df if label is None else df.where(F.col("label") == label)

    def edges(self, type_: str | None = None) -> DataFrame:
        df = self.read("edges", EDGES)
        return df if type_ is None else df.where(F.col("type") == type_)

    def upsert(self, artifacts: DataFrame) -> None:
        """Insert or replace by key; the last row of a key (by ``seq``, if there is one) wins."""
        fresh = artifacts.withColumn("key", artifact_key())
        fresh = fresh if "seq" in fresh.columns else fresh.withColumn("seq", F.lit(1).cast("long"))
        cols = ["key", "id", "layer", "structHash", "payload"]
        old = self.read("artifacts", ARTIFACTS).select(*cols, F.lit(-1).cast("long").alias("seq"))
        both = old.unionByName(fresh.select(*cols, F.col("seq").cast("long").alias("seq")))
        self.write("artifacts", materialize(latest(both, "key", [F.col("seq")]).drop("seq"), "artifacts"), ["layer"])

    def artifacts(self, layer: str | None = None) -> DataFrame:
        df = self.read("artifacts", ARTIFACTS).where(F.col("layer") != DELETED)
        return df if layer is None else df.where(F.col("layer") == layer)

    def delete(self, keys: DataFrame) -> None:
        """Tombstones: rows of ``keys`` (``key``) stay, without payload and out of every layer."""
        old = self.read("artifacts", ARTIFACTS)
        gone = keys.select("key", F.lit(True).alias("gone")).distinct()
        both = old.join(gone, "key", "left")
        out = both.select(
            "key", "id", F.when(F.col("gone"), DELETED).otherwise(F.col("layer")).alias("layer"), "structHash", F.when(F.col("gone"), "").otherwise(F.col("payload")).alias("payload")
        )
        self.write("artifacts", materialize(out, "artifacts"), ["layer"])

    def delete_files(self, paths: DataFrame) -> None:
        """Nodes of the files (``filePath``) and all edges at them."""
        nodes = materialize(self.nodes().join(paths.select("filePath").distinct(), "filePath", "left_anti"), "nodes")
        edges = materialize(project_edges(self.edges(), nodes), "edges")
        self.write("nodes", nodes.select("id", "label", "name", "filePath", "startLine", "endLine", "isExported", "properties"), ["label"])
        self.write("edges", edges, ["type"])

    def snapshot(self, tag: str, compiled_at: str) -> None:
        """Keep the current artifacts under ``tag``; a tag is written once."""
        path = f"{self.root}/snapshots/snapshot_tag={tag}"
        self.artifacts().withColumn("compiled_at", F.lit(compiled_at)).write.mode("error").parquet(path)

    def snapshots(self) -> DataFrame:
        """All snapshots: artifacts with ``snapshot_tag`` and ``compiled_at``."""
        return self.spark.read.parquet(f"{self.root}/snapshots")

    def export(self, path: str) -> None:
        """Nodes and edges as JSON lines."""
        self.nodes().write.mode("overwrite").json(f"{path}/nodes")
        self.edges().write.mode("overwrite").json(f"{path}/edges")

    def log(self, name: str, rows: DataFrame) -> None:
        """Append to a log of JSON lines."""
        rows.write.mode("append").json(f"{self.root}/logs/{name}")


def supplement(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with a File node for every ``path`` of ``files`` that has none."""
    have = nodes.where("label = 'File'").select(F.col("filePath").alias("path"))
    missing = files.select("path").distinct().join(have, "path", "left_anti")
    fresh = missing.select(F.concat(F.lit("File:"), "path").alias("id"), F.lit("File").alias("label"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("filePath"))
    return nodes.unionByName(fresh, allowMissingColumns=True)


def cache_hits(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``files`` (``path``, ``content_hash``) that ``cache`` holds with the same hash, and the rest."""
    keys = cache.select("path", "content_hash").distinct()
    return files.join(keys, ["path", "content_hash"], "left_semi"), files.join(keys, ["path", "content_hash"], "left_anti")


def content_hash(text: str = "text") -> Column:
    return F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 40)
