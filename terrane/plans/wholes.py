"""Queries of searches over whole documents and of derived tables that are kept up to date, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.functions.scratch import drop, materialize, scratch_root
from terrane.operators import documents as D, layers
from terrane.plans import adapters as A
from terrane.plans.adapters import with_
from terrane.plans.registry import query
from terrane.sources import derived
from terrane.sources.store import GraphStore
from terrane.sources.tables import table


def _bm25_sql(docs: str, query_: str, limit: int, least: float) -> str:
    return f"""{docs}, w AS (SELECT kind, id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), lambda x: length(x) > 1) AS w FROM docs),
    sz AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w), q AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split('{query_}', ' ')) AS term) GROUP BY 1),
    tf AS (SELECT kind, id, len(w) AS len, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1),
    s AS (SELECT kind, id, sum(round(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / average)), 12)) AS score FROM tf JOIN df USING (term), sz WHERE tf > 0 GROUP BY 1, 2)
    SELECT kind, id, round(score, 9) AS score FROM s WHERE score >= {least} ORDER BY s.score DESC, kind, id LIMIT {limit}"""


_KINDS = """WITH docs AS (SELECT 'module' AS kind, n_name AS id, n_name || ' ' || r_name || ' ' || coalesce((SELECT string_agg(DISTINCT c_mktsegment, ' ' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), '') AS text FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'concept', p_partkey::VARCHAR, p_name || ' ' || p_type || ' ' || p_brand FROM part UNION ALL SELECT 'document', doc_id::VARCHAR, coalesce(text, '') || ' ' || coalesce(source, '') FROM documents)"""


@query(_bm25_sql(_KINDS, "red widget erand building promo red station", 50, 0.0))
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    """Modules with nested and listed strings, concepts with a map, and whole documents, in one index."""
    t = lambda n: table(spark, sf, n)
    segments = t("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("files"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(segments, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    modules = places.select(F.col("n_name").alias("id"), F.struct(F.struct("r_name", "r_regionkey").alias("region"), "files").alias("data"))
    concepts = t("part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type", F.lit("brand"), "p_brand").alias("data"))
    docs = t("documents").select(F.col("doc_id").alias("id"), "text", "source")
    index = D.postings(D.whole_documents({"module": (modules, "id"), "concept": (concepts, "id"), "document": (docs, "id")}))
    return D.search_documents(index, "red widget erand building promo red station").withColumn("score", F.round("score", 9))


_ARCHITECTURE = """WITH docs AS (SELECT 'perspective' AS kind, 'architecture/' || r_name AS id, 'Trade of ' || r_name || ' All of region ' || r_regionkey AS text FROM region
      UNION ALL SELECT 'element', 'architecture/' || r_name || '/' || n_name, n_name || ' src/' || n_name || coalesce(' ' || (SELECT string_agg(s_name, ' ') FROM supplier WHERE s_nationkey = n_nationkey), '') || CASE WHEN n_nationkey % 2 = 0 THEN ' Ships to region ' || r_regionkey ELSE '' END
        FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(_bm25_sql(_ARCHITECTURE, "trade region supplier ships nation", 20, 0.5))
def architecture_search(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    region = F.col("r_regionkey").cast("string")
    perspectives = t("region").select(F.col("r_name").alias("perspective"), F.concat(F.lit("Trade of "), "r_name").alias("label"))
    names = t("supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("files"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(names, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    none = F.lit(None).cast("array<string>")
    elements = places.select(
        F.col("r_name").alias("perspective"), F.col("n_name").alias("element"), F.col("n_name").alias("label"), F.concat(F.lit("src/"), "n_name").alias("directory"), "files",
        *[none.alias(c) for c in ("functions", "provides", "consumes", "flows")],
    )
    told = t("region").select(F.col("r_name").alias("path"), F.concat(F.lit("All of region "), region).alias("text"))
    told = told.union(places.where("n_nationkey % 2 = 0").select(F.concat_ws("/", "r_name", "n_name"), F.concat(F.lit("Ships to region "), region)))
    return D.architecture_search(perspectives, elements, told, "trade region supplier ships nation").withColumn("score", F.round("score", 9))


def _store(spark: SparkSession) -> tuple[GraphStore, str]:
    path = f"{scratch_root(spark)}/terrane/derived-{uuid.uuid4().hex}"
    return GraphStore(spark, path), path


@query(
    """WITH a AS (SELECT p_partkey AS id, p_size AS h FROM part), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN h + 1 ELSE h END AS h FROM a WHERE id % 10 > 0 UNION ALL SELECT s_suppkey + 100000000, 1 FROM supplier),
    n AS (SELECT (SELECT count(*) FROM a) AS na, count(*) AS nb, count(*) FILTER (a.id IS NOT NULL AND a.h = b.h) AS same FROM b LEFT JOIN a ON a.id = b.id)
    SELECT 1 AS run, na AS total, na AS embedded, 0 AS cached, 0 AS removed FROM n UNION ALL SELECT 2, na, 0, na, 0 FROM n UNION ALL SELECT 3, nb, nb - same, same, na - same FROM n UNION ALL SELECT 4, nb, nb, 0, nb FROM n"""
)
def embedding_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Four refreshes: all is new; nothing has changed; some nodes changed, went or came; another model."""
    part = table(spark, sf, "part")
    first = part.select(F.lit("module").alias("layer"), F.col("p_partkey").alias("id"), F.col("p_size").alias("struct_hash"), F.col("p_name").alias("text"))
    changed = F.when(F.col("id") % 7 == 0, F.col("struct_hash") + 1).otherwise(F.col("struct_hash"))
    second = first.where("id % 10 > 0").withColumn("struct_hash", changed)
    second = second.union(table(spark, sf, "supplier").select(F.lit("module"), F.col("s_suppkey") + 100_000_000, F.lit(1), F.col("s_name")))
    store, path = _store(spark)
    runs = [(first, "a"), (first.orderBy(F.desc("id")), "a"), (second, "a"), (second, "b")]
    counts = [(k + 1, *derived.refresh_embeddings(store, nodes, model, derived.hashed_vectors).values()) for k, (nodes, model) in enumerate(runs)]
    drop(spark, path)
    return spark.createDataFrame(counts, "run int, total long, embedded long, cached long, removed long")


@query(
    with_("trade")
    + """, pairs AS (SELECT DISTINCT src_module, dst_module FROM trade WHERE src_module <> dst_module), a AS (SELECT src_module AS module, string_agg(dst_module, ',' ORDER BY dst_module) AS depends_on FROM pairs GROUP BY 1),
    b AS (SELECT dst_module AS module, string_agg(src_module, ',' ORDER BY src_module) AS depended_by FROM pairs GROUP BY 1), r(run, reused) AS (VALUES (1, FALSE), (2, TRUE), (3, FALSE))
    SELECT run, reused, coalesce(a.module, b.module) AS module, coalesce(depends_on, '') AS depends_on, coalesce(depended_by, '') AS depended_by FROM a FULL JOIN b ON a.module = b.module CROSS JOIN r"""
)
def reused_results(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies of modules, computed, reused for the same rows in another order, and computed again for one row more."""
    calls = materialize(A.trade(spark, sf), "trade")
    store, path = _store(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inputs = [calls, calls.repartition(parts, "dst", "src"), calls.union(calls.limit(1))]  # not by name: brands are few, and so would be the tasks
    out = None
    for k, given in enumerate(inputs):
        found, reused = derived.cached_result(store, "dependencies", {"calls": given}, {"least": 1}, lambda given=given: layers.module_dependencies(given))
        rows = found.select(F.lit(k + 1).alias("run"), F.lit(reused).alias("reused"), "module", "depends_on", "depended_by")
        rows = materialize(rows, "reused")
        out = rows if out is None else out.union(rows)
    drop(spark, path)
    return out
