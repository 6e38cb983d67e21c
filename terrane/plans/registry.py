"""All queries of the graph, search, change and rule planes over the driver's tables, each with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terrane.functions import extract, names
from terrane.functions.scratch import materialize
from terrane.operators import architecture, change, decision, families, graph, index, layers, lint, processes as flows_, planning, resolution, search, web
from terrane.plans import adapters as A
from terrane.plans.adapters import with_
from terrane.plans.cypher import Graph
from terrane.sources.tables import table
from terrane.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return put


def _all() -> None:
    """Modules of further queries register theirs when they are imported; they use :func:`query` of this one."""
    for name in ("structure", "web", "facts", "wholes", "inputs", "workspace", "decide", "rest"):
        importlib.import_module(f"terrane.plans.{name}")


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


# Layers -------------------------------------------------------------------------------------------------------------


@query(
    with_("trade")
    + """ SELECT src_module || '--' || dst_module AS id, src_module AS consumer, dst_module AS provider,
    string_agg(DISTINCT name, ',' ORDER BY name) AS interface, count(*) AS n_calls FROM trade WHERE src_module <> dst_module GROUP BY 1, 2, 3"""
)
def contract_map(spark: SparkSession, sf: str) -> DataFrame:
    return layers.contracts(A.trade(spark, sf))


@query(
    with_("trade")
    + """, pairs AS (SELECT DISTINCT src_module, dst_module FROM trade WHERE src_module <> dst_module),
    a AS (SELECT src_module AS module, string_agg(dst_module, ',' ORDER BY dst_module) AS depends_on FROM pairs GROUP BY 1),
    b AS (SELECT dst_module AS module, string_agg(src_module, ',' ORDER BY src_module) AS depended_by FROM pairs GROUP BY 1)
    SELECT coalesce(a.module, b.module) AS module, coalesce(depends_on, '') AS depends_on, coalesce(depended_by, '') AS depended_by FROM a FULL JOIN b ON a.module = b.module"""
)
def module_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return layers.module_dependencies(A.trade(spark, sf))


@query(
    with_("trade")
    + """, n AS (SELECT dst AS id, count(*) AS n FROM trade WHERE src_module <> dst_module GROUP BY 1),
    s AS (SELECT 's' || s_suppkey AS id, n_name AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0)
    SELECT module, id AS entry, coalesce(n, 0) AS in_calls FROM s LEFT JOIN n USING (id)
    QUALIFY row_number() OVER (PARTITION BY module ORDER BY coalesce(n, 0) DESC, id) = 1"""
)
def canonical_entry(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    symbols = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    symbols = symbols.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("n_name").alias("module"), (F.col("s_acctbal") > 0).alias("exported"))
    return layers.canonical_entry(symbols, A.trade(spark, sf))


@query(
    with_("tokens")
    + """, once AS (SELECT DISTINCT unnest(w) AS term, doc_id AS symbol, source AS module FROM tokens),
    m AS (SELECT term, module, count(*) AS n FROM once WHERE term NOT IN ('the', 'of', 'de', 'der') GROUP BY 1, 2),
    t AS (SELECT term, sum(n)::BIGINT AS n_symbols, count(*) AS n_modules FROM m GROUP BY 1 HAVING sum(n) >= 3)
    SELECT t.*, (SELECT module FROM m WHERE m.term = t.term ORDER BY n DESC, module LIMIT 1) AS home FROM t""",
)
def concepts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array_distinct(search.tokenize(F.col("text")))).alias("term"))
    return layers.concepts(docs.select("term", F.col("doc_id").alias("symbol"), F.col("source").alias("module")), ["the", "of", "de", "der"], once=True)


@query(with_("flow") + " SELECT flow, step, module FROM flow")
def flow_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = layers.flow_steps(A.flow(spark, sf), ["ts", "event_id"])
    return steps.select("flow", F.col("step").cast("long").alias("step"), "module")


@query(
    with_("flow")
    + """, p AS (SELECT lag(module) OVER (PARTITION BY flow ORDER BY step) AS source, module AS target FROM flow)
    SELECT source, target, count(*) AS weight FROM p WHERE source <> target GROUP BY 1, 2"""
)
def flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    return layers.flow_edges(layers.flow_steps(A.flow(spark, sf), ["ts", "event_id"]))


@query(
    """WITH f AS (SELECT o_custkey AS module, l_orderkey AS id, count(*) AS cyclomatic, max(l_linenumber)::BIGINT AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY depth * cyclomatic DESC, id) AS nth FROM f)
    SELECT module, max(cyclomatic) AS max_cyclomatic, round(avg(cyclomatic), 2) AS avg_cyclomatic, count(*) AS n_functions,
    string_agg(id::VARCHAR, ',' ORDER BY nth) FILTER (nth <= 3) AS hotspots FROM r GROUP BY 1"""
)
def complexity_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    functions = lines.groupBy(F.col("o_custkey").alias("module"), F.col("l_orderkey").alias("id"))
    functions = functions.agg(F.count("*").alias("cyclomatic"), F.max("l_linenumber").cast("long").alias("depth"))
    return layers.complexity(functions)


@query(
    """WITH leaf AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, 1::BIGINT AS n, length(c_name)::BIGINT AS size, c_acctbal AS risk
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    g AS (SELECT 'region' AS level, region AS name, * FROM leaf UNION ALL SELECT 'nation', nation, * FROM leaf UNION ALL SELECT 'segment', segment, * FROM leaf)
    SELECT level, name, count(*) AS n, sum(size)::BIGINT AS size, max(size) AS peak, round(sum(size * risk) / sum(size), 6) AS risk FROM g GROUP BY 1, 2"""
)
def weighted_rollup(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = leaves.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.length("c_name").cast("long").alias("size"), F.col("c_acctbal").alias("risk")
    )
    return layers.rollup(leaves, ["region", "nation", "segment"]).withColumn("risk", F.round("risk", 6))


@query(
    with_("trade")
    + """, l AS (SELECT src_module AS source, dst_module AS target, name, count(*) AS n FROM trade WHERE src_module <> dst_module GROUP BY 1, 2, 3)
    SELECT source, target, sum(n)::BIGINT AS weight, array_to_string(list_sort(list(name))[1:3], ',') AS labels FROM l GROUP BY 1, 2"""
)
def component_edges(spark: SparkSession, sf: str) -> DataFrame:
    return layers.component_edges(A.trade(spark, sf))


@query(
    """WITH f AS (SELECT p_partkey AS file, p_brand AS module FROM part), c AS (SELECT DISTINCT l_partkey AS file FROM lineitem WHERE l_returnflag = 'R')
    SELECT module, round(count(c.file) / count(*), 2) AS density FROM f LEFT JOIN c USING (file) GROUP BY 1"""
)
def test_density(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("module"))
    return layers.test_density(files, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("file")))


# Graph --------------------------------------------------------------------------------------------------------------


def _bfs_sql(seeds: str, depth: int, types: str, step: str) -> str:
    return f"""{with_("hier_nodes", "hier_edges", recursive=True)}, e AS (SELECT {step} FROM hier_edges WHERE type IN ({types})),
    seeds AS ({seeds}), walk AS (SELECT id, 0::BIGINT AS depth FROM seeds UNION SELECT e.b, walk.depth + 1 FROM walk JOIN e ON walk.id = e.a WHERE walk.depth < {depth})
    SELECT id, min(depth) AS depth FROM walk WHERE id NOT IN (SELECT id FROM seeds) GROUP BY 1"""


_ALL = "'CONTAINS', 'MEMBER_OF', 'CALLS'"


def _depths(df: DataFrame) -> DataFrame:
    return df.withColumn("depth", F.col("depth").cast("long"))


@query(_bfs_sql("SELECT id FROM hier_nodes WHERE name = 'ASIA'", 3, "'CONTAINS', 'CALLS'", "src AS a, dst AS b"))
def impact_downstream(spark: SparkSession, sf: str) -> DataFrame:
    seeds = A.hier_nodes(spark, sf).where("name = 'ASIA'").select("id")
    return _depths(graph.k_hop(A.hier_edges(spark, sf), seeds, 3, "downstream", ["CONTAINS", "CALLS"]))


@query(_bfs_sql("SELECT id FROM hier_nodes WHERE label = 'Order' AND name = '1-URGENT'", 2, _ALL, "dst AS a, src AS b"))
def impact_upstream(spark: SparkSession, sf: str) -> DataFrame:
    seeds = A.hier_nodes(spark, sf).where("label = 'Order' AND name = '1-URGENT'").select("id")
    return _depths(graph.k_hop(A.hier_edges(spark, sf), seeds, 2, "upstream"))


@query(_bfs_sql("SELECT id FROM hier_nodes WHERE label = 'Region'", 4, _ALL, "src AS a, dst AS b"))
def bfs_depths(spark: SparkSession, sf: str) -> DataFrame:
    return _depths(graph.k_hop(A.hier_edges(spark, sf), A.hier_nodes(spark, sf).where("label = 'Region'").select("id"), 4))


@query(
    with_("hier_nodes", "hier_edges")
    + """ SELECT n.id, dst AS neighbor, 'out' AS way, type FROM hier_edges JOIN hier_nodes n ON src = n.id WHERE label = 'Nation'
    UNION ALL SELECT n.id, src, 'in', type FROM hier_edges JOIN hier_nodes n ON dst = n.id WHERE label = 'Nation'"""
)
def neighbors_both(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbors(A.hier_edges(spark, sf), A.hier_nodes(spark, sf).where("label = 'Nation'").select("id"))


@query(
    with_("hier_nodes", "hier_edges")
    + """, near AS (SELECT src AS id, dst AS neighbor, 'out' AS way, lower(type) AS type FROM hier_edges UNION ALL SELECT dst, src, 'in', lower(type) FROM hier_edges)
    SELECT id, way, type, count(*) AS n, min(neighbor) AS first_neighbor, max(neighbor) AS last_neighbor, any_value(label) AS label FROM near JOIN hier_nodes USING (id) GROUP BY 1, 2, 3"""
)
def node_context(spark: SparkSession, sf: str) -> DataFrame:
    nodes = A.hier_nodes(spark, sf)
    return graph.context(nodes, A.hier_edges(spark, sf), nodes.select("id"))


@query(with_("hier_nodes") + " SELECT label, count(*) AS n, count(DISTINCT name) AS n_names FROM hier_nodes GROUP BY 1")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.hier_nodes(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@query(
    with_("hier_edges")
    + """, domain AS (SELECT unnest(['CALLS', 'CONTAINS', 'IMPORTS', 'MEMBER_OF']) AS type) SELECT type, count(src) AS n FROM domain LEFT JOIN hier_edges USING (type) GROUP BY 1"""
)
def relation_histogram(spark: SparkSession, sf: str) -> DataFrame:
    domain = spark.createDataFrame([("CALLS",), ("CONTAINS",), ("IMPORTS",), ("MEMBER_OF",)], "type string")
    counts = A.hier_edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    return domain.join(counts, "type", "left").fillna(0, ["n"])


def _rank_sql(rounds: int, focus: str) -> str:
    out = f"""{with_("seq")}, nodes AS (SELECT p_partkey AS id FROM part), focus AS ({focus}),
    t AS (SELECT id, CASE WHEN id IN (SELECT id FROM focus) THEN 1.0::DOUBLE / (SELECT count(*) FROM focus) ELSE 0.0 END AS t FROM nodes),
    d AS (SELECT src, count(*) AS degree FROM seq GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""
    for k in range(rounds):
        out += f""", l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM d)),
        g{k} AS (SELECT dst AS id, sum(rank / degree) AS got FROM seq JOIN d USING (src) JOIN r{k} ON r{k}.id = src GROUP BY 1),
        r{k + 1} AS (SELECT t.id, 0.15 * t + 0.85 * (coalesce(got, 0) + lost * t) AS rank FROM t LEFT JOIN g{k} USING (id) CROSS JOIN l{k})"""
    return out + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


@query(_rank_sql(5, "SELECT id FROM nodes"))
def pagerank_fixed(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.page_rank(_parts(spark, sf), A.seq(spark, sf), iterations=5, tolerance=0)
    return out.withColumn("rank", F.round("rank", 9))


@query(_rank_sql(4, "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3'"))
def pagerank_personalized(spark: SparkSession, sf: str) -> DataFrame:
    focus = table(spark, sf, "part").where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("id"))
    out = graph.page_rank(_parts(spark, sf), A.seq(spark, sf), focus, iterations=4, tolerance=0)
    return out.withColumn("rank", F.round("rank", 9))


_PATHS = f"""{with_("seq", recursive=True)}, step AS (SELECT src, dst FROM seq QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3),
    walk AS (SELECT [p_partkey] AS path, p_partkey AS tip FROM part UNION ALL SELECT list_append(path, dst), dst FROM walk JOIN step ON tip = src WHERE len(path) < 4 AND NOT list_contains(path, dst)),
    done AS (SELECT path FROM walk WHERE len(path) = 4 OR (len(path) = 3 AND NOT EXISTS (SELECT 1 FROM step WHERE src = tip AND NOT list_contains(path, dst))))"""


@query(_PATHS + " SELECT path[1] AS start, path[-1] AS finish, array_to_string(path, '>') AS path FROM done")
def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = graph.simple_paths(A.seq(spark, sf), _parts(spark, sf), hops=3, fan=3, least=3)
    return paths.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(
    _PATHS
    + """ SELECT path[1] AS start, path[-1] AS finish, array_to_string(path, '>') AS path FROM done
    QUALIFY row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, path) = 1"""
)
def trace_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    paths = graph.longest_per_ends(graph.simple_paths(A.seq(spark, sf), _parts(spark, sf), hops=3, fan=3, least=3))
    return paths.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(
    with_("hier_nodes", "hier_edges", recursive=True)
    + """, walk AS (SELECT id, 0::BIGINT AS level FROM hier_nodes WHERE id NOT IN (SELECT dst FROM hier_edges)
    UNION SELECT dst, level + 1 FROM walk JOIN hier_edges ON id = src) SELECT id, max(level) AS level FROM walk GROUP BY 1"""
)
def topo_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = graph.topological_levels(A.hier_nodes(spark, sf), A.hier_edges(spark, sf))
    return out.withColumn("level", F.col("level").cast("long"))


def _lpa_sql(rounds: int) -> str:
    out = f"""{with_("trade")}, e AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade), c0 AS (SELECT DISTINCT src AS id, src AS community FROM e)"""
    for k in range(rounds):
        out += f""", v{k} AS (SELECT src AS id, community, count(*) AS n FROM e JOIN c{k} ON dst = id GROUP BY 1, 2),
        c{k + 1} AS (SELECT id, community FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, community) = 1)"""
    return out + f" SELECT id, community FROM c{rounds}"


@query(_lpa_sql(3))
def communities(spark: SparkSession, sf: str) -> DataFrame:
    calls = materialize(A.trade(spark, sf).select("src", "dst").distinct(), "calls")
    nodes = calls.select(F.col("src").alias("id")).union(calls.select("dst")).distinct()
    return graph.label_propagation(nodes, calls, 3)


@query(
    with_("trade")
    + """, m AS (SELECT src AS id, src_module AS community FROM trade UNION SELECT dst, dst_module FROM trade),
    e AS (SELECT src_module AS community, dst_module AS other FROM trade UNION ALL SELECT dst_module, src_module FROM trade),
    s AS (SELECT community, count(*) AS members FROM m GROUP BY 1)
    SELECT community, members, count(*) FILTER (community = other) AS internal, count(*) AS total, round(count(*) FILTER (community = other) / count(*), 6) AS cohesion
    FROM e JOIN s USING (community) GROUP BY 1, 2"""
)
def community_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    calls = materialize(A.trade(spark, sf).select("src", "dst", "src_module", "dst_module"), "calls")
    members = calls.select(F.col("src").alias("id"), F.col("src_module").alias("community")).union(calls.select("dst", "dst_module")).distinct()
    return graph.cohesion(members, calls).withColumn("cohesion", F.round("cohesion", 6))


@query(
    with_("seq")
    + """, o AS (SELECT src AS id, count(*) AS callees FROM seq GROUP BY 1), i AS (SELECT dst AS id, count(*) AS callers FROM seq GROUP BY 1)
    SELECT id, coalesce(callers, 0) AS callers, callees, round(callees / (coalesce(callers, 0) + 1) * CASE WHEN p_retailprice > 1000 THEN 2.0 ELSE 1.0 END, 6) AS score
    FROM o JOIN part ON p_partkey = id LEFT JOIN i USING (id) WHERE p_type <> 'PROMO' ORDER BY score DESC, id LIMIT 200"""
)
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") > 1000).alias("exported"), (F.col("p_type") == "PROMO").alias("is_test"))
    return graph.entry_points(nodes, A.seq(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    with_("hier_nodes")
    + """, p AS (SELECT string_split(path, '/') AS p FROM hier_nodes), k AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p)
    SELECT DISTINCT array_to_string(p[1:depth], '/') AS id, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '/') END AS parent, depth FROM k"""
)
def containment_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _depths(graph.containment_tree(A.hier_nodes(spark, sf).select("path")))


@query(with_("hier_nodes", "hier_edges") + " SELECT src, dst, type FROM hier_edges WHERE src IN (SELECT id FROM hier_nodes WHERE label <> 'Customer') AND dst IN (SELECT id FROM hier_nodes WHERE label <> 'Customer')")
def dangling_gc(spark: SparkSession, sf: str) -> DataFrame:
    nodes = A.hier_nodes(spark, sf).where("label <> 'Customer'")
    return graph.drop_dangling(nodes, A.hier_edges(spark, sf)).select("src", "dst", "type")


@query(
    """WITH n AS (SELECT r_name AS h, n_name AS class FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT class, [class, h || '.base', h || '.mixin', 'root'] AS o FROM n
      UNION ALL SELECT r_name || '.base', [r_name || '.base', 'root'] FROM region UNION ALL SELECT r_name || '.mixin', [r_name || '.mixin', 'root'] FROM region UNION ALL SELECT 'root', ['root'] FROM region)
    SELECT class, unnest(range(len(o))) AS position, unnest(o) AS ancestor, 'c3' AS strategy FROM c"""
)
def mro_c3(spark: SparkSession, sf: str) -> DataFrame:
    """Nation below region below a root, and a diamond in each region."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaf = n.select(F.col("r_name").alias("hierarchy"), F.col("n_name").alias("class"), F.concat("r_name", F.lit(".base")).alias("parent"), F.lit(0).alias("seq"))
    mixin = n.select("r_name", "n_name", F.concat("r_name", F.lit(".mixin")), F.lit(1))
    r = table(spark, sf, "region")
    up = r.select("r_name", F.concat("r_name", F.lit(".base")), F.lit("root"), F.lit(0)).union(r.select("r_name", F.concat("r_name", F.lit(".mixin")), F.lit("root"), F.lit(0)))
    return graph.method_resolution_order(leaf.union(mixin).union(up))


# Search -------------------------------------------------------------------------------------------------------------

_TERMS = ("thin", "erand", "station", "der")
_BM25 = (
    with_("tokens")
    + """, q AS (SELECT unnest(['thin', 'erand', 'station', 'der']) AS term), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS av FROM tokens),
    tf AS (SELECT doc_id AS id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM tokens CROSS JOIN q),
    df AS (SELECT term, count(*) FILTER (tf > 0)::DOUBLE AS df FROM tf GROUP BY 1),
    scored AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))) AS score FROM tf JOIN df USING (term) CROSS JOIN s GROUP BY 1 HAVING sum(tf) > 0)"""
)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query(_BM25 + " SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 20")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.bm25(_docs(spark, sf), " ".join(_TERMS)).withColumn("score", F.round("score", 6))
    return search.top(found, 20)


@query(
    _BM25
    + ", "
    + A.SQL["hier_nodes"]
    + """, t AS (SELECT 'text' AS origin, id::VARCHAR AS id, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, id::VARCHAR LIMIT 15),
    c AS (SELECT 'code' AS origin, id, CASE WHEN lower(name) = 'asia' THEN 1.0 WHEN contains(lower(name), 'asia') THEN 0.85 WHEN contains(lower(id), 'asia') THEN 0.75
      WHEN contains(lower(path), 'asia') THEN 0.55 ELSE 0.1 END AS score FROM hier_nodes WHERE contains(name, 'ASIA') OR contains(path, 'ASIA') OR contains(id, 'ASIA') ORDER BY score DESC, id LIMIT 15)
    SELECT origin, id, score, row_number() OVER (ORDER BY origin DESC, score DESC, id) AS position FROM (SELECT * FROM t UNION ALL SELECT * FROM c) QUALIFY position <= 15"""
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    text = search.bm25(_docs(spark, sf), " ".join(_TERMS)).select(F.col("id").cast("string").alias("id"), F.round("score", 6).alias("score"))
    out = search.hybrid(text, search.code_search(A.hier_nodes(spark, sf), "ASIA"), 15)
    return out.withColumn("position", F.col("position").cast("long"))


_QUERY = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_COSINE = f"""SELECT vec_id AS id, label, round(list_dot_product(embedding::DOUBLE[], {_QUERY}::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))
    / sqrt(list_dot_product({_QUERY}::DOUBLE[], {_QUERY}::DOUBLE[])), 6) AS score FROM embeddings"""


def _vector_hits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    given = e.orderBy("vec_id").select("embedding").first()[0]
    scored = search.vector_search(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), given)
    return scored.withColumn("score", F.round("score", 6))


@query(f"SELECT id, score FROM ({_COSINE}) ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top(_vector_hits(spark, sf), 10)


@query(f"SELECT id, score FROM (SELECT * FROM ({_COSINE}) ORDER BY score DESC, id LIMIT 50) WHERE label < 5")
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    live = table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("id"))
    return search.top(_vector_hits(spark, sf), 50).join(live, "id", "left_semi")


# Change -------------------------------------------------------------------------------------------------------------


@query(
    with_("snap")
    + """, a AS (SELECT id, hash FROM counted WHERE tag = (SELECT min(tag) FROM months)), b AS (SELECT id, hash FROM counted WHERE tag = (SELECT max(tag) FROM months))
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.hash IS DISTINCT FROM b.hash THEN 'changed' ELSE 'unchanged' END AS status
    FROM a FULL JOIN b ON a.id = b.id"""
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(A.snapshots(spark, sf).where("hash is not null"), "snap")
    ends = A.snapshots(spark, sf).agg(F.min("tag").alias("a"), F.max("tag").alias("b")).first()
    return change.diff(rows.where(F.col("tag") == ends.a), rows.where(F.col("tag") == ends.b))


@query(
    with_("snap")
    + """ SELECT id, count(*) FILTER (changed) AS n_changes, max(tag) FILTER (changed) AS last_change, round(count(*) FILTER (changed) / count(*), 4) AS ratio,
    CASE WHEN count(*) FILTER (changed) / count(*) <= 0.2 THEN 'stable' WHEN count(*) FILTER (changed) / count(*) <= 0.5 THEN 'active' ELSE 'volatile' END AS stability FROM transitions GROUP BY 1"""
)
def churn(spark: SparkSession, sf: str) -> DataFrame:
    return change.churn(A.snapshots(spark, sf))


@query(
    with_("snap")
    + """, h AS (SELECT tag, id FROM transitions WHERE changed), n AS (SELECT id, count(*) AS n FROM h GROUP BY 1),
    p AS (SELECT x.id AS a, y.id AS b, count(*) AS co FROM h x JOIN h y ON x.tag = y.tag AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT a, b, co, na.n + nb.n - co AS either, round(co / (na.n + nb.n - co), 2) AS coupling FROM p JOIN n na ON a = na.id JOIN n nb ON b = nb.id WHERE co / (na.n + nb.n - co) >= 0.4"""
)
def temporal_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return change.temporal_coupling(A.snapshots(spark, sf))


_COCHANGE = """c0 AS (SELECT DISTINCT l_orderkey AS "commit", p_brand AS file FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT * FROM c0 WHERE "commit" IN (SELECT "commit" FROM c0 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)), n AS (SELECT file, count(*) AS n FROM c GROUP BY 1),
    p AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM c x JOIN c y ON x."commit" = y."commit" AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2),
    rules AS (SELECT a, b, together, round(together / greatest(na.n, nb.n), 3) AS confidence FROM p JOIN n na ON a = na.file JOIN n nb ON b = nb.file)"""


def _cochange(spark: SparkSession, sf: str, confidence: float) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return change.cochange(lines.select(F.col("l_orderkey").alias("commit"), F.col("p_brand").alias("file")), confidence=confidence)


@query(f"WITH {_COCHANGE} SELECT * FROM rules WHERE confidence >= 0.1")
def cochange_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _cochange(spark, sf, 0.1)


@query(f"WITH {_COCHANGE} SELECT * FROM rules WHERE confidence >= 0.1 ORDER BY confidence DESC, together DESC, a, b LIMIT 25")
def first_cochange_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The report's first 25 rules."""
    return change.ranked_rules(_cochange(spark, sf, 0.1), 25)


_RANGES = """r AS (SELECT o_custkey AS key, o_orderkey AS a_id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 30 AS e FROM orders)"""


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("a_id"), day.alias("start"), (day + 30).alias("end"))


@query(
    f"""WITH {_RANGES}, m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT key, min(s) AS start, max(e) AS "end" FROM i GROUP BY key, island"""
)
def range_merge(spark: SparkSession, sf: str) -> DataFrame:
    return change.merge_ranges(_ranges(spark, sf).drop("a_id"))


@query(f"WITH {_RANGES} SELECT x.key, x.a_id, y.a_id AS b_id FROM r x JOIN r y ON x.key = y.key AND x.s <= y.e AND x.e >= y.s AND x.a_id < y.a_id")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranges(spark, sf)
    return change.overlaps(r, r.withColumnRenamed("a_id", "b_id"), 30).where("a_id < b_id")


@query(
    with_("trade")
    + """, m AS (SELECT DISTINCT n_name AS module FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9900)
    SELECT 'module' AS kind, module AS id FROM m UNION SELECT 'contract', src_module || '--' || dst_module FROM trade
    WHERE src_module <> dst_module AND (src_module IN (SELECT module FROM m) OR dst_module IN (SELECT module FROM m))"""
)
def delta_affected(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    files = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("file"), F.col("n_name").alias("module"), "c_mktsegment", "c_acctbal")
    return change.affected(files.where("c_mktsegment = 'BUILDING' AND c_acctbal > 9900").select("file"), files.select("file", "module"), A.trade(spark, sf))


@query(
    """WITH d AS (SELECT doc_id AS id, n_chars AS struct_hash, quality * n_chars AS source_hash FROM documents LEFT JOIN labels USING (doc_id))
    SELECT id, CASE WHEN source_hash IS NULL THEN 'missing' ELSE 'outdated' END AS reason FROM d WHERE source_hash IS NULL OR source_hash <> struct_hash"""
)
def stale_items(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return change.stale(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("struct_hash"), (F.col("quality") * F.col("n_chars")).alias("source_hash")))


@query("SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return change.latest(events, "user_id", [F.col("ts"), F.col("event_id")])


@query("SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same state as :func:`upsert_latest`, reached by a stream over the table's files."""
    return upsert.replay(spark, f"{sf}/events.parquet", ["user_id", "event_type", "value", "ts", "event_id"], "user_id", ["ts", "event_id"])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by an event-time window with a watermark, over a stream of the table's files."""
    return upsert.windows(spark, f"{sf}/events.parquet", "1 hour").withColumn("total", F.round("total", 4))


@query(
    """WITH refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref, o_custkey AS file, l_partkey AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
    syms AS (SELECT l_suppkey AS symbol, o_custkey AS file, l_partkey AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
    imps AS (SELECT DISTINCT a.c_custkey AS file, a.c_custkey + 1 AS target FROM customer a),
    c AS (SELECT ref, symbol, CASE WHEN refs.file = syms.file THEN 1 WHEN imps.file IS NOT NULL THEN 2 ELSE 3 END AS tier FROM refs JOIN syms USING (name)
      LEFT JOIN imps ON imps.file = refs.file AND imps.target = syms.file)
    SELECT ref, symbol, tier, [0.95, 0.9, 0.5][tier]::DOUBLE AS confidence FROM c QUALIFY tier = min(tier) OVER (PARTITION BY ref)"""
)
def tiered_resolution(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    refs = lines.where("l_returnflag = 'A'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.col("o_custkey").alias("file"), F.col("l_partkey").alias("name"))
    syms = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("symbol"), F.col("o_custkey").alias("file"), F.col("l_partkey").alias("name"))
    imports = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") + 1).alias("target"))
    return change.resolve(refs, syms, imports)


@query(
    """WITH i AS (SELECT o_custkey AS file, l_suppkey AS target, min(l_orderkey) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    e AS (SELECT DISTINCT l_suppkey AS target, l_returnflag || l_linestatus || l_linenumber AS name FROM lineitem),
    f AS (SELECT file, name, seq, target FROM i JOIN e USING (target) QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY seq, target) = 1)
    SELECT file, name, target AS symbol FROM f QUALIFY row_number() OVER (PARTITION BY file ORDER BY seq, name) <= 1000"""
)
def wildcard_bindings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    imports = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("file"), F.col("l_suppkey").alias("target"))
    exports = lines.select(F.col("l_suppkey").alias("target"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("name"), F.col("l_suppkey").alias("symbol")).distinct()
    return change.wildcard_bindings(imports.agg(F.min("l_orderkey").alias("seq")), exports)


@query(
    with_("trade")
    + """ SELECT src, dst, round(max(CASE WHEN src_module = dst_module THEN 0.95 ELSE sqrt(0.5 * 0.9) END), 6) AS confidence FROM trade GROUP BY 1, 2"""
)
def edge_confidence(spark: SparkSession, sf: str) -> DataFrame:
    confidence = F.when(F.col("src_module") == F.col("dst_module"), F.lit(0.95)).otherwise(F.sqrt(F.lit(0.5) * 0.9))
    return A.trade(spark, sf).groupBy("src", "dst").agg(F.round(F.max(confidence), 6).alias("confidence"))


# Decision -----------------------------------------------------------------------------------------------------------

_UNITS = """w AS (SELECT n_name AS family, 's' || s_suppkey AS unit, CASE WHEN s_acctbal > 5000 THEN 'repository' WHEN s_acctbal > 0 THEN 'validator' ELSE 'unknown' END AS kind,
      r_name || s_suppkey % 3 AS module, 'f' || s_suppkey % 200 AS file, ['a' || s_suppkey % 2, 'b' || s_suppkey % 3, 'c' || s_suppkey % 4, 'd' || s_suppkey % 5] AS words
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    raw AS (SELECT x.family, x.unit AS from_unit, y.unit AS to_unit, x.kind = y.kind AND x.module = y.module AND x.kind <> 'unknown' AS hard, (x.kind = y.kind)::INT * 0.45::DOUBLE + (x.module = y.module)::INT * 0.3::DOUBLE
      + len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) * 0.25::DOUBLE AS score FROM w x JOIN w y ON x.family = y.family AND x.unit < y.unit),
    sym AS (SELECT family, from_unit, to_unit, round(score, 3) AS score, CASE WHEN hard THEN 'hard' ELSE 'soft' END AS strength FROM raw WHERE hard OR score >= 0.55)"""


def _units(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    u = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = lambda letter, n: F.concat(F.lit(letter), (F.col("s_suppkey") % n).cast("string"))
    return u.select(
        F.col("n_name").alias("family"), F.concat(F.lit("s"), "s_suppkey").alias("unit"),
        F.when(F.col("s_acctbal") > 5000, "repository").when(F.col("s_acctbal") > 0, "validator").otherwise("unknown").alias("kind"),
        F.concat("r_name", (F.col("s_suppkey") % 3).cast("string")).alias("module"), part("f", 200).alias("file"),
        F.array(part("a", 2), part("b", 3), part("c", 4), part("d", 5)).alias("words"),
    )


@query(f"WITH {_UNITS} SELECT * FROM sym")
def symmetry_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return decision.symmetry_edges(_units(spark, sf))


@query(
    f"""WITH {_UNITS}, c0 AS (SELECT DISTINCT l_orderkey AS "commit", 'f' || l_suppkey % 200 AS file FROM lineitem),
    c AS (SELECT * FROM c0 WHERE "commit" IN (SELECT "commit" FROM c0 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)), n AS (SELECT file, count(*) AS n FROM c GROUP BY 1),
    p AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM c x JOIN c y ON x."commit" = y."commit" AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2),
    rules AS (SELECT a, b, round(together / greatest(na.n, nb.n), 3) AS confidence FROM p JOIN n na ON a = na.file JOIN n nb ON b = nb.file WHERE round(together / greatest(na.n, nb.n), 3) >= 0.04),
    both_ AS (SELECT a, b, confidence FROM rules UNION ALL SELECT b, a, confidence FROM rules),
    m AS (SELECT from_unit AS target, to_unit AS unit, 1 AS priority, CASE strength WHEN 'hard' THEN 'must_review' ELSE 'should_review' END AS level, 'symmetry' AS reason, score AS confidence FROM sym
      UNION ALL SELECT to_unit, from_unit, 1, CASE strength WHEN 'hard' THEN 'must_review' ELSE 'should_review' END, 'symmetry', score FROM sym
      UNION ALL SELECT x.unit, y.unit, 2, 'should_review', 'cochange', confidence FROM both_ JOIN w x ON x.file = a JOIN w y ON y.file = b WHERE x.unit <> y.unit
      UNION ALL SELECT x.unit, y.unit, 3, 'must_change_if_strategy_selected', 'family', 0.5 FROM w x JOIN w y ON x.family = y.family AND x.unit <> y.unit)
    SELECT target, unit, level, reason, confidence::DOUBLE AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY target, unit ORDER BY priority, confidence DESC) = 1"""
)
def closure_members(spark: SparkSession, sf: str) -> DataFrame:
    units = materialize(_units(spark, sf), "units")
    commits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("f"), (F.col("l_suppkey") % 200).cast("string")).alias("file"))
    return decision.closure_members(units, None, change.cochange(commits, confidence=0.04))


#: Orders as flows of three steps; names, roles and contracts by their columns.
_FLOWS = """o AS (SELECT o_orderkey AS flow, CASE o_orderstatus WHEN 'F' THEN 'createOrder' WHEN 'O' THEN 'listOrders' ELSE 'processOrder' END AS f0, 'check' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS f1,
      'svc' || o_custkey % 3 AS m1, CASE left(o_orderpriority, 1) WHEN '1' THEN 'saveOrder' WHEN '2' THEN 'readStock' WHEN '3' THEN 'renderInvoice' WHEN '4' THEN 'notifyUser' ELSE 'storeEvent' END AS f2
      FROM orders JOIN customer ON o_custkey = c_custkey),
    p0 AS (SELECT flow, [f0, f1, f2] AS functions, ['api', m1, 'db'] AS modules, f0 AS entry, f2 AS sink, CASE WHEN m1 = 'svc1' THEN ['api--svc1', 'svc1--db'] WHEN m1 = 'svc2' THEN ['api--svc2'] ELSE [] END AS contracts FROM o),
    st AS (SELECT flow, unnest(functions) AS name, unnest(modules) AS module FROM p0),
    fn AS (SELECT module || '.' || name AS id, name, module, CASE module WHEN 'api' THEN 'prod_entrypoint' WHEN 'svc0' THEN 'peripheral' ELSE 'prod_core' END AS role,
      CASE module WHEN 'api' THEN 3.0 ELSE 0.5 END::DOUBLE AS entry_score, count(*) AS callers FROM st GROUP BY 1, 2, 3, 4, 5),
    act(w, generic) AS (SELECT unnest(string_split('auth authorize build commit create delete dispatch fetch get log persist post prepare put query read save send set start store sync trigger update validate write', ' ')), FALSE),
    rw AS (SELECT name, unnest(list_filter(string_split(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '), lambda x: len(x) > 1)) AS word FROM (SELECT DISTINCT name FROM fn)),
    rt AS (SELECT name, word, CASE WHEN word LIKE '%ing' AND left(word, -3) IN (SELECT w FROM act) THEN left(word, -3) ELSE word END AS root FROM rw),
    g AS (SELECT root, count(*) AS everywhere FROM rt JOIN fn USING (name) GROUP BY 1),
    sk AS (SELECT *, CASE WHEN sink IN ('saveOrder', 'storeEvent') OR entry = 'createOrder' THEN 'repository_write' WHEN sink = 'readStock' OR entry = 'listOrders' THEN 'repository_read' ELSE 'validation' END AS sink_role FROM p0),
    sg AS (SELECT flow, unnest(list_distinct(list_concat([entry, sink], CASE WHEN modules[2] = 'svc0' THEN [] ELSE [functions[2]] END))) AS name FROM sk WHERE entry <> 'createOrder'),
    sc AS (SELECT flow, root, count(*) AS here, any_value(everywhere) AS everywhere, root IN (SELECT w FROM act) AS specific FROM sg JOIN rt USING (name) JOIN g USING (root) WHERE len(root) >= 3 GROUP BY 1, 2),
    hd AS (SELECT flow, root AS head FROM sc QUALIFY row_number() OVER (PARTITION BY flow ORDER BY specific DESC, round(here / everywhere + CASE WHEN specific THEN 0.4 ELSE 0 END, 9) DESC, here DESC, len(root) DESC, root) = 1),
    pi0 AS (SELECT sk.*, coalesce(head, 'create') || ':' || sink_role AS family FROM sk LEFT JOIN hd USING (flow)),
    pi AS (SELECT *, left(sha256('{"familyKey":"' || family || '","functions":"' || array_to_string(functions, '>') || '","modules":"' || array_to_string(modules, '>') || '","source":"' || flow || '"}'), 8) AS id, 'flow_trigger' AS entry_kind FROM pi0)"""


def _flows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps of flows, functions, and paths."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    status, first = F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))
    f0 = F.when(status == "F", "createOrder").when(status == "O", "listOrders").otherwise("processOrder")
    f1 = F.concat(F.lit("check"), F.upper(F.left("c_mktsegment", F.lit(1))), F.lower(F.expr("substring(c_mktsegment, 2)")))
    f2 = F.when(first == "1", "saveOrder").when(first == "2", "readStock").when(first == "3", "renderInvoice").when(first == "4", "notifyUser").otherwise("storeEvent")
    step = lambda k, f, m: F.struct(F.lit(k).alias("step"), f.alias("function"), m.alias("module"))
    steps = F.array(step(0, f0, F.lit("api")), step(1, f1, F.concat(F.lit("svc"), (F.col("o_custkey") % 3).cast("string"))), step(2, f2, F.lit("db")))
    flows = o.select(F.col("o_orderkey").alias("flow"), F.inline(steps))
    role = F.when(F.col("module") == "api", "prod_entrypoint").when(F.col("module") == "svc0", "peripheral").otherwise("prod_core")
    functions = flows.groupBy("module", F.col("function").alias("name")).agg(F.count("*").alias("callers")).select(
        F.concat_ws(".", "module", "name").alias("id"), "name", "module", role.alias("role"), F.when(F.col("module") == "api", 3.0).otherwise(0.5).alias("entry_score"),
        "callers", F.lit(True).alias("public"),
    )
    functions = materialize(functions, "functions")
    contracts = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(f"{a}--{b}").alias("id"), F.lit(a).alias("consumer"), F.lit(b).alias("provider")) for a, b in (("api", "svc1"), ("svc1", "db"), ("api", "svc2"))
    ])))
    return flows, functions, materialize(families.path_instances(flows, functions, contracts), "paths")


@query(f"WITH {_FLOWS} SELECT id, flow, family, functions, modules, contracts, entry, entry_kind, sink, sink_role FROM pi")
def path_instances(spark: SparkSession, sf: str) -> DataFrame:
    return _flows(spark, sf)[2]


@query(
    f"""WITH {_FLOWS}, r AS (SELECT family, string_agg(DISTINCT word, ',' ORDER BY word) AS resources FROM (SELECT DISTINCT family, unnest(functions) AS name FROM pi) JOIN rt USING (name)
      WHERE word NOT IN (SELECT w FROM act) AND word NOT IN ('add', 'check', 'execute', 'handle', 'init', 'list', 'load', 'process', 'run') GROUP BY 1)
    SELECT family, replace(replace(family, ':', ' '), '_', ' ') AS name, any_value(sink_role) AS sink_role, any_value(entry_kind) AS entry_kinds, count(*) AS n_paths, any_value(resources) AS resources,
    round(least(0.95, 0.55 + 0.15 * (count(*) - 1)), 4)::DOUBLE AS confidence, CASE WHEN count(*) >= 2 THEN 'confirmed' ELSE 'candidate' END AS status FROM pi JOIN r USING (family) GROUP BY 1"""
)
def concern_families(spark: SparkSession, sf: str) -> DataFrame:
    return families.concern_families(_flows(spark, sf)[2])


@query(
    f"""WITH {_FLOWS}, s AS (SELECT id, flow, family, unnest(functions) AS symbol, unnest(modules) AS module FROM pi)
    SELECT module || ':' || symbol AS unit, arg_min(family, id || family) AS family, module, symbol,
    CASE WHEN symbol LIKE 'check%' THEN 'validator' WHEN regexp_matches(symbol, '^(save|store|read)') THEN 'repository' ELSE 'unknown' END AS kind, count(DISTINCT flow) AS n_paths FROM s GROUP BY 3, 4"""
)
def operation_units(spark: SparkSession, sf: str) -> DataFrame:
    return families.operation_units(_flows(spark, sf)[2])


@query(
    f"""WITH {_FLOWS}, fan AS (SELECT name AS sink, arg_max(callers, id) AS callers FROM fn GROUP BY 1), mx AS (SELECT max(callers) AS most FROM fn),
    m AS (SELECT pi.*, array_to_string(modules, '>') || '|' || sink || '|' || sink_role || '|' || array_to_string(contracts, '>') AS signature FROM pi),
    gr AS (SELECT family, signature, any_value(sink_role) AS sink_role, count(*) AS n_paths, max(callers / most) AS fan_in, max(CASE WHEN len(contracts) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS contract_reuse, 0.75::DOUBLE AS entry_strength,
      avg(list_sum([0.95::DOUBLE, CASE modules[2] WHEN 'svc0' THEN 0.45 ELSE 1 END, 1]) / 3) AS role_purity FROM m JOIN fan USING (sink) CROSS JOIN mx GROUP BY 1, 2),
    al AS (SELECT family, count(*) AS n_all FROM pi GROUP BY 1),
    s AS (SELECT *, n_paths / n_all AS coverage, round(n_paths / n_all * 0.5::DOUBLE + fan_in * 0.2::DOUBLE + contract_reuse * 0.15::DOUBLE + entry_strength * 0.15::DOUBLE, 9) AS score FROM gr JOIN al USING (family)),
    r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY family ORDER BY score DESC, n_paths DESC, signature)),
    v AS (SELECT *, round(greatest(0, least(1, score * 0.7::DOUBLE + role_purity * 0.3::DOUBLE - CASE WHEN split_part(family, ':', 1) IN ('process', 'build', 'set', 'run', 'add', 'check', 'misc', 'unknown') THEN 0.18::DOUBLE ELSE 0 END)), 3) AS visibility FROM r WHERE nth = 1)
    SELECT family, signature, n_paths, round(coverage, 3) AS coverage, round(fan_in, 3) AS fan_in, round(contract_reuse, 3) AS contract_reuse, round(entry_strength, 3) AS entry_strength, round(role_purity, 3) AS role_purity, visibility,
    round(score, 3) AS confidence, n_all - n_paths AS deviations, CASE WHEN n_paths >= 2 AND score >= 0.55 AND visibility >= 0.66 AND (nxt IS NULL OR round(score - nxt, 9) >= 0.05) THEN 'canonical' ELSE 'candidate' END AS status FROM v"""
)
def canonical_paths(spark: SparkSession, sf: str) -> DataFrame:
    _, functions, paths = _flows(spark, sf)
    return families.canonical_paths(paths, functions)


_BEST = f"""WITH {_FLOWS}, fan AS (SELECT name AS sink, arg_max(callers, id) AS callers FROM fn GROUP BY 1), mx AS (SELECT max(callers) AS most FROM fn),
    m AS (SELECT pi.*, array_to_string(modules, '>') || '|' || sink || '|' || sink_role || '|' || array_to_string(contracts, '>') AS signature FROM pi), al AS (SELECT family, count(*) AS n_all FROM pi GROUP BY 1),
    gr AS (SELECT family, signature, any_value(sink_role) AS sink_role, count(*) AS n_paths, max(callers / most) AS fan_in, max(CASE WHEN len(contracts) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS reuse, avg(list_sum([0.95::DOUBLE, CASE modules[2] WHEN 'svc0' THEN 0.45 ELSE 1 END, 1]) / 3) AS purity FROM m JOIN fan USING (sink) CROSS JOIN mx GROUP BY 1, 2),
    s AS (SELECT *, round(n_paths / n_all * 0.5::DOUBLE + fan_in * 0.2::DOUBLE + reuse * 0.15::DOUBLE + 0.75::DOUBLE * 0.15::DOUBLE, 9) AS score FROM gr JOIN al USING (family)),
    r AS (SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY family ORDER BY score DESC, n_paths DESC, signature)),
    v AS (SELECT *, round(greatest(0, least(1, score * 0.7::DOUBLE + purity * 0.3::DOUBLE - CASE WHEN split_part(family, ':', 1) IN ('process', 'build', 'set', 'run', 'add', 'check', 'misc', 'unknown') THEN 0.18::DOUBLE ELSE 0 END)), 3) AS visibility FROM r WHERE nth = 1),
    bs AS (SELECT *, n_paths >= 2 AND score >= 0.55 AND visibility >= 0.66 AND (nxt IS NULL OR round(score - nxt, 9) >= 0.05) AS canonical FROM v), gp AS (SELECT m.* FROM m JOIN bs ON bs.family = m.family AND bs.signature = m.signature),
    md AS (SELECT family, arg_min(functions, id || flow::VARCHAR) AS symbols, arg_min(modules, id || flow::VARCHAR) AS modules, min(id) AS model, list_sort(list(DISTINCT entry)) AS entries FROM gp GROUP BY 1)"""


@query(_BEST + " SELECT family, 'canonical:' || family AS canonical, modules[-1] AS owner, entries, model, symbols FROM md")
def canonical_details(spark: SparkSession, sf: str) -> DataFrame:
    _, functions, paths = _flows(spark, sf)
    return families.canonical_details(paths, families.canonical_paths(paths, functions))


@query(_BEST + " SELECT family, id, flow FROM gp")
def canonical_members(spark: SparkSession, sf: str) -> DataFrame:
    _, functions, paths = _flows(spark, sf)
    return families.canonical_members(paths, families.canonical_paths(paths, functions))


@query(
    _BEST
    + """ SELECT m.family, id, flow, m.modules[-1] AS module, sink AS symbol, list_filter(symbols, lambda x: NOT list_contains(functions, x)) AS missing, 'deviates from ' || symbols[-1] AS reason FROM m JOIN md ON md.family = m.family JOIN bs ON bs.family = m.family WHERE bs.signature <> m.signature"""
)
def path_deviations(spark: SparkSession, sf: str) -> DataFrame:
    _, functions, paths = _flows(spark, sf)
    return families.deviations(paths, families.canonical_paths(paths, functions))


@query(
    _BEST
    + """, su AS (SELECT id, family, unnest(functions) AS symbol, unnest(modules) AS module FROM pi), un AS (SELECT module || ':' || symbol AS unit, module, arg_min(family, id || family) AS family FROM su GROUP BY 1, 2),
    ow AS (SELECT family, count(*) AS n_units, count(DISTINCT module) AS n_modules, arg_min(module, unit) AS owner FROM un GROUP BY 1)
    SELECT al.family, CASE WHEN NOT canonical AND al.family LIKE '%:repository_write' THEN 'lift_to_canonical_path' WHEN n_modules > 1 THEN 'extract_service' ELSE 'extract_helper' END AS level, coalesce(owner, 'unknown') AS owner, coalesce(n_units, 0) AS n_units, al.n_all AS n_paths,
    round(least(0.95, 0.55 + al.n_all * 0.07), 3)::DOUBLE AS confidence, CASE WHEN al.n_all >= 4 THEN 'recommended' ELSE 'candidate' END AS status FROM al JOIN bs ON bs.family = al.family LEFT JOIN ow ON ow.family = al.family WHERE al.n_all >= 3"""
)
def abstraction_details(spark: SparkSession, sf: str) -> DataFrame:
    _, functions, paths = _flows(spark, sf)
    return decision.abstraction_details(families.concern_families(paths), families.operation_units(paths), families.canonical_paths(paths, functions))


@query(f"WITH {_FLOWS} SELECT family, count(*) AS n_paths, round(least(0.95, 0.55 + 0.07 * count(*)), 4)::DOUBLE AS confidence FROM pi GROUP BY 1 HAVING count(*) >= 3")
def abstraction_opportunities(spark: SparkSession, sf: str) -> DataFrame:
    return decision.abstractions(_flows(spark, sf)[2])


_SHAPE = """k AS (SELECT route, list(DISTINCT key) AS keys FROM props GROUP BY 1),
    a AS (SELECT route, list(DISTINCT key || CASE WHEN consumer % 3 = 0 THEN '' ELSE consumer::VARCHAR END) AS used FROM props WHERE route <> 'view' GROUP BY 1),
    shape AS (SELECT route, len(keys) AS n_keys, len(used) AS n_accessed, array_to_string(list_sort(list_filter(used, lambda x: NOT list_contains(keys, x))), ',') AS missing FROM k JOIN a USING (route))"""


def _shape(spark: SparkSession, sf: str) -> DataFrame:
    keys = A.event_keys(spark, sf)
    used = keys.where("route <> 'view'").select("route", F.concat("key", F.when(F.col("consumer") % 3 == 0, "").otherwise(F.col("consumer").cast("string"))).alias("key"))
    out = decision.shape_check(keys.select("route", "key").distinct(), used.distinct())
    return out.withColumns({"n_keys": F.col("n_keys").cast("long"), "n_accessed": F.col("n_accessed").cast("long")})


@query(f"{with_('props')}, {_SHAPE} SELECT *, CASE WHEN missing = '' THEN 'OK' ELSE 'MISMATCH' END AS status FROM shape")
def shape_check(spark: SparkSession, sf: str) -> DataFrame:
    return _shape(spark, sf)


@query(
    f"""{with_('props')}, {_SHAPE}, n AS (SELECT route, count(DISTINCT consumer) AS consumers FROM props GROUP BY 1),
    m AS (SELECT *, CASE WHEN missing = '' THEN 0 ELSE len(string_split(missing, ',')) END AS mismatches FROM shape JOIN n USING (route))
    SELECT route, consumers, mismatches, CASE WHEN consumers >= 10 OR mismatches >= 4 THEN 'HIGH' WHEN consumers >= 4 OR mismatches >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM m"""
)
def api_impact(spark: SparkSession, sf: str) -> DataFrame:
    n = A.event_keys(spark, sf).groupBy("route").agg(F.count_distinct("consumer").alias("consumers"))
    m = _shape(spark, sf).join(n, "route")
    mismatches = F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ","))).cast("long")
    m = m.withColumn("mismatches", mismatches)
    return m.select("route", "consumers", "mismatches", decision.api_risk(F.col("consumers"), F.col("mismatches")).alias("risk"))


@query(
    with_("trade")
    + """, called AS (SELECT DISTINCT dst FROM trade WHERE name = 'Brand#3')
    SELECT 'dead-code' AS rule, 's' || s_suppkey AS subject, 1::BIGINT AS n FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT dst FROM called)
    UNION ALL SELECT 'forbidden', src_module || '->' || dst_module, count(*) FROM trade WHERE (src_module, dst_module) IN (SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) GROUP BY 2
    UNION ALL SELECT 'no-orders', 'c' || c_custkey, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def lint_union(spark: SparkSession, sf: str) -> DataFrame:
    calls = materialize(A.trade(spark, sf), "trade")
    symbols = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_name").alias("src_module"), "n_regionkey", F.col("n_nationkey").alias("x"))
    b = n.select(F.col("n_name").alias("dst_module"), "n_regionkey", F.col("n_nationkey").alias("y"))
    rules = a.join(b, "n_regionkey").where("x < y").select("src_module", "dst_module")
    dead = decision.dead_code(symbols, calls.where("name = 'Brand#3'")).select(F.lit("dead-code").alias("rule"), F.col("id").alias("subject"), F.lit(1).cast("long").alias("n"))
    bad = decision.forbidden(calls, rules).select(F.lit("forbidden"), F.concat("src_module", F.lit("->"), "dst_module"), "n")
    idle = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return dead.union(bad).union(idle.select(F.lit("no-orders"), F.concat(F.lit("c"), "c_custkey"), F.lit(1).cast("long")))


_RISK = (
    with_("snap", "trade")
    + """, ch AS (SELECT id AS module, count(*) FILTER (changed) / count(*) AS ratio FROM transitions GROUP BY 1),
    dep AS (SELECT dst_module AS module, count(DISTINCT src_module) AS in_degree FROM trade WHERE src_module <> dst_module GROUP BY 1),
    cx AS (SELECT src_module AS module, count(DISTINCT name) AS max_nesting, count(DISTINCT dst) % 9 AS max_cyclomatic FROM trade GROUP BY 1),
    dn AS (SELECT src_module AS module, count(*) FILTER (name < 'Brand#2') / count(*) AS density FROM trade GROUP BY 1),
    f AS (SELECT module, least(25, floor(max_nesting * max_cyclomatic / 30 * 25 + 0.5))::INT AS complexity, CASE WHEN ratio <= 0.2 THEN 5 WHEN ratio <= 0.5 THEN 15 ELSE 25 END AS churn,
      least(25, floor(in_degree / greatest(25 * 0.5, 5) * 25 + 0.5))::INT AS coupling, CASE WHEN density > 0.4 THEN 12 ELSE floor((1 - density) * 25 + 0.5)::INT END AS coverage
      FROM ch JOIN dep USING (module) JOIN cx USING (module) JOIN dn USING (module)),
    t AS (SELECT *, complexity + churn + coupling + coverage AS risk FROM f)
    SELECT *, CASE WHEN risk <= 25 THEN 'LOW' WHEN risk <= 50 THEN 'MEDIUM' WHEN risk <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS bucket FROM t"""
)


@query(_RISK)
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    calls = materialize(A.trade(spark, sf), "trade")
    ch = change.churn(A.snapshots(spark, sf)).select(F.col("id").alias("module"), "stability")
    dep = calls.where("src_module <> dst_module").groupBy(F.col("dst_module").alias("module")).agg(F.count_distinct("src_module").alias("in_degree"))
    cx = calls.groupBy(F.col("src_module").alias("module")).agg(F.count_distinct("name").alias("max_nesting"), (F.count_distinct("dst") % 9).alias("max_cyclomatic"))
    share = F.count_if(F.col("name") < "Brand#2") / F.count("*")
    dn = calls.groupBy(F.col("src_module").alias("module")).agg(F.when(share <= 0.4, share).alias("density"))
    return decision.risk_score(ch.join(dep, "module").join(cx, "module").join(dn, "module").withColumn("n_modules", F.lit(25)))


@query(
    """WITH d AS (SELECT source AS layer, n_chars AS struct_hash, quality * n_chars AS source_hash FROM documents LEFT JOIN labels USING (doc_id))
    SELECT layer, count(*) AS n, count(source_hash) AS enriched, count(*) FILTER (source_hash <> struct_hash) AS stale,
    CASE WHEN count(source_hash) = 0 THEN 'none' WHEN count(source_hash) < count(*) THEN 'partial' ELSE 'complete' END AS status FROM d GROUP BY 1"""
)
def enrichment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return planning.coverage(docs.select(F.col("source").alias("layer"), F.col("n_chars").alias("struct_hash"), (F.col("quality") * F.col("n_chars")).alias("source_hash")))


@query(
    """WITH c AS (SELECT DISTINCT l_partkey AS file FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)
    SELECT 'file' AS kind, file::VARCHAR AS id FROM c UNION ALL SELECT DISTINCT 'symbol', p_partkey || '::' || p_name FROM part WHERE p_partkey IN (SELECT file FROM c)
    UNION ALL SELECT DISTINCT 'module', p_brand FROM part WHERE p_partkey IN (SELECT file FROM c)"""
)
def dirty_set(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"))
    changed = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_partkey").alias("file"))
    return planning.dirty_set(changed, part, part)


@query(
    """WITH calls AS (SELECT o_orderkey AS call, o_custkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'constructor' ELSE 'free' END AS form, o_orderkey % 4 AS n_args FROM orders),
    cand AS (SELECT DISTINCT o_custkey AS name, p_brand AS symbol, CASE WHEN p_size < 10 THEN 'Constructor' WHEN p_size < 20 THEN 'Class' ELSE 'Function' END AS label, p_size % 4 AS n_params, p_size % 2 AS n_required
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    r AS (SELECT *, CASE WHEN form = 'constructor' AND label = 'Constructor' THEN 1 WHEN form = 'constructor' AND label = 'Class' THEN 2 WHEN label IN ('Function', 'Constructor') THEN 3 END AS rank FROM calls JOIN cand USING (name)),
    b AS (SELECT * FROM r WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY call)),
    f AS (SELECT * FROM b WHERE n_args BETWEEN n_required AND n_params) SELECT call, symbol FROM f QUALIFY count(*) OVER (PARTITION BY call) = 1"""
)
def overload_resolution(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "constructor").otherwise("free")
    calls = orders.select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("name"), form.alias("form"), (F.col("o_orderkey") % 4).alias("n_args"))
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    label = F.when(F.col("p_size") < 10, "Constructor").when(F.col("p_size") < 20, "Class").otherwise("Function")
    candidates = lines.select(F.col("o_custkey").alias("name"), F.col("p_brand").alias("symbol"), label.alias("label"), (F.col("p_size") % 4).alias("n_params"), (F.col("p_size") % 2).alias("n_required"))
    return resolution.overloads(calls, candidates.distinct())


# Web ----------------------------------------------------------------------------------------------------------------

_URL_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')"
_ROUTES = [("/en/:id", 1), ("/fr/:id", 2), ("/de/*", 3), ("/:lang/:id", 4)]


@query(
    f"""WITH u AS (SELECT page_id AS url_id, list_filter(string_split({_URL_PATH}, '/'), lambda x: x <> '') AS p FROM pages)
    SELECT url_id, CASE WHEN len(p) = 2 AND p[1] = 'en' THEN '/en/:id' WHEN len(p) = 2 AND p[1] = 'fr' THEN '/fr/:id' WHEN len(p) >= 1 AND p[1] = 'de' THEN '/de/*' ELSE '/:lang/:id' END AS route
    FROM u WHERE len(p) = 2 OR p[1] = 'de'"""
)
def route_match(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("url_id"), web.url_path(F.col("url")).alias("path"))
    return web.match_routes(urls, spark.createDataFrame(_ROUTES, "route string, seq int"))


@query(
    """WITH l AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1), regexp_extract_all(html, 'action="([^"]*)"', 1))) AS target FROM pages)
    SELECT page_id, target, count(*) AS n FROM l GROUP BY 1, 2"""
)
def html_form_routes(spark: SparkSession, sf: str) -> DataFrame:
    return web.links(table(spark, sf, "pages").select("page_id", "html")).groupBy("page_id", "target").agg(F.count("*").alias("n"))


_HEADINGS = """x AS (SELECT conv_id AS doc, turn AS line, CASE WHEN role = 'system' THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS level FROM conversations),
    h AS (SELECT doc, line, level, max(line) OVER (PARTITION BY doc) AS last FROM x)"""


@query(
    f"""WITH {_HEADINGS} SELECT doc, line, level::BIGINT AS level, coalesce((SELECT min(line) - 1 FROM h b WHERE b.doc = a.doc AND b.line > a.line AND b.level <= a.level), last) AS end_line,
    (SELECT max(line) FROM h b WHERE b.doc = a.doc AND b.line < a.line AND b.level < a.level) AS parent FROM h a"""
)
def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3).cast("long")
    rows = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), level.alias("level"), F.max("turn").over(Window.partitionBy("conv_id")).alias("last"))
    return web.sections(rows)


@query(
    f"""WITH u AS (SELECT DISTINCT list_filter(string_split({_URL_PATH}, '/'), lambda x: x <> '') AS p FROM pages), q AS (SELECT array_to_string(p, '/') AS path FROM u),
    b AS (SELECT 'en' AS prefix UNION SELECT 'fr' UNION SELECT path FROM q WHERE path LIKE 'de/1%')
    SELECT path, (SELECT prefix FROM b WHERE prefix = path OR starts_with(path, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1) AS prefix FROM q"""
)
def longest_prefix_boundary(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_join(F.filter(F.split(web.url_path(F.col("url")), "/"), lambda x: x != ""), "/")
    paths = table(spark, sf, "pages").select(parts.alias("path")).distinct()
    bounds = spark.createDataFrame([("en",), ("fr",)], "prefix string").union(paths.where("path like 'de/1%'").select("path"))
    return change.longest_prefix(paths, bounds)


# Cypher -------------------------------------------------------------------------------------------------------------

_HIER = with_("hier_nodes", "hier_edges")
_CYPHER = {
    "context": (
        "MATCH (n:Nation)-[r:CONTAINS]->(c:Customer) RETURN n.name AS nation, r.confidence AS confidence, count(c) AS customers",
        f"{_HIER} SELECT n.name AS nation, confidence, count(*) AS customers FROM hier_nodes n JOIN hier_edges ON src = n.id JOIN hier_nodes c ON dst = c.id WHERE n.label = 'Nation' AND type = 'CONTAINS' AND c.label = 'Customer' GROUP BY 1, 2",
    ),
    "downstream": (
        "MATCH (r:Region {name: 'EUROPE'})-[:CONTAINS|MEMBER_OF*1..2]->(x) RETURN DISTINCT x.id AS id, x.label AS label",
        f"""{_HIER}, e AS (SELECT src, dst FROM hier_edges WHERE type IN ('CONTAINS', 'MEMBER_OF')), a AS (SELECT dst FROM e JOIN hier_nodes ON src = id WHERE label = 'Region' AND name = 'EUROPE'),
        b AS (SELECT dst FROM a UNION SELECT e.dst FROM a JOIN e ON e.src = a.dst) SELECT id, label FROM b JOIN hier_nodes ON dst = id""",
    ),
    "upstream": (
        "MATCH (o:Order {name: '1-URGENT'})<-[:CALLS]-(c:Customer)<-[:CONTAINS]-(n:Nation) RETURN n.name AS nation, count(DISTINCT c.id) AS customers, count(o) AS orders",
        f"""{_HIER} SELECT n.name AS nation, count(DISTINCT c.id) AS customers, count(*) AS orders FROM hier_nodes o JOIN hier_edges x ON x.dst = o.id JOIN hier_nodes c ON x.src = c.id
        JOIN hier_edges y ON y.dst = c.id JOIN hier_nodes n ON y.src = n.id WHERE o.label = 'Order' AND o.name = '1-URGENT' AND c.label = 'Customer' AND n.label = 'Nation' GROUP BY 1""",
    ),
    "label_counts": ("MATCH (n) RETURN labels(n) AS label, count(n) AS n", f"{_HIER} SELECT label, count(*) AS n FROM hier_nodes GROUP BY 1"),
    "prefix": (
        "MATCH (n:Customer) WHERE n.path STARTS WITH 'NATION_1' AND NOT n.path ENDS WITH 'BUILDING' RETURN n.id AS id, n.path AS path",
        f"{_HIER} SELECT id, path FROM hier_nodes WHERE label = 'Customer' AND starts_with(path, 'NATION_1') AND NOT ends_with(path, 'BUILDING')",
    ),
    "contains_or": (
        "MATCH (n) WHERE n.name CONTAINS 'URGENT' OR n.label IN ['Region', 'Nation'] RETURN n.label AS label, count(n) AS n",
        f"{_HIER} SELECT label, count(*) AS n FROM hier_nodes WHERE contains(name, 'URGENT') OR label IN ('Region', 'Nation') GROUP BY 1",
    ),
    "not_exists": (
        "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:CALLS]->(o:Order) } RETURN c.id AS id",
        f"{_HIER} SELECT id FROM hier_nodes WHERE label = 'Customer' AND id NOT IN (SELECT src FROM hier_edges WHERE type = 'CALLS')",
    ),
    "undirected": (
        "MATCH (n:Nation)-[r]-(x) WHERE r.confidence >= 0.9 RETURN n.name AS nation, x.label AS label, count(x) AS n",
        f"""{_HIER}, e AS (SELECT src AS a, dst AS b, confidence FROM hier_edges UNION ALL SELECT dst, src, confidence FROM hier_edges)
        SELECT n.name AS nation, x.label, count(*) AS n FROM hier_nodes n JOIN e ON a = n.id JOIN hier_nodes x ON b = x.id WHERE n.label = 'Nation' AND confidence >= 0.9 GROUP BY 1, 2""",
    ),
    "shared_variable": (
        "MATCH (n:Nation)-[:CONTAINS]->(c:Customer), (n)-[:MEMBER_OF]->(s:Supplier) WHERE c.path CONTAINS 'BUILDING' RETURN n.name AS nation, count(DISTINCT c) AS customers, count(DISTINCT s) AS suppliers",
        f"""{_HIER} SELECT n.name AS nation, count(DISTINCT c.id) AS customers, count(DISTINCT s.id) AS suppliers FROM hier_nodes n JOIN hier_edges x ON x.src = n.id AND x.type = 'CONTAINS' JOIN hier_nodes c ON x.dst = c.id AND c.label = 'Customer'
        JOIN hier_edges y ON y.src = n.id AND y.type = 'MEMBER_OF' JOIN hier_nodes s ON y.dst = s.id AND s.label = 'Supplier' WHERE n.label = 'Nation' AND contains(c.path, 'BUILDING') GROUP BY 1""",
    ),
    "ordered": (
        "MATCH (n:Supplier) WHERE n.name <> 'x' RETURN n.name AS name, n.path AS path ORDER BY n.path DESC, n.name LIMIT 12",
        f"{_HIER} SELECT name, path FROM hier_nodes WHERE label = 'Supplier' AND name <> 'x' ORDER BY path DESC, name LIMIT 12",
    ),
    "collected": (
        "MATCH (r:Region)-[:CONTAINS]->(n:Nation) RETURN r.name AS region, collect(n.name) AS nations, max(n.path) AS last, count(*) AS n ORDER BY region SKIP 1 LIMIT 3",
        f"""{_HIER} SELECT r.name AS region, list(n.name ORDER BY n.name) AS nations, max(n.path) AS last, count(*) AS n FROM hier_nodes r JOIN hier_edges e ON e.src = r.id AND e.type = 'CONTAINS'
        JOIN hier_nodes n ON n.id = e.dst WHERE r.label = 'Region' AND n.label = 'Nation' GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 1""",
    ),
}


def _cypher(text: str) -> Query:
    return lambda spark, sf: Graph(A.hier_nodes(spark, sf), A.hier_edges(spark, sf)).query(text)


for _name, (_text, _sql) in _CYPHER.items():
    query(_sql, f"cypher_{_name}")(_cypher(_text))


# Architecture -------------------------------------------------------------------------------------------------------

_BRANDS = """brands AS (SELECT p_brand AS module, p_partkey AS file FROM part)"""


@query(
    f"""WITH {_BRANDS}, f AS (SELECT p_brand AS module, CAST(floor(l_quantity) AS BIGINT) AS c, l_linenumber AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
    a AS (SELECT module, count(DISTINCT file) AS file_count FROM brands GROUP BY 1),
    b AS (SELECT module, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, max(c) AS most, max(d) AS deepest FROM f GROUP BY 1)
    SELECT a.module, file_count, coalesce(n, 0) AS function_count, coalesce(total, 0) AS total_cyclomatic, coalesce(most, 0) AS max_cyclomatic, CAST(coalesce(deepest, 0) AS BIGINT) AS max_nesting_depth,
    CAST(least(50, coalesce(most * deepest, 0)) + least(50, file_count * 3) AS BIGINT) AS risk_score FROM a LEFT JOIN b ON a.module = b.module"""
)
def leaf_stats(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("module"))
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    functions = lines.select("module", F.floor("l_quantity").alias("cyclomatic"), F.col("l_linenumber").alias("depth"))
    return architecture.leaf_stats(part.select("module", F.col("p_partkey").alias("file")), functions)


@query(
    with_("seq")
    + f""", {_BRANDS}, ends AS (SELECT a.module AS a, b.module AS b FROM seq LEFT JOIN brands a ON src = a.file LEFT JOIN brands b ON dst = b.file),
    m AS (SELECT module, count(DISTINCT file) AS n_files FROM brands GROUP BY 1),
    s AS (SELECT a AS module, CAST(a = b AS INT) AS inner_ FROM ends UNION ALL SELECT b, 0 FROM ends WHERE a <> b),
    c AS (SELECT module, sum(inner_) / count(*) AS cohesion FROM s GROUP BY 1)
    SELECT m.module AS "group", n_files, coalesce(cohesion, 1.0) AS cohesion, CASE WHEN n_files <= 15 OR cohesion > 0.7 OR cohesion IS NULL THEN 'leaf' ELSE 'group' END AS kind
    FROM m LEFT JOIN c ON m.module = c.module"""
)
def architecture_kinds(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("group"))
    return architecture.group_kinds(part.select("group", F.col("id").alias("file")), part, A.seq(spark, sf))


@query(
    f"""{_HIER}, n AS (SELECT src AS id, count(*) AS n FROM hier_edges GROUP BY 1)
    SELECT h.id, CASE WHEN label <> 'Order' AND coalesce(n, 0) > 0 THEN 'recurse' ELSE 'leaf' END AS action, CASE WHEN label = 'Order' THEN 0 ELSE coalesce(n, 0) END AS n_children
    FROM hier_nodes h LEFT JOIN n ON h.id = n.id"""
)
def recursion_plan(spark: SparkSession, sf: str) -> DataFrame:
    above = A.hier_edges(spark, sf).select(F.col("dst").alias("id"), F.col("src").alias("parent_id"))
    elements = A.hier_nodes(spark, sf).select("id", F.col("label").alias("level")).join(above, "id", "left")
    return architecture.recursion_plan(elements, terminal="Order")


@query(
    """WITH o AS (SELECT l_orderkey AS trace, list('s' || l_suppkey ORDER BY l_linenumber, l_suppkey) AS path FROM lineitem GROUP BY 1),
    p AS (SELECT path, min(trace) AS trace FROM o GROUP BY 1),
    parts AS (SELECT DISTINCT list_slice(path, i, j - 1) AS stem, path[j] AS whole, path AS "outer" FROM p, range(1, 20) a(i), range(1, 20) b(j) WHERE i <= j AND j <= len(path)),
    gone AS (SELECT DISTINCT p.path FROM p JOIN parts ON stem = list_slice(p.path, 1, len(p.path) - 1) AND "outer" <> p.path
    AND CASE WHEN len(p.path) = 1 THEN whole = p.path[1] ELSE starts_with(whole, p.path[len(p.path)]) END)
    SELECT trace, array_to_string(path, ',') AS path FROM p WHERE path NOT IN (SELECT path FROM gone)"""
)
def trace_containment(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trace"))
    lines = lines.agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("steps"))
    traces = lines.select("trace", F.transform("steps", lambda x: F.concat(F.lit("s"), x["l_suppkey"])).alias("path"))
    return architecture.drop_contained(traces).select("trace", F.array_join("path", ",").alias("path"))


@query(
    """WITH t AS (SELECT c_custkey, c_acctbal > 0 AS ready, c_mktsegment AS s, c_custkey % 7 = 0 AS changed, c_custkey % 3 AS gaps, c_custkey % 5 % 2 AS stale, c_custkey % 17 AS unknown FROM customer),
    m AS (SELECT *, CASE WHEN NOT ready OR changed THEN 'none' WHEN s = 'BUILDING' AND (gaps > 0 OR stale > 0 OR unknown > 0) THEN 'architecture-enrich' WHEN gaps > 0 OR stale > 0 OR unknown >= 12 THEN 'docs-consistency-review'
    WHEN unknown > 0 THEN 'bounded-stale-enrich' ELSE 'none' END AS mode FROM t),
    p AS (SELECT mode, CASE WHEN NOT ready THEN 'bootstrap' WHEN changed THEN 'review' WHEN mode <> 'none' THEN 'enrich' ELSE 'develop' END AS phase FROM m)
    SELECT phase, mode, count(*) AS n FROM p GROUP BY 1, 2"""
)
def task_phases(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    tasks = table(spark, sf, "customer").select(
        (F.col("c_acctbal") > 0).alias("has_facts"),
        F.when(F.col("c_mktsegment") == "BUILDING", "architecture").otherwise("general").alias("intent"),
        (key % 7 == 0).cast("int").alias("changed_files"),
        F.lit("complete").alias("index_status"),
        (key % 3).alias("graph_gaps"),
        (key % 5 % 2).alias("stale_docs"),
        (key % 17).alias("unknown"),
        F.lit(0).alias("contradicted"),
    )
    return architecture.task_phase(tasks).groupBy("phase", "mode").agg(F.count("*").alias("n"))


# Processes, labels, rules, changes and extraction -----------------------------------------------------------------------

_TRACES = (
    with_("calls", recursive=True)
    + """, c AS (SELECT src, dst FROM calls WHERE confidence >= 0.5), fn AS (SELECT p_partkey AS id, p_brand AS community, ['handle', 'get', 'load', 'on'][p_size % 4 + 1] || replace(p_brand, '#', '') AS name,
      [1.5, 0.3, 1, 1.5][p_size % 4 + 1]::DOUBLE * [2.5, 3, 1][p_size % 3 + 1]::DOUBLE * CASE WHEN p_retailprice > 1000 THEN 2 ELSE 1 END AS factor, p_type LIKE 'PROMO%' AS is_test FROM part),
    outs AS (SELECT src AS id, count(*) AS callees FROM c GROUP BY 1), ins AS (SELECT dst AS id, count(*) AS callers FROM c GROUP BY 1),
    en AS (SELECT id, callees / (coalesce(callers, 0) + 1) * factor AS score FROM fn JOIN outs USING (id) LEFT JOIN ins USING (id) WHERE NOT is_test ORDER BY score DESC, id LIMIT 200),
    step AS (SELECT src, dst FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 4),
    walk AS (SELECT [id] AS path, id AS tip FROM en UNION ALL SELECT list_append(path, dst), dst FROM walk JOIN step ON tip = src WHERE len(path) < 10 AND NOT list_contains(path, dst)),
    done AS (SELECT path FROM walk WHERE len(path) = 10 OR (len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM step WHERE src = tip AND NOT list_contains(path, dst)))),
    cut AS (SELECT path FROM done QUALIFY row_number() OVER (PARTITION BY path[1] ORDER BY len(path), path) <= 12), most AS (SELECT greatest(20, least(300, floor(count(*) / 10 + 0.5))) AS n FROM part),
    each AS (SELECT id, score, count(*) AS n FROM en JOIN cut ON path[1] = id GROUP BY 1, 2),
    lead_ AS (SELECT id FROM (SELECT id, coalesce(sum(n) OVER (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM each) WHERE before < 2 * (SELECT n FROM most)),
    first_ AS (SELECT path, list_transform(path, lambda x: x::VARCHAR) AS p FROM cut WHERE path[1] IN (SELECT id FROM lead_)),
    parts AS (SELECT DISTINCT list_slice(p, i, j - 1) AS stem, p[j] AS whole, p AS "outer" FROM first_, range(1, 11) a(i), range(1, 11) b(j) WHERE i <= j AND j <= len(p)),
    gone AS (SELECT DISTINCT f.p FROM first_ f JOIN parts ON stem = list_slice(f.p, 1, len(f.p) - 1) AND "outer" <> f.p AND starts_with(whole, f.p[len(f.p)])),
    ends AS (SELECT path FROM first_ WHERE p NOT IN (SELECT p FROM gone) QUALIFY row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path) DESC, path) = 1),
    top AS (SELECT path, row_number() OVER (ORDER BY len(path) DESC, path) - 1 AS idx FROM ends QUALIFY idx < (SELECT n FROM most))"""
)
_PROCESSES = (
    _TRACES
    + """, cm AS (SELECT idx, string_agg(DISTINCT community, ',' ORDER BY community) AS communities, count(DISTINCT community) AS n FROM (SELECT idx, unnest(path) AS id FROM top) JOIN fn USING (id) GROUP BY 1),
    pr AS (SELECT 'proc_' || idx || '_' || lower(left(a.name, 20)) AS process, upper(left(a.name, 1)) || substr(a.name, 2) || ' → ' || upper(left(b.name, 1)) || substr(b.name, 2) AS label,
      CASE WHEN n > 1 THEN 'cross_community' ELSE 'intra_community' END AS kind, len(path)::INT AS step_count, communities, path[1] AS entry, path[-1] AS terminal, path AS trace
      FROM top JOIN cm USING (idx) JOIN fn a ON a.id = path[1] JOIN fn b ON b.id = path[-1])"""
)


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as functions: ``id``, ``name``, ``community``, ``path``, ``exported``, ``is_test``."""
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("p_size") % len(items) + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(pick(("handle", "get", "load", "on")), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("name"), F.col("p_brand").alias("community"),
        pick(("src/routes/x.ts", "src/main.go", "lib/a.rb")).alias("path"), (F.col("p_retailprice") > 1000).alias("exported"), F.col("p_type").startswith("PROMO").alias("is_test"),
    )


def _processes(spark: SparkSession, sf: str) -> DataFrame:
    functions = materialize(_functions(spark, sf), "functions")
    calls = materialize(flows_.calls(A.calls(spark, sf)), "calls")
    entries = materialize(graph.entry_points(functions, calls), "entries")
    most = flows_.most_processes(functions.count())
    found = flows_.whole_traces(flows_.first_traces(flows_.traces(calls, entries), entries, most))
    return flows_.processes(found, functions.select("id", "name"), functions.select("id", "community"), most)


@query(_PROCESSES + " SELECT * FROM pr")
def processes(spark: SparkSession, sf: str) -> DataFrame:
    return _processes(spark, sf)


@query(_PROCESSES + " SELECT process, unnest(range(1, len(trace) + 1))::INT AS step, unnest(trace) AS id FROM pr")
def process_steps(spark: SparkSession, sf: str) -> DataFrame:
    return flows_.steps(_processes(spark, sf))


@query(
    """WITH m AS (SELECT p_size AS community, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'app/' || lower(p_type) || '/x.py' ELSE 'app/src/x.py' END AS path FROM part),
    f AS (SELECT community, string_split(path, '/')[-2] AS folder, count(*) AS n FROM m WHERE string_split(path, '/')[-2] <> 'src' GROUP BY 1, 2),
    b AS (SELECT community, folder FROM f QUALIFY row_number() OVER (PARTITION BY community ORDER BY n DESC, folder) = 1),
    e AS (SELECT community, min(name) AS lo, max(name) AS hi, count(*) AS n FROM m GROUP BY 1),
    p AS (SELECT community, n, left(lo, list_max(list_filter(range(0, 1 + least(length(lo), length(hi))), lambda k: left(lo, k) = left(hi, k)))) AS prefix FROM e),
    t AS (SELECT community, coalesce(folder, CASE WHEN n > 2 AND length(prefix) > 2 THEN prefix END) AS told FROM p LEFT JOIN b USING (community))
    SELECT community, coalesce(upper(left(told, 1)) || substr(told, 2), 'Cluster_' || community) AS label FROM t"""
)
def community_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("app/"), F.lower("p_type"), F.lit("/x.py"))).otherwise("app/src/x.py")
    return flows_.community_labels(table(spark, sf, "part").select(F.col("p_size").alias("community"), F.col("p_name").alias("name"), path.alias("path")))


@query(
    """WITH w AS (SELECT p_brand AS module, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part), n AS (SELECT module, word, count(*) AS n FROM w WHERE word NOT IN ('new', 'base', 'default', 'item', 'type') AND length(word) > 1 GROUP BY 1, 2)
    SELECT module, word AS label FROM n QUALIFY row_number() OVER (PARTITION BY module ORDER BY n DESC, length(word) DESC, word) = 1"""
)
def module_labels(spark: SparkSession, sf: str) -> DataFrame:
    return flows_.module_labels(table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_name").alias("name")))


@query(
    """WITH md AS (SELECT n_name AS id, n_nationkey AS k, n_regionkey AS r FROM nation), mf AS (SELECT id AS module, 's' || s_suppkey AS file FROM md JOIN supplier ON s_nationkey = k),
    fl AS (SELECT 's' || s_suppkey AS file FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 9000),
    dp AS (SELECT a.id AS module, b.id AS "on" FROM md a JOIN md b ON a.r = b.r AND b.k = a.k + 5), miss AS (SELECT DISTINCT module, file FROM mf WHERE file NOT IN (SELECT file FROM fl)),
    free AS (SELECT file, row_number() OVER (ORDER BY file) AS nth FROM fl WHERE file NOT IN (SELECT file FROM mf)),
    cf AS (SELECT DISTINCT p_brand AS concept, 's' || p_partkey % 150 AS file FROM part),
    ct AS (SELECT id || '--x' AS id, id AS provider, CASE WHEN k % 4 = 0 THEN 'gone' || k ELSE 'CHINA' END AS consumer FROM md), fs AS (SELECT event_type AS flow, CASE WHEN user_id % 9 = 0 THEN 'm' || user_id % 5 ELSE 'CHINA' END AS module FROM events)
    SELECT 'ERROR' AS level, 'MISSING_FILE' AS type, module AS node_id, 'module' AS layer, 'Module "' || module || '" references missing file: ' || file AS message FROM miss
    UNION ALL SELECT 'WARN', 'STALE_ENRICHMENT', id, 'module', 'Module "' || id || '" enrichment is stale (source_hash ' || k % 5 || ' ≠ struct_hash ' || r || ')' FROM md WHERE k % 5 <> r
    UNION ALL SELECT 'WARN', 'STALE_ANNOTATION', id, 'module', 'Annotation 0 on "' || id || '" is stale: ' || CASE WHEN r > 1 THEN 'moved' ELSE 'unknown reason' END FROM md WHERE k % 7 = 0
    UNION ALL SELECT 'INFO', 'ORPHAN_MODULE', id, 'module', 'Module "' || id || '" has no dependencies or dependents (isolated)' FROM md WHERE id IN (SELECT module FROM mf) AND id NOT IN (SELECT module FROM dp UNION SELECT "on" FROM dp)
    UNION ALL SELECT 'INFO', 'UNCOVERED_FILE', file, 'module', 'Source file not claimed by any module: ' || file FROM free WHERE nth <= 20
    UNION ALL SELECT 'INFO', 'UNCOVERED_FILE', '_summary', 'module', (count(*) - 20) || ' more uncovered source files (only first 20 shown)' FROM free HAVING count(*) > 20
    UNION ALL SELECT 'WARN', 'MISSING_CONCEPT_REF', concept, 'concept', 'Concept "' || concept || '" references missing file: ' || file FROM cf WHERE file NOT IN (SELECT file FROM fl)
    UNION ALL SELECT 'ERROR', 'CONTRACT_MODULE_MISSING', id, 'contract', 'Contract "' || id || '" references missing consumer module: ' || consumer FROM ct WHERE consumer NOT IN (SELECT id FROM md)
    UNION ALL SELECT 'WARN', 'FLOW_MODULE_MISSING', flow, 'flow', 'Flow "' || flow || '" step references missing module: ' || min(module) FROM fs WHERE module NOT IN (SELECT id FROM md) GROUP BY flow
    UNION ALL SELECT 'WARN', 'HIGH_STALENESS', '_map', 'module', 'Map staleness: HIGH (' || floor(100 * n / 25 + 0.5)::INT || '% of modules have missing files). Compile again.' FROM (SELECT count(DISTINCT module) AS n FROM miss) WHERE floor(100 * n / 25 + 0.5) > 30"""
)
def lint_rules(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    s = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    md = t("nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    nodes = md.select(F.lit("module").alias("layer"), "id", F.col("r").cast("string").alias("struct_hash"), (F.col("k") % 5).cast("string").alias("source_hash"))
    notes = md.select(F.lit("module").alias("layer"), "id", F.lit(0).alias("nth"), (F.col("k") % 7 == 0).alias("stale"), F.when(F.col("r") > 1, "moved").alias("reason"))
    mf = md.join(t("supplier"), F.col("s_nationkey") == F.col("k")).select(F.col("id").alias("module"), s("s", F.col("s_suppkey")).alias("file"))
    files = t("supplier").where("s_acctbal > 0").select(s("s", F.col("s_suppkey")).alias("file")).union(t("customer").where("c_acctbal > 9000").select(s("c", F.col("c_custkey"))))
    deps = md.select(F.col("id").alias("module"), "k", "r").join(md.select(F.col("id").alias("on"), (F.col("k") - 5).alias("k"), "r"), ["k", "r"]).select("module", "on")
    cf = t("part").select(F.col("p_brand").alias("concept"), s("s", F.col("p_partkey") % 150).alias("file"))
    ct = md.select(F.concat("id", F.lit("--x")).alias("id"), F.col("id").alias("provider"), F.when(F.col("k") % 4 == 0, s("gone", F.col("k"))).otherwise("CHINA").alias("consumer"))
    fs = t("events").select(F.col("event_type").alias("flow"), F.when(F.col("user_id") % 9 == 0, s("m", F.col("user_id") % 5)).otherwise("CHINA").alias("module"))
    return lint.lint(nodes, notes, mf, deps, files, cf, ct, fs)


_LAYERS = """o AS (SELECT n_name AS id, count(*)::VARCHAR AS h, list('s' || s_suppkey) AS files, max(s_suppkey) % 3 AS entry FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000 GROUP BY 1),
    n AS (SELECT n_name AS id, count(*)::VARCHAR AS h, list('s' || s_suppkey) AS files, max(s_suppkey) % 3 AS entry FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 8000 GROUP BY 1),
    x AS (SELECT coalesce(o.id, n.id) AS id, o.h AS oh, n.h AS nh, o.entry AS oe, n.entry AS ne, len(list_filter(coalesce(n.files, []), lambda f: NOT list_contains(coalesce(o.files, []), f))) AS came,
      len(list_filter(coalesce(o.files, []), lambda f: NOT list_contains(coalesce(n.files, []), f))) AS went FROM o FULL JOIN n ON o.id = n.id)"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    both = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))

    def version(where: str) -> DataFrame:
        return both.where(where).groupBy(F.col("n_name").alias("id")).agg(
            F.count("*").cast("string").alias("struct_hash"), F.collect_list(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("files"), (F.max("s_suppkey") % 3).alias("entry")
        )

    return version("s_acctbal > 1000"), version("s_acctbal < 8000")


@query(
    f"""WITH {_LAYERS} SELECT id, 'module' AS layer, CASE WHEN oh IS NULL THEN 'added' WHEN nh IS NULL THEN 'removed' ELSE 'changed' END AS status,
    CASE WHEN oh IS NOT NULL AND nh IS NOT NULL THEN 'structure changed' || CASE WHEN came > 0 THEN ', +' || came || ' files' ELSE '' END || CASE WHEN went > 0 THEN ', -' || went || ' files' ELSE '' END
      || CASE WHEN oe IS DISTINCT FROM ne THEN ', entry changed' ELSE '' END END AS changes FROM x WHERE oh IS DISTINCT FROM nh"""
)
def layer_changes(spark: SparkSession, sf: str) -> DataFrame:
    return index.layer_changes(*_versions(spark, sf), "module")


@query(f"WITH {_LAYERS} SELECT count(*) FILTER (oh IS DISTINCT FROM nh) AS n FROM x")
def n_changed(spark: SparkSession, sf: str) -> DataFrame:
    return index.n_changed(*_versions(spark, sf))


@query(
    """SELECT c_name AS path, 'prisma' AS orm, lower(c_mktsegment) AS model, 'findMany' AS method, 1 AS line FROM customer UNION ALL SELECT c_name, 'prisma', 'user', 'upsert', 3 FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_name, 'supabase', 't' || c_nationkey, 'insert', 2 FROM customer"""
)
def orm_queries(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit("import x\nawait prisma."), F.lower("c_mktsegment"), F.lit(".findMany({})\nsupabase.from( 't"), F.col("c_nationkey").cast("string"), F.lit("' ).insert (\n"),
        F.when(F.col("c_custkey") % 2 == 0, "prisma.user.upsert(x)").otherwise("myprisma.user.upsert(x)"),
    )
    return extract.orm_queries(table(spark, sf, "customer").select(F.col("c_name").alias("path"), text.alias("content")))


@query(
    """SELECT 'tool_' || p_size AS name, min('lib/tools/' || p_brand || '.ts') AS path, 'Does ' || p_size || ' things' AS description FROM part GROUP BY p_size"""
)
def tool_definitions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("const t = [{ name: 'tool_"), F.col("p_size").cast("string"), F.lit("',\n  description: `Does "), F.col("p_size").cast("string"), F.lit("\nthings `, inputSchema: {} }]"))
    return extract.tool_definitions(table(spark, sf, "part").select(F.concat(F.lit("lib/tools/"), "p_brand", F.lit(".ts")).alias("path"), text.alias("content")))


@query(
    """WITH x AS (SELECT o_orderkey % 7 AS e, c_nationkey AS x, o_orderkey % 5 AS p, c_custkey % 4 AS c, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'src/server/a' WHEN 1 THEN 'src/core/a' WHEN 2 THEN 'tests/a' WHEN 3 THEN 'demo/x' WHEN 4 THEN 'src/gen/b' ELSE 'lib/scripts/c' END AS d
      FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT *, least(1, x / 6) * 0.35::DOUBLE + least(1, p / 4) * 0.35::DOUBLE + least(1, c / 3) * 0.2::DOUBLE + least(1, e / 4) * 0.1::DOUBLE AS score FROM x),
    r AS (SELECT o_orderkey AS id, CASE WHEN d LIKE 'tests%' THEN ['test', '0.98'] WHEN d LIKE '%/gen/%' THEN ['generated', '0.95'] WHEN d LIKE 'demo%' THEN ['example', '0.92'] WHEN d LIKE '%/scripts/%' THEN ['dev_tool', '0.9']
      WHEN (e > 1.3 OR d LIKE '%/server%') AND (score >= 0.25 OR e >= 1.5) THEN ['prod_entrypoint', round(0.65 + score * 0.3, 3)::VARCHAR] WHEN score >= 0.28 THEN ['prod_core', round(0.55 + score * 0.35, 3)::VARCHAR]
      ELSE ['peripheral', round(0.45 + score * 0.2, 3)::VARCHAR] END AS r FROM s) SELECT id, r[1] AS role, r[2]::DOUBLE AS confidence FROM r"""
)
def inferred_roles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    folder = F.when(k % 6 == 0, "src/server/a").when(k % 6 == 1, "src/core/a").when(k % 6 == 2, "tests/a").when(k % 6 == 3, "demo/x").when(k % 6 == 4, "src/gen/b").otherwise("lib/scripts/c")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    role = names.infer_role(F.concat(folder, F.lit("/f.ts")), F.lit("src"), k % 7, F.col("c_nationkey"), k % 5, F.col("c_custkey") % 4)
    return o.select(k.alias("id"), role.alias("r")).select("id", "r.role", "r.confidence")


_BASES = """RECURSIVE inh AS (SELECT c_custkey AS class, c_custkey // 2 AS parent, 0 AS seq, 'EXTENDS' AS kind FROM customer WHERE c_custkey > 0
      UNION ALL SELECT c_custkey, c_custkey // 3, 1, 'IMPLEMENTS' FROM customer WHERE c_custkey > 2 AND c_custkey // 3 <> c_custkey // 2),
    walk AS (SELECT class, parent AS ancestor, [seq] AS key, kind FROM inh UNION ALL SELECT w.class, i.parent, list_append(w.key, i.seq), w.kind FROM walk w JOIN inh i ON w.ancestor = i.class),
    one AS (SELECT class, ancestor, key, kind FROM walk QUALIFY row_number() OVER (PARTITION BY class, ancestor ORDER BY len(key), key) = 1),
    anc AS (SELECT class, ancestor, kind, (row_number() OVER (PARTITION BY class ORDER BY len(key), key) - 1)::INT AS position FROM one)"""


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("class"))
    half, third = F.floor(F.col("class") / 2), F.floor(F.col("class") / 3)
    one = k.where("class > 0").select("class", half.alias("parent"), F.lit(0).alias("seq"), F.lit("EXTENDS").alias("kind"))
    return one.union(k.where(third != half).where("class > 2").select("class", third, F.lit(1), F.lit("IMPLEMENTS")))


@query(f"WITH {_BASES} SELECT * FROM anc")
def class_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.ancestors(_bases(spark, sf))


@query(
    f"""WITH {_BASES}, o AS (SELECT *, ['first-wins', 'leftmost-base', 'implements-split', 'qualified-syntax'][class % 4 + 1] AS strategy FROM anc),
    mt AS (SELECT c_custkey AS class, 'm' || c_custkey % 5 AS name, c_custkey || '.m' AS id, CASE WHEN c_custkey % 7 = 0 THEN 'Property' ELSE 'Method' END AS label FROM customer),
    d AS (SELECT o.*, mt.name, mt.id FROM o JOIN mt ON mt.class = o.ancestor AND label = 'Method' WHERE NOT EXISTS (SELECT 1 FROM mt own WHERE own.class = o.class AND own.name = mt.name)),
    g AS (SELECT class, name, any_value(strategy) AS strategy, arg_min(id, position) AS first, arg_min(ancestor, position) AS first_of, arg_min(id, position) FILTER (kind = 'EXTENDS') AS own, arg_min(ancestor, position) FILTER (kind = 'EXTENDS') AS own_of
      FROM d GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT class, name, CASE strategy WHEN 'qualified-syntax' THEN NULL WHEN 'implements-split' THEN own ELSE first END AS method, CASE WHEN strategy = 'qualified-syntax' OR (strategy = 'implements-split' AND own IS NULL) THEN 0.5
    WHEN strategy = 'implements-split' THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN strategy = 'qualified-syntax' THEN 'requires qualified syntax: ' || name WHEN strategy = 'implements-split' AND own IS NULL THEN 'ambiguous: ' || name
    WHEN strategy = 'implements-split' THEN 'class method wins: ' || own_of || '::' || name WHEN strategy = 'leftmost-base' THEN 'leftmost base: ' || first_of || '::' || name ELSE 'first definition: ' || first_of || '::' || name END AS reason FROM g"""
)
def method_overrides(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("class") % 4
    strategy = F.when(k == 0, "first-wins").when(k == 1, "leftmost-base").when(k == 2, "implements-split").otherwise("qualified-syntax")
    lists, parts = resolution.ancestor_lists(_bases(spark, sf))
    c = F.col("c_custkey")
    methods = table(spark, sf, "customer").select(
        F.concat(c.cast("string"), F.lit(".m")).alias("id"), c.alias("class"), F.concat(F.lit("m"), (c % 5).cast("string")).alias("name"),
        F.when(c % 7 == 0, "Property").otherwise("Method").alias("label"), F.lit(0).alias("seq"),
    )
    return resolution.listed_overrides(lists.withColumn("strategy", strategy), methods, parts)


@query(
    f"""{with_("seq", recursive=True)}, fn AS (SELECT p_partkey AS id, p_name AS name, p_brand AS module, ['prod_core', 'test', 'peripheral', 'example'][p_size % 4 + 1] AS role, [1, 0.05, 0.45, 0.18][p_size % 4 + 1]::DOUBLE AS weight FROM part),
    step AS (SELECT src, dst FROM (SELECT DISTINCT src, dst FROM seq WHERE src IN (SELECT id FROM fn) AND dst IN (SELECT id FROM fn)) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3),
    walk AS (SELECT [id] AS path, id AS tip, FALSE AS again FROM fn UNION ALL SELECT list_append(path, dst), dst, list_contains(path, dst) FROM walk JOIN step ON tip = src WHERE len(path) < 6 AND NOT again),
    done AS (SELECT path FROM walk WHERE again OR len(path) = 6 OR NOT EXISTS (SELECT 1 FROM step WHERE src = tip)),
    ats AS (SELECT path, unnest(path) AS id, unnest(range(len(path))) AS nth FROM done WHERE len(path) >= 2),
    p AS (SELECT path, list(name ORDER BY nth) AS functions, list(module ORDER BY nth) AS modules, avg(weight) AS w, count(DISTINCT module) AS n FROM ats JOIN fn USING (id) GROUP BY 1)
    SELECT array_to_string(path, '>') AS flow, path, functions, modules FROM p WHERE n >= 2 AND w >= 0.28"""
)
def call_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    role = F.when(k == 0, "prod_core").when(k == 1, "test").when(k == 2, "peripheral").otherwise("example")
    functions = materialize(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"), role.alias("role")), "functions")
    return families.call_paths(functions, A.seq(spark, sf), functions.select("id"))


# Index, descriptions and names ----------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT a.n_name AS module, b.n_name AS "on" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
    SELECT module AS "from", "on" AS "to", 'depends_on' AS relation FROM d UNION ALL SELECT CASE p_size % 3 WHEN 1 THEN p_brand WHEN 2 THEN p_type END, p_name, 'owns_concept' FROM part WHERE p_size % 3 > 0
    UNION ALL SELECT n_name, r_name, 'contract' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT event_id::VARCHAR, event_type, 'step_in_flow' FROM events UNION ALL SELECT s_name, s_nationkey::VARCHAR, 'affects' FROM supplier"""
)
def index_edges(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    a, b = (t("nation").select(F.col("n_name").alias(x), "n_regionkey", F.col("n_nationkey").alias(f"k_{x}")) for x in ("module", "on"))
    deps = a.join(b, "n_regionkey").where("k_module < k_on")
    owner = F.when(F.col("p_size") % 3 == 1, F.col("p_brand")).when(F.col("p_size") % 3 == 2, F.col("p_type")).otherwise("")
    contracts = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("consumer"), F.col("r_name").alias("provider"))
    steps = t("events").select(F.col("event_id").alias("flow"), F.col("event_type").alias("module"))
    concerns = t("supplier").select(F.col("s_name").alias("id"), F.col("s_nationkey").alias("module"))
    return index.index_edges(deps, t("part").select(F.col("p_name").alias("id"), owner.alias("layer")), contracts, steps, concerns)


@query("SELECT p_brand AS module, count(*) AS n FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1")
def concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    return index.concept_counts(table(spark, sf, "part").select(F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).alias("layer")))


@query(
    """WITH f AS (SELECT p_brand AS module, 'f' || p_partkey || ['.py', '.md', '.json', '.yml', '', '.Py'][p_size % 6 + 1] AS file, ['py', 'md', 'json', 'yml', '<none>', 'py'][p_size % 6 + 1] AS kind FROM part),
    k AS (SELECT module, kind, count(*) AS n FROM f GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, kind) AS place FROM k),
    l AS (SELECT module, string_agg(n || CASE kind WHEN 'md' THEN ' markdown doc' || CASE WHEN n > 1 THEN 's' ELSE '' END WHEN 'json' THEN ' JSON config' || CASE WHEN n > 1 THEN 's' ELSE '' END
      WHEN 'yml' THEN ' YAML file' || CASE WHEN n > 1 THEN 's' ELSE '' END ELSE ' .' || kind END, ', ' ORDER BY place) AS kinds FROM t WHERE place <= 3 GROUP BY 1),
    s AS (SELECT module, count(*) AS n, array_to_string(list(file ORDER BY file)[1:3], ', ') AS sample FROM f GROUP BY 1)
    SELECT module, n || ' file' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' (' || kinds || '). Sample: ' || sample AS description FROM s JOIN l USING (module)"""
)
def file_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".py", ".md", ".json", ".yml", "", ".Py"))), (F.col("p_size") % 6 + 1).cast("int"))
    return index.describe_files(table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), ending).alias("file")))


@query(
    """WITH w AS (SELECT p_type AS module, unnest(string_split(p_name, ' ')) AS word FROM part), n AS (SELECT module, word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, word) AS place FROM n)
    SELECT module, upper(left(min_by(word, place), 1)) || substr(min_by(word, place), 2) || ' operations: ' || string_agg(word, ', ' ORDER BY place) || ' (entry: ' || lower(module) || ')' AS description FROM t WHERE place <= 5 GROUP BY 1"""
)
def name_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return index.describe_names(table(spark, sf, "part").select(F.col("p_type").alias("module"), F.col("p_name").alias("name"), F.lower("p_type").alias("entry")))


@query(
    """WITH x AS (SELECT c_custkey AS id, ['apps/web', 'packages/a/gen', 'libs/b', 'cmd/t', 'src/core', 'a/tests', 'tools/x', 'q/r', 'examples/e', 'z'][c_custkey % 10 + 1] AS path, ['none', 'nested-repo', 'package'][c_custkey % 3 + 1] AS kind,
      CASE WHEN c_custkey % 2 = 0 THEN 'apps/x' ELSE 'y' END AS place FROM customer)
    SELECT id, CASE WHEN path LIKE '%/gen' THEN 'generated' WHEN path LIKE 'examples%' THEN 'example' WHEN path LIKE '%/tests' THEN 'test' WHEN path LIKE 'tools%' THEN 'tooling' WHEN path LIKE 'apps/%' OR path LIKE 'cmd/%' THEN 'app'
    WHEN path LIKE 'libs/%' THEN 'package' WHEN path LIKE 'src%' THEN 'repo-core' WHEN kind = 'nested-repo' THEN 'unknown' WHEN kind = 'package' THEN CASE WHEN place LIKE 'apps/%' THEN 'app' ELSE 'package' END ELSE 'repo-core' END AS role FROM x"""
)
def root_roles(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    one = lambda items, n: F.element_at(F.array(*map(F.lit, items)), (k % n + 1).cast("int"))
    path = one(("apps/web", "packages/a/gen", "libs/b", "cmd/t", "src/core", "a/tests", "tools/x", "q/r", "examples/e", "z"), 10)
    kind, at = one(("none", "nested-repo", "package"), 3), F.when(k % 2 == 0, "apps/x").otherwise("y")
    return table(spark, sf, "customer").select(k.alias("id"), names.root_role(path, kind, at).alias("role"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'src/o' || o_custkey WHEN 1 THEN 'src/' || lower(o_orderstatus) || '/' WHEN 2 THEN 'route:GET /orders/' || o_custkey WHEN 3 THEN 'tool:' || o_orderpriority
    WHEN 4 THEN 'a.py#' || o_orderpriority ELSE 'class:' || o_orderpriority END AS ref FROM orders"""
)
def impacted_refs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    label = F.element_at(F.array(*map(F.lit, ("File", "Folder", "Route", "Tool", "Function", "Class"))), (k + 1).cast("int"))
    path = F.when(k == 0, F.concat(F.lit("./src/o"), F.col("o_custkey").cast("string"))).when(k == 1, F.concat(F.lit("src\\"), F.lower("o_orderstatus"), F.lit("/"))).when(k == 4, "a.py")
    route = F.when(k == 2, F.concat(F.lit("/orders/"), F.col("o_custkey").cast("string")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), names.impacted_ref(label, F.col("o_orderpriority"), path, route, F.lit("GET")).alias("ref"))


@query(
    """SELECT event_id AS id, CASE WHEN user_id % 7 = 0 THEN FALSE WHEN user_id % 5 = 0 THEN TRUE WHEN event_type <> 'click' THEN FALSE WHEN value > 50 THEN FALSE ELSE TRUE END AS fresh,
    CASE WHEN user_id % 7 = 0 THEN 'no-meta' WHEN user_id % 5 = 0 THEN 'no-git' WHEN event_type <> 'click' THEN 'head-changed' WHEN value > 50 THEN 'working-tree-dirty' END AS reason FROM events"""
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    state = index.freshness(u % 7 != 0, u % 5 != 0, F.col("event_type"), F.lit("click"), F.when(F.col("value") > 50, "x").otherwise("y"), F.lit("y"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), state.alias("s")).select("id", "s.fresh", "s.reason")


@query(
    """SELECT p_brand AS path, max(p_retailprice) AS confidence, (list(p_partkey ORDER BY p_retailprice DESC, p_partkey))[1] AS seq, (list(p_type ORDER BY p_retailprice DESC, p_partkey))[1] AS role FROM part GROUP BY 1"""
)
def surest_roots(spark: SparkSession, sf: str) -> DataFrame:
    return index.surest_roots(table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("role")))


@query(
    """SELECT p_partkey AS id, list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), 'v2', 'url']))) AS tokens FROM part"""
)
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_name", F.lit("/"), "p_type", F.lit(".v2:URL"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_sort(extract.token_set(text)).alias("tokens"))


@query("""SELECT p_partkey AS id, list_sort(list_distinct(['src/' || lower(p_type) || '.ts', 'docs/p' || p_size % 3 || '.md'])) AS paths FROM part""")
def referenced_paths(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("See (./src/"), F.lower("p_type"), F.lit(".ts), `docs/p"), (F.col("p_size") % 3).cast("string"), F.lit(".md`. Not x/src/y nor lib/http://z, but src/"), F.lower("p_type"), F.lit(".ts"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), extract.referenced_paths(text).alias("paths"))


@query(
    """WITH s AS (SELECT doc_id AS id FROM documents WHERE n_chars > 500), a AS (SELECT doc_id AS id FROM labels WHERE quality = 1) SELECT DISTINCT id FROM s WHERE id IN (SELECT id FROM a)"""
)
def enrichment_targets(spark: SparkSession, sf: str) -> DataFrame:
    stale = table(spark, sf, "documents").where("n_chars > 500").select(F.col("doc_id").alias("id"))
    return index.enrichment_targets(stale, table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "affected-only")


@query(
    """WITH s AS (SELECT s_suppkey AS id, 'm' || s_suppkey % 20 AS name, 'f' || s_suppkey % 30 AS file, CASE WHEN s_suppkey % 3 = 0 THEN 'Property' ELSE 'Method' END AS label, s_nationkey AS owner, s_suppkey AS seq FROM supplier)
    SELECT id, name, file, label, owner, seq FROM s QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY seq) = 1"""
)
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(
        k.alias("id"), F.concat(F.lit("m"), (k % 20).cast("string")).alias("name"), F.concat(F.lit("f"), (k % 30).cast("string")).alias("file"),
        F.when(k % 3 == 0, "Property").otherwise("Method").alias("label"), F.col("s_nationkey").alias("owner"), k.alias("seq"),
    )
    return index.Symbols(s).exact(s.select("file", "name")).select("id", "name", "file", "label", "owner", "seq")


@query(
    """WITH i AS (SELECT l_orderkey % 500 AS file, 'lib' || l_suppkey % 4 || '/mod' || l_partkey % 50 || '.py' AS target, 'mod' || l_partkey % 50 AS alias, l_orderkey * 10 + l_linenumber AS seq, l_suppkey % 4 AS k FROM lineitem)
    SELECT file, alias, target FROM i QUALIFY row_number() OVER (PARTITION BY file, alias ORDER BY seq DESC, target DESC) = 1"""
)
def module_aliases(spark: SparkSession, sf: str) -> DataFrame:
    target = F.concat(F.lit("lib"), (F.col("l_suppkey") % 4).cast("string"), F.lit("/mod"), (F.col("l_partkey") % 50).cast("string"), F.lit(".py"))
    return index.module_aliases(table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("file"), target.alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))
