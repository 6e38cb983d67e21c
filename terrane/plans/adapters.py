"""The driver's tables as graphs, calls, flows, snapshots and documents; for each, the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrane.sources.tables import table

# Common table expressions for the oracles, by name.
SQL = {
    "trade": """trade AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, nc.n_name AS src_module, ns.n_name AS dst_module, p_brand AS name
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN part ON l_partkey = p_partkey)""",
    "hier_nodes": """hier_nodes AS (SELECT 'r' || r_regionkey AS id, 'Region' AS label, r_name AS name, r_name AS path FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, n_name || '/' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, n_name || '/supply' FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT 'o' || o_orderkey, 'Order', o_orderpriority, o_orderstatus FROM orders)""",
    "hier_edges": """hier_edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'CONTAINS' AS type, 1.0::DOUBLE AS confidence FROM nation
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS', 1.0 FROM customer
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'MEMBER_OF', 0.9 FROM supplier
      UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CALLS', 0.5 FROM orders)""",
    "seq": """seq AS (SELECT DISTINCT l_partkey AS src, nxt AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt
      FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey)""",
    "calls": """calls AS (SELECT l_partkey AS src, nxt AS dst, max(q) / 98.0::DOUBLE AS confidence FROM (SELECT l_partkey, l_quantity AS q, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt
      FROM lineitem) WHERE nxt IS NOT NULL AND nxt <> l_partkey GROUP BY 1, 2)""",
    "snap": """months AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS tag FROM orders),
      counted AS (SELECT n_name AS id, strftime(o_orderdate, '%Y-%m') AS tag, count(*) FILTER (o_orderpriority = '1-URGENT')::VARCHAR AS hash
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
      snap AS (SELECT m.tag, n.n_name AS id, c.hash FROM months m CROSS JOIN nation n LEFT JOIN counted c ON c.tag = m.tag AND c.id = n.n_name),
      transitions AS (SELECT tag, id, hash IS DISTINCT FROM was AS changed FROM (SELECT *, lag(hash) OVER w AS was, row_number() OVER w AS nth FROM snap
        WINDOW w AS (PARTITION BY id ORDER BY tag)) WHERE nth > 1)""",
    "tokens": """tokens AS (SELECT doc_id, source, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), lambda x: length(x) > 1) AS w FROM documents)""",
    "flow": """flow AS (SELECT user_id AS flow, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS module, ts, event_id FROM events)""",
    "props": """props AS (SELECT event_id, event_type AS route, user_id % 10 AS consumer, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL AND json_valid(props) AND json_type(props) = 'OBJECT')""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in names)


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Calls from customers to suppliers, one per line item: ``src``, ``dst``, ``src_module``, ``dst_module``, ``name`` (brand)."""
    t = lambda n: table(spark, sf, n)
    n = t("nation")
    customer = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src_module"))
    supplier = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst_module"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return lines.select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "src_module", "dst_module", F.col("p_brand").alias("name")
    )


def hier_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, customers, suppliers and orders as nodes: ``id``, ``label``, ``name``, ``path``."""
    t = lambda n: table(spark, sf, n)

    def of(df: DataFrame, mark: str, key: str, label: str, name: str, path: Column) -> DataFrame:
        return df.select(F.concat(F.lit(mark), key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"), path.alias("path"))

    region, nation = t("region"), t("nation")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = of(region, "r", "r_regionkey", "Region", "r_name", F.col("r_name"))
    out = out.union(of(places, "n", "n_nationkey", "Nation", "n_name", F.concat_ws("/", "r_name", "n_name")))
    at = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.union(of(at, "c", "c_custkey", "Customer", "c_name", F.concat_ws("/", "n_name", "c_mktsegment")))
    at = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = out.union(of(at, "s", "s_suppkey", "Supplier", "s_name", F.concat_ws("/", "n_name", F.lit("supply"))))
    return out.union(of(t("orders"), "o", "o_orderkey", "Order", "o_orderpriority", F.col("o_orderstatus")))


def hier_edges(spark: SparkSession, sf: str) -> DataFrame:
    """``src``, ``dst``, ``type``, ``confidence`` from regions down to orders."""
    t = lambda n: table(spark, sf, n)

    def of(df: DataFrame, a: str, src: str, b: str, dst: str, kind: str, confidence: float) -> DataFrame:
        return df.select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

    out = of(t("nation"), "r", "n_regionkey", "n", "n_nationkey", "CONTAINS", 1.0)
    out = out.union(of(t("customer"), "n", "c_nationkey", "c", "c_custkey", "CONTAINS", 1.0))
    out = out.union(of(t("supplier"), "n", "s_nationkey", "s", "s_suppkey", "MEMBER_OF", 0.9))
    return out.union(of(t("orders"), "c", "o_custkey", "o", "o_orderkey", "CALLS", 0.5))


def seq(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that follow each other within an order: distinct ``src``, ``dst``."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), nxt.alias("dst"))
    return lines.where("dst is not null and src <> dst").distinct()


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of :func:`seq` as calls: ``src``, ``dst``, ``type``, ``confidence``, the surer the larger the greatest quantity."""
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), nxt.alias("dst"), F.col("l_quantity").alias("q")).where("dst is not null and src <> dst")
    return lines.groupBy("src", "dst").agg(F.lit("CALLS").alias("type"), (F.max("q") / 98.0).alias("confidence"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by month, densified: ``tag``, ``id``, ``hash`` (null where a nation has no order)."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("tag"))
    nation = table(spark, sf, "nation")
    who = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("id"))
    counted = orders.join(who, F.col("o_custkey") == F.col("c_custkey")).groupBy("id", "tag")
    counted = counted.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("string").alias("hash"))
    # Months x nations: the calendar and 25 rows, not the data.
    grid = orders.select("tag").distinct().join(F.broadcast(nation.select(F.col("n_name").alias("id"))))
    return grid.join(counted, ["id", "tag"], "left").select("tag", "id", "hash")


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user: ``flow``, ``module``, ``ts``, ``event_id``."""
    return table(spark, sf, "events").select(F.col("user_id").alias("flow"), F.col("event_type").alias("module"), "ts", "event_id")


def event_keys(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id``, ``route``, ``consumer``, ``key``: the keys of the events' JSON properties."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("route"), (F.col("user_id") % 10).alias("consumer"), "props")
    return e.select("event_id", "route", "consumer", F.explode(F.json_object_keys("props")).alias("key"))
