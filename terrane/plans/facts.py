"""Queries of scans and of member accesses over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrane.operators.access import accesses
from terrane.plans.registry import query
from terrane.sources import ignore
from terrane.sources.tables import table

#: Customers as classes with a next one, a home and a getter, nations with a region, regions with a name; orders as chains of members.
_CHAINS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS form, o_orderkey % 5 = 0 AS w FROM orders), h AS (SELECT c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
    st AS (SELECT k, w, unnest([{'i': 0, 'd': 'c' || o.c || '.next'}, {'i': 1, 'd': 'c' || (o.c // 2) || '.next'}, {'i': 2, 'd': 'c' || (o.c // 4) || '.home'}, {'i': 9, 'd': 'n' || n || '.region'}], recursive := true) FROM o JOIN h x ON x.c = o.c // 4 WHERE form = 0
      UNION ALL SELECT k, w, 9, 'c' || (c // 3) || '.home' FROM o WHERE form = 1
      UNION ALL SELECT k, w, unnest([{'i': 0, 'd': 'c' || o.c || '.home'}, {'i': 1, 'd': 'n' || n || '.region'}, {'i': 9, 'd': 'r' || r || '.name'}], recursive := true) FROM o JOIN h ON h.c = o.c WHERE form = 2)"""


def _chains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf, n)
    s = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    member = lambda owner, name, kind, gives, seq: F.struct(
        owner.alias("owner"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.concat(owner, F.lit(f".{name}")).alias("id"), gives.cast("string").alias("gives"), F.lit(seq).alias("seq")
    )
    me = s("c", c)
    own = F.array(member(me, "next", "field", s("c", F.floor(c / 2)), 0), member(me, "home", "field", s("n", F.col("c_nationkey")), 1), member(me, "getNext", "method", s("c", F.floor(c / 3)), 2))
    members = t("customer").select(F.inline(own)).union(t("nation").select(F.inline(F.array(member(s("n", n), "region", "field", s("r", F.col("n_regionkey")), 0)))))
    members = members.union(t("region").select(F.inline(F.array(member(s("r", F.col("r_regionkey")), "name", "field", F.lit(None), 0)))))
    step = lambda text: F.array(*[F.struct(F.lit(x.split(":")[0]).alias("kind"), F.lit(x.split(":")[1]).alias("name")) for x in text.split()])
    k = F.col("o_orderkey")
    forms = [step(x) for x in ("field:next field:next field:home field:region", "call:getNext field:home", "field:home call:clone field:region field:name", "field:missing field:home")]
    steps = F.when(k % 4 == 0, forms[0]).when(k % 4 == 1, forms[1]).when(k % 4 == 2, forms[2]).otherwise(forms[3])
    chains = t("orders").select(k.alias("chain"), s("o", k).alias("src"), s("c", F.col("o_custkey")).alias("start"), steps.alias("steps"), (k % 5 == 0).alias("writes"))
    return chains, members


@query(f"WITH {_CHAINS} SELECT DISTINCT 'o' || k AS src, d AS dst, 'ACCESSES' AS type, 1.0::DOUBLE AS confidence, CASE WHEN i = 9 AND w THEN 'write' ELSE 'read' END AS reason FROM st")
def field_accesses(spark: SparkSession, sf: str) -> DataFrame:
    return accesses(*_chains(spark, sf))[0]


@query(
    f"""WITH {_CHAINS} SELECT k AS chain, 'r' || r AS receiver FROM o JOIN h x ON x.c = o.c // 4 WHERE form = 0 UNION ALL SELECT k, 'n' || n FROM o JOIN h x ON x.c = o.c // 3 WHERE form = 1"""
)
def chain_receivers(spark: SparkSession, sf: str) -> DataFrame:
    return accesses(*_chains(spark, sf))[1]


#: Rules of three folders; customers as files below region, nation and segment.
_RULES = [
    ("", 0, "*.log"), ("", 1, "!f7.log"), ("", 2, "n3/"), ("", 3, "r1/**/furniture/"), ("", 4, "# none"), ("r2", 0, "!*.log"), ("r2", 1, "/n7/*/*.md"), ("r2/n2", 0, "*"), ("r2/n2", 1, "!*/"), ("r2/n2", 2, "!*.py"),
]
_TREE = """f AS (SELECT n_regionkey AS r, n_nationkey AS n, lower(c_mktsegment) AS s, c_custkey % 50 AS k, ['.log', '.py', '.tmp', '.md', '.min.js'][c_custkey % 5 + 1] AS e, CASE WHEN c_custkey % 11 = 0 THEN 'dist/' ELSE '' END AS sub FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT *, 'r' || r || '/n' || n || '/' || s || '/' || sub || 'f' || k || e AS path FROM f),
    g AS (SELECT DISTINCT path FROM p WHERE n = 3 OR (r = 1 AND s = 'furniture') OR (r <> 2 AND e = '.log' AND k <> 7) OR (n = 7 AND e = '.md' AND sub = '') OR (n = 2 AND e <> '.py'))"""


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    ending = F.element_at(F.array(*map(F.lit, (".log", ".py", ".tmp", ".md", ".min.js"))), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("r"), text(F.col("n_regionkey")), F.lit("/n"), text(F.col("n_nationkey")), F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), F.when(k % 11 == 0, "dist/").otherwise(""), F.lit("f"), text(k % 50), ending)
    return c.select(path.alias("path")).distinct(), spark.createDataFrame(_RULES, "folder string, seq int, line string")


@query(f"WITH {_TREE} SELECT path FROM g")
def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    return ignore.ignored_paths(*_tree(spark, sf))


@query(f"WITH {_TREE} SELECT DISTINCT path FROM p WHERE path NOT IN (SELECT path FROM g) AND sub = '' AND e <> '.min.js'")
def source_files(spark: SparkSession, sf: str) -> DataFrame:
    return ignore.sources(*_tree(spark, sf))
