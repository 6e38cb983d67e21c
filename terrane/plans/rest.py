"""Queries of scans, symbols, rules and tools over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrane.functions import names
from terrane.functions.scratch import drop, materialize, scratch_root
from terrane.operators import architecture, index, planning, resolution
from terrane.plans import adapters as A, api
from terrane.plans.adapters import with_
from terrane.plans.registry import query
from terrane.sources import code
from terrane.sources.store import GraphStore, cache_hits, supplement
from terrane.sources.tables import table


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _pick(key: Column, items: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (key % len(items) + 1).cast("int"))


# Scans ----------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT lpad(l_orderkey::VARCHAR, 40, '0') AS commit, p_brand AS file FROM lineitem JOIN part ON l_partkey = p_partkey")
def git_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits of one long log, their lines' brands as files."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    o = F.col("o_orderkey")
    heads = table(spark, sf, "orders").select((o * 100).alias("seq"), F.inline(F.array(F.struct(F.lit(0).alias("k"), _text("commit ", F.lpad(o.cast("string"), 40, "0")).alias("value")), F.struct(F.lit(50).alias("k"), F.lit("  ").alias("value")))))
    files = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit(" "), "p_brand").alias("value"))
    return code.git_log(heads.select((F.col("seq") + F.col("k")).alias("seq"), "value").union(files))


@query(
    """WITH o AS (SELECT o_custkey AS c, o_orderkey % 500 AS s, o_orderkey % 7 AS n FROM orders) SELECT 'f' || c AS file, s AS start, s + CASE WHEN n = 6 THEN 1 ELSE n END - 1 AS "end" FROM o WHERE n > 0"""
)
def diff_hunk_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files of one long diff, their orders as hunks; of a hunk of one line the number is left out."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    size = F.when(o % 7 == 6, "").otherwise(_text(",", o % 7))
    hunks = table(spark, sf, "orders").select((c * 10_000 + nth * 2).alias("seq"), _text("@@ -1,3 +", o % 500, size, " @@ def f").alias("value"))
    added = table(spark, sf, "orders").select((c * 10_000 + nth * 2 + 1).alias("seq"), F.lit("+new").alias("value"))
    files = table(spark, sf, "customer").select((F.col("c_custkey") * 10_000).alias("seq"), _text("+++ b/f", F.col("c_custkey")).alias("value"))
    return code.diff_hunks(hunks.union(added).union(files))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size FROM part), m AS (SELECT k, ['src/a.ts', 'lib/Rakefile', 'x/y.PY', 'b.unknown', 'Dockerfile'][k % 5 + 1] AS p, p_size FROM p)
    SELECT k AS id, CASE k % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'ruby' WHEN 2 THEN 'python' WHEN 4 THEN 'docker' END AS language, k % 5 = 2 AS has_headings FROM m"""
)
def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    path = _pick(k, ("src/a.ts", "lib/Rakefile", "x/y.PY", "b.unknown", "Dockerfile"))
    return table(spark, sf, "part").select(k.alias("id"), code.language(path).alias("language"), (k % 5 == 2).alias("has_headings"))


@query(
    """SELECT doc_id::VARCHAR AS path, unnest([1, 3, 8])::BIGINT AS line, unnest([1, 2, 3])::INT AS level, unnest(['Document ' || doc_id, 'In ' || coalesce(lang, 'none'), 'End']) AS title FROM documents"""
)
def document_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown between headings, one of them within a fence."""
    d, body = F.col("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[\n#`]+", " ")
    text = _text("# Document ", d, "\n", body, "\n## In ", F.coalesce("lang", F.lit("none")), " ##\n```\n# no heading\n  ```\ntext # none\n### End\n#none")
    return code.headings(table(spark, sf, "documents").select(d.cast("string").alias("path"), text.alias("text")))


# Names ----------------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_size, p_type FROM part), n AS (SELECT id, w, w[1] || upper(left(w[2], 1)) || substr(w[2], 2) || '_v' || p_size AS name, p_size, p_type FROM p)
    SELECT id, 'Function:' || name AS node, w[1] || '-' || w[2] || '-v' || p_size AS kebab, lower(left(name, 20)) AS clean, [w[1], w[2], 'v' || p_size] AS words, FALSE AS noisy FROM n"""
)
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    name = _text(F.get(w, F.lit(0)), F.initcap(F.get(w, F.lit(1))), "_v", F.col("p_size"))
    forms = names.node_id(F.lit("Function"), name).alias("node"), names.kebab(name).alias("kebab"), names.sanitize(name).alias("clean"), names.split_words(name).alias("words"), names.is_noisy(name).alias("noisy")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *forms)


@query(
    """WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS k, lower(p_type) AS t FROM part)
    SELECT id, CASE k WHEN 0 THEN t || '/x' WHEN 1 THEN t || '/' || t WHEN 2 THEN 'src/' || t WHEN 3 THEN t WHEN 4 THEN t ELSE t || '/a.ts' END AS scope, k = 1 AS test FROM p"""
)
def scope_hints(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("p_partkey") % 6, F.lower("p_type")
    path = F.when(k == 0, _text(t, "/src/x/f.ts")).when(k == 1, _text(t, "/", t, "/b.test.ts")).when(k == 2, _text("src\\", t, "\\c.ts")).when(k == 3, "other/d.ts").when(k == 4, "").otherwise(_text(t, "/a.ts"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.scope_hint(t, path).alias("scope"), names.is_test_path(path).alias("test"))


# Symbols --------------------------------------------------------------------------------------------------------------


@query(
    """WITH i AS (SELECT DISTINCT p_type AS receiver, 'f' || p_partkey % 40 AS file FROM part WHERE p_size % 2 = 0), m AS (SELECT DISTINCT 'f' || s_suppkey % 40 AS file, 'm' || s_suppkey % 5 AS name, s_suppkey AS symbol FROM supplier),
    c AS (SELECT o_orderkey AS call, 'm' || o_custkey % 5 AS name, ['PROMO', 'SMALL', 'LARGE', 'NONE'][o_orderkey % 4 + 1] AS receiver, o_custkey % 50 AS target FROM orders)
    SELECT DISTINCT call, symbol, 0.7::DOUBLE AS confidence FROM c JOIN i USING (receiver) JOIN m USING (file, name) WHERE symbol <> target"""
)
def interface_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    s, o, p = F.col("s_suppkey"), F.col("o_orderkey"), F.col("p_partkey")
    implementors = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_type").alias("interface"), _text("f", p % 40).alias("file"))
    methods = table(spark, sf, "supplier").select(_text("f", s % 40).alias("file"), _text("m", s % 5).alias("name"), s.alias("symbol"))
    calls = table(spark, sf, "orders").select(o.alias("call"), _text("m", F.col("o_custkey") % 5).alias("name"), _pick(o, ("PROMO", "SMALL", "LARGE", "NONE")).alias("receiver"), (F.col("o_custkey") % 50).alias("target"))
    return resolution.interface_dispatch(calls, implementors, methods)


@query("SELECT p_type AS interface, list_sort(list(DISTINCT 'f' || p_partkey % 40)) AS files FROM part GROUP BY 1")
def implementor_map(spark: SparkSession, sf: str) -> DataFrame:
    return resolution.implementor_map(table(spark, sf, "part").select(F.col("p_type").alias("parent"), _text("f", F.col("p_partkey") % 40).alias("file")))


_METHODS = """c AS (SELECT 'c' || c_custkey AS class, 'n' || c_nationkey AS interface FROM customer), m AS (SELECT 'c' || c_custkey AS owner, 'm' || c_custkey % 3 AS name, CASE WHEN c_custkey % 4 > 0 THEN ['int', 'str'][c_custkey % 2 + 1] END AS params, 'c' || c_custkey || '.m' AS symbol FROM customer
      UNION ALL SELECT 'n' || n_nationkey, 'm' || k, CASE k WHEN 0 THEN 'int' WHEN 1 THEN NULL ELSE 'str' END, 'n' || n_nationkey || '.' || k FROM nation, range(3) t(k))"""


@query(
    f"""WITH {_METHODS}, b AS (SELECT a.symbol AS src, c.interface, i.symbol AS dst, CASE WHEN a.params = i.params THEN 1.0::DOUBLE WHEN a.params IS NULL OR i.params IS NULL THEN 0.7 END AS confidence FROM c JOIN m a ON a.owner = c.class JOIN m i ON i.owner = c.interface AND i.name = a.name)
    SELECT src, dst, confidence FROM b WHERE confidence IS NOT NULL"""
)
def method_implements(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    own = c.select(_text("c", k).alias("owner"), _text("m", k % 3).alias("name"), F.when(k % 4 > 0, _pick(k, ("int", "str"))).alias("params"), _text("c", k, ".m").alias("symbol"))
    n = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    asked = n.select(_text("n", F.col("n_nationkey")), _text("m", F.col("k")), F.when(F.col("k") == 0, "int").when(F.col("k") == 2, "str"), _text("n", F.col("n_nationkey"), ".", F.col("k")))
    return resolution.method_implements(c.select(_text("c", k).alias("class"), _text("n", F.col("c_nationkey")).alias("interface")), own.union(asked))


@query(
    """WITH RECURSIVE d AS (SELECT s_suppkey AS file FROM supplier WHERE s_suppkey % 4 = 0), w AS (SELECT o_orderkey AS binding, o_custkey % 60 AS file, 0 AS n FROM orders UNION ALL SELECT binding, file - 1, n + 1 FROM w WHERE file NOT IN (SELECT file FROM d) AND file % 11 > 0 AND n < 2 AND file > 0)
    SELECT DISTINCT binding, 's' || file AS symbol FROM w WHERE file IN (SELECT file FROM d)"""
)
def followed_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose names are exported again by the file after them, up to two files on."""
    s = F.col("s_suppkey")
    bindings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("binding"), (F.col("o_custkey") % 60).alias("file"), F.lit("x").alias("name"))
    exports = spark.range(60).where("id % 11 > 0").select(F.col("id").alias("file"), F.lit("x").alias("name"), (F.col("id") - 1).alias("to_file"), F.lit("x").alias("to_name"))
    known = table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(s.alias("file"), F.lit("x").alias("name"), _text("s", s).alias("symbol"))
    return resolution.follow_exports(bindings, exports, known, depth=2)


@query(
    """WITH f AS (SELECT DISTINCT 'src/' || lower(p_type) || '/' || string_split(p_name, ' ')[2] || '.ts' AS path FROM part), i AS (SELECT DISTINCT c_custkey AS k, 'web/c' || c_custkey || '.ts' AS file, './' || ['promo', 'small', 'nowhere'][c_custkey % 3 + 1] || '/' || ['rod', 'gear'][c_custkey % 2 + 1] AS raw FROM customer)
    SELECT file, raw, 'src/' || substr(raw, 3) || '.ts' AS target FROM i WHERE 'src/' || substr(raw, 3) || '.ts' IN (SELECT path FROM f)"""
)
def import_targets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    files = table(spark, sf, "part").select(_text("src/", F.lower("p_type"), "/", F.get(F.split("p_name", " "), F.lit(1)), ".ts").alias("path")).distinct()
    imports = table(spark, sf, "customer").select(_text("web/c", k, ".ts").alias("file"), _text("./", _pick(k, ("promo", "small", "nowhere")), "/", _pick(k, ("rod", "gear"))).alias("raw"))
    return resolution.import_targets(imports, files)


@query(
    """WITH k AS (SELECT 's' || s_suppkey % 20 AS scope, 'v' || s_suppkey AS name, 'T' || min(s_suppkey % 3) AS type FROM supplier GROUP BY 1, 2), r AS (SELECT 's' || c_custkey % 20 AS scope, 'w' || c_custkey AS name, c_custkey FROM customer),
    a AS (SELECT scope, name, CASE c_custkey % 3 WHEN 0 THEN 'R' || c_custkey % 7 END AS type, c_custkey FROM r), c AS (SELECT r.scope, r.name, k.type FROM r JOIN k ON k.scope = r.scope AND k.name = 'v' || r.c_custkey % 40 WHERE r.c_custkey % 3 = 1),
    f AS (SELECT r.scope, r.name, CASE k.type WHEN 'T0' THEN 'F0' WHEN 'T1' THEN 'F1' END AS type FROM r JOIN k ON k.scope = r.scope AND k.name = 'v' || r.c_custkey % 40 WHERE r.c_custkey % 3 = 2)
    SELECT scope, name, type FROM k UNION ALL SELECT scope, name, type FROM a WHERE type IS NOT NULL AND scope IN (SELECT scope FROM k) UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f WHERE type IS NOT NULL"""
)
def type_environment(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    known = table(spark, sf, "supplier").select(_text("s", s % 20).alias("scope"), _text("v", s).alias("name"), _text("T", s % 3).alias("type"))
    source = F.when(c % 3 == 0, _text("g", c % 7)).otherwise(_text("v", c % 40))
    pending = table(spark, sf, "customer").select(c.alias("seq"), _text("s", c % 20).alias("scope"), _text("w", c).alias("name"), _pick(c, ("call", "copy", "field")).alias("kind"), source.alias("source"), F.lit("m").alias("member"))
    returns = spark.range(7).select(_text("g", F.col("id")).alias("callee"), _text("R", F.col("id")).alias("type"))
    members = spark.range(2).select(_text("T", F.col("id")).alias("owner"), F.lit("field").alias("kind"), F.lit("m").alias("member"), _text("F", F.col("id")).alias("type"))
    return architecture.propagate_types(known, pending, returns, members)


# Rules ----------------------------------------------------------------------------------------------------------------


def _options_sql() -> str:
    rows = []
    for option, (needs, bad, scores) in planning.OPTIONS.items():
        for (dimension, weight), score in zip(planning.DIMENSIONS.items(), scores):
            yes, no = score if isinstance(score, tuple) else (score, score)
            rows.append(f"('{option}', '{needs or ''}', {bad}, {weight}::DOUBLE, '{planning.CONDITIONS.get(dimension, '')}', {yes}::DOUBLE, {no}::DOUBLE)")
    return ", ".join(rows)


@query(
    f"""WITH t AS (SELECT c_custkey AS target, c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b, c_custkey % 5 = 0 AS c FROM customer), o(option, needs, bad, weight, given, yes, no) AS (VALUES {_options_sql()}),
    h AS (SELECT *, CASE needs WHEN 'has_canonical' THEN a WHEN 'has_closure' THEN b WHEN 'has_abstraction' THEN c ELSE TRUE END AS there, CASE given WHEN 'has_canonical' THEN a WHEN 'has_closure' THEN b WHEN 'has_abstraction' THEN c ELSE TRUE END AS held FROM t, o),
    s AS (SELECT target, option, bad OR (option = 'local_patch' AND (a OR b OR c)) AS discouraged, round(sum(CASE WHEN held THEN yes ELSE no END * weight), 3) AS total_score, round(avg(CASE WHEN held THEN yes ELSE no END), 3) AS confidence FROM h WHERE there GROUP BY 1, 2, 3)
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY discouraged, total_score DESC, option) = 1 AS recommended FROM s"""
)
def plan_options(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return planning.change_plans(table(spark, sf, "customer").select(k.alias("target"), (k % 2 == 0).alias("has_canonical"), (k % 3 == 0).alias("has_closure"), (k % 5 == 0).alias("has_abstraction")))


@query(
    """WITH u AS (SELECT c_custkey AS k, 'u' || c_custkey AS unit, 'src/' || CASE WHEN c_custkey % 9 = 0 THEN 'legacy-' ELSE 'x-' END || c_custkey || '.ts' AS file, 'n' || c_nationkey AS module, c_mktsegment AS family FROM customer), ch AS (SELECT * FROM u WHERE k % 4 = 0),
    cn AS (SELECT DISTINCT 'canonical:' || c_mktsegment || c_nationkey AS id, c_mktsegment AS family, 'n' || c_nationkey AS module FROM customer WHERE c_nationkey % 5 = 0)
    SELECT 'compatibility_layer' AS kind, 'warning' AS severity, file AS ref FROM ch WHERE file LIKE '%legacy%' UNION ALL SELECT DISTINCT 'compatibility_layer', 'warning', 'a ' || lower(p_type) || ' shim' FROM part WHERE p_size = 7
    UNION ALL SELECT 'local_patch', 'warning', unit FROM u WHERE k - 1 IN (SELECT k FROM ch WHERE k % 8 = 0) AND k % 4 > 0 UNION ALL SELECT 'canonical_bypass', 'warning', id FROM cn WHERE family IN (SELECT family FROM ch) AND module NOT IN (SELECT module FROM ch)"""
)
def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    units = c.select(_text("u", k).alias("unit"), _text("src/", F.when(k % 9 == 0, "legacy-").otherwise("x-"), k, ".ts").alias("file"), _text("n", F.col("c_nationkey")).alias("module"), F.col("c_mktsegment").alias("family"), k.alias("k"))
    added = table(spark, sf, "part").select(F.when(F.col("p_size") == 7, _text("a ", F.lower("p_type"), " shim")).otherwise("plain").alias("line"))
    closures = c.select(_text("u", k).alias("target"), _text("u", k + 1).alias("unit"), F.when(k % 8 == 0, "must").otherwise("should").alias("level"))
    canonical = c.where("c_nationkey % 5 = 0").select(_text("canonical:", F.col("c_mktsegment"), F.col("c_nationkey")).alias("id"), F.col("c_mktsegment").alias("family"), _text("n", F.col("c_nationkey")).alias("module")).distinct()
    return planning.review_findings(units.where("k % 4 = 0").select("file"), added, units.drop("k"), closures, canonical)


_DOCTRINE = with_("trade") + """, st AS (SELECT 'principle' AS kind, 'soft' AS strength, 'repo' AS scope, 'Change the module that owns a behaviour before adding a way between modules.' AS statement, (SELECT list(n_name ORDER BY n_name)[1:5] FROM nation) AS evidence
    UNION ALL SELECT 'preferred_pattern', 'soft', 'repo', 'Extend a contract that is there rather than go around it.', (SELECT list(id ORDER BY id)[1:5] FROM (SELECT DISTINCT src_module || '--' || dst_module AS id FROM trade WHERE src_module <> dst_module))
    UNION ALL SELECT 'preferred_pattern', 'soft', 'repo', 'Review the whole flow that a change touches.', (SELECT list(t ORDER BY t)[1:5] FROM (SELECT DISTINCT event_type AS t FROM events))
    UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'constraint' ELSE 'decision_note' END, CASE WHEN n_nationkey % 2 = 0 THEN 'hard' ELSE 'soft' END, 'module', 'Note ' || n_nationkey, [n_name] FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 5 > 0)"""


def _doctrine(spark: SparkSession, sf: str) -> DataFrame:
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    crossing = A.trade(spark, sf).where("src_module <> dst_module").select(F.concat_ws("--", "src_module", "dst_module").alias("id")).distinct()
    kind = F.when(k % 3 == 0, "remark").when(k % 2 == 0, "constraint").otherwise("intent")
    notes = n.select(F.col("n_name").alias("module"), kind.alias("type"), _text("Note ", k).alias("content"), (k % 5 == 0).alias("stale"))
    return planning.doctrine(n.select(F.col("n_name").alias("id")), crossing, table(spark, sf, "events").select(F.col("event_type").alias("id")).distinct(), notes)


@query(_DOCTRINE + " SELECT * FROM st")
def doctrine_statements(spark: SparkSession, sf: str) -> DataFrame:
    return _doctrine(spark, sf)


@query(_DOCTRINE + " SELECT * FROM st WHERE scope = 'repo' OR evidence[1] IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def relevant_doctrine(spark: SparkSession, sf: str) -> DataFrame:
    return planning.relevant_doctrine(_doctrine(spark, sf), table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("id")))


@query(
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS k FROM orders) SELECT id, 'EVIDENCE_FILE_MISSING' AS code, 'f' || k AS ref FROM c WHERE k % 4 > 0 UNION ALL SELECT id, 'NODE_MISSING', 's' || k FROM c WHERE 's' || k NOT IN (SELECT 's' || s_suppkey FROM supplier)
    UNION ALL SELECT DISTINCT id, 'EDGE_PRESENT', 'c' || k || ' CALLS s' || id % 10 FROM c WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = k AND l_suppkey = c.id % 10)"""
)
def correction_findings(spark: SparkSession, sf: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    given = table(spark, sf, "orders").select(o.alias("id"), F.array(_text("f", k)).alias("evidence"), F.array(_text("s", k), _text("s", k)).alias("nodes"), _text("c", k).alias("src"), _text("s", o % 10).alias("dst"), F.lit("CALLS").alias("type"))
    files = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(_text("f", F.col("c_custkey")).alias("file"))
    nodes = table(spark, sf, "supplier").select(_text("s", F.col("s_suppkey")).alias("id"))
    return architecture.correction_findings(given, files, nodes, A.trade(spark, sf).select("src", "dst", F.lit("CALLS").alias("type")))


@query(
    """WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS enriched, c_custkey % 2 AS h FROM customer), o AS (SELECT c_custkey AS id, 'old ' || c_custkey AS enriched FROM customer WHERE c_custkey % 5 > 0)
    SELECT id, coalesce(n.enriched, o.enriched) AS enriched, h AS struct_hash FROM n LEFT JOIN o USING (id)"""
)
def preserved_zones(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    fresh = c.select(k.alias("id"), F.when(k % 3 == 0, F.col("c_name")).alias("enriched"), (k % 2).alias("struct_hash"))
    return planning.preserve_zones(fresh, c.where("c_custkey % 5 > 0").select(k.alias("id"), _text("old ", k).alias("enriched")), ["enriched"])


@query(
    """SELECT c_custkey AS id, c_custkey % 4 = 0 OR c_nationkey < 10 AS stale, CASE WHEN c_custkey % 4 = 0 THEN 'before' WHEN c_nationkey < 10 THEN 'structure changed' END AS stale_reason FROM customer"""
)
def marked_annotations(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    notes = c.select(k.alias("id"), (k % 4 == 0).alias("stale"), F.when(k % 4 == 0, "before").alias("stale_reason"))
    return planning.mark_stale(notes, c.where("c_nationkey < 10").select(k.alias("id")), "structure changed")


@query(
    """WITH f AS (SELECT 'c' || o_custkey AS subject, list(DISTINCT o_orderstatus) AS v FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1), c AS (SELECT c_custkey AS claim, 'c' || c_custkey AS subject, CASE WHEN c_custkey % 7 > 0 THEN ['F', 'O', 'P'][c_custkey % 3 + 1] END AS expects FROM customer)
    SELECT claim, CASE WHEN expects IS NULL THEN 'unknown' WHEN list_contains(v, expects) THEN 'confirmed' WHEN v IS NOT NULL THEN 'contradicted' WHEN claim % 2 = 0 THEN 'graph-gap' ELSE 'stale-doc' END AS finding FROM c LEFT JOIN f USING (subject)"""
)
def claim_findings(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    claims = c.select(k.alias("claim"), _text("c", k).alias("subject"), F.when(k % 7 > 0, _pick(k, ("F", "O", "P"))).alias("expects"))
    facts = table(spark, sf, "orders").where("o_custkey % 3 > 0").select(_text("c", F.col("o_custkey")).alias("subject"), F.col("o_orderstatus").alias("value"))
    return planning.consistency(claims, facts, c.where("c_custkey % 2 = 0").select(_text("c", k).alias("subject")))


@query("SELECT c_custkey AS id, c_custkey % 2 = 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0 AS valid FROM customer")
def override_validity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, "t").otherwise("  ").alias("target"), F.when(k % 3 > 0, "r").alias("reason"), F.when(k % 5 > 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return planning.valid_overrides(rows).select("id", "valid")


# Tools ----------------------------------------------------------------------------------------------------------------


@query(
    """WITH h AS (SELECT 'r' || n_regionkey AS route, list_sort(list(DISTINCT 'n' || n_nationkey)) AS handlers FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1), c AS (SELECT 'r' || n_regionkey AS route, list_sort(list(DISTINCT 's' || s_suppkey)) AS consumers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT 'r' || r_regionkey AS route, coalesce(handlers, []) AS handlers, coalesce(consumers, []) AS consumers FROM region LEFT JOIN h ON h.route = 'r' || r_regionkey LEFT JOIN c ON c.route = 'r' || r_regionkey"""
)
def route_map(spark: SparkSession, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    nodes = table(spark, sf, "region").select(_text("r", F.col("r_regionkey")).alias("id"), F.lit("Route").alias("label"))
    handles = n.where("n_nationkey % 2 = 0").select(_text("n", F.col("n_nationkey")).alias("src"), _text("r", F.col("n_regionkey")).alias("dst"), F.lit("HANDLES_ROUTE").alias("type"))
    fetched = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(_text("s", F.col("s_suppkey")), _text("r", F.col("n_regionkey")), F.lit("FETCHES"))
    return api.route_map(nodes, handles.union(fetched))


@query(
    """WITH h AS (SELECT o_custkey AS f, o_orderkey % 400 AS s, o_orderkey % 400 + o_orderkey % 9 AS e FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT 'c' || o_custkey || '.' || o_orderkey % 25 AS id, o_custkey AS f, min(o_orderkey % 25 * 20 + 1) AS s, min(o_orderkey % 25 * 20 + 10) AS e FROM orders GROUP BY 1, 2),
    t AS (SELECT DISTINCT id FROM n JOIN h USING (f) WHERE n.s <= h.e AND n.e >= h.s) SELECT id, 'changed' AS how, 0 AS depth FROM t"""
)
def detected_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Hunks of files against the lines of their symbols; no calls lead on."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf, "orders")
    hunks = orders.where("o_orderstatus = 'F'").select(k.alias("file"), (o % 400).alias("start"), (o % 400 + o % 9).alias("end"))
    nodes = orders.select(_text("c", k, ".", o % 25).alias("id"), k.alias("filePath"), (o % 25 * 20 + 1).alias("startLine"), (o % 25 * 20 + 10).alias("endLine")).distinct()
    edges = spark.createDataFrame([], "src string, dst string, type string, confidence double")
    return api.detect_changes(hunks, nodes, edges)


@query(
    """WITH RECURSIVE h AS (SELECT o_custkey AS f, o_orderkey % 400 AS s, o_orderkey % 400 + o_orderkey % 9 AS e FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), n AS (SELECT DISTINCT o_custkey AS f, o_orderkey % 25 AS k, ['Function', 'File', 'Method'][o_orderkey % 25 % 3 + 1] AS label FROM orders),
    t AS (SELECT DISTINCT n.f, k FROM n JOIN h USING (f) WHERE label <> 'File' AND k * 20 + 1 <= h.e AND k * 20 + 10 >= h.s), c AS (SELECT a.f, a.k AS src, b.k AS dst FROM n a JOIN n b ON a.f = b.f AND b.k = a.k + 1),
    w AS (SELECT f, k, 0 AS d FROM t UNION SELECT w.f, src, d + 1 FROM w JOIN c ON c.f = w.f AND c.dst = w.k WHERE d < 3), a AS (SELECT DISTINCT f, k FROM w WHERE (f, k) NOT IN (SELECT (f, k) FROM t)), p AS (SELECT * FROM t WHERE k % 5 = 0),
    x AS (SELECT (SELECT count(*) FROM t) AS changed, (SELECT count(*) FROM a) AS affected, (SELECT count(*) FROM p) AS processes)
    SELECT *, CASE WHEN affected >= 50 OR processes >= 10 THEN 'HIGH' WHEN affected >= 10 OR processes > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x"""
)
def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of a file call the next one; some are steps of processes."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf, "orders")
    hunks = orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(k.alias("file"), (o % 400).alias("start"), (o % 400 + o % 9).alias("end"))
    n = materialize(orders.select(k.alias("f"), (o % 25).alias("k")).distinct(), "nodes")
    nodes = n.select(_text("c", F.col("f"), ".", F.col("k")).alias("id"), _pick(F.col("k"), ("Function", "File", "Method")).alias("label"), F.col("f").alias("filePath"), (F.col("k") * 20 + 1).alias("startLine"), (F.col("k") * 20 + 10).alias("endLine"))
    calls = n.join(n.select("f", (F.col("k") - 1).alias("k")), ["f", "k"]).select(_text("c", F.col("f"), ".", F.col("k")).alias("src"), _text("c", F.col("f"), ".", F.col("k") + 1).alias("dst"), F.lit("CALLS").alias("type"))
    steps = n.where("k % 5 = 0").select(_text("c", F.col("f"), ".", F.col("k")), _text("p", F.col("f") % 10), F.lit("STEP_IN_PROCESS"))
    edges = calls.union(steps).select("src", "dst", "type", F.lit(1.0).alias("confidence"), F.lit(1).alias("step"))
    return api.change_summary(hunks, nodes, edges)


@query(
    with_("trade")
    + """, m AS (SELECT DISTINCT src_module, dst_module FROM trade WHERE src_module <> dst_module), r AS (SELECT CASE src_module WHEN 'NATION_1' THEN 'RENAMED' ELSE src_module END AS a, CASE dst_module WHEN 'NATION_1' THEN 'RENAMED' ELSE dst_module END AS b FROM m)
    SELECT a || '--' || b AS contract, a AS consumer, [a, b] AS ends FROM r"""
)
def renamed_contracts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.trade(spark, sf).where("src_module <> dst_module").select("src_module", "dst_module").distinct()
    ids = pairs.select(F.concat_ws("--", "src_module", "dst_module").alias("contract"), F.col("src_module").alias("consumer"), F.array("src_module", "dst_module").alias("ends"))
    return api.rename_module(ids, "NATION_1", "RENAMED", ["contract", "consumer", "ends"])


@query(
    """WITH a AS (SELECT p_brand AS m, p_partkey AS f FROM part), b AS (SELECT CASE WHEN p_partkey % 4 > 0 THEN 'new ' || p_brand ELSE 'other' END AS m, p_partkey AS f FROM part), z AS (SELECT m, count(*) AS n FROM a GROUP BY 1), s AS (SELECT a.m, b.m AS t, count(*) AS n FROM a JOIN b USING (f) GROUP BY 1, 2)
    SELECT s.m AS old_module, t AS new_module FROM s JOIN z USING (m) WHERE s.n / z.n > 0.6 QUALIFY row_number() OVER (PARTITION BY s.m ORDER BY s.n DESC, t) = 1"""
)
def migrated_annotations(spark: SparkSession, sf: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    part = table(spark, sf, "part")
    return api.migrate_annotations(part.select(brand.alias("module"), k.alias("file")), part.select(F.when(k % 4 > 0, _text("new ", brand)).otherwise("other").alias("module"), k.alias("file")))


@query(
    """WITH n AS (SELECT s_suppkey AS k, 's' || s_suppkey AS id, ['Function', 'Class'][s_suppkey % 2 + 1] AS label FROM supplier), e AS (SELECT DISTINCT 's' || s_suppkey AS a, 's' || (s_suppkey + 1) AS b FROM supplier WHERE s_suppkey + 1 IN (SELECT k FROM n))
    SELECT 'node' AS kind, label AS type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', 'CALLS', count(*) FROM e UNION ALL SELECT 'file', 'File', count(DISTINCT 'f' || k % 30) FROM n UNION ALL SELECT 'again', 'written', 0 UNION ALL SELECT 'cached', 'files', (SELECT count(*) FROM n WHERE k % 3 > 0)"""
)
def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written to a store, read back by type; the same facts again are not written; files whose content is cached."""
    path = f"{scratch_root(spark)}/terrane/store-{uuid.uuid4().hex}"
    store, k = GraphStore(spark, path), F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    nodes = s.select(_text("s", k).alias("id"), _pick(k, ("Function", "Class")).alias("label"), _text("f", k % 30).alias("filePath"))
    edges = s.select(_text("s", k).alias("from"), _text("s", k + 1).alias("to"), F.lit("CALLS").alias("type"))
    store.write_facts(nodes, edges)
    again = store.write_facts(nodes.orderBy(F.desc("id")), edges)
    files = s.select(_text("f", k % 30).alias("path"))
    out = store.nodes().groupBy(F.lit("node").alias("kind"), F.col("label").alias("type")).agg(F.count("*").alias("n")).union(store.edges().groupBy(F.lit("edge"), "type").agg(F.count("*")))
    added = supplement(store.nodes(), files).where("label = 'File'").agg(F.lit("file").alias("kind"), F.lit("File").alias("type"), F.count("*").alias("n"))
    hits, _ = cache_hits(s.select(_text("p", k).alias("path"), (k % 3).cast("string").alias("content_hash")), s.select(_text("p", k).alias("path"), F.when(k % 3 > 0, (k % 3).cast("string")).otherwise("x").alias("content_hash")))
    told = spark.createDataFrame([("again", "written", int(again))], "kind string, type string, n long")
    out = materialize(out.union(added).union(told).union(hits.agg(F.lit("cached"), F.lit("files"), F.count("*"))), "facts")
    drop(spark, path)
    return out


@query(
    """SELECT c_custkey AS id, c_name AS label, ['added', 'changed', 'removed'][c_custkey % 3 + 1] AS status FROM customer WHERE c_custkey % 3 < 2 AND contains(lower(c_custkey || ' ' || c_name), '7')"""
)
def recent_matches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return index.recent_matches(table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("label"), _pick(k, ("added", "changed", "removed")).alias("status")), "7")


@query(
    """WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS nth, s_name || ' of ' || s_nationkey AS line FROM supplier), n AS (SELECT count(*)::INT AS k FROM l UNION ALL SELECT floor(k * 0.75)::INT FROM n WHERE k > 1),
    f AS (SELECT max(k) AS k FROM n WHERE (SELECT sum(length(line) + 1) FROM l WHERE nth <= k) <= 1000) SELECT nth, line FROM l WHERE nth <= coalesce((SELECT k FROM f), (SELECT min(k) FROM n))"""
)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as the lines of a report of at most 1,000 characters: that limit is what the operator is for."""
    lines = table(spark, sf, "supplier").select(F.row_number().over(Window.orderBy("s_suppkey")).cast("long").alias("nth"), _text(F.col("s_name"), " of ", F.col("s_nationkey")).alias("line"))
    return index.within_budget(lines, 1000)


@query(
    """SELECT '/' || lower(p_type) || '/' || p_partkey AS path, CASE WHEN lower(p_type) IN ('promo', 'small') THEN list_concat(['auth', 'log'], list_filter(['own' || p_size % 3, 'log'], lambda x: x <> 'log')) ELSE ['own' || p_size % 3, 'log'] END AS middleware FROM part"""
)
def attached_middleware(spark: SparkSession, sf: str) -> DataFrame:
    routes = table(spark, sf, "part").select(_text("/", F.lower("p_type"), "/", F.col("p_partkey")).alias("path"), F.array(_text("own", F.col("p_size") % 3), F.lit("log")).alias("middleware"))
    return architecture.attach_middleware(routes, ["auth", "log"], ["/promo/.*", "/sma[lL]+/[0-9]+"])


@query(
    """WITH t AS (SELECT 't' || p_size AS tool, list_sort(list(DISTINCT p_brand)) AS handlers FROM part WHERE p_size % 4 > 0 GROUP BY 1) SELECT DISTINCT 't' || p_size AS tool, handlers FROM part LEFT JOIN t ON tool = 't' || p_size"""
)
def tool_map(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    part = table(spark, sf, "part")
    nodes = part.select(_text("t", size).alias("id"), F.lit("Tool").alias("label")).distinct()
    edges = part.where("p_size % 4 > 0").select(F.col("p_brand").alias("src"), _text("t", size).alias("dst"), F.lit("HANDLES_TOOL").alias("type"))
    return api.tool_map(nodes, edges)


@query(
    """SELECT DISTINCT 's' || l_partkey AS node, 'o' || l_orderkey AS process, l_linenumber AS step FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'"""
)
def processes_of_nodes(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(_text("s", F.col("l_partkey")).alias("src"), _text("o", F.col("l_orderkey")).alias("dst"), F.lit("STEP_IN_PROCESS").alias("type"), F.col("l_linenumber").alias("step")).distinct()
    return api.processes_of(edges, table(spark, sf, "part").where("p_type = 'PROMO'").select(_text("s", F.col("p_partkey")).alias("id")))


@query(
    with_("trade")
    + """, f AS (SELECT 'dead-code' AS rule, 'INFO' AS severity, 's' || s_suppkey AS subject FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT dst FROM trade WHERE name = 'Brand#3')
      UNION ALL SELECT DISTINCT 'forbidden', 'ERROR', src_module || ' -> ' || dst_module FROM trade WHERE src_module <> dst_module AND src_module IN (SELECT n_name FROM nation WHERE n_regionkey = 2) AND dst_module IN (SELECT n_name FROM nation WHERE n_regionkey = 2)),
    n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY subject) AS nth, count(*) OVER (PARTITION BY rule) AS k FROM f)
    SELECT rule, severity, subject FROM n WHERE nth <= 20 UNION ALL SELECT DISTINCT rule, severity, 'and ' || (k - 20) || ' more' FROM n WHERE k > 20"""
)
def lint_report(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 findings of each rule and the number of the others, as the tool reports them."""
    n = table(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("src_module"))
    rules = n.join(n.select(F.col("src_module").alias("dst_module")), F.col("src_module") != F.col("dst_module"))  # five nations
    calls = materialize(A.trade(spark, sf), "trade")
    symbols = table(spark, sf, "supplier").select(_text("s", F.col("s_suppkey")).alias("id"))
    dead = calls.where("name = 'Brand#3'")
    found = api.lint(symbols, dead.union(calls.where("name <> 'Brand#3'").withColumn("dst", F.lit("elsewhere"))), rules)
    return found
