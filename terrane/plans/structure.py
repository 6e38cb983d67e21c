"""Queries of communities and modules over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terrane.operators import communities as C, modules as M
from terrane.plans import adapters as A
from terrane.plans.adapters import with_
from terrane.plans.registry import query
from terrane.sources.tables import table

#: Parts as symbols: calls between parts that follow each other in orders, and a chain of inheritance within a brand and type.
_EDGES = f"""{with_("calls")}, nd AS (SELECT p_partkey AS id, ['Function', 'Class', 'Method', 'Interface', 'File'][p_size % 5 + 1] AS label FROM part),
    ed AS (SELECT src, dst, 'CALLS' AS type, confidence FROM calls UNION ALL SELECT * FROM (SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS dst, 'EXTENDS' AS type, 1.0::DOUBLE AS confidence FROM part) WHERE dst IS NOT NULL
      UNION ALL SELECT * FROM (SELECT p_partkey, lead(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS dst, 'IMPLEMENTS', 0.9::DOUBLE FROM part) WHERE dst IS NOT NULL)"""
#: All symbols with an edge.
_WHOLE = (
    _EDGES
    + """, used AS (SELECT src, dst FROM ed WHERE src <> dst), kept AS MATERIALIZED (SELECT DISTINCT id FROM nd JOIN (SELECT src AS id FROM used UNION ALL SELECT dst FROM used) USING (id) WHERE label <> 'File'),
    links AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM used WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept))"""
)
#: What reports of communities keep of a large graph.
_GRAPH = (
    _EDGES
    + """,
    big AS (SELECT count(*) > 10000 AS large FROM nd WHERE label <> 'File'), used AS (SELECT src, dst FROM ed, big WHERE src <> dst AND (NOT large OR confidence >= 0.5)),
    deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM used UNION ALL SELECT dst FROM used) GROUP BY 1),
    kept AS MATERIALIZED (SELECT id FROM nd JOIN deg USING (id), big WHERE label <> 'File' AND n >= CASE WHEN large THEN 2 ELSE 1 END),
    links AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM used WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept))"""
)
TURNS, LEVELS = 5, 3


def _communities_sql(turns: int = TURNS, levels: int = LEVELS, whole: bool = False) -> str:
    """The turns of each level unrolled; a turn that does not raise modularity is taken back."""
    weights = "1 AS res FROM st0" if whole else "CASE WHEN any_value(large) THEN 2 ELSE 1 END AS res FROM st0, big"
    out = f"""{_WHOLE if whole else _GRAPH}, e0 AS MATERIALIZED (SELECT a, b, 1::BIGINT AS w FROM links UNION ALL SELECT b, a, 1 FROM links),
    st0 AS MATERIALIZED (SELECT kept.id, kept.id AS c, coalesce(k, 0)::BIGINT AS k, 0::BIGINT AS inner_ FROM kept LEFT JOIN (SELECT a AS id, count(*) AS k FROM e0 GROUP BY 1) USING (id)),
    al AS MATERIALIZED (SELECT sum(k)::HUGEINT AS whole, {weights}), m0 AS (SELECT id, id AS c FROM st0)"""

    def looked(name: str, state: str, steps: str) -> str:
        return f""", {name} AS MATERIALIZED (WITH tt AS (SELECT c, sum(k)::HUGEINT AS total FROM {state} GROUP BY 1),
      ev AS (SELECT id, c, sum(l) AS l FROM (SELECT a AS id, c, w AS l FROM {steps} JOIN {state} ON b = id UNION ALL SELECT id, c, 0 FROM {state}) GROUP BY 1, 2),
      sc AS (SELECT ev.id, ev.c, l, m.c AS here, k, inner_, total, whole * l - res * k * (total - CASE WHEN ev.c = m.c THEN k ELSE 0 END) AS gain FROM ev JOIN {state} m ON m.id = ev.id JOIN tt ON tt.c = ev.c, al),
      b AS (SELECT id, any_value(here) AS c, any_value(k) AS k, any_value(inner_) AS inner_, max(l) FILTER (c = here) AS own, max(total) FILTER (c = here) AS total, max(gain) FILTER (c = here) AS stay, max(gain) AS most FROM sc GROUP BY 1)
      SELECT b.id, b.c, b.k, b.inner_, own, b.total, CASE WHEN most > stay THEN (SELECT min(sc.c) FROM sc WHERE sc.id = b.id AND sc.gain = most) END AS target FROM b),
    q_{name} AS MATERIALIZED (SELECT coalesce(sum(whole * (own + 2 * inner_) - res * k * total), 0) AS q FROM {name}, al)"""

    for level in range(levels):
        best = f"v{level}"
        out += looked(best, f"st{level}", f"e{level}")
        for turn in range(turns):
            state, tried, later = f"s{level}_{turn}", f"t{level}_{turn}", f"b{level}_{turn}"
            out += f""", {state} AS MATERIALIZED (SELECT id, CASE WHEN ('0x' || left(md5(id::VARCHAR || '/{level}/{turn}'), 1))::INT % 2 = 0 THEN coalesce(target, c) ELSE c END AS c, k, inner_ FROM {best})"""
            out += looked(tried, state, f"e{level}")
            out += f""", {later} AS MATERIALIZED (SELECT * FROM {tried} WHERE (SELECT q FROM q_{tried}) > (SELECT q FROM q_{best}) UNION ALL SELECT * FROM {best} WHERE (SELECT q FROM q_{tried}) <= (SELECT q FROM q_{best})),
    q_{later} AS MATERIALIZED (SELECT greatest((SELECT q FROM q_{tried}), (SELECT q FROM q_{best})) AS q)"""
            best = later
        out += f""", st{level + 1} AS MATERIALIZED (SELECT c AS id, c, sum(k)::BIGINT AS k, (sum(inner_) + sum(own) // 2)::BIGINT AS inner_ FROM {best} GROUP BY 1, 2),
    m{level + 1} AS MATERIALIZED (SELECT m.id, n.c FROM m{level} m JOIN {best} n ON n.id = m.c),
    e{level + 1} AS MATERIALIZED (SELECT x.c AS a, y.c AS b, sum(w)::BIGINT AS w FROM e{level} JOIN {best} x ON x.id = a JOIN {best} y ON y.id = b WHERE x.c <> y.c GROUP BY 1, 2)"""
    return out + f", ms AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY c) AS community FROM m{levels})"


def _graph(spark: SparkSession, sf: str, large: int | None) -> tuple[DataFrame, DataFrame, bool]:
    part = table(spark, sf, "part")
    label = F.element_at(F.array(*map(F.lit, ("Function", "Class", "Method", "Interface", "File"))), (F.col("p_size") % 5 + 1).cast("int"))
    nodes = part.select(F.col("p_partkey").alias("id"), label.alias("label"))
    after = lambda n: F.lead("p_partkey", n).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    chain = [part.select(F.col("p_partkey").alias("src"), after(n).alias("dst"), F.lit(t).alias("type"), F.lit(c).alias("confidence")).where("dst IS NOT NULL") for n, t, c in ((1, "EXTENDS", 1.0), (2, "IMPLEMENTS", 0.9))]
    edges = A.calls(spark, sf).select("src", "dst", "type", "confidence").union(chain[0]).union(chain[1])
    return C.symbol_graph(nodes, edges, large)


def _communities(spark: SparkSession, sf: str, large: int | None = C.LARGE) -> tuple[DataFrame, DataFrame, int]:
    nodes, links, is_large = _graph(spark, sf, large)
    resolution = 2 if is_large else 1
    return C.modular_communities(nodes, links, resolution, TURNS, LEVELS), links, resolution


@query(_communities_sql(whole=True) + " SELECT id, community FROM ms")
def modular_communities(spark: SparkSession, sf: str) -> DataFrame:
    return _communities(spark, sf, None)[0]


@query(
    _communities_sql()
    + """, en AS (SELECT x.community AS c, y.community = x.community AS same FROM e0 JOIN ms x ON x.id = a JOIN ms y ON y.id = b), s AS (SELECT c, count(*) AS total, count(*) FILTER (same) AS own FROM en GROUP BY 1)
    SELECT round((SELECT sum(own) / sum(total) - any_value(res) * sum(total::DOUBLE * total) / sum(total) / sum(total) FROM s, al), 9) AS modularity, count(DISTINCT community) AS communities, count(*) AS nodes FROM ms"""
)
def community_modularity(spark: SparkSession, sf: str) -> DataFrame:
    found, links, resolution = _communities(spark, sf)
    return C.modularity(found, links, resolution).withColumn("modularity", F.round("modularity", 9))


@query(
    _communities_sql()
    + """, z AS (SELECT community, count(*) AS members FROM ms GROUP BY 1 HAVING count(*) > 1), f AS (SELECT id, community FROM ms WHERE community IN (SELECT community FROM z) QUALIFY row_number() OVER (PARTITION BY community ORDER BY id) <= 50),
    n AS (SELECT f.community, count(*) FILTER (y.community = f.community) / count(*) AS cohesion FROM f JOIN e0 ON a = f.id JOIN ms y ON y.id = b GROUP BY 1)
    SELECT community, members, round(coalesce(cohesion, 1.0), 9) AS cohesion FROM z LEFT JOIN n USING (community)"""
)
def community_nodes(spark: SparkSession, sf: str) -> DataFrame:
    found, links, _ = _communities(spark, sf)
    return C.community_nodes(found, links).withColumn("cohesion", F.round("cohesion", 9))


#: Parts as functions of files in four folders, three quarters of them in communities; the words of a name are its camel humps.
_FILES = f"""{with_("calls")}, nd AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_retailprice > 950 AS exported, p_size, CASE WHEN p_partkey % 4 > 0 THEN p_name || p_size % 2 END AS community,
      ['api', 'cli', 'db', 'web'][p_size % 4 + 1] AS dir, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'core/' ELSE p_type || '/' END AS sub FROM part),
    nn AS (SELECT *, w[1] || upper(left(w[2], 1)) || substr(w[2], 2) AS name, dir || '/' || sub || CASE WHEN p_size % 10 = 0 THEN 'misc' ELSE w[2] END || '_' || id % 1000 // 2 || CASE WHEN id % 11 = 0 THEN '_test.go' ELSE '.go' END AS path FROM nd)"""
_FILE_MODULES = (
    _FILES
    + """, fi AS (SELECT DISTINCT path, dir FROM nn), bg AS (SELECT dir FROM fi GROUP BY 1 HAVING count(*) > 50), sp AS MATERIALIZED (SELECT * FROM nn WHERE dir IN (SELECT dir FROM bg)),
    wd AS (SELECT id, dir, path, community, unnest(w) AS word FROM sp), gw AS (SELECT * FROM wd WHERE word NOT IN ('new')),
    cl AS (SELECT dir, community, word AS label FROM gw WHERE community IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY dir, community ORDER BY count(*) DESC, length(word) DESC, word) = 1),
    vo AS (SELECT sp.dir, path, label, count(*) AS n FROM sp JOIN cl ON cl.dir = sp.dir AND cl.community = sp.community GROUP BY 1, 2, 3),
    bm AS MATERIALIZED (SELECT dir, path, label FROM vo QUALIFY row_number() OVER (PARTITION BY dir, path ORDER BY n DESC, label) = 1),
    sf AS (SELECT dir, path, string_split(string_split(path, '/')[-1], '_')[1] AS stem FROM fi), st AS (SELECT bm.dir, stem, label, count(*) AS n FROM bm JOIN sf ON sf.path = bm.path GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY bm.dir, stem ORDER BY count(*) DESC, label) = 1),
    rs AS (SELECT DISTINCT dir, path FROM sp WHERE path NOT IN (SELECT path FROM bm)), bs AS (SELECT rs.dir, rs.path, label FROM rs JOIN sf ON sf.path = rs.path LEFT JOIN st ON st.dir = rs.dir AND st.stem = sf.stem),
    ow AS (SELECT dir, path, word AS label FROM gw WHERE path IN (SELECT path FROM bs WHERE label IS NULL) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY dir, path ORDER BY count(*) DESC, length(word) DESC, word) = 1),
    lb AS MATERIALIZED (SELECT * FROM bm UNION ALL SELECT * FROM bs WHERE label IS NOT NULL UNION ALL SELECT * FROM ow), sz AS (SELECT dir, label, count(*) AS n FROM lb GROUP BY 1, 2),
    wh AS (SELECT id, sp.dir, label FROM sp JOIN lb ON lb.path = sp.path), me AS (SELECT x.dir, x.label AS f, y.label AS t, count(*) AS n FROM calls JOIN wh x ON x.id = src JOIN wh y ON y.id = dst WHERE x.dir = y.dir AND x.label <> y.label GROUP BY 1, 2, 3),
    bo AS (SELECT dir, f AS small, t AS label, n FROM me UNION ALL SELECT dir, t, f, n FROM me),
    ne AS (SELECT bo.dir, small, bo.label, sum(bo.n) AS n FROM bo JOIN sz s ON s.dir = bo.dir AND s.label = small AND s.n < 5 JOIN sz l ON l.dir = bo.dir AND l.label = bo.label AND l.n >= 5 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY bo.dir, small ORDER BY sum(bo.n) DESC, bo.label) = 1),
    wi AS (SELECT dir, label AS widest FROM sz WHERE n >= 5 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, label) = 1),
    it AS (SELECT sz.dir, sz.label, coalesce(ne.label, widest) AS goes FROM sz JOIN wi ON wi.dir = sz.dir LEFT JOIN ne ON ne.dir = sz.dir AND ne.small = sz.label WHERE sz.n < 5),
    mg AS (SELECT lb.dir, path, coalesce(goes, lb.label) AS label, CASE WHEN len(string_split(path, '/')) >= 3 THEN string_split(path, '/')[2] END AS folder FROM lb LEFT JOIN it ON it.dir = lb.dir AND it.label = lb.label),
    wd2 AS (SELECT dir, label FROM mg GROUP BY 1, 2 HAVING count(*) > 100 AND count(DISTINCT coalesce(folder, '_flat')) >= 2),
    fm AS MATERIALIZED (SELECT path, mg.dir || '/' || CASE WHEN wd2.label IS NOT NULL THEN coalesce(folder, mg.label) ELSE mg.label END AS module FROM mg LEFT JOIN wd2 ON wd2.dir = mg.dir AND wd2.label = mg.label
      UNION ALL SELECT path, dir FROM fi WHERE dir NOT IN (SELECT dir FROM bg))"""
)


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key, size, words = F.col("p_partkey"), F.col("p_size"), F.split("p_name", " ")
    second = F.get(words, F.lit(1))
    name = F.concat(F.get(words, F.lit(0)), F.initcap(second))
    folder = F.element_at(F.array(*map(F.lit, ("api", "cli", "db", "web"))), (size % 4 + 1).cast("int"))
    sub = F.when(key % 3 == 0, "").when(key % 3 == 1, "core/").otherwise(F.concat("p_type", F.lit("/")))
    ending = F.when(key % 11 == 0, "_test.go").otherwise(".go")
    path = F.concat(folder, F.lit("/"), sub, F.when(size % 10 == 0, "misc").otherwise(second), F.lit("_"), F.floor(key % 1000 / 2).cast("string"), ending)
    part = table(spark, sf, "part")
    nodes = part.select(key.alias("id"), name.alias("name"), path.alias("path"), (F.col("p_retailprice") > 950).alias("exported"))
    membership = part.where(key % 4 > 0).select(key.alias("id"), F.concat("p_name", (size % 2).cast("string")).alias("community"))
    return nodes, A.calls(spark, sf), membership


@query(_FILE_MODULES + " SELECT path, module FROM fm")
def file_modules(spark: SparkSession, sf: str) -> DataFrame:
    return M.file_modules(*_files(spark, sf))


@query(
    _FILE_MODULES
    + """, pl AS MATERIALIZED (SELECT id, name, nn.path, module, exported FROM nn JOIN fm ON fm.path = nn.path), cr AS (SELECT x.module AS a, y.module AS b, dst FROM calls JOIN pl x ON x.id = src JOIN pl y ON y.id = dst WHERE x.module <> y.module),
    ic AS (SELECT dst, count(*) AS n FROM cr GROUP BY 1), ce AS (SELECT module, name FROM pl LEFT JOIN ic ON dst = id WHERE exported AND path NOT LIKE '%_test.go' QUALIFY row_number() OVER (PARTITION BY module ORDER BY coalesce(n, 0) DESC, id) = 1),
    fl AS (SELECT module, list_sort(list(DISTINCT path)) AS files FROM fm GROUP BY 1), dp AS (SELECT a AS module, string_agg(DISTINCT b, ',' ORDER BY b) AS l FROM cr GROUP BY 1), db_ AS (SELECT b AS module, string_agg(DISTINCT a, ',' ORDER BY a) AS l FROM cr GROUP BY 1)
    SELECT fl.module, coalesce(ce.name, '') AS canonical_entry, len(files)::INT AS n_files, coalesce(dp.l, '') AS depends_on, coalesce(db_.l, '') AS depended_by,
    left(sha256('{"canonical_entry":"' || coalesce(ce.name, '') || '","files":["' || array_to_string(files, '","') || '"],"id":"' || fl.module || '"}'), 8) AS struct_hash
    FROM fl LEFT JOIN ce ON ce.module = fl.module LEFT JOIN dp ON dp.module = fl.module LEFT JOIN db_ ON db_.module = fl.module"""
)
def modules(spark: SparkSession, sf: str) -> DataFrame:
    return M.modules(*_files(spark, sf))
