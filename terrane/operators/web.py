"""Routes, links, forms and sections out of page and document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def url_path(url: Column) -> Column:
    """The path of a URL, without host, query and fragment; '/' if empty."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/?#]*", ""), "[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def match_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """``url_id``, ``route``: the first route by ``seq`` whose segments match the path's.

    ``:name`` matches one segment, a last ``*`` any number. Paths and fixed-length routes meet by their number of
    segments; catch-all routes, of which there are few, by the first segment.
    """
    split = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    u = urls.select("url_id", split("path").alias("p")).withColumn("n", F.size("p"))
    r = routes.select("route", "seq", split("route").alias("r")).withColumn("any", F.element_at(F.concat(F.array(F.lit("")), "r"), -1) == "*")
    same = lambda p, q: F.forall(F.zip_with(q, F.slice(p, 1, F.size(q)), lambda y, x: (y == x) | F.startswith(y, F.lit(":"))), lambda ok: F.coalesce(ok, F.lit(False)))
    fixed = u.join(r.where("not any").withColumn("n", F.size("r")), "n").where(same(F.col("p"), F.col("r")))
    open_ = r.where("any").withColumn("r", F.slice("r", 1, F.size("r") - 1)).withColumn("first", F.get("r", F.lit(0)))
    caught = u.withColumn("first", F.get("p", F.lit(0))).join(open_, "first").where((F.size("r") <= F.col("n")) & same(F.col("p"), F.col("r")))
    both = fixed.select("url_id", "seq", "route").union(caught.select("url_id", "seq", "route"))
    return both.groupBy("url_id").agg(F.min(F.struct("seq", "route")).alias("x")).select("url_id", F.col("x.route").alias("route"))


def links(pages: DataFrame) -> DataFrame:
    """``page_id``, ``target`` of every ``href`` and form ``action``, in order of neither."""
    found = F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"')), F.regexp_extract_all("html", F.lit('action="([^"]*)"')))
    return pages.select("page_id", F.explode(found).alias("target"))


def sections(lines: DataFrame) -> DataFrame:
    """``doc``, ``line``, ``level``, ``end_line``, ``parent`` from headings (``doc``, ``line``, ``level``, ``last``: the document's last line).

    A section ends before the next heading of its level or a higher one; its parent is the nearest heading before it of
    a lower level number. Levels are few, so both are running minima and maxima by level, not a self-join.
    """
    order = Window.partitionBy("doc").orderBy("line")
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 7)
    next_ = F.least(*[F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("line"))).over(after)) for k in levels], F.lit(None).cast("long"))
    up = F.greatest(*[F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("line"))).over(before)) for k in levels], F.lit(None).cast("long"))
    return lines.select("doc", "line", "level", F.coalesce(next_ - 1, "last").alias("end_line"), up.alias("parent"))
