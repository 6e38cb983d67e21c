"""Every query that has SQL equals what DuckDB makes of the same tables."""

import duckdb
import pytest

from terrane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    res = con.execute(sql)
    have = [d[0] for d in res.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    compare(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
