"""Every registered query against its SQL over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple("~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def core():
    from newsloom.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.mark.parametrize("name", core())
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    assert columns == sorted(duck.sql(sql).columns)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert shown(df.select(*columns).collect()) == shown(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity", "competitor_pct", "internal_pct", "gap", "priority"]


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
