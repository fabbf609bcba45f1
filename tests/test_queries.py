"""Each query against its SQL in DuckDB over the small tables."""

import datetime
import decimal

import duckdb
import pytest

from weftline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def one(v):
        if isinstance(v, (float, decimal.Decimal)):
            return f"{float(v):.9g}"
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    found = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
