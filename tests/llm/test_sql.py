"""Queries of the training-data operators against their SQL in DuckDB."""

import duckdb
import pytest

from weftline.llm import registry


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for name_of in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{sf_dir}/{name_of}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = registry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns) and plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)
