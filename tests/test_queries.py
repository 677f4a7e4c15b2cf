"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from tidewatch.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, data).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)


def test_entry_registers_queries():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
