"""Every registered query against its DuckDB oracle on the smallest tables
(the driver checks sf0.01; this keeps the suite quick)."""

import duckdb
import pytest

import __spark_entry__ as E
from stagecraft.plans import catalog
from stagecraft.sources.tables import TABLES
from tools.check import digest

from conftest import SF_SMALL

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = SQL.get(name)
    if sql is None:
        pytest.skip("no oracle")
    # File-listing oracles name the sf0.01 folder; run them there.
    if "read_blob(" in sql:
        sql = sql.replace("/root/testdata/sf0.01", SF_SMALL)
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_oracle():
    missing = set(catalog.queries()) - set(SQL)
    assert not missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["FILE_NAME", "PROCESSED_DATA", "PROCESSED_AT"]
    assert df.count() > 0
