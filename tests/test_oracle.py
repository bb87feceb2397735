"""Every registered query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from paths import SF_SMALL
from retentio.plans import catalog
from retentio.sources.tables import TABLES

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(tbl):
    cols = sorted(tbl.column_names)
    data = {c: tbl.column(c).to_pylist() for c in cols}
    return sorted(tuple(repr(data[c][i]) for c in cols) for i in range(tbl.num_rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    got = df.toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(got) == _rows(want)


def test_entry_smoke(spark):
    out = entry.entry(spark)
    assert out.count() == 1 and "total_customers" in out.columns
