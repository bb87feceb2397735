"""The registered queries of the text operators against their SQL, on the smallest tables."""

import duckdb
import pytest

from retentio.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SMALL).toArrow().select(want.column_names)
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist()))


def test_every_contract_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
