import os

import duckdb
import pytest

from aulario.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{SF_DIR}/documents.parquet'")
        want = con.sql(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, SF_DIR).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    assert sorted(map(str, got.select(columns).to_pylist())) == sorted(map(str, want.select(columns).to_pylist()))
    for c in columns:
        assert str(got.schema.field(c).type) == str(want.schema.field(c).type).replace("large_string", "string")


def test_queries_are_registered_under_their_numbers():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13 and "pipeline" in QUERIES
