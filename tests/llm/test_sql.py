"""Registered queries of the training-data operators against their DuckDB SQL, over whole tables."""

import duckdb
import pytest

from deltaloom.llm import queries

SF = "/root/testdata/sf0.001"


def rows_of(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, [str(f.type) for f in table.schema], sorted(repr(list(r.values())) for r in table.to_pylist())


@pytest.mark.parametrize("name", ["op1_substring", "quality_base_counts"])
def test_query(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = rows_of(queries.QUERIES[name](spark, SF).toArrow())
    assert got == rows_of(con.sql(queries.ORACLES[name]).to_arrow_table()) and got[2]
