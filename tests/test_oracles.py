"""Every registered core query against its DuckDB SQL, over whole tables."""

import duckdb
import pytest

from deltaloom.plans import delta_tables, linked_tables, registry
from jobs import registry as job_registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

MODULES = (registry, linked_tables, delta_tables, job_registry)
QUERIES, ORACLES = ({name: x for m in MODULES for name, x in getattr(m, kind).items()} for kind in ("QUERIES", "ORACLES"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, [str(f.type) for f in table.schema], sorted(repr([round(v, 8) if isinstance(v, float) else v for v in r.values()]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = rows_of(QUERIES[name](spark, SF).toArrow()), rows_of(duck.sql(ORACLES[name]).to_arrow_table())
    assert got == want
    assert got[2] or name in ("companions", "job2_companion_history")


def test_two_hop_whole_by_force(spark, duck):
    """Over all edges, none left out: counted in plain Python from the raw tables."""
    edges = set(duck.sql("select o_custkey, l_suppkey from orders, lineitem where o_orderkey = l_orderkey").fetchall())
    customers, reached = {c for (c,) in duck.sql("select c_custkey from customer").fetchall()}, {}
    for src, dst in edges:
        reached.setdefault(src, set()).add(dst)
    want = {(src, dst, end) for src, dst in edges if dst in customers for end in reached.get(dst, ())}
    got = registry.QUERIES["two_hop"](spark, SF).collect()
    assert len(got) == len(want) and {(r.start, r.via, r.reached) for r in got} == want
