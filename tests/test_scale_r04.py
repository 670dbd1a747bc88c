"""What filled the disk: pairs of all years at once, each twice, and shuffle files that outlived their query."""

import datetime
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from deltaloom.operators import history, staging
from jobs import companion_history
from jobs.common import config, earlier
from jobs.registry import _COMPANIONS_SQL


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Four years, one of them unknown; files and commits that are null, repeated lines, commits that are too large, one by a null, orders without lines."""
    top = tmp_path_factory.mktemp("tables")
    orders = [(c, None if c % 4 == 3 else datetime.datetime(1992 + c % 4, 1 + c % 12, 1 + c % 28)) for c in range(120)]
    lines = [(c, f) for c in range(110) for f in [c % 7, c % 7 + 100, c % 5 + 200, None if c % 9 == 0 else c % 3, c % 7]]
    lines += [(3, f) for f in range(1000, 1026)] + [(c, f) for c in (8, 18) for f in range(1000, 1027)] + [(None, 1), (None, 2), (999, 1), (999, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(str(top / "orders"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(str(top / "lineitem"))
    return str(top / "orders"), str(top / "lineitem"), lines


def by_sql(orders, lineitem):
    con = duckdb.connect()
    for name, path in (("orders", orders), ("lineitem", lineitem)):
        con.execute(f"create view {name} as select * from '{path}/*.parquet'")
    return sorted(con.execute(_COMPANIONS_SQL).fetchall())


def shuffled(spark):
    """The shuffle files that are there."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_years_and_parts_go_one_after_another(spark, tables, tmp_path, monkeypatch):
    orders, lineitem, _ = tables
    settings, output, want = config(companion_history.CONFIG), str(tmp_path / "out"), by_sql(*tables[:2])
    taken, made, write = [], [], staging.stage
    monkeypatch.setattr(companion_history, "stage", lambda df, name, **by: made.append(name) or write(df, name, **by))
    monkeypatch.setattr(companion_history, "paired", lambda lists, by: taken.append(sorted(r.year or 0 for r in lists.select("year").distinct().collect())) or history.paired(lists, by))
    got = []
    for at_once in (10**6, 300, 1):
        monkeypatch.setattr(companion_history, "AT_ONCE", at_once)
        taken.clear(), made.clear()
        got.append(companion_history.run(spark, orders, lineitem, output, settings))
        assert sorted(tuple(r) for r in companion_history.read(spark, output).select("a", "b", "n", "rank").collect()) == want and len(want) > 10
        assert sorted(y for years in taken for y in years) == [0, 1992, 1993, 1994] and len(taken) == (1 if at_once > 300 else len(taken))
        assert made == ["lists"] + ["frequent"] * (1 if at_once > 300 else companion_history.PARTS)
    assert len(taken) == 4 and got[0] == got[1] == got[2]
    assert not [x for x in staging._written if "lists" in x[1] or "frequent" in x[1]]


def test_a_run_leaves_no_shuffle_files_and_no_settings(spark, tables, tmp_path):
    before, conf = shuffled(spark), {k: spark.conf.get(k) for k in companion_history.HELD}
    companion_history.run(spark, *tables[:2], str(tmp_path / "out"), config(companion_history.CONFIG))
    for _ in range(20):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.5)
    assert not left and {k: spark.conf.get(k) for k in companion_history.HELD} == conf


def test_both_ways_are_one_pair_until_counted(spark, tables):
    lines = spark.createDataFrame(tables[2], "c long, p long").filter("c is not null")
    lists = history.listed(lines, "c", "p")
    files = {}
    for c, f in tables[2]:
        files.setdefault(c, set()).add(f)
    want = sorted(sorted(x for x in f if x is not None) for c, f in files.items() if c is not None and 2 <= len(f) <= 30)
    assert sorted(r.files for r in lists.collect()) == want and max(map(len, want)) == 30
    assert len(files[8]) == len(files[18]) == 31 and None in files[18]
    pairs = [tuple(r) for r in history.paired(lists).collect()]
    assert len(pairs) == sum(len(f) * (len(f) - 1) // 2 for f in want) and all(a < b for a, b in pairs)


def test_rare_pairs_are_not_ranked(spark):
    """Of 400 pairs two come three times: no more are shuffled and sorted for the ranks."""
    pairs = spark.createDataFrame([(i % 20, i, 3 if i in (7, 8) else 1 + i % 2) for i in range(400)], "a long, b long, n long")
    plan = history.companions(pairs)._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Window"):
        plan = plan.children().apply(0)
    assert "(n#" in plan.children().apply(0).toString() and ">= 3)" in plan.children().apply(0).toString()
    assert sorted(tuple(r) for r in history.companions(pairs).collect()) == [(7, 7, 3, 1), (8, 8, 3, 1)]


def test_stored_pairs_are_one_row_a_year(spark, tables, tmp_path):
    output = str(tmp_path / "out")
    counts = companion_history.run(spark, *tables[:2], output, config(companion_history.CONFIG))
    stored = earlier(spark, f"{output}/pairs", companion_history.PAIRS)
    assert stored.count() == counts["pairs"] == stored.select("a", "b", "year").distinct().count()
    assert stored.filter("year is null").count() and not stored.groupBy(F.least("a", "b"), F.greatest("a", "b"), "year", "n").count().filter("count <> 2").count()


def test_years_without_pairs(spark, tables, tmp_path):
    """Nothing to count makes empty tables, and leaves other years as they are."""
    settings, output = config(companion_history.CONFIG), tmp_path / "out"
    none = {"first_year": 1901, "last_year": 1902}
    assert companion_history.run(spark, *tables[:2], str(output), settings | none) == {"read": 0, "pairs": 0, "companions": 0}
    assert (output / "pairs").exists() and companion_history.read(spark, str(output)).collect() == []
    whole = companion_history.run(spark, *tables[:2], str(output), settings)
    assert companion_history.run(spark, *tables[:2], str(output), settings | none) == whole | {"read": 0, "pairs": 0}
