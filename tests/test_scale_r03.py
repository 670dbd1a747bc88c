"""Steps whose work once grew faster than their input, on small tables that tell the difference."""

from pyspark.sql import functions as F

from deltaloom.operators import graph, history, intervals, staging
from deltaloom.plans import delta_tables, link, registry

SF = "/root/testdata/sf0.001"


def rows_made(df):
    """The most rows that one operator of the executed plan puts out."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plans, most = [df._jdf.queryExecution().executedPlan()], 0
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
    while plans:
        p = plans.pop()
        found = p.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_copies_of_a_definition_are_counted_before_they_meet_the_asks(spark):
    """40 files ask for a name that the module they import defines 50 times, and for one that it defines three times."""
    defs = [("r", "m.py", "m", "hot", "function", i) for i in range(50)] + [("r", "m.py", "m", "rare", "function", 100 + i) for i in range(3)] + [("r", "u1.py", "u1", "rare", "function", 0)]
    symbols = link.symbols_with_names(spark.createDataFrame(defs, "repo string, path string, module string, qualname string, kind string, ord int"))
    imports = spark.createDataFrame([("r", f"u{i}.py", t) for i in range(40) for t in ("m", "m.rare", "u1")[: 2 if i else 3]], "repo string, path string, target string")
    asks = spark.createDataFrame([("r", f"u{i}.py", s) for i in range(40) for s in ("hot", "rare", "none")], "repo string, path string, short string")
    got = link.answers(asks, symbols, imports)
    by_force = link.importable(asks, symbols, imports).groupBy("repo", "path", "short").agg(F.count(F.lit(1)).alias("n"), F.collect_list("c_fqname").alias("c")).filter("n <= 3").select("repo", "path", "short", "n", F.explode("c").alias("c"))
    want = sorted(map(tuple, by_force.collect()))
    assert len(want) == 38 * 3 and sorted(map(tuple, got.collect())) == want
    assert rows_made(link.answers(asks, symbols, imports)) < 300 < 40 * 50 <= rows_made(link.importable(asks, symbols, imports))


def test_pagerank_ends_with_the_walk_and_keeps_plans_small(spark, monkeypatch):
    """Every written table has one step's plan; walks that die out are not followed, and cycles are, to the end."""
    plans = []

    def kept(df, name="stage"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join")))
        return staging.stage(df, name)

    monkeypatch.setattr(graph, "stage", kept)
    made = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    ends = {r.node: r.score for r in graph.pagerank(made([("a", "s"), ("a", "t"), ("b", "t"), ("b", "b"), ("a", None)])).collect()}
    assert [n for n, _ in plans].count("vector") == 2
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")]
    cycle = {r.node: r.score for r in graph.pagerank(made(rows)).collect()}
    assert [n for n, _ in plans].count("vector") == 2 + 25 and max(n for _, n in plans) <= 1
    alone = {r.node: r.score for r in graph.pagerank(made([("x", "x"), ("y", "y")])).collect()}
    assert alone == {"x": 0.5, "y": 0.5}
    for got, edges in ((ends, [("a", "s"), ("a", "t"), ("b", "t")]), (cycle, [e for e in rows if e[0] != e[1]])):
        rank = dict.fromkeys(got, 1 / len(got))
        for _ in range(25):
            out = {n: [b for a, b in edges if a == n] for n in got}
            lost = sum(rank[n] for n in got if not out[n])
            rank = {n: 0.15 / len(got) + 0.85 * lost / len(got) + 0.85 * sum(rank[m] * out[m].count(n) / len(out[m]) for m in got if out[m]) for n in got}
        assert all(abs(rank[n] - got[n]) < 1e-12 for n in got)


def test_two_hop_does_not_group_its_result(spark):
    """The result is by far the largest table, and distinct as it is: its last step is the join."""
    plan = registry.QUERIES["two_hop"](spark, SF)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().apply(0)
    assert plan.nodeName() == "Join"


def test_a_task_pairs_a_bounded_number_of_files(spark, monkeypatch):
    """Commits are dealt out by the pairs that they make; companions of a table of pairs are ranked by one sort."""
    dealt = []
    monkeypatch.setattr(history, "dealt", lambda df, rows, *by: dealt.append(rows) or staging.dealt(df, rows, *by))
    monkeypatch.setattr(staging, "ROWS", 40)
    rows = [(c, f"f{(c * 7 + i) % 23}") for c in range(50) for i in range(c % 6)] * 2 + [(99, f"f{i}") for i in range(31)] + [(None, "f1"), (None, "f2"), (7, None)]
    made, alike = (history.co_changes(spark.createDataFrame(rows, "c int, p string"), "c", "p", sparse=x) for x in (True, False))
    want = {}
    for c in range(50):
        files = {p for k, p in rows if k == c}
        for a in files:
            for b in files - {a} if 2 <= len(files) <= 30 else ():
                want[a, b] = want.get((a, b), 0) + (a is not None and b is not None)
    assert {(r.a, r.b): r.n for r in made.collect()} == {k: n for k, n in want.items() if n}
    assert sorted(alike.collect()) == sorted(made.collect()) and len(dealt) == 3 and min(dealt) >= sum(want.values())
    ranked = history.companions(made, least=1, share=0.0)
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1 + made._jdf.queryExecution().optimizedPlan().toString().count("Window [")


def test_a_sweep_is_one_pass_over_its_points(spark, monkeypatch):
    """Points come out of the sweep with their columns, in parts of bounded size, whatever is null or repeated."""
    monkeypatch.setattr(staging, "ROWS", 10)
    points = [(k, i, f"t{i % 3}") for k in ("a", "b", None) for i in range(-9, 60, 2)] + [("a", None, "n"), ("a", 5, "x"), ("a", 5, "x"), ("c", 4000, "y")]
    spans = [(k, i, i + i % 11) for k in ("a", None) for i in range(-5, 50, 3)] + [("a", 9, 3), ("a", 1, None), ("c", 1, 9000), ("d", 1, 2)]
    p, s = spark.createDataFrame(points, "k string, at int, tag string"), spark.createDataFrame(spans, "k string, a int, z int")
    got = intervals.depth(p, s, ["k"], "a", "z", "at", cell=8)
    want = sorted(repr((k, at, tag, sum(1 for key, a, z in spans if key == k and at is not None and z is not None and a <= at <= z))) for k, at, tag in points)
    assert got.columns == ["k", "at", "tag", "depth"] and sorted(repr(tuple(r)) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() > 4 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_statistics_write_no_table_of_linked_calls(spark, monkeypatch):
    """Bound calls are counted as they are made; only what the linker reads again is written."""
    names = []
    monkeypatch.setattr(delta_tables, "stage", lambda df, name="stage": names.append(name) or staging.stage(df, name))
    delta_tables.index_statistics(spark, SF)
    assert names == ["index"] * 3
