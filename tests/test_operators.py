"""Single operators on small tables: empty inputs, nulls, ties."""

from pyspark.sql import functions as F

from deltaloom.functions import scalars as S
from deltaloom.operators import evidence, graph, history, intervals, merge, ranking


def test_lines_and_windows(spark):
    texts = ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h", "x" * 50]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.split_lines(F.col("t")).alias("l"), S.token_estimate(F.col("t")).alias("n")).collect()
    assert all(r.l == texts[r.i].splitlines() and r.n == max(1, int(len(texts[r.i]) / 3.3)) for r in rows)
    lines = spark.createDataFrame([([f"l{i}" for i in range(1, 12)],)], "l array<string>")
    assert lines.select(S.numbered_window(F.col("l"), F.lit(9), 2)).first()[0] == "  7|l7\n  8|l8\n> 9|l9\n 10|l10\n 11|l11"
    got = lines.select(S.numbered_slice(F.col("l"), F.lit(2), F.lit(99), 400)).first()[0].split("\n")
    assert got[0] == " 2|l2" and got[-1] == "11|l11"


def test_scores(spark):
    df = spark.createDataFrame([("HIGH", "self"), ("odd", "odd"), (None, None)], "s string, r string")
    assert [(r[0], r[1]) for r in df.select(S.severity_rank(F.col("s")), S.confidence_of(F.col("r"))).collect()] == [(3, 0.9), (0, 0.3), (0, 0.3)]
    assert [r[0] for r in spark.createDataFrame([("tests/a.py",), ("x/test_a.py",), ("a_test.py",), ("contest.py",), ("conftest.py",)], "p string").select(S.is_test_path(F.col("p"))).collect()] == [True, True, True, False, True]


def test_ownership_and_ties(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer", 0), ("f", 10, 20, "a", 1), ("f", 10, 20, "b", 2), ("g", 5, 4, "none", 3)], "path string, s int, e int, name string, ord int")
    points = spark.createDataFrame([("f", 15), ("f", 99), ("f", 300), ("g", 5), (None, 1)], "path string, line int")
    got = intervals.owning_span(points, spans, ["path"], "line", "s", "e", [F.col("e") - F.col("s"), F.col("ord")], ["name"])
    assert {(r.path, r.line): r.name for r in got.collect()} == {("f", 15): "a", ("f", 99): "outer", ("f", 300): None, ("g", 5): None, (None, 1): None}


def test_graphs(spark):
    edges = spark.createDataFrame([("b", "a", 0), ("c", "b", 0), ("c", "x", 1), ("a", "c", 0)], "child string, parent string, position int")
    down = graph.descendants(spark.createDataFrame([("a",), ("z",)], "start string"), edges)
    assert {(r.start, r.node, r.depth) for r in down.collect()} == {("a", "b", 1), ("a", "c", 2)}  # a cycle ends
    up = graph.ancestors(spark.createDataFrame([("c",)], "start string"), edges, 2).orderBy("path").collect()
    assert [r.node for r in up] == ["c", "b", "a", "x"]
    assert graph.descendants(edges.limit(0).select(F.col("child").alias("start")), edges).count() == 0
    ranks = {r.node: r.score for r in graph.pagerank(spark.createDataFrame([("a", "h"), ("a", "h"), ("b", "h"), ("h", "d"), ("b", "b"), ("a", "d")], "src string, dst string")).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "d" and ranks["h"] > ranks["a"]
    assert graph.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_rank_budget_merge_history(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 1), ("b", 4, 99)], "k string, i int, c int")
    assert sorted(r.i for r in ranking.within_budget(rows, ["k"], [F.asc("i")], F.col("c"), 10).collect()) == [1, 2]
    assert sorted(r.i for r in ranking.first_wins(rows, ["k"], ["i"]).collect()) == [1, 4]
    proven = spark.createDataFrame([("f", 10), ("f", None)], "file string, line int")
    model = spark.createDataFrame([("f", 10), ("f", 11), ("f", 12), ("g", 10), ("f", None)], "file string, line int")
    assert {(r.file, r.line) for r in merge.without_neighbours(model, proven, "file", "line").collect()} == {("f", 12), ("g", 10), ("f", None)}
    commits = spark.createDataFrame([(c, p) for c in range(4) for p in ("a", "b")] + [(9, "a"), *((8, f"x{i}") for i in range(40))], "c int, p string")
    pairs = history.co_changes(commits, "c", "p")
    assert {(r.a, r.b, r.n) for r in pairs.collect()} == {("a", "b", 4), ("b", "a", 4)}
    assert [r.b for r in history.companions(pairs, spark.createDataFrame([("a",)], "path string")).collect()] == ["b"]
    cand = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), *((3, c) for c in "wxyz")], "key int, candidate string")
    assert {(r.key, r.outcome, r.n) for r in evidence.classified(cand, ["key"]).collect()} == {(1, "resolved", 1), (2, "ambiguous", 2), (3, "dropped", 4)}
