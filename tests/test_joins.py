"""Suffix and prefix joins, sweeps, and matching in rounds against brute force."""

import random
import re

import pytest

from deltaloom.operators import evidence, graph, intervals, matching
from deltaloom.plans import link


def test_suffixes_of_names(spark):
    names = ["a.b.c.d", "b.c.d", "c.d", "d", "x.c.d", "", ".c.d", None, "a..d"]
    defined = ["c.d", "b.c.d", "d", "a.b.c.d", ".d"]
    asked = spark.createDataFrame([("r", n) for n in [*names, "c.d"]] + [("s", "x.c.d")], "repo string, target string")
    known = spark.createDataFrame([("r", q, i) for i, q in enumerate([*defined, "c.d"])], "repo string, qualname string, id int")
    got = sorted((r.target, r.id) for r in evidence.suffix_matches(asked, known, ["repo"], "target", "qualname").collect())
    want = sorted((n, i) for n in names if n for i, q in enumerate([*defined, "c.d"]) if "." in q and n.endswith("." + q) and q.count(".") < n.count("."))
    assert got == want and ("x.c.d", 0) in got


@pytest.mark.parametrize("separator", [".", "/"])
def test_longest_prefix(spark, separator):
    rng = random.Random(4)
    word = lambda n: separator.join(rng.choice("ab*") for _ in range(rng.randrange(1, n)))
    names = [(rng.choice("rs"), word(6)) for _ in range(80)] + [("r", None), ("r", ""), ("r", "ab"), ("r", "a")]
    known = [(rng.choice("rs"), word(4)) for _ in range(14)] * 2
    got = evidence.longest_prefix(spark.createDataFrame(names, "k string, name string"), spark.createDataFrame(known, "k string, p string"), ["k"], "name", "p", separator).collect()
    fits = lambda k, n: [p for j, p in known if j == k and n is not None and (n == p or n.startswith(p + separator))]
    assert sorted(map(str, ((r.k, r.name, r.p) for r in got))) == sorted(map(str, ((k, n, max(fits(k, n), key=len, default=None)) for k, n in names)))


@pytest.mark.parametrize("cell", [1, 3, 4096])
def test_sweeps(spark, cell):
    rng = random.Random(cell)
    key = lambda: rng.choice(["x", "y", None])
    points = [(key(), rng.choice([None, *range(-20, 20)])) for _ in range(120)]
    spans = [(i, key(), a := rng.randrange(-22, 22), a + rng.randrange(-2, 15)) for i in range(60)] + [(99, "x", None, 3), (98, "x", 3, None), (97, "z", 0, 9)]
    p, s = spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(spans, "id int, k string, a int, z int")
    held = {r.id: r.points for r in intervals.coverage(s, p, ["k"], "a", "z", "at", cell=cell).collect()}
    assert held == {i: len({x for j, x in points if j == k and x is not None and a is not None and z is not None and a <= x <= z}) for i, k, a, z in spans}
    got = sorted((str(r.k), str(r.at), r.depth) for r in intervals.depth(p, s, ["k"], "a", "z", "at", cell=cell).collect())
    assert got == sorted((str(k), str(x), sum(j == k and x is not None and a is not None and z is not None and a <= x <= z for _, j, a, z in spans)) for k, x in points)


def taken_in_turn(pairs):
    out, gone = {}, set()
    for k, t in sorted({(k, t) for k, t, _ in pairs}):
        free = sorted(p for j, u, p in pairs if (j, u) == (k, t) and (k, p) not in gone)
        if free:
            out[k, t] = free[0]
            gone.add((k, free[0]))
    return out


@pytest.mark.parametrize("dense", [2, 6])
def test_first_come_as_one_after_the_other(spark, dense):
    rng = random.Random(dense)
    pairs = [(rng.randrange(3), rng.randrange(25), rng.randrange(25)) for _ in range(60 * dense)]
    # A chain in which each taker pushes the next one on.
    pairs += [(9, i, j) for i in range(12) for j in range(i + 1)] + [(8, 5, 1), (8, 2, 1), (8, 5, 3), (8, 2, 0)]
    got = matching.first_come(spark.createDataFrame(pairs, "k int, t int, p int"), ["k"], "t", "p").collect()
    assert {(r.k, r.t): r.p for r in got} == taken_in_turn(pairs)


def scores_by_force(findings, golden):
    out = {}
    for group in {f[0] for f in findings} | {g[0] for g in golden}:
        left = sorted((g for g in golden if g[0] == group), key=lambda g: tuple(map(str, (f"{g[1]:05}", *g[2:]))))
        own = sorted((f for f in findings if f[0] == group), key=lambda f: tuple(map(str, (f"{f[1]:05}", *f[2:]))))
        tp = 0
        for _, _, file, line, title, detail in own:
            for g in left:
                if file == g[2] and line is not None and abs(line - g[3]) <= 2 and (g[4] or "").lower() in f"{title} {detail}".lower():
                    left.remove(g)
                    tp += 1
                    break
        out[group] = (tp, len(own) - tp, len(left))
    return out


def test_scores(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["Gone", "renamed", "arg"])
    findings = [(rng.choice("abc"), i, rng.choice(["f.py", "g.py"]), rng.choice([None, *range(1, 12)]), word(), word()) for i in range(60)] + [("d", 1, "f.py", 1, "x", "y")] * 2
    golden = [(rng.choice("abce"), i, rng.choice(["f.py", "g.py"]), rng.randrange(1, 12), rng.choice([None, "", "GONE", "ren"])) for i in range(40)] + [("d", 1, "f.py", 2, "x")] * 2
    f = spark.createDataFrame(findings, "s string, ord int, file string, line int, title string, detail string")
    g = spark.createDataFrame(golden, "s string, ord int, path string, line int, keyword string")
    got = {r.s: (r.tp, r.fp, r.fn) for r in matching.greedy_match(f, g, "s").collect()}
    assert got == scores_by_force(findings, golden) and got["d"] == (2, 0, 0)


def test_a_hot_name_meets_only_what_a_file_imports(spark):
    """A name that 2,000 modules define and 300 files call: candidates are those of each file's own imports."""
    symbols = link.symbols_with_names(spark.createDataFrame([("r", f"m{i}.py", f"m{i}", "main", "function", 0) for i in range(2000)], "repo string, path string, module string, qualname string, kind string, ord int"))
    imports = spark.createDataFrame([("r", f"u{i}.py", f"m{i}") for i in range(300)], "repo string, path string, target string")
    asks = spark.createDataFrame([("r", f"u{i}.py", "main") for i in range(300)], "repo string, path string, short string")
    near = link.importable(asks, symbols, imports)
    assert sorted((r.path, r.c_fqname) for r in near.collect()) == sorted((f"u{i}.py", f"m{i}.main") for i in range(300))
    near.write.format("noop").mode("overwrite").save()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Join [repo#" in plan and not re.search(r"Join \[repo#\d+, short#\d+\]", plan)


def test_imports_lead_to_modules(spark):
    files = spark.createDataFrame([("r", "a", 1), ("r", "a.b", 2), ("r", "a.b.c", 3), ("q", "x", 4)], "repo string, module string, n int")
    imports = spark.createDataFrame([("r", "u.py", t) for t in ("a.b.c.f", "a.b", "a.z", "os.path", "ab")], "repo string, path string, target string")
    assert sorted((r.target, r.module) for r in link.depends(imports, files).collect()) == [("a.b", "a.b"), ("a.b.c.f", "a.b.c"), ("a.z", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_with_cycles_and_stops(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(i + 100, i + 101) for i in range(11)]
    starts, stops = [0, 1, 2, 100, 999], {(0, 5), (1, 7), (100, 107)}
    want = {}
    for with_stops in (False, True):
        for s in starts:
            level, seen, depth = {s}, {s}, 0
            while level:
                depth += 1
                level = {c for p, c in edges if p in level and not (with_stops and (s, p) in stops)} - seen
                seen |= level
                want.update({(with_stops, s, n): depth for n in level})
    table = spark.createDataFrame(edges, "parent int, child int")
    begin, end = spark.createDataFrame([(s,) for s in starts], "start int"), spark.createDataFrame(sorted(stops), "start int, node int")
    got = {(bool(e), r.start, r.node): r.depth for e in (None, end) for r in graph.descendants(begin, table, stops=e).collect()}
    assert got == want
