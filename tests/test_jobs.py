"""The two jobs: runs over growing copies, runs again, and results by plain Python."""

import datetime
import json
import re
import subprocess
import sys
from collections import Counter
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import companion_history, scan_texts
from jobs.common import config, earlier

SF = "/root/testdata/sf0.001"
COLUMNS = ["file", "line", "ord", "title", "layer", "severity", "confidence", "excerpt", "tokens"]


def found_by_force(rows, settings):
    out = []
    for doc_id, source, text in rows:
        hits = []
        for at, line in enumerate((text or "").splitlines(), 1):
            for i, r in enumerate(settings["rules"]):
                if r["confidence"] >= settings["floor"] and re.search(r["pattern"], line):
                    hits.append((f"{source or ''}/{doc_id}", at, i, r["title"], r["layer"], r["severity"], r["confidence"], re.sub(r["pattern"], "[...]", line)[: settings["excerpt"]], max(1, int(len(line) / 3.3))))
        proven = {h[1] for h in hits if h[4] == "proof"}
        seen = set()
        for h in hits:
            if h[4] != "proof" and proven & {h[1] - 1, h[1], h[1] + 1} or (h[1], h[3].strip().lower()) in seen:
                continue
            seen.add((h[1], h[3].strip().lower()))
            out.append(h)
    return sorted(out)


def found(spark, output):
    return sorted(tuple(r[c] for c in COLUMNS) for r in scan_texts.read(spark, output).collect())


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(str(path))


TEXTS = [
    (1, "a", 'x token = "0123456789abcdef0123" y\nnear 1234567812345678\n\nfar 1234567812345678'),
    (2, "a", "mail a.b@mail.example.com and c@d.org\r\nReleased under the MIT License."),
    (3, None, None),
    (4, "b", ""),
    (5, "b", "call +1 (555) 123-4567, 10.0.0.1\x85Licensed under the Apache License 10.20.30.40"),
    (6, "b", "nothing to see"),
]
LATER = [(7, "c", "card 1111222233334444 here"), (2, "a", "mail a.b@mail.example.com and c@d.org\r\nReleased under the MIT License."), (8, None, "é " * 500 + "9.9.9.9")]


def test_scan_takes_only_what_is_new(spark, tmp_path):
    settings = config(scan_texts.CONFIG)
    where = [str(tmp_path / x) for x in ("documents", "findings", "checkpoint")]
    write(spark, TEXTS, where[0])
    assert scan_texts.run(spark, *where, settings) == {"batches": 1, "read": 6, "written": len(found_by_force(TEXTS, settings))}
    assert found(spark, where[1]) == found_by_force(TEXTS, settings)
    before = {p: p.read_bytes() for p in Path(where[1]).rglob("*.parquet")}
    assert scan_texts.run(spark, *where, settings) == {"batches": 0, "read": 0, "written": 0}
    assert {p: p.read_bytes() for p in Path(where[1]).rglob("*.parquet")} == before

    write(spark, LATER, where[0])
    got = scan_texts.run(spark, *where, settings)
    # Document 2 comes again: its findings are known.
    assert got["read"] == 3 and got["written"] == len(found_by_force([LATER[0], LATER[2]], settings))
    both = found_by_force([*TEXTS, LATER[0], LATER[2]], settings)
    assert found(spark, where[1]) == both
    assert all(p.read_bytes() == b for p, b in before.items())

    # A batch whose commit was lost runs again and leaves the same rows.
    for p in (Path(where[2]) / "commits").glob("*1*"):
        p.unlink()
    assert scan_texts.run(spark, *where, settings)["batches"] == 1
    assert found(spark, where[1]) == both


def test_scan_of_a_given_table(spark, tmp_path):
    settings = config(scan_texts.CONFIG)
    half = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    where = [str(tmp_path / x) for x in ("documents", "findings", "checkpoint")]
    half.filter("doc_id % 2 = 0").write.parquet(where[0])
    scan_texts.run(spark, *where, settings)
    half.filter("doc_id % 2 = 1").write.mode("append").parquet(where[0])
    scan_texts.run(spark, *where, settings)
    assert found(spark, where[1]) == found_by_force([tuple(r) for r in half.collect()], settings)
    batches = {r.batch: r.n for r in scan_texts.read(spark, where[1]).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert set(batches) == {0, 1}


def test_scan_in_small_batches(spark, tmp_path):
    settings = config(scan_texts.CONFIG) | {"files_per_batch": 1}
    where = [str(tmp_path / x) for x in ("documents", "findings", "checkpoint")]
    for row in TEXTS:
        write(spark, [row], where[0])
    assert scan_texts.run(spark, *where, settings) == {"batches": 6, "read": 6, "written": len(found_by_force(TEXTS, settings))}
    assert found(spark, where[1]) == found_by_force(TEXTS, settings)


def test_scan_of_nothing(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("documents", "findings", "checkpoint")]
    write(spark, [(6, "b", "nothing to see")], where[0])
    assert scan_texts.run(spark, *where, config(scan_texts.CONFIG))["written"] == 0
    assert found(spark, where[1]) == []


def test_one_file_as_input(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("findings", "checkpoint")]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    scan_texts.run(spark, f"{SF}/documents.parquet", *where, config(scan_texts.CONFIG))
    assert found(spark, where[0]) == found_by_force(rows, config(scan_texts.CONFIG))


def companions_by_force(commits, settings):
    pairs = Counter()
    for files in commits.values():
        if settings["least"] <= len(files) <= settings["most"]:
            pairs.update(permutations(files, 2))
    out = []
    for a in {a for a, _ in pairs}:
        own = sorted(((-n, b) for (x, b), n in pairs.items() if x == a))
        out += [(a, b, -n, i) for i, (n, b) in enumerate(own[: settings["top"]], 1) if -n >= settings["together"] and -n >= settings["share"] * -own[0][0]]
    return sorted(out), pairs


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Orders and lines of three years with files that often go together, and one commit that is too large."""
    top = tmp_path_factory.mktemp("history")
    orders, lines, commits = [], [], {}
    for c in range(90):
        files = {c % 7, c % 7 + 100, c % 5 + 200} if c != 50 else set(range(1000, 1040))
        orders.append((c, datetime.date(1992 + c % 3, 1 + c % 12, 1 + c % 28)))
        lines += [(c, f) for f in [*files, min(files)]]
        commits[c] = files
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date").write.parquet(str(top / "orders"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(top / "lineitem"))
    return str(top / "orders"), str(top / "lineitem"), orders, commits


def test_companions_year_by_year(spark, history, tmp_path):
    orders, lineitem, dates, commits = history
    settings = config(companion_history.CONFIG)
    want, pairs = companions_by_force(commits, settings)
    rows = lambda path: sorted(tuple(r) for r in companion_history.read(spark, path).select("a", "b", "n", "rank").collect())
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    counts = companion_history.run(spark, orders, lineitem, whole, settings)
    assert rows(whole) == want and counts["companions"] == len(want)
    assert companion_history.run(spark, orders, lineitem, whole, settings) == counts and rows(whole) == want
    for first, last in ((1992, 1992), (1994, None), (None, 1993), (1993, 1993)):
        companion_history.run(spark, orders, lineitem, parts, settings | {"first_year": first, "last_year": last})
    assert rows(parts) == want
    by_year = earlier(spark, f"{parts}/pairs", companion_history.PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    assert {(r.a, r.b): r.n for r in by_year} == pairs
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_a_year_is_replaced(spark, history, tmp_path):
    orders, lineitem, dates, commits = history
    settings, output = config(companion_history.CONFIG), str(tmp_path / "out")
    companion_history.run(spark, orders, lineitem, output, settings)
    fewer = str(tmp_path / "fewer")
    spark.read.parquet(lineitem).filter("l_orderkey not between 0 and 29").write.parquet(fewer)
    companion_history.run(spark, orders, fewer, output, settings | {"first_year": 1992, "last_year": 1992})
    years = dict(dates)
    left = {c: f for c, f in commits.items() if years[c].year != 1992 or c > 29}
    got = earlier(spark, f"{output}/pairs", companion_history.PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    assert {(r.a, r.b): r.n for r in got} == companions_by_force(left, settings)[1]


def test_dates_reach_the_scan(spark, history):
    files = companion_history.touched(spark.read.parquet(history[0]), spark.read.parquet(history[1]), 1993, 1993)
    assert "GreaterThanOrEqual(o_orderdate,1993-01-01)" in files._jdf.queryExecution().executedPlan().toString()


def test_command_line(tmp_path):
    settings = json.loads(Path(companion_history.CONFIG).read_text()) | {"first_year": 1995}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    line = [sys.executable, "-m", "jobs.companion_history", "--orders", f"{SF}/orders.parquet", "--lineitem", f"{SF}/lineitem.parquet", "--output", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(line, cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = json.loads(done.stdout.strip().splitlines()[-1])
    assert counts["read"] > 0 and (tmp_path / "out/pairs/year=1995").exists() and not (tmp_path / "out/pairs/year=1994").exists()
    assert "touched files" in done.stderr


def test_jobs_need_no_other_half():
    for p in Path(scan_texts.__file__).parent.glob("*.py"):
        assert not re.search(r"\bllm\b|corpus_pipeline", p.read_text())


def rule(pattern, confidence=0.9, layer="proof"):
    return {"title": pattern, "layer": layer, "severity": "high", "confidence": confidence, "pattern": pattern}


def tried(df):
    """Rows that meet the rules one by one: what the filter under the hits lets through."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plans, out = [df._jdf.queryExecution().executedPlan()], []
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
    while plans:
        p = plans.pop()
        if p.nodeName() == "Filter":
            out.append(p.metrics().apply("numOutputRows").value())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_only_lines_with_hits_meet_the_rules(spark):
    rows = [(i, "a", "\n".join(f"line {j} of it" if j or i % 10 else "mail a@b.org, 123456789012" for j in range(50))) for i in range(40)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)
    df = scan_texts.hits(documents, config(scan_texts.CONFIG))
    # Of 2,000 lines four have a mail address; the filter after the hits keeps as many, and drops the long number, below the floor.
    assert df.count() == 4 and tried(df) == [4, 4]


def test_a_text_is_split_once(spark):
    documents = spark.createDataFrame([(1, "a", "x\ny\n")], "doc_id long, source string, text string")
    plan = scan_texts.hits(documents, config(scan_texts.CONFIG))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


@pytest.mark.parametrize("floor", [0.5, 0.95])
def test_rules_of_any_syntax_find_what_spark_finds(spark, floor):
    """Patterns that RE2 reads like Spark, reads otherwise, or can't read; lines with odd characters and broken UTF-8."""
    patterns = ["^a+$", "(^|[^0-9])[0-9]{3}([^0-9]|$)", ".", "^$", "é|ß", r"\bword\b", r"\w\s\d", "(?i)K", "a(?=b)", "(?<!x)y", "(a)b\\1", "a*+b", "[a-f[xyz]]{2}", "[a-z&&[^b-y]]{2}", "[]q]{2}", "x{1001}", "\\x{1F600}", "^.{3}$", r"\p{L}{4}"]
    rules = [rule(p) for p in patterns] + [rule("z+", 0.3), rule("high", 0.99), rule("[0-9]{3}", 0.96, "hint")]
    lines = ["aaa", "123", "x123y", "1234", "", "é", "Kelvin K", "word", "aword b", "w 1", "ab", "xy", "aba", "aaab", "az", "]q]", "x" * 1001, "😀😀", "zzz", "high 123", "a 123\u0085b", "\x1c1\x1d2\x1e", "\r\n\r", "ſ k", "\x00123\x00"]
    documents = spark.createDataFrame([(i, "s", t) for i, t in enumerate(lines)] + [(90, None, "\n".join(lines) + "\n"), (91, "s", None)], "doc_id long, source string, text string")
    documents = documents.unionByName(spark.sql("select 92L doc_id, 's' source, cast(concat(X'FF', cast('123' as binary), X'C328') as string) text"))
    settings = {"floor": floor, "reach": 1, "excerpt": 20, "rules": rules}
    texts = documents.select(F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("file"), F.posexplode(scan_texts.split_lines(F.col("text"))).alias("at", "text"))
    want = {(r.file, r.at + 1, i) for i, x in enumerate(rules) if x["confidence"] >= floor for r in texts.filter(F.col("text").rlike(x["pattern"])).collect()}
    got = [(r.file, r.line, r.ord) for r in scan_texts.hits(documents, settings).collect()]
    assert sorted(got) == sorted(want) and len({i for _, _, i in want}) == sum(x["confidence"] >= floor for x in rules)


def test_no_rule_reaches_the_floor(spark):
    documents = spark.createDataFrame([(1, "a", "zz")], "doc_id long, source string, text string")
    assert scan_texts.hits(documents, {"floor": 0.5, "reach": 1, "excerpt": 20, "rules": [rule("z+", 0.3)]}).count() == 0
