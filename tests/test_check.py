"""The static checker, packets and the reviewer pass."""

import random

import pytest
from pyspark.sql import functions as F

from deltaloom.operators.merge import postprocessed
from deltaloom.operators.matching import greedy_match, precision_recall
from deltaloom.operators.staging import stage
from deltaloom.plans import check, packets, review, scenarios
from deltaloom.plans.config import TEMPLATE, Config, load
from deltaloom.sources import reports
from deltaloom.sources.python_code import params_of


@pytest.fixture(scope="module")
def index(spark):
    return check.build_index(*scenarios.snapshots(spark), stage=stage)


@pytest.fixture(scope="module")
def found(index):
    return stage(check.findings(index))


def test_golden_scores(spark, index, found):
    rows = found.withColumnRenamed("repo", "scenario")
    gold = scenarios.golden(spark).withColumnRenamed("repo", "scenario")
    got = precision_recall(greedy_match(rows.select("scenario", "file", "line", "title", "detail", "ord"), gold, "scenario")).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall, got.f1) == (gold.count(), 0, 0, 1.0, 1.0, 1.0) and got.tp > 12
    breaking = {r.repo for r in check.changed_symbols(index).filter("breaking").select("repo").distinct().collect()}
    assert breaking == set(scenarios.SCENARIOS)
    deltas = {(r.repo, r.qualname): r for r in check.changed_symbols(index).collect()}
    assert deltas["feed_loading", "rows"].breaking and deltas["feed_loading", "rows"].kind == "body_only"  # a generator now
    assert not any(deltas["quiet_edits", f].breaking for f in ("scale", "label")) and deltas["quiet_edits", "frame"].breaking


def test_packets_and_review(spark, index, found):
    p = stage(packets.with_prompts(packets.build(index, Config(max_callers=1)), found))
    rows = {(r.repo, r.unit, r.qualname): r for r in p.collect()}
    post = rows["ledger_posting", "symbol", "post"]
    assert (post.total_callers, post.dropped_callers, len(post.callers)) == (4, 3, 1) and "must now be given: currency" in post.prompt and "ALREADY PROVEN" in post.prompt
    assert rows["ledger_posting", "removed", "close_month"].callers[0]["path"] == "ledger/books.py"
    assert rows["order_fields", "field", "Order"].removed_fields == ["discount"]
    # Old bodies: where behaviour changed, and of what is gone.
    gone = rows["ledger_posting", "removed", "close_month"]
    assert "def close_month" in gone.old_source and "## BEFORE" in gone.prompt and any("were bound to it" in n for n in gone.notes)
    behaved = [r for r in rows.values() if r.unit == "symbol" and len(r.behavior)]
    assert behaved and all(r.old_source and f"def {r.qualname.rpartition('.')[2]}" in r.old_source and "## BEFORE" in r.prompt for r in behaved if r.kind != "full_review")
    assert all(r.old_source is None for r in rows.values() if r.unit == "symbol" and not len(r.behavior))
    assert all(sorted(r.place for r in rows.values() if r.repo == repo) == list(range(1, 1 + sum(r.repo == repo for r in rows.values()))) for repo in scenarios.SCENARIOS)

    def reviewer(prompt):
        if "Refute" in prompt:
            return {"content": '{"real": %s, "confidence": 0.6}' % ("true" if "weak" in prompt else "false")}
        if "feed/load.py" in prompt:
            raise RuntimeError("no answer")
        return {"content": 'Well:\n{"findings": [{"title": "weak spot", "line": 2, "confidence": 2}, {"title": "made up", "line": "x"}, {"title": " "}]}', "prompt_tokens": 5}

    one = p.filter("repo in ('pool_limits', 'feed_loading')")
    said, calls = review.review(one, reviewer, found.filter("repo = 'pool_limits'"))
    rows = said.collect()
    assert {(r.origin, r.title) for r in rows if r.origin == "model"} == {("model", "weak spot")} and all(r.confidence == 0.6 for r in rows if r.origin == "model")
    assert sum(r.origin == "static" for r in rows) == 2
    total = {r.repo: r for r in review.summary(said, calls).collect()}
    assert total["pool_limits"].worst_severity == "high" and total["feed_loading"].errors and all("no answer" in e for e in total["feed_loading"].errors)
    many = calls.withColumn("error", F.lit("no answer")).crossJoin(spark.range(7))
    assert {r.repo: (len(r.errors), r.failed) for r in review.summary(said, many).collect()} == {r.repo: (5, r.units * 7) for r in total.values()}
    assert review.gate(said) == 1 and review.gate(said.filter("origin = 'model'")) == 0
    assert "acquire" in reports.findings_text(said) and "## Review" in reports.comment_markdown(said).first().body
    assert reports.packets_json(one).count() == one.count() and "callers" in reports.packets_text(one)


def test_one_finding_of_a_place_and_title(spark):
    """Titles are equal whatever their case; of equal ones the first rule's stays."""
    rows = [("f", 3, "Gone", 0.9, 2), ("f", 3, " gone ", 0.95, 1), ("f", 4, "gone", 0.2, 3), ("f", None, "gone", 0.9, 4), ("g", 3, "gone", 0.9, 5)]
    df = spark.createDataFrame(rows, "file string, line long, title string, confidence double, ord long")
    assert sorted(r.ord for r in postprocessed(df, 0.45).collect()) == [1, 4, 5]


def test_binding_against_python(spark):
    """Where the rules speak, Python refuses the call; where they are silent without stars, it takes it."""
    rng, rows, truth = random.Random(4), [], []
    import ast

    for _ in range(400):
        kinds = sorted(rng.choices(range(5), k=rng.randrange(5)))
        kinds = [k for i, k in enumerate(kinds) if k not in (2, 4) or k not in kinds[:i]]
        parts, default, slash = [], False, 0
        for i, k in enumerate(kinds):
            default = (default and k < 2) or rng.random() < 0.3
            if k == 3 and not any(x in (2, 3) for x in kinds[:i]):
                parts.append("*")
            parts.append({2: "*", 4: "**"}.get(k, "") + f"p{i}" + ("=0" if default and k in (0, 1, 3) else ""))
            if k == 0 and not any(x == 0 for x in kinds[i + 1 :]):
                parts.append("/")
        src = f"def f({', '.join(parts)}): pass"
        names = {}
        exec(src, names)
        positional, keywords = rng.randrange(4), rng.sample(["p0", "p1", "p2", "q"], rng.randrange(3))
        try:
            names["f"](*[0] * positional, **dict.fromkeys(keywords, 0))
            truth.append(True)
        except TypeError:
            truth.append(False)
        rows.append((len(rows), params_of(ast.parse(src).body[0]), positional, keywords))
    df = spark.createDataFrame(rows, "i int, params array<struct<name: string, kind: string, annotation: string, has_default: boolean, `default`: string>>, positional int, keywords array<string>")
    no = F.lit(False)
    out = df.select("i", check.bind_problems(F.col("params"), no, no, F.lit("import"), F.col("positional"), F.col("keywords"), no, no, no).alias("p")).collect()
    wrong = [(rows[r.i], r.p, truth[r.i]) for r in out if (len(r.p) == 0) != truth[r.i]]
    assert not wrong and 50 < sum(truth) < 350, wrong[:2]


def test_config(tmp_path):
    (tmp_path / "deltaloom.toml").write_text("max_callers = 3\n[review]\nfail_on = 'low'\nnonsense = 1\n")
    (tmp_path / "deep").mkdir()
    c = load(tmp_path / "deep", {"DELTALOOM_TWO_HOP": "no", "DELTALOOM_MAX_CALLERS": "5"}, fail_on=None, num_ctx=1000)
    assert (c.max_callers, c.fail_on, c.two_hop, c.unit_budget) == (5, "low", False, 1200) and c.source
    assert "max_callers" in TEMPLATE and Config(max_unit_tokens=7).unit_budget == 7
