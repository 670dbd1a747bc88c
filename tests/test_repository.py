"""Repositories, the index store, statistics and the incremental parser on a small git repository."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from deltaloom import cli
from deltaloom.operators.staging import stage
from deltaloom.plans import benchmark, link
from deltaloom.sources import diffs, endpoint, index_store, reports, repository
from deltaloom.sources.python_code import parsed, table_of, with_modules
from deltaloom.streaming.incremental import parse_arrivals


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    (root / "shop" / "deep").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "build").mkdir()
    for name, text in {"shop/__init__.py": "", "shop/p.py": "def price(x, y):\n    return x\n", "shop/q.py": "from shop.p import price\n\n\ndef f(a):\n    return price(a, 1)\n", "shop/deep/z.py": "def lone():\n    pass\n", ".hidden/h.py": "x = 1\n", "build/b.py": "x = 1\n", "notes.txt": "no"}.items():
        (root / name).write_text(text)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q", "-b", "main"), git("add", "-A"), git("commit", "-qm", "one")
    (root / "shop/p.py").write_text("def price(x, y, z):\n    return x\n")
    git("commit", "-qam", "two")
    return root


def test_tree_diff_and_history(spark, repo):
    files = repository.read_tree(spark, str(repo), exclude=("build",))
    assert {r.path for r in files.collect()} == {"shop/__init__.py", "shop/p.py", "shop/q.py", "shop/deep/z.py"}
    modules = {r.path: r.module for r in with_modules(files).collect()}
    assert modules == {"shop/__init__.py": "shop", "shop/p.py": "shop.p", "shop/q.py": "shop.q", "shop/deep/z.py": "z"}
    text, base = repository.diff_text(str(repo), span="HEAD")
    assert base == "HEAD^" and [f["path"] for f in diffs.parse_diff(text)] == ["shop/p.py"]
    assert repository.diff_text(str(repo), span="HEAD~1..HEAD")[0] == text == repository.diff_text(str(repo), span="HEAD~1...HEAD")[0]
    assert repository.default_base(str(repo)) == "main" and not repository.has_revision("nothing", str(repo))
    old = repository.files_at(spark, str(repo), base, ["shop/p.py", "shop/none.py"]).collect()
    assert [r.path for r in old] == ["shop/p.py"] and "x, y)" in old[0].src
    assert {(r.commit, r.path) for r in repository.history(spark, str(repo)).filter("path like 'shop/p%'").collect()} == {("1", "shop/p.py"), ("2", "shop/p.py")}
    with pytest.raises(repository.GitError):
        repository.git(["show", "nothing"], str(repo))
    base_files, change = files.select("repo", "path", "src"), spark.createDataFrame([("", "shop/q.py", None), ("", "new.py", "x")], "repo string, path string, src string")
    assert {r.path for r in repository.overlay(base_files, change).collect()} == {"shop/__init__.py", "shop/p.py", "shop/deep/z.py", "new.py"}
    whole = {r.path: r.new_lines for r in diffs.whole_file(base_files).collect()}
    assert whole["shop/p.py"] == [1, 2] and whole["shop/__init__.py"] == []


def test_store_parses_only_what_changed(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    files = with_modules(repository.read_tree(spark, str(repo), exclude=("build",)))
    index_store.save(index_store.refreshed(spark, files, store), store)
    changed = files.withColumn("src", F.lit("def other(): pass")).withColumn("size", F.when(F.col("path") == "shop/q.py", 1).otherwise(F.col("size")).cast("bigint"))
    rows = {r.path: [s.qualname for s in r.symbols] for r in index_store.refreshed(spark, changed, store).collect()}
    assert rows == {"shop/__init__.py": [], "shop/p.py": ["price"], "shop/q.py": ["other"], "shop/deep/z.py": ["lone"]}


def test_linking_needs_evidence(spark):
    a = "def run_it():\n    pass\n\ndef get():\n    pass\n\ndef print():\n    pass\n"
    many = {f"m{i}.py": "def go():\n    pass\n" for i in range(3)}
    base = "class A:\n    def act(self):\n        pass\n"
    cases = {
        "nothing imports it": {"a.py": a, "u.py": "x.run_it()\n"},
        "an import, a protocol name, a builtin": {"a.py": a, "u.py": "import a\nx.run_it()\nx.get()\nprint(1)\n"},
        "three candidates": many | {"u.py": "import m0, m1, m2\nx.go()\n"},
        "four candidates": many | {"m3.py": "def go():\n    pass\n", "u.py": "import m0, m1, m2, m3\nx.go()\n"},
        "inherited": {"b.py": base, "c.py": "from b import A\n\nclass B(A):\n    pass\n", "u.py": "from c import B\n\ndef f(b: B):\n    b.act()\n"},
    }
    files = spark.createDataFrame([(r, p, src) for r, fs in cases.items() for p, src in fs.items()], "repo string, path string, src string")
    rows = stage(parsed(with_modules(files)))
    symbols = link.symbols_with_names(table_of(rows, "symbols"))
    imports, calls = table_of(rows, "imports").select("repo", "path", "target"), table_of(rows, "calls")
    linked, dropped = link.link(calls, symbols, imports, link.hierarchy(symbols, imports))
    linked, dropped = stage(linked), stage(dropped.select("repo", "key"))
    got = {r: set() for r in cases}
    for r in linked.filter("path = 'u.py'").collect():
        got[r.repo].add((r.line, r.callee, r.tag))
    assert list(got.values()) == [set(), {(2, "a.run_it", "attr")}, {(2, f"m{i}.go", "ambiguous") for i in range(3)}, set(), {(4, "b.A.act", "typed")}]
    stats = {r.repo: r for r in link.statistics(rows, symbols, calls, linked, dropped).collect()}
    assert [stats[r].too_ambiguous for r in cases] == [1, 2, 0, 1, 0] and stats["inherited"].files == 3 and stats["three candidates"].resolved == 3


def test_incremental(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.createDataFrame([("r", f"f{n}.py", f"f{n}", f"def g{n}(): pass")], "repo string, path string, module string, src string").coalesce(1).write.mode("append").parquet(source)
        parse_arrivals(spark, source, target, str(tmp_path / "marks")).awaitTermination()
        assert spark.read.parquet(target).count() == n


def test_bytes_that_are_no_text_are_replaced(spark, repo):
    (repo / "shop" / "latin.py").write_bytes(b"# caf\xe9\ndef served():\n    pass\n")
    files = repository.read_tree(spark, str(repo), exclude=("build",))
    rows = {r.path: r for r in parsed(with_modules(files)).collect()}
    assert [s.qualname for s in rows["shop/latin.py"].symbols] == ["served"]
    assert files.filter("path = 'shop/latin.py'").first().src.startswith("# caf\ufffd")


def test_a_lost_write_leaves_the_old_store(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    files = with_modules(repository.read_tree(spark, str(repo), exclude=("build",)))
    assert index_store.current(spark, store) is None
    index_store.save(index_store.refreshed(spark, files, store), store)
    first = index_store.current(spark, store)
    index_store.refreshed(spark, files, None).limit(1).write.parquet(f"{store}/v{index_store.VERSION}-lost")  # written, never pointed to
    assert index_store.current(spark, store) == first and spark.read.parquet(first).count() == 4
    index_store.save(index_store.refreshed(spark, files, store).filter("path <> 'shop/q.py'"), store)
    assert index_store.current(spark, store) != first and index_store.refreshed(spark, files, store).count() == 4


def test_pull_requests_by_the_forges_command(spark, repo, tmp_path):
    gh = tmp_path / "gh"
    gh.write_text('#!/bin/sh\nif [ "$2" = diff ]; then git diff HEAD^ HEAD; else echo \'{"baseRefOid": "nothing", "baseRefName": "main"}\'; fi\n')
    gh.chmod(0o755)
    text, base = repository.pull_request(str(repo), 7, str(gh))
    assert base == "main" and [f["path"] for f in diffs.parse_diff(text)] == ["shop/p.py"]
    with pytest.raises(repository.GitError):
        repository.pull_request(str(repo), 7, str(tmp_path / "none"))


@pytest.fixture
def served():
    """An endpoint that knows one model and says what it was asked."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            data = json.dumps(body).encode()
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self.answer({"models": [{"name": "m:1"}, {"name": "a"}]})

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["model"] != "m:1":
                self.answer({})
            elif self.path == "/api/show":
                self.answer({"model_info": {"x.context_length": 4096}})
            else:
                found = {"findings": [{"title": "said by the model", "line": 1, "confidence": 0.9}]}
                text = '{"real": true, "confidence": 0.8}' if "Refute" in asked["messages"][1]["content"] else json.dumps(found)
                self.answer({"message": {"content": text}, "prompt_eval_count": asked["options"]["num_ctx"] - 5, "eval_count": 3, "total_duration": 5_000_000})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_endpoint(served):
    model = endpoint.Endpoint(served, "m:1", 16384)
    assert model.models() == ["a", "m:1"] and model.context_length() == 4096 and model.clamped().num_ctx == 4096
    got = model.clamped()("hello")
    assert (got["truncated"], got["prompt_tokens"], got["eval_tokens"], got["duration_ms"]) == (True, 4091, 3, 5)
    assert model.health()[0] and endpoint.Endpoint(served, "m:2").health()[0] and not endpoint.Endpoint(served, "z").health()[0]
    assert not endpoint.Endpoint("http://127.0.0.1:9", "m").health()[0]
    with pytest.raises(endpoint.EndpointAway):
        endpoint.Endpoint("http://127.0.0.1:9", "m")("x")
    with pytest.raises(endpoint.EndpointError):
        endpoint.Endpoint(served, "z")("x")


def test_answers_are_read_without_a_server():
    """Recorded answers, whole and with parts missing."""
    assert endpoint.review_in({"message": {"content": "x"}, "prompt_eval_count": 10, "eval_count": 2, "total_duration": 1_999_999}, 4096) == {"content": "x", "prompt_tokens": 10, "eval_tokens": 2, "duration_ms": 1, "truncated": False}
    assert endpoint.review_in({}, 4) == {"content": "", "prompt_tokens": 0, "eval_tokens": 0, "duration_ms": 0, "truncated": True}
    assert endpoint.length_in({"model_info": {"a.context_length": 9, "b.context_length": "7", "b.other": 1}}) == 7 and endpoint.length_in({}) is None
    assert endpoint.names_in({"models": [{"name": "b"}, {"name": "a"}]}) == ["a", "b"] and endpoint.names_in({}) == []
    assert [endpoint.standing(w, ["m:1", "n:1"])[0] for w in ("m:1", "m:2", "m", "o", "")] == [True, True, True, False, False]


def test_failures_have_words():
    from urllib.error import HTTPError, URLError

    told = lambda e: endpoint.explained("http://h", 3, e)
    away = [told(URLError("refused")), told(ConnectionResetError("reset"))]
    assert all(isinstance(e, endpoint.EndpointAway) for e in away)
    others = [told(HTTPError("http://h", 500, "broken", {}, None)), told(TimeoutError()), told(URLError(TimeoutError())), told(ValueError("no"))]
    assert not any(isinstance(e, endpoint.EndpointAway) for e in others) and ["500" in str(others[0]), "3 s" in str(others[1]), "3 s" in str(others[2]), "JSON" in str(others[3])] == [True] * 4


def test_command_line(spark, repo, served, capsys, monkeypatch):
    (repo / "shop/p.py").write_text("def price(x, y, z, t):\n    return x\n")
    (repo / "shop/new.py").write_text("def fresh():\n    pass\n")
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert cli.main(["check", "--root", str(repo), "--json"]) == 1
    assert "is missing required argument" in capsys.readouterr().out
    assert index_store.current(spark, str(repo / cli.STORE))  # the next run parses what changed only
    assert cli.main(["review", "--root", str(repo), "--untracked", "--host", served, "--model", "m:1"]) == 1
    told = capsys.readouterr().out
    assert "said by the model" in told and "is missing required argument" in told and "shop/new.py" in told
    assert cli.main(["doctor", "--root", str(repo), "--host", served, "--model", "m:1"]) == 0 and "4096" in capsys.readouterr().out
    assert cli.main(["models", "--root", str(repo), "--host", served]) == 0 and capsys.readouterr().out.split() == ["a", "m:1"]
    assert reports.painted("x", "red", True) == "\x1b[31mx\x1b[0m" and reports.painted("x", "red", False) == "x"


def test_scale_and_review_sets(spark, tmp_path):
    row = benchmark.scale_row(spark, 12, 5).first()
    assert (row.modules, row.callers) == (12, 5) and row.full > row.packets > 0 and row.ratio == pytest.approx(row.full / row.packets)
    (tmp_path / "m.json").write_text('[{"url": "u/1", "num": 1, "goldens": [{"comment": "lock is lost", "severity": "High"}, {"comment": "off by one", "severity": "Low"}]}, {"url": "u/2", "num": 2, "goldens": [{"comment": "leak", "severity": "Low"}]}]')
    (tmp_path / "r1.json").write_text('{"pr": 1, "mode": "static", "packets": 2, "comments": [{"path": "a.py", "line": 3, "body": "the <b>lock</b> is lost"}, {"path": "b.py", "line": null, "body": "style"}]}')
    (tmp_path / "r2.json").write_text('{"pr": 2, "mode": "static", "packets": 0, "comments": []}')
    known = benchmark.manifest(spark, str(tmp_path / "m.json"))
    said = benchmark.candidates(benchmark.results(spark, str(tmp_path / "r*.json")), known, "ours")
    assert said.filter("url = 'u/1'").first().comments == ["(a.py:3) the lock is lost", "(b.py:None) style"]

    def judge(prompt):
        if "off by one" in prompt:
            raise RuntimeError("no answer")
        return 0 if "lock" in prompt else 5

    (total,) = benchmark.totals(benchmark.judged(known, said, judge)).collect()
    assert (total.tool, total.golden, total.matched, total.comments, total.matched_comments) == ("ours", 3, 1, 2, 1)
    assert total.recall == pytest.approx(1 / 3) and total.precision == 0.5
    found = spark.createDataFrame([("a.py", 1, "low", "t", "d", "s", 0.5, 1), ("b.py", 2, "high", "t2", "d2", None, 0.9, 2)], "file string, line long, severity string, title string, detail string, suggestion string, confidence double, ord long")
    assert [c["body"] for c in json.loads(benchmark.exported(found))] == ["**t2**\n\nd2", "**t**\n\nd\n\nSuggestion: s"]
