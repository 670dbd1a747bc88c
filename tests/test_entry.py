"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pagerank' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); import deltaloom.cli"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_query(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and [r.place for r in rows] == list(range(1, 11))


def test_nothing_else_imports_the_subpackage():
    for top, _, names in os.walk(os.path.join(REPO, "deltaloom")):
        if os.sep + "llm" not in top:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(top, n), encoding="utf-8") as f:
                        assert "deltaloom.llm" not in f.read()
