"""Repositories as tables: a directory, git revisions, diffs and history. git runs on the driver; what it
prints becomes rows. Anything else (object stores, tables of files) only has to give (repo, path, src)."""

from __future__ import annotations

import json
import re
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GitError(RuntimeError):
    pass


def git(args: list[str], cwd: str, check: bool = True) -> str:
    done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
    if check and done.returncode:
        raise GitError(f"git {' '.join(args)}: {done.stderr.strip()}")
    return done.stdout if not done.returncode else ""


def has_revision(rev: str, cwd: str) -> bool:
    return bool(git(["rev-parse", "--verify", "--quiet", f"{rev}^{{commit}}"], cwd, check=False).strip())


def default_base(cwd: str) -> str:
    """The remote's head, else the first usual branch that exists, else HEAD."""
    head = git(["symbolic-ref", "--quiet", "--short", "refs/remotes/origin/HEAD"], cwd, check=False).strip()
    return next((b for b in (head, "main", "master", "develop") if b and has_revision(b, cwd)), "HEAD")


def diff_text(cwd: str, base: str | None = None, staged: bool = False, span: str | None = None) -> tuple[str, str]:
    """(diff, base revision): of a range (A...B, A..B, or one commit), against a base's merge base, or of the working tree."""
    how = ["diff", "-U3", "--find-renames", "--no-color"]
    if span:
        if "..." in span:
            left, right = span.split("...", 1)
            start = git(["merge-base", left or "HEAD", right or "HEAD"], cwd).strip()
        else:
            left, _, right = span.partition("..")
            start, right = (left or "HEAD", right or "HEAD") if ".." in span else (f"{span}^", span)
        return git([*how, start, right or "HEAD"], cwd), start
    if base:
        start = git(["merge-base", base, "HEAD"], cwd).strip()
        return git([*how, start], cwd), start
    return git([*how, "--cached"] if staged else [*how, "HEAD"], cwd), "HEAD"


def pull_request(cwd: str, number: int, program: str = "gh") -> tuple[str, str]:
    """(diff, base revision) of a pull request, by the forge's command line; the base is its commit, else its branch, else HEAD."""

    def told(*args: str) -> str | None:
        try:
            done = subprocess.run([program, "pr", *args], cwd=cwd, capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
        except FileNotFoundError:
            return None
        return done.stdout if not done.returncode else None

    diff = told("diff", str(number))
    if diff is None:
        raise GitError(f"pull request {number} can't be fetched by {program}")
    try:
        base = json.loads(told("view", str(number), "--json", "baseRefName,baseRefOid") or "{}")
    except json.JSONDecodeError:
        base = {}
    known = (r for r in (base.get("baseRefOid"), base.get("baseRefName")) if r and has_revision(r, cwd))
    return diff, next(known, "HEAD")


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = (), repo: str = "") -> DataFrame:
    """(repo, path, src) of the Python files below root, without excluded and dotted directories; bytes that
    aren't UTF-8 are replaced. Read by Spark, so any file system that it knows will do."""
    where = [f"{root.rstrip('/')}/{r}" for r in roots] or [root]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(where)
    bare = F.regexp_replace("path", r"^[A-Za-z0-9]+:/+", "/")
    rows = files.select(bare.alias("full"), F.expr("make_valid_utf8(cast(content as string))").alias("src"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    rows = rows.unionByName(_underscored(spark, where))
    start = re.sub(r"^[A-Za-z0-9]+:/+", "/", root.rstrip("/")) + "/"
    rows = rows.select(F.lit(repo).alias("repo"), F.expr(f"substring(full, {len(start) + 1})").alias("path"), "src", "mtime", "size")
    return rows.filter(~F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda x: x.isin(*exclude, "") | x.startswith(".")))


def _underscored(spark: SparkSession, where: list[str]) -> DataFrame:
    """Python files whose names start with an underscore: Spark's scans take those for hidden, but every
    package has one. They are listed and read by the same file system's client on the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for root in where:
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if name.startswith("_") and name.endswith(".py"):
                stream = fs.open(f.getPath())
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                stream.close()
                rows.append((f.getPath().toUri().getPath(), data.decode("utf-8", "replace"), datetime.fromtimestamp(f.getModificationTime() / 1000, tz=UTC), f.getLen()))
    return spark.createDataFrame(rows, "full string, src string, mtime timestamp, size bigint")


def files_at(spark: SparkSession, cwd: str, rev: str, paths: list[str], repo: str = "") -> DataFrame:
    """(repo, path, src) of some files at a revision; those that it doesn't have are left out."""
    asked = "".join(f"{rev}:{p}\n" for p in paths)  # one process for all of them
    done = subprocess.run(["git", "cat-file", "--batch"], cwd=cwd, input=asked.encode(), capture_output=True, check=False)
    rows, at = [], 0
    for p in paths:
        end = done.stdout.find(b"\n", at)
        head, at = done.stdout[at:end].split(b" "), end + 1
        if end < 0 or head[-1] == b"missing" or len(head) < 3:
            continue
        size = int(head[-1])
        rows.append((repo, p, done.stdout[at : at + size].decode("utf-8", "replace")))
        at += size + 1
    return spark.createDataFrame(rows, "repo string, path string, src string")


def history(spark: SparkSession, cwd: str, most: int = 400, repo: str = "") -> DataFrame:
    """(repo, commit, path) of the last commits."""
    blocks = git(["log", f"-n{most}", "--name-only", "--pretty=format:%x00"], cwd, check=False).split("\x00")
    return spark.createDataFrame([(repo, str(i), p) for i, b in enumerate(blocks) for p in b.split("\n") if p.strip()], "repo string, commit string, path string")


def untracked(cwd: str) -> list[str]:
    return [p for p in git(["ls-files", "--others", "--exclude-standard"], cwd, check=False).splitlines() if p.endswith(".py")]


def overlay(base: DataFrame, change: DataFrame) -> DataFrame:
    """A snapshot with a change (null src: deleted) put over it."""
    return base.join(change.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(change.filter("src is not null"))


def synthetic(spark: SparkSession, modules: int, callers: int) -> DataFrame:
    """(repo, path, src): a package of one module with a formula and `modules` others, of which `callers` use it."""
    table = F.lit("\n\nTABLE = {\n" + "".join(f"    {k}: {k * k},\n" for k in range(30)) + "}\n")
    user = F.concat(F.format_string("from orbit.formula import period\n\n\ndef planet_%d(mass):\n    return period(mass, %d)\n", "id", "id"), table)
    idle = F.concat(F.format_string("def moon_%d(mass):\n    return mass + %d\n", "id", "id"), table)
    rows = spark.range(modules).select(F.lit("").alias("repo"), F.format_string("orbit/body_%d.py", "id").alias("path"), F.when(F.col("id") < callers, user).otherwise(idle).alias("src"))
    fixed = spark.createDataFrame([("", "orbit/__init__.py", ""), ("", "orbit/formula.py", "def period(mass, axis):\n    return axis ** 1.5 / mass\n")], "repo string, path string, src string")
    return rows.unionByName(fixed)


def nearest_root(path: str) -> str:
    p = Path(path).resolve()
    return next((str(d) for d in (p, *p.parents) if (d / ".git").exists()), str(p if p.is_dir() else p.parent))
